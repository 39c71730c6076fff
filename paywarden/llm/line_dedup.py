"""Boilerplate lines by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds `ratio` and at
least `min_pages` of its pages do. Boilerplate lines are dropped from every page of that host.

    pages ── distinct line hashes per page ── count per (host, line) ── > ratio of the host's pages
          ── one short list of hashes per host ── filter each page's lines in place

A host has at most (distinct lines per page / ratio) boilerplate lines, so its list is short whatever the
host's size. Counts are combined before the shuffle; the key (host, line) spreads a hot host over all
tasks. The lists meet the pages in an ordinary join: broadcast below the session's threshold, otherwise a
shuffle whose hot hosts adaptive execution splits. Page texts aren't shuffled for the counts.

Lines end at "\\n" only and compare exactly. Blank lines are never boilerplate. A null host is a host of its own;
null text stays null and counts as a page; an empty text has one blank line. Repeated rows count as often
as they occur. Other columns pass through; columns named like an output are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import without

OUTPUTS = ["n_lines", "n_dropped"]


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(host, line_hash, pages, host_pages) of every boilerplate line."""
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("t"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("t", "\n"))).alias("line")).filter("trim(line) != ''")
    counts = lines.groupBy("host", line_hash(F.col("line")).alias("line_hash")).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    return (counts.join(totals, counts.host.eqNullSafe(totals.host))
            .filter(F.col("pages") > ratio * F.col("host_pages")).select(counts.host, "line_hash", "pages", "host_pages"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """`df` with boilerplate lines taken out of `text`, and n_lines (before), n_dropped."""
    found = boilerplate(df, host, text, ratio, min_pages)
    per_host = found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line_hash").alias("__drop"))
    kept = without(df, [*OUTPUTS, "__host", "__drop"])
    joined = kept.join(per_host, kept[host].eqNullSafe(F.col("__host")), "left")
    lines = F.split(F.col(text), "\n")
    stay = F.when(F.col("__drop").isNull(), lines).otherwise(
        F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col("__drop"), line_hash(line))))
    wide = joined.withColumn("__stay", stay)
    return wide.select(*[F.when(F.col(text).isNotNull(), F.array_join("__stay", "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in kept.columns],
                       F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
                       F.coalesce(F.size(lines) - F.size("__stay"), F.lit(0)).alias("n_dropped"))
