"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm import bpe, decontaminate, langid, line_dedup, order_minhash
from paywarden.llm.common import read
from paywarden.llm.queries import tokenizer_path
from paywarden.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing `lang` becomes the prediction."""
    model = langid.fit(docs.filter(~langid.held_out("doc_id", 5, 0)))
    known = langid.identify(docs.select(*COLUMNS), model).filter("not rejected")
    return known.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of each source; no document goes."""
    return line_dedup.drop_boilerplate(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return order_minhash.drop_copies(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of `benchmark`."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the ids and of the text they decode to."""
    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return done.select("doc_id", "lang", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
                       F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: A language model, hash sketches and merges have no SQL form; the tests replay the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
