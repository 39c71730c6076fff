from collections import Counter, defaultdict

import __spark_entry__ as entry
import pytest
from checks.compare import compare
from paywarden.llm.line_dedup import drop_boilerplate
from tests.conftest import SF
from tests.llm.conftest import edge_rows


@pytest.mark.parametrize("name", ["op2_line_dedup", "op8_decontaminate", "op10_warc"])
def test_query_equals_duckdb(spark, name):
    assert compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok")


def replay(rows, ratio, least):
    pages, lines = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        pages[host] += 1
        lines[host].update({x for x in (text or "").split("\n") if x.strip(" ")})
    bad = {h: {x for x, n in c.items() if n >= least and n > ratio * pages[h]} for h, c in lines.items()}
    return [(i, h, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad.get(h, ()))) for i, h, t in rows]


def test_boilerplate_by_host(spark):
    rows = [(i, ["a", "b", None][i % 3], f"menu\nunique {i}\n\nfooter" + ("\nrare" if i == 3 else "")) for i in range(60)] + [(99, "c", "menu\nfooter"), (100, "a", None), (101, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = drop_boilerplate(docs, ratio=0.5, min_pages=5)
    assert sorted((r.doc_id, r.source, r.text) for r in got.collect()) == sorted(replay(rows, 0.5, 5))
    one = {r.doc_id: r for r in got.collect()}
    assert (one[3].n_lines, one[3].n_dropped, one[99].n_dropped, one[100].n_lines) == (5, 2, 0, 0)


def test_edge_rows(edge, empty):
    got = drop_boilerplate(edge.withColumnRenamed("n_tokens", "N_LINES"), min_pages=2, ratio=0.1)
    assert got.count() == len(edge_rows()) and got.columns.count("n_lines") == 1
    assert drop_boilerplate(empty).count() == 0
