import pytest

import __spark_entry__ as entry
from checks.compare import compare
from tests.conftest import SF

QUICK = ["f4_profile_snapshot", "f5_entity_snapshot", "f8_late_rows", "p1_temporal_split", "p7_build_sequences", "p8_time_order_check",
         "v3_balances", "v5_identifier_lengths", "i7_parse_time", "i10_unified_checks", "i11_canonical_id", "k5_case_workflow", "k7_drop_repeats",
         "k8_hash_chain", "k9_verify_chain", "k10_changed_entries", "q13_dataset_profile", "r8_registry"]


def test_every_text_belongs_to_a_query():
    queries, texts = entry.queries(), entry.oracle_sql()
    assert set(texts) <= set(queries) and len(queries) > 130


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_duckdb(spark, name):
    assert compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok")


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.volume == row.approved + row.verified + row.blocked > 0
