import random
import re
from collections import Counter

import pytest

from paywarden.llm import phrases as ph
from paywarden.llm.queries import OP13_SQL, op13_phrases
from tests.conftest import SF


def plain(rows, least=10, share=50, top=2000):
    """The definition over (text, lang) rows."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        if any(100 * b >= share * a for (own, longer), b in found.items()
               if own == lang and len(longer) > len(words) and any(longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1))):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def both(spark, rows, trigger=ph.TRIGGER, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in ph.phrases(df, trigger=trigger, **options).collect())
    want = plain(rows, **options)
    assert got == want
    return got


def prose(seed, n, words=30, length=60):
    rng = random.Random(seed)
    own = [f"w{i}" for i in range(words)] + ["É", "ß", "THE", "of"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ", "?! "]
    return [("".join(rng.choice(own) + rng.choice(ends) for _ in range(rng.randint(0, length))), rng.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("trigger", [1, 2, 5, 16, 10**9])
def test_every_way_of_cutting_gives_the_counts_of_the_definition(spark, trigger):
    assert both(spark, prose(trigger, 150, 12), trigger, least=5)


def test_chunks_hold_every_gram_once(spark):
    rows = prose(9, 60)
    df = spark.createDataFrame(rows, "text string, lang string")

    def counted(trigger):
        dictionary = ph.chunks(df, trigger=trigger)
        return dictionary, {tuple(r) for n in (1, 2, 3) for r in ph.grams(dictionary, n, 1).collect()}

    whole = counted(10**9)[1]
    for trigger in (1, 3, 7):
        dictionary, found = counted(trigger)
        assert dictionary.filter("inner").count() > 0
        assert found == whole


@pytest.mark.parametrize("bits", [26, 7])
def test_frequent_parts_leave_out_rare_phrases_only(spark, bits):
    """Also with a bitmap that is nearly full."""
    dictionary = ph.chunks(spark.createDataFrame(prose(11, 80, 25), "text string, lang string"))
    parts = None
    for n in (1, 2, 3):
        all_ = {tuple(r) for r in ph.grams(dictionary, n, 6).collect()}
        found = ph.grams(dictionary, n, 6, parts)
        assert {tuple(r) for r in found.collect()} == all_
        if n < 3:
            parts = ph.marked(found, bits)
            counted = {tuple(r) for r in ph.grams(dictionary, n + 1, 1, parts).collect()}
            if bits == 26 and n == 2:
                assert len(counted) < ph.grams(dictionary, n + 1, 1).count()


def test_copies_share_the_dictionary(spark):
    text = " ".join(f"x{i}" for i in range(2000))
    one = ph.chunks(spark.createDataFrame([(text, "en")], "text string, lang string"))
    many = ph.chunks(spark.createDataFrame([(text, "en")] * 50, "text string, lang string").repartition(4))
    assert one.count() == many.count() > 5
    assert {r.weight for r in many.collect()} == {50}


def test_small_counters_and_batches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ph, "ENTRIES", 10)
    monkeypatch.setattr(ph, "GRAM_WORDS", 50)
    assert both(spark, prose(4, 120, 10), 3, least=5)


def test_longer_candidates_drop_the_shorter_ones(spark):
    rows = [("a b c", "en")] * 10 + [("a b", "en")] * 10 + [("b c", "en")] * 11
    got = both(spark, rows)
    assert [r[2] for r in got] == ["a b c", "b c"] or {r[2] for r in got} == {"a b c", "b c"}


def test_ties_and_the_limit(spark):
    rows = [(f"p{i} q{i}", "en") for i in range(30) for _ in range(10)]
    got = both(spark, rows, top=7)
    assert [r[2] for r in got] == sorted(f"p{i} q{i}" for i in range(30))[:7]


def test_scores_stay_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 10_000_000_033, 70_000_000_001
    row = spark.range(1).selectExpr(f"{a}L as a", f"{left}L as l", f"{right}L as r").select(ph.score(*[ph.F.col(c) for c in "alr"]).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_edge_rows(spark, edge, empty):
    rows = [(r.text, r.lang) for r in edge.collect()]
    got = sorted(tuple(r) for r in ph.phrases(edge.withColumn("phrase", ph.F.lit(1)).withColumn("weight", ph.F.lit(2))).collect())
    assert got == plain(rows) and got
    assert ph.phrases(empty).count() == 0
    assert ph.phrases(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_query_equals_sql_and_the_definition(spark):
    import duckdb
    got = sorted(tuple(r) for r in op13_phrases(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.execute(OP13_SQL).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == plain([(d.text, d.lang) for d in docs])
