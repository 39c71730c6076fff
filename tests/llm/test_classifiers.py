import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from paywarden.llm import langid, toxicity
from paywarden.llm.queries import op6_toxicity, op7_language
from tests.llm.conftest import edge_rows

MID = "/root/testdata/sf0.01"


def test_grams_of_texts():
    key, sizes = langid.grams(["Ab c!", "", None, "12", "é"])
    text = lambda k: "".join(chr(int(k) >> 16 * i & 0xFFFF) for i in range(3, -1, -1)).replace("\0", "_")
    assert [text(k) for k in key] == ["___a", "__ab", "_ab_", "ab_c", "b_c_", "___é", "__é_"] and sizes.tolist() == [5, 0, 0, 0, 2]


def signed(key):
    return key - (1 << 64) if key >= 1 << 63 else key


def test_model_is_a_distribution_and_equals_plain_kneser_ney(spark):
    rng = random.Random(2)
    counts = Counter(tuple(rng.choice("abc_") for _ in range(4)) for _ in range(150))
    code = lambda g: sum((0 if c == "_" else ord(c)) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    rows = [(lang, signed(code(g)), n) for lang in ("x", "y") for g, n in counts.items() if lang == "x" or n > 1]
    model = langid.write_model(spark.createDataFrame(rows, "lang string, gram long, n long")).load().models[0]
    levels = {4: dict(counts)}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def plain(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        level = levels[len(g)]
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        own = [v for k, v in level.items() if k[:-1] == g[:-1]]
        if not own:
            return plain(g[1:])
        return max(level.get(g, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * plain(g[1:])

    for _ in range(100):
        g = tuple(rng.choice("abcd_") for _ in range(4))
        assert math.isclose(float(model.probability(np.array([code(g)], np.uint64))[0]), plain(g), rel_tol=1e-9)
    total = sum(float(model.probability(np.array([code(("a", "b", "c", x))], np.uint64))[0]) for x in "abc_")
    assert 0.5 < total <= 1 + 1e-9


def test_memo_changes_nothing(spark):
    rows = [("x", int(k) * 77777777777, int(k)) for k in range(1, 500)]
    own = langid.write_model(spark.createDataFrame(rows, "lang string, gram long, n long")).load()
    rng = np.random.default_rng(1)
    key = rng.choice(np.arange(1, 800, dtype=np.uint64) * np.uint64(77777777777), 5000)
    langid.MEMO, before = 4, langid.MEMO
    try:
        assert np.allclose(own.gram_bits(key), own.bits(key)) and np.allclose(own.gram_bits(key), own.bits(key))
    finally:
        langid.MEMO = before


def test_op7_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = op7_language(spark, MID).collect()
    assert {r.doc_id for r in rows} == set(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in rows)


def test_op7_equals_plain_models(spark):
    """Winner and cross-entropy of every document, from counts in plain dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    levels = {}
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            levels.setdefault(r.lang, {4: Counter()})[4].update(langid.grams([r.text])[0].tolist())
    totals, discounts = {}, {}
    for lang, own in levels.items():
        for n in (3, 2, 1):
            own[n] = Counter(g & (1 << 16 * n) - 1 for g in own[n + 1])
        for n, table in own.items():
            ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
            discounts[lang, n] = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
            for g, v in table.items():
                total, kinds = totals.get((lang, n, g >> 16), (0, 0))
                totals[lang, n, g >> 16] = total + v, kinds + 1

    def bits(lang, key):
        p = 1 / (len(levels[lang][1]) + 1)
        for n in (1, 2, 3, 4):
            g = key & (1 << 16 * n) - 1
            total, kinds = totals.get((lang, n, g >> 16), (0, 0))
            if total:
                d = discounts[lang, n]
                p = max(levels[lang][n].get(g, 0) - d, 0) / total + d * kinds / total * p
        return -math.log2(p)

    texts = {r.doc_id: r.text for r in docs}
    memo = {}
    for r in op7_language(spark, "/root/testdata/sf0.001").collect():
        keys = langid.grams([texts[r.doc_id]])[0].tolist()
        if not keys:
            assert r.lang_pred == "und" and r.score == 0
            continue
        for k in keys:
            if k not in memo:
                memo[k] = [bits(lang, k) for lang in sorted(levels)]
        mean = [sum(col) / len(keys) for col in zip(*map(memo.get, keys))]
        assert r.lang_pred == sorted(levels)[mean.index(min(mean))] and math.isclose(r.cross_entropy, min(mean), rel_tol=1e-4)


def test_a_small_language_beside_large_ones(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("text", "lang")
    rng = random.Random(8)
    words = ["kaixo", "etxea", "gizona", "mendia", "txakurra", "zuhaitza", "ikastola", "arratsalde", "egun", "ura", "haurrak", "liburua", "eskerrik", "asko"]
    few = [(" ".join(rng.choices(words, k=12)), "eu") for _ in range(50)]
    model = langid.fit(docs.union(docs).union(docs).union(spark.createDataFrame(few[:30], "text string, lang string")))
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(few[30:], "text string, lang string"), model).collect()} == {"eu"}


def test_language_edges(spark, edge, empty):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = langid.fit(docs)
    foreign = spark.createDataFrame([("全く違う言語の文章です " * 20, "x"), ("Это совсем другой язык " * 20, "x")], "text string, SCORE string")
    found = langid.identify(foreign, model)
    assert all(r.rejected for r in found.collect()) and "SCORE" not in found.columns
    rows = langid.identify(edge, model).collect()
    assert len(rows) == len(edge_rows())
    assert all(r.lang_pred == "und" and r.rejected for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(edge, nothing).collect()} == {"und"}


def plain_kernel(s, t):
    from itertools import combinations

    def weights(x):
        out, norm = Counter(), 0.0
        for at in combinations(range(len(x)), toxicity.P):
            span = at[-1] - at[0] + 1
            if span <= toxicity.SPAN:
                out["".join(x[i] for i in at)] += toxicity.DECAY ** span
                norm += toxicity.DECAY ** (2 * span)
        return out, math.sqrt(max(norm, 1e-12))

    (a, na), (b, nb) = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items()) / na / nb


def test_kernel_equals_plain_subsequence_kernel():
    some = ["^idiot$", "^idxiot$", "^abc$", "^a$", "^hahahaha$", "^straße$", "^toxicity$"]
    found = toxicity.kernel(some, some)
    for i, s in enumerate(some):
        for j, t in enumerate(some):
            assert math.isclose(found[i, j], plain_kernel(s, t), rel_tol=1e-9, abs_tol=1e-12)


@pytest.fixture(scope="module")
def scorer():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(2, 10))) for _ in range(2000)]
    insults = ["blockhead", "scoundrel", "numbskull"]
    unit = lambda t: {u for w in set(toxicity.words(t)) for u in toxicity.units(w)}
    clean = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(300)]
    toxic = [" ".join([*rng.choices(vocabulary, k=30), *rng.sample(insults, 2)]) for _ in range(150)]
    return toxicity.train([unit(t) for t in toxic], [unit(t) for t in clean], landmarks=64), vocabulary, rng


def test_insults_plain_gapped_and_inserted(scorer):
    own, vocabulary, rng = scorer
    base = " ".join(rng.choices(vocabulary, k=20))
    low, *high = own.predict([base, *[f"{base} {w} {base}" for w in ("blockhead", "BLOCKHEAD!", "block-head", "b.l.o.c.k.h.e.a.d", "b l o c k h e a d", "blockxhead", "scoundrel")]])
    assert low < 0.1 and min(high) > 0.5 and min(high[:5]) >= 0.7
    assert max(own.predict(["", None, "123 !!"])) <= low + 0.5 and len(own.raw(["x" * 200_000])) == 1


def labelled(rng, n_toxic, n_clean):
    """Texts with two of three insults and texts without."""
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(2, 10))) for _ in range(2000)]
    insults = ["blockhead", "scoundrel", "numbskull"]
    toxic = [" ".join([*rng.choices(vocabulary, k=30), *rng.sample(insults, 2)]) for _ in range(n_toxic)]
    return toxic, [" ".join(rng.choices(vocabulary, k=40)) for _ in range(n_clean)]


def auc(own, toxic, clean):
    good, bad = own.predict(clean), own.predict(toxic)
    return np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])


def test_flipped_labels_cost_little():
    unit = lambda t: {u for w in set(toxicity.words(t)) for u in toxicity.units(w)}
    toxic, clean = labelled(random.Random(4), 300, 300)
    found = []
    for flip in (0, 10):                                    # of 200 of each kind
        own = toxicity.train([unit(t) for t in toxic[flip:200] + clean[:flip]], [unit(t) for t in clean[flip:200] + toxic[:flip]], landmarks=64)
        found.append(auc(own, toxic[200:], clean[200:]))
    assert found[0] > 0.98 and found[1] > found[0] - 0.02
    toxic, clean = labelled(random.Random(5), 150, 300)
    clean[7] += " blockhead scoundrel numbskull"            # one clean text quotes every insult
    own = toxicity.train([unit(t) for t in toxic], [unit(t) for t in clean], landmarks=64)
    assert auc(own, toxic, clean[8:]) > 0.98 and np.mean(np.array(own.predict(toxic)) >= 0.7) > 0.95


def test_collapsed_scores_equal_kernel_expansion(scorer):
    own, vocabulary, _ = scorer
    words = [f"^{w}$" for w in [*vocabulary[:50], "blockhead"]]
    r, k, v = toxicity.features(toxicity.matrix(words))
    weight = dict(zip(own.keys.tolist(), own.values.tolist()))
    plain = np.bincount(r, [weight.get(int(x), 0.0) * y for x, y in zip(k, v)], len(words)) + own.constant
    assert np.allclose(own.score_units(words), plain)


def test_op6_on_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect() if r.toxic is not None}
    rows = op6_toxicity(spark, MID).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.84       # some 30 toxic texts in four languages to learn from


def test_toxicity_edges(spark, edge, empty):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    found = toxicity.fit(docs, labels.union(labels), docs_per_class=100)
    rows = toxicity.score(edge.withColumnRenamed("node", "PREDICTED"), found).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, found).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None and toxicity.fit(empty, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(edge, None).collect()} == {0.0}
