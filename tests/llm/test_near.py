import random
from collections import defaultdict

import numpy as np
import pytest

from paywarden.llm import decontaminate, order_minhash, substring
from paywarden.llm.queries import op4_repeats, op5_near_copies
from tests.conftest import SF
from tests.llm.conftest import TEXT, edge_rows

VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in rng.choices(VOCABULARY, k=n))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_alignment_equals_plain_lcs():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        b = [x for x in a if rng.random() > 0.15] if rng.random() < 0.7 else [rng.randrange(6) for _ in range(20)]
        if rng.random() < 0.3:
            b.insert(rng.randrange(len(b) + 1), 9)
        if not b:
            continue
        k = lcs(a, b)
        for threshold in (0.5, 0.8, 1.0):
            assert order_minhash.alignment(np.array(a, np.uint64), np.array(b, np.uint64), threshold) == (k / (len(a) + len(b) - k) >= threshold - 1e-12)


def plain_classes(rows, threshold=0.8):
    seq = [order_minhash.shingles(order_minhash.words(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(seq[i]) and len(seq[j]) and order_minhash.alignment(seq[j], seq[i], threshold):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_op5_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    want = plain_classes(rows)
    got = op5_near_copies(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_large_buckets_lose_no_class(spark):
    """Copies of one text, each edited by itself: any two are farther apart than each is from the original."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = [(500, " ".join(base))]
    for i in range(120):
        own = list(base)
        own[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    shared = prose(rng, 100)
    rows += [(1000 + i, f"{prose(rng, 40)} {shared} {prose(rng, 40)}") for i in range(60)]
    rows += [(2000 + i, prose(rng, 80)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert got == plain_classes(sorted(rows))
    assert len({got[i] for i in range(120)} | {got[500]}) == 1 and len({got[i] for i in range(1000, 1060)}) == 60


def edited(rng, words, edits, pool):
    own = list(words)
    for _ in range(edits):
        i = rng.randrange(len(own))
        kind = rng.random()
        if kind < 0.4:
            own[i] = rng.choice(pool)
        elif kind < 0.6:
            own.insert(i, rng.choice(pool))
        elif len(own) > 20:
            del own[i:i + rng.choice([1, 1, 9])]
    return own


def test_linked_texts_share_a_key_of_their_hub():
    """Unless both could be linked with the hub; keys and the condition on places leave few other pairs."""
    rng = random.Random(31)
    linked = others = met = 0
    for _ in range(40):
        base = rng.choices(VOCABULARY[:rng.choice([5, 3000])], k=rng.randrange(8, 130))
        pool = [f"p{i}" for i in range(rng.choice([3, 3000]))]
        hub = order_minhash.labelled(order_minhash.shingles(base))
        group = []
        for _ in range(25):
            source = base if rng.random() < 0.6 or not group else rng.choice(group)[0]
            own = edited(rng, source, rng.randrange(1, max(2, len(base) // 12)), pool)
            h = order_minhash.shingles(own)
            group.append((own, h, order_minhash.keys_of(hub, order_minhash.labelled(h), 0.8)))
        for i, (_, x, (dx, outside_x, far_x, keys_x)) in enumerate(group):
            for _, y, (dy, outside_y, far_y, keys_y) in group[:i]:
                if not (outside_x or outside_y) or min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
                    continue
                need = max(1, int(np.ceil((dx + dy - (len(x) + len(y)) / 9) / 2 - 1e-9)))
                at = {k: i for i, k in enumerate(keys_y.tolist())}
                meet = any(k in at and (far_x or far_y or (i <= dx - need and at[k] <= dy - need)) for i, k in enumerate(keys_x.tolist()))
                if order_minhash.alignment(x, y, 0.8):
                    linked += 1
                    assert meet
                else:
                    others, met = others + 1, met + meet
    assert linked > 50 and met < 0.2 * others


def test_linked_texts_share_a_lead_and_a_difference_of_it():
    """As their keys do; a changed word is one lead, and `key_groups` lists the differences that `keys_of` may list."""
    rng = random.Random(41)
    linked = leads = keys = 0
    for _ in range(40):
        base = rng.choices(VOCABULARY[:rng.choice([5, 3000])], k=rng.randrange(8, 130))
        of_hub = order_minhash.word_hashes(base)
        hub = order_minhash.labelled(order_minhash.runs(of_hub))
        places = np.arange(len(hub), dtype=np.uint64) // np.uint64(order_minhash.BLOCK)
        group = []
        for _ in range(25):
            source = base if rng.random() < 0.6 or not group else rng.choice(group)[0]
            own = edited(rng, source, rng.randrange(1, max(2, len(base) // 12)), [f"p{i}" for i in range(30)])
            h = order_minhash.shingles(own)
            found = order_minhash.key_groups(hub, order_minhash.labelled(h), 0.8, places, order_minhash.word_leads(order_minhash.word_hashes(own), of_hub))
            plain = order_minhash.keys_of(hub, order_minhash.labelled(h), 0.8)
            assert found[:3] == plain[:3] and len(found[3]) == len(plain[3])
            parts = {k: (at, set(part.tolist())) for k, at, part in zip(found[4].tolist(), found[5].tolist(), np.split(found[3], found[5][1:]))}
            group.append((own, h, found, parts))
            leads, keys = leads + len(found[4]), keys + len(plain[3])
        for i, (_, x, (dx, outside_x, far_x, *_), of_x) in enumerate(group):
            for _, y, (dy, outside_y, far_y, *_), of_y in group[:i]:
                if (outside_x or outside_y) and order_minhash.alignment(x, y, 0.8):
                    linked += 1
                    need = max(1, int(np.ceil((dx + dy - (len(x) + len(y)) / 9) / 2 - 1e-9)))
                    assert any(of_x[k][1] & of_y[k][1] and (far_x or far_y or (of_x[k][0] <= dx - need and of_y[k][0] <= dy - need)) for k in of_x.keys() & of_y.keys())
    assert linked > 50 and leads < 0.5 * keys


def test_a_changed_word_is_listed_once(spark, monkeypatch):
    """The rows that a hub's members are listed in grow with their edits, not with five shingles gained and lost by each."""
    rng = random.Random(43)
    base = rng.choices(VOCABULARY, k=120)
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        own = list(base)
        for at in rng.sample(range(5, 115), 4):
            own[at] = f"new{i}x{at}"
        rows.append((i, " ".join(own)))
    listed = []

    def counted(df, name):
        done = materialise(df, name)
        if name == "omh-differences":
            column = "leads" if "leads" in done.columns else "keys"
            listed.append(done.agg(order_minhash.F.sum(order_minhash.F.size(column))).first()[0] / done.count())
        return done

    materialise = order_minhash.materialise
    monkeypatch.setattr(order_minhash, "materialise", counted)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_classes(rows) and listed
    assert max(listed) < 4 * 4


@pytest.mark.parametrize("rounds", [2, 1, 0])
def test_variants_below_the_threshold_of_their_original(spark, monkeypatch, rounds):
    """A large group whose members are mostly not linked with the hub, some with each other, some only reordered."""
    monkeypatch.setattr(order_minhash, "ROUNDS", rounds)
    monkeypatch.setattr(order_minhash, "SMALL_KEY", 8)
    rng = random.Random(37)
    base = rng.choices(VOCABULARY, k=110)
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        rows.append((i, " ".join(edited(rng, base, rng.randrange(2, 7), VOCABULARY[:9]))))
    for i in range(70, 100):
        rows.append((i, " ".join(edited(rng, rows[rng.randrange(1, i)][1].split(), 2, VOCABULARY[:9]))))
    rows += [(100 + i, " ".join([*base[cut:], *base[:cut]])) for i, cut in enumerate(range(20, 95, 3))]
    rows += [(200 + i, " ".join(edited(rng, rows[100][1].split(), 1, VOCABULARY))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_classes(rows)
    assert {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()} == want
    assert len(set(want.values())) > 10


def test_short_linked_texts_share_a_bucket():
    rng = random.Random(17)
    linked = 0
    for _ in range(6000):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, order_minhash.SHORT + 1))]
        b = [x for x in a if rng.random() > 0.12]
        if rng.random() < 0.5:
            b.insert(rng.randrange(len(b) + 1), 9)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        for threshold in (0.7, 0.8, 1.0):
            if 0 < len(b) <= order_minhash.SHORT and order_minhash.alignment(x, y, threshold):
                linked += a != b
                assert np.intersect1d(order_minhash.buckets(x, threshold), order_minhash.buckets(y, threshold)).size
    assert linked > 500


def test_one_word_more_on_short_texts(spark):
    """Texts of 6 to 16 words with a word added at an end, alone and as one large group of variants."""
    rng = random.Random(23)
    rows = []
    for n in range(6, 17):
        own = rng.choices(VOCABULARY, k=n)
        rows += [(10 * n, " ".join(own)), (10 * n + 1, " ".join([*own, "more"])), (10 * n + 2, " ".join(["less", *own[1:], "other"]))]
    own = rng.choices(VOCABULARY, k=9)
    rows += [(1000 + i, " ".join([*own, f"end{i}"])) for i in range(40)] + [(1100, " ".join(own[1:]))]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_classes(sorted(rows))
    assert all(got[10 * n + 1] == 10 * n for n in range(8, 17))


def test_shared_buckets_count_over_all_sizes(spark, monkeypatch):
    """Pairs of one small and one large bucket, and short ones of one large bucket, are compared."""
    rng = random.Random(21)
    base, short = prose(rng, 60).split(), prose(rng, 14).split()
    near = [*base[:-1], "changed"]
    small = [*short, "more"]
    crowd = [" ".join(rng.choices(VOCABULARY, k=60)) for _ in range(20)]
    tiny = [" ".join(rng.choices(VOCABULARY, k=14)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([" ".join(base), " ".join(near), " ".join(short), " ".join(small), *crowd, *tiny])]
    filler = iter(range(10 ** 6))
    shared = {rows[0][1]: [1, 2], rows[1][1]: [1, 2], rows[2][1]: [3], rows[3][1]: [3]} | {t: [2] for t in crowd} | {t: [3] for t in tiny}
    of = {order_minhash.shingles(order_minhash.words(t)).tobytes(): own for t, own in shared.items()}

    def dealt(h, *_):
        own = of[h.tobytes()]
        return np.array([10 + s if s in own else 1000 + next(filler) for s in range(order_minhash.SLOTS)], np.uint64)

    member = [(t, s) for t, own in shared.items() for s in own]
    assert [sum(s == x for _, s in member) for x in (1, 2, 3)] == [2, 22, 22]
    real = order_minhash.sketches

    def picked(docs, ident, text, *rest):
        done = real(docs, ident, text, *rest).collect()
        text_of = dict(rows)
        out = [(r.doc_id, r.key, r.node, r.n, dealt(order_minhash.shingles(order_minhash.words(text_of[r.doc_id]))).view(np.int64).tolist()) for r in done]
        return spark.createDataFrame(out, "doc_id long, key struct<id: long, h: long>, node binary, n int, picks array<long>")

    monkeypatch.setattr(order_minhash, "sketches", picked)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows) and got[1] == 0 and got[3] == 2


def test_near_copies_edges(spark, edge, empty):
    got = order_minhash.drop_copies(edge)
    assert got.columns == edge.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in got.collect())
    # documents 2 and null repeat 1; rows that repeat id and text stay together; wordless texts stay
    assert [i for none, i, _ in ids if not none] == [1, 1, 3, 4, 6, 7, 8, 9] and sum(none for none, _, _ in ids) == 1
    assert order_minhash.classes(empty).count() == 0 and order_minhash.drop_copies(empty).count() == 0


def plain_repeats(rows):
    seen, gone, parts = {}, defaultdict(set), {}
    for i, text in rows:
        parts[i] = substring.sentences(text or "")
        assert "".join(p for p, _ in parts[i]) == (text or "")
        for k, least in substring.RUNS:
            for j in range(len(parts[i]) - k + 1):
                own = tuple(tuple(w) for _, w in parts[i][j:j + k])
                if sum(map(len, own)) >= least and seen.setdefault((k, own), (i, j)) != (i, j):
                    gone[i].update(range(j, j + k))
    return {i: "".join(p for n, (p, _) in enumerate(parts[i]) if n not in gone[i]) for i, _ in rows}, gone


def test_op4_equals_brute_force(spark):
    """Windows of a kind are compared in document order, as the first place is the smallest."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    want, gone = plain_repeats(rows)
    got = {r.doc_id: r for r in op4_repeats(spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) == sum(map(len, gone.values())) > 0


def test_passages_of_fifty_words_go(spark):
    rng = random.Random(9)
    passage = " ".join(" ".join(rng.choices(VOCABULARY, k=9)) + "." for _ in range(6))
    bare = " ".join(rng.choices(VOCABULARY, k=90))
    clean = prose(rng, 100)
    rows = [(1, f"{prose(rng, 50)}. {passage} {prose(rng, 30)}"), (2, f"{prose(rng, 20)}.\n{passage}\n{prose(rng, 30)}"), (3, f"{prose(rng, 20)}. {bare}. Done."),
            (4, f"{prose(rng, 30)}. {bare}. {prose(rng, 10)}"), (5, clean)]
    got = {r.doc_id: r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and passage not in got[2] and passage[60:300] not in got[2] and got[3] == rows[2][1] and got[5] == clean
    assert sum(w in got[4].split() for w in bare.split()) < 45


def test_repeats_edges(edge, empty):
    got = substring.remove_repeats(edge.withColumnRenamed("score", "N_REMOVED"))
    rows = got.collect()
    assert len(rows) == len(edge_rows()) and got.columns.count("n_removed") == 1
    assert {r.text for r in rows if r.doc_id == 1} == {""} and [r.text for r in rows if r.doc_id == 3] == [None]     # a null id comes first
    assert substring.remove_repeats(empty).count() == 0


def plain_matches(docs, items, threshold=0.8):
    import re
    from collections import Counter
    cut = lambda t: [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]
    gram = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    out = {}
    for i, t in docs:
        d = gram(cut(t))
        for j, u in items:
            own = gram(cut(u))
            best = 0.0
            for s in range(len(d)) if own else ():
                win = d[s:s + len(own)]
                k = sum((Counter(win) & Counter(own)).values())
                best = max(best, k / (len(win) + len(own) - k))
            if best >= threshold - 1e-9:
                out[i, j] = round(best, 9)
    return out


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 5, 20, 40, 60))] + [(9, None), (10, "")]
    other = lambda: prose(rng, 60)
    near = items[4][1].split()
    near[30] = "changed"
    docs = [(1, other()), (2, f"{other()} {items[2][1]} {other()}"), (3, items[3][1].upper()), (4, f"{other()} {' '.join(near)} {other()}"), (5, None), (6, ""),
            (7, f"{items[1][1]}, {items[4][1]}"), (8, " ".join(items[4][1].split()[:30])), (9, " ".join(items[4][1].split()[:56])), (8, other())]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == plain_matches(docs, items)


def test_decontamination_at_the_threshold(spark):
    """Items whose mirror has exactly the similarity 0.8, at every length; mirrors of one item in many documents."""
    rng = random.Random(5)
    items, docs = [], []
    for i in range(400):
        m = (9, 18, 27, 36, 45, 90)[i % 6]
        text = prose(rng, m + 4)
        words = text.split()
        for k in range(m // 9 // 5):                     # a word inside changes five shingles
            words[10 + 20 * k] = "changed"
        for k in range(m // 9 % 5):                      # of the first or last words, one each
            words[-1 - k] = "changed"
        items.append((i, text))
        docs += [(3 * i + j, " ".join(words)) for j in range(3)]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()}
    assert set(got.values()) == {0.8} and all(d // 3 == i for d, i in got)
    assert len(got) >= 0.995 * len(docs)


def test_block_index_is_complete():
    rng = random.Random(1)
    assert sum(w for _, w in decontaminate.CUTS) == 64 and len(decontaminate.CUTS) == decontaminate.RADIUS + 1
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        assert any((a >> at) % (1 << w) == (b >> at) % (1 << w) for at, w in decontaminate.CUTS)


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, TEXT), (2, None)], "item_id long, text string")
    got = decontaminate.drop_contaminated(edge, bench)
    assert got.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 3, 4, 6, 7, 8, 9]
    assert decontaminate.drop_contaminated(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(edge, bench.limit(0)).count() == len(edge_rows())


def test_simhash_plan_has_no_python(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert "Python" not in decontaminate.matches(docs, bench)._jdf.queryExecution().toString()
