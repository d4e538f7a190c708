"""The n-gram join, ranked search and weighted clusters against brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import DOCS, brute_components, edge_rows, words

from sieveline.llm import clusters, gram_join, near_dup, search


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).cache()


def joined(df, **kind):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in gram_join.gram_join(df, **kind).collect())


@pytest.mark.parametrize("k, percent", [(2, 80), (5, 80), (5, 60)])
def test_join(docs, k, percent):
    assert joined(docs, k=k, percent=percent) == brute_components([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_join_without_rows(spark):
    assert joined(spark.createDataFrame([], DOCS)) == Counter()
    rows = [(None, "a b"), (None, None), (1, None)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows, 5, 80)


def test_join_of_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(gram_join, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(250):  # copies with a few words changed: linked to some, not to others
        w = list(base)
        for _ in range(rng.choice([0, 2, 5, 9, 14])):
            w[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), k=2) == brute_components(rows, 2, 80)


def test_join_of_long_sets_in_classes(spark, monkeypatch):
    """Sets on both sides of the tiers' bounds, similar to about the threshold."""
    monkeypatch.setattr(gram_join, "PART", 16)
    rng = random.Random(6)
    rows = []
    for size in (14, 31, 33, 60, 66, 130, 260):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for cut in range(0, size // 3, max(1, size // 24)):
            rows.append((len(rows), " ".join(base[: size - cut])))
            swapped = list(base)
            for at in rng.sample(range(size), cut // 2):
                swapped[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(swapped)))
    for k in (1, 5):
        assert joined(spark.createDataFrame(rows, "doc_id long, text string"), k=k) == brute_components(rows, k, 80)


def test_every_order_passes_similar_sets():
    """The filters themselves: similar sets share a prefix token in some class under each order, and sizes fit."""
    rng = np.random.default_rng(7)
    levels = np.full(1 << gram_join.BITS, 3, np.uint8)
    for n in (5, 100, 511, 512, 640, 3000):
        for _ in range(20):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            gone = rng.integers(0, n // 9 + 1)
            y = np.append(x[gone:], rng.integers(0, 2**63, rng.integers(0, n // 10 + 1)).astype(np.uint64))
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            a = {p[0]: p for p in gram_join.prefixes(x, levels, 80)}
            b = {p[0]: p for p in gram_join.prefixes(y, levels, 80)}
            parts = min(gram_join.tier(len(x)), gram_join.tier(len(y)))
            assert any(
                a[c][1] == parts and all(len(np.intersect1d(a[c][o], b[c][o])) for o in (3, 4, 5)) and 100 * min(a[c][2], b[c][2]) >= 80 * max(a[c][2], b[c][2])
                for c in set(a) & set(b)
            )


def test_filters_drop_pairs_that_one_order_lets_through():
    rng = np.random.default_rng(8)
    levels = np.full(1 << gram_join.BITS, 3, np.uint8)
    shared = rng.integers(0, 2**63, 8).astype(np.uint64)
    passed = Counter()
    for _ in range(200):
        a, b = (gram_join.prefixes(np.unique(np.append(shared, rng.integers(0, 2**63, 92).astype(np.uint64))), levels, 80)[0] for _ in range(2))
        found = [len(np.intersect1d(a[o], b[o])) > 0 for o in (3, 4, 5)]
        passed.update(one=found[0], all=all(found))
    assert passed["one"] > 3 * passed["all"]


def test_sketches_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(9)
    for n in (1, 40, 500, 3000):
        for gone, more in ((0, 0), (1, 0), (n // 9, n // 10), (n, n)):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            y = np.append(x[gone:], rng.integers(0, 2**63, more).astype(np.uint64))
            apart = np.bitwise_count((gram_join.sketch(x) ^ gram_join.sketch(y)).view(np.uint64)).sum()
            assert apart <= gone + more and (apart + gone + more) % 2 == 0


def test_join_compares_no_texts_of_pairs_that_sketches_tell_apart(spark, monkeypatch):
    """Each passage is in two documents, so all prefixes meet, but one pair alone is similar."""
    made, stored = {}, gram_join.stored

    def counted(df, what, path=None):
        out = stored(df, what, path)
        made[what] = out.count()
        return out

    monkeypatch.setattr(gram_join, "stored", counted)
    rng = random.Random(10)
    passage = {(i, j): " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for i in range(6) for j in range(6)}
    texts = [" ".join(passage[i, j] for j in range(6)) for i in range(6)] + [" ".join(passage[i, j] for i in range(6)) for j in range(6)]
    rows = list(enumerate([*texts, "and " + texts[3] + " then"]))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows, 5, 80)
    assert made["groups"] > 60
    assert (made["star"], made["texts"], made["links"], made["packs"]) == (1, 2, 1, 0)


@pytest.mark.parametrize("join", [gram_join.gram_join, near_dup.near_duplicates])
def test_all_texts_of_a_document_are_compared(spark, join):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    rows = [(1, t) for t in texts] + [(2 + i, t + " end") for i, t in enumerate(texts)] + [(9, "and " + texts[2] + " then")]
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), k=2).collect())
    assert found == brute_components(rows, 2, 80) and {c for _, _, c in found} == {1}


# search


def brute_search(docs, items, top):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, Counter(term(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, []).extend(term(t))
    rows = []
    for item, q in asked.items():
        scored = []
        for i, c in texts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in q if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        rows += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return Counter(rows)


@pytest.mark.parametrize("block, triples", [(200_000, 2_000_000), (40, 7)])
def test_search(docs, spark, monkeypatch, block, triples):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "TRIPLES", triples)
    monkeypatch.setattr(search, "RANGE_ROWS", 10)
    items = [(i, words(30, i)) for i in range(12)] + [(3, "w1 W1 w2"), (12, None), (13, ""), (14, "nowhere"), (None, "w1"), (15, "W5 w5 w5 É \U0001f600"), (16, "same FIVE")]
    bank = spark.createDataFrame([(*r, "t") for r in items], "item_id long, text string, term string")
    for top in (3, 20):
        got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked_search(docs, bank, top).collect())
        assert got == brute_search([(r.doc_id, r.text) for r in docs.collect()], items, top)
    named = bank.selectExpr("concat('i', item_id) as item_id", "text")
    assert {r.item_id for r in search.ranked_search(docs, named, 1).collect()} == {f"i{i}" for i in (*range(12), 15, 16)}


def test_search_without_rows(docs, spark):
    bank = spark.createDataFrame([(1, "w1")], "item_id int, text string")
    for found in (search.ranked_search(docs.limit(0), bank), search.ranked_search(docs, bank.limit(0)), search.ranked_search(docs.where("text is null"), bank)):
        assert found.count() == 0 and found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_terms_are_the_pattern_s_matches():
    text = "".join(map(chr, range(128))) + " É\u0130x\U0001f600-ABC1_d"
    want = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for t in search.terms_of(text)] == want


def test_radix_order_and_sums():
    rng = np.random.default_rng(3)
    item, doc, impact = rng.integers(0, 300, 5000), rng.integers(0, 70_000, 5000) % 97 * 700, rng.integers(0, 10**12, 5000)
    keys = (item << 17) | doc
    assert (keys[search.radix_order(keys, 26)] == np.sort(keys)).all()
    want = Counter()
    for i, d, s in zip(item.tolist(), doc.tolist(), impact.tolist()):
        want[i, d] += s
    assert dict(zip(zip(*(x.tolist() for x in search.accumulate(item, doc, impact)[:2])), search.accumulate(item, doc, impact)[2].tolist())) == want


# clusters


def brute_clusters(rows, dim, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    centers = [list(v) for _, _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centers)), key=lambda c: (far(v, centers[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for c in set(at):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            centers[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    dist = [far(v, centers[a]) for (_, v), a in zip(kept, at)]
    total = Counter()
    for a, d in zip(at, dist):
        total[a] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, a, d, total[a], sum(dist), sha[a]) for (i, _), a, d in zip(kept, at, dist))


def vectors(n, dim, seed):
    rng = random.Random(seed)
    some = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n // 3)]
    rows = [(i, some[min(rng.randrange(len(some)), rng.randrange(len(some)))]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0] * (dim - 1)), (n + 2, [None] + [1.0] * (dim - 1)), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] + [0.0] * (dim - 1)), (None, some[0]), (None, [0.5] * dim), (3, some[1]), (3, [-0.25] * dim), (5, some[0])]
    return rows


@pytest.mark.parametrize("n, k, rounds", [(200, 8, 10), (12, 8, 3), (60, 3, 0)])
def test_clusters(spark, n, k, rounds):
    rows = vectors(n, 4, n)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = clusters.weighted_clusters(df, dim=4, k=k, rounds=rounds).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows, 4, k, rounds)


def test_clusters_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert clusters.weighted_clusters(spark.createDataFrame([], kind), dim=2).count() == 0
    assert clusters.weighted_clusters(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0])], kind), dim=2).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])]
    assert Counter(map(tuple, clusters.weighted_clusters(spark.createDataFrame(rows, kind), dim=2).collect())) == brute_clusters(rows, 2, 8, 10)
    assert clusters.weighted_clusters(spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<float>"), dim=2).first().vec_id == "a"


def test_far_components_saturate(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0]), (4, [1e300, 1.0])]
    got = clusters.weighted_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=2, k=2).collect()
    assert len(got) == 4 and all(r.distance >= 0 for r in got)


def test_weights_beyond_32_bits_sum_exactly():
    q = np.array([[clusters.LARGEST, -clusters.LARGEST], [3, -7]], "<i4")
    import pyarrow as pa

    w = [(1 << 42) + 12345, (1 << 21) + 1]
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in q]), pa.array(w)], ["q", "w"])
    out = next(clusters._sums(np.array([[0, 0]]))([batch]))
    assert out.column("total").to_pylist() == [sum(w), *(sum(w[i] * int(q[i][j]) for i in range(2)) for j in range(2))]
