"""Operators behind the audit queries, against brute force."""

import random
from itertools import combinations, permutations
from math import exp, log

from pyspark.sql import functions as F

from sieveline.operators import curation, similarity, statistics


def brute_episodes(rows):
    """All pairs of probes in order, as the definition has it."""
    erred = [r for r in rows if r[2]]
    controls = [r for r in rows if r[3]]
    used, out = set(), []
    for teach in erred:
        if teach[0] in used:
            continue
        found = None
        free = [r for r in erred if r[0] not in used and r[0] != teach[0]]
        for x, y in combinations(free, 2):
            control = next((r for r in controls if r[0] not in used and r[0] not in (teach[0], x[0], y[0])), None)
            if control is None or any(set(r[1]) & set(teach[1]) for r in (x, y, control)):
                continue
            found = (teach[0], x[0], y[0], control[0])
            break
        used |= set(found) if found else {teach[0]}
        if found:
            out.append(found)
    return out


def test_episodes():
    rng = random.Random(1)
    for _ in range(200):
        rows = []
        for i in range(rng.randrange(25)):
            kind = rng.randrange(3)
            rows.append((i, [rng.randrange(30) for _ in range(rng.randrange(4))], kind < 2, kind == 2))
        assert curation.build_episodes(rows) == brute_episodes(rows)


def test_shapley_parts_are_means_over_orders(spark):
    n = {("A", "A"): 30, ("A", "B"): 9, ("A", "cut"): 4, ("A", "none"): 1, ("B", "A"): 12, ("B", "B"): 25, ("B", "cut"): 2, ("B", "none"): 8}
    rows = spark.createDataFrame([(0, r, o, k) for (r, o), k in n.items()], "cell int, r string, o string, n int")
    got = {r.factor: r.part for r in statistics.shapley_factors(rows, ["cell"], {"cut": ["cut"], "none": ["none"]}).collect()}
    total = {s: sum(k for (r, _), k in n.items() if r == s) for s in "AB"}
    rate = {s: (n[s, "A"] + 0.5) / (n[s, "A"] + n[s, "B"] + 1) for s in "AB"}
    odds = {s: log(rate[s] / (1 - rate[s])) for s in "AB"}
    beta, delta = (odds["A"] + odds["B"]) / 2, (odds["A"] - odds["B"]) / 2

    def value(gone):
        share = {(s, f): n[s, f] / total[s] for s in "AB" for f in ("cut", "none")}
        if "bias" in gone:
            share = {(s, f): (share["A", f] + share["B", f]) / 2 for s, f in share}
        left = {s: 1 - sum(share[s, f] for f in ("cut", "none") if f not in gone) for s in "AB"}
        b = 0 if "bias" in gone else beta
        return 0.5 * (left["A"] / (1 + exp(-(b + delta))) + left["B"] / (1 + exp(-(delta - b))))

    orders = list(permutations(("bias", "cut", "none")))
    for f in got:
        gains = [value({*o[: o.index(f)], f}) - value(set(o[: o.index(f)])) for o in orders]
        assert abs(got[f] - sum(gains) / len(gains)) < 1e-12
    assert abs(sum(got.values()) - (value({"bias", "cut", "none"}) - value(set()))) < 1e-12


def test_similarity_classes_lose_no_link(spark):
    rng = random.Random(3)
    base = [sorted(rng.sample(range(60), 20)) for _ in range(6)]
    rows = []
    for i in range(80):
        s = list(rng.choice(base))
        if rng.random() < 0.5:
            s[rng.randrange(20)] = rng.randrange(60, 70)
        rows.append((i, s if i % 20 else []))
    links = {(r.a, r.b) for r in similarity.similarity_classes(spark.createDataFrame(rows, "id long, s array<long>"), "id", "s", 0.8).collect()}
    first = {}
    for i, s in rows:
        first.setdefault(frozenset(s), i)
    sets = {i: frozenset(s) for i, s in rows if s}
    want = {(first[s], i) for i, s in sets.items() if first[s] != i}
    want |= {(a, b) for a, b in combinations(sorted({first[s] for s in sets.values()}), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert links == want


def test_nearest_beyond_a_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [f"w{rng.randrange(15)}" for _ in range(8)]) for i in range(40)], "id long, w array<string>")
    bank = rows.select((F.col("id") + 100).alias("item"), F.reverse("w").alias("v")).where("id % 3 = 0")
    whole = sorted(map(tuple, curation.nearest(rows, "id", "w", bank, "item", "v", 4).collect()))
    monkeypatch.setattr(curation, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, curation.nearest(rows, "id", "w", bank, "item", "v", 4).collect())) == whole


def test_length_matching():
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.randrange(30), i, rng.random() < 0.4) for i in range(rng.randrange(30))]
        free = sorted((n, i) for n, i, target in rows if not target)
        want = []
        for n, i in sorted((n, i) for n, i, target in rows if target):
            if not free:
                break
            best = min(free, key=lambda c: (abs(c[0] - n), c))
            free.remove(best)
            want.append((i, best[1], abs(best[0] - n)))
        assert curation.match_lengths([(n, i) for n, i, t in rows if t], [(n, i) for n, i, t in rows if not t]) == want


def test_isotonic_out_of_fold(spark):
    from sieveline.operators import models

    rng = random.Random(2)
    rows = [(p, int(rng.random() < p), i % 3) for i, p in enumerate(round(rng.random(), 2) for _ in range(200))]
    got = models.isotonic(spark.createDataFrame(rows, "p double, y int, fold int"), "p", "y", "fold", 3).collect()
    assert len(got) == len(rows)
    for k in range(3):
        by = {}
        for p, y, f in rows:
            if f != k:
                by.setdefault(p, []).append(y)
        xs = sorted(by)
        mean = lambda a, b, xs=xs, by=by: sum(sum(by[x]) for x in xs[a : b + 1]) / sum(len(by[x]) for x in xs[a : b + 1])
        fit = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
        for r in got:
            if r.fold == k:
                i = sum(x <= r.p for x in xs) - 1
                inside = 0 <= i < len(xs) - 1
                want = fit[i] + (fit[i + 1] - fit[i]) * (r.p - xs[i]) / (xs[i + 1] - xs[i]) if inside else fit[max(i, 0)]
                assert abs(r.calibrated - want) < 1e-9


def test_shortlist_has_the_word_boundaries_and_cases_of_sql(spark, duck, tmp_path):
    from sieveline.plans import registry

    texts = ["1 lesè", "1 éel", "1 the", "1 thee", "1 leſ", "1 leſx", "1 _der", "1 el licenſe under", "1 el licenſed UNDER", "1 el abKſ!!", "1 el abK!!", "1 el AbCd!!", "el", None]
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = {r[0] for r in con.execute(registry.ORACLE["surface_shortlist"]).fetchall()}
    assert {r.doc_id for r in registry.QUERIES["surface_shortlist"](spark, str(tmp_path)).collect()} == want
    assert {0, 1, 2} <= want and not want & {3, 4, 12}
