"""Lineage gates, shared keys, lists of ids and stopped scans against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import curation, lineage, statistics
from sieveline.session import shared_folder
from sieveline.sources import lookup, shards
from sieveline.streaming import logs


def brute_state(nodes, i):
    """Walks up one link at a time."""
    seen, hops, bad, at = set(), 0, None, i
    while True:
        if at in seen:
            return ("cycle", None, None)
        seen.add(at)
        parent, ok = nodes[at]
        bad = at if bad is None and not ok else bad
        if parent is None:
            return ("holds", hops, None) if bad is None else ("broken", hops, bad)
        if parent not in nodes:
            return ("missing", hops, None)
        at, hops = parent, hops + 1


def test_held_claims(spark):
    rng = random.Random(3)
    rows = [(i, i - 1 if i else None, rng.random() < 0.98) for i in range(90)]  # one long chain
    rows += [(i, rng.choice([None, 0, 88, *range(90, i), 5000 + i]), rng.random() < 0.9) for i in range(100, 200) if i > 91]
    rows += [(300, 300, True), (301, 302, True), (302, 303, False), (303, 301, True), (304, 301, True), (305, 304, None)]
    nodes = {i: (p, bool(ok)) for i, p, ok in rows}
    df = spark.createDataFrame([*rows, (None, 1, True), rows[5]], "id long, parent long, ok boolean").withColumn("state", F.lit("x")).withColumn("hops", F.lit(9))
    got = {r.id: (r.state, r.hops, r.first_broken) for r in lineage.held_claims(df, "id", "parent", F.col("ok")).collect()}
    assert got == {i: brute_state(nodes, i) for i in nodes}
    assert {s for s, _, _ in got.values()} == {"holds", "broken", "missing", "cycle"}
    assert lineage.held_claims(df.limit(0), "id", "parent", F.col("ok")).count() == 0


def test_repeated_ids_hold_together(spark):
    df = spark.createDataFrame([(1, None, True), (1, None, False), (2, 1, True)], "id long, parent long, ok boolean")
    got = {r.id: (r.state, r.first_broken) for r in lineage.held_claims(df, "id", "parent", F.col("ok")).collect()}
    assert got == {1: ("broken", 1), 2: ("broken", 1)}


def test_gate(spark):
    df = spark.createDataFrame([("a", "holds"), ("a", "holds"), ("b", "holds"), ("b", "cycle")], "g string, state string")
    assert {r.g: (r.n, r.held, r.passes) for r in lineage.gate(df, "g").collect()} == {"a": (2, 2, True), "b": (2, 1, False)}


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_shared_keys(spark, keys):
    rng = random.Random(5)
    rows = [(i, *[rng.choice([None, *"pqrstuvw"[: 3 + 2 * j]]) for j in range(3)]) for i in range(60)] + [(100, None, None, None), (101, "only", None, "one")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string").withColumn("matches", F.lit(1))
    want = {}
    for r in rows:
        others = [o for o in rows if o[0] != r[0] and any(r[1 + j] is not None and r[1 + j] == o[1 + j] for j in range(len(keys)))]
        kinds = sorted({keys[j] for o in others for j in range(len(keys)) if r[1 + j] is not None and r[1 + j] == o[1 + j]})
        if others:
            want[r[0]] = (len(others), ",".join(kinds))
    assert {r.id: (r.matches, r.kinds) for r in curation.shared_keys(df, "id", keys).collect()} == want


def test_lookup_reads_only_its_folders(spark):
    folder = shared_folder(spark, "lookup")
    rows = [(i, f"text {i}") for i in range(2000)] + [(7, "a second row"), (None, "no key")]
    lookup.store(spark.createDataFrame(rows, "id long, text string").withColumn("extra", F.lit(1)), "id", folder, 100)
    lists = spark.createDataFrame([(1, [7, 1500, 9999, 7]), (2, []), (3, None), (4, [None, 12])], "owner long, ids array<long>")
    ids = lists.select(F.explode("ids").alias("id"))
    n, some = lookup.buckets_of(spark, folder, ids, "id")
    assert n == 21 and len(some) <= 4
    # all other folders are spoilt: a lookup that read them would fail
    from pathlib import Path
    root = Path(folder.removeprefix("file://"))
    spoilt = [p for p in root.glob(f"rows/{lookup.BUCKET}=*/*.parquet") if int(p.parent.name.split("=")[1]) not in some]
    assert len({p.parent for p in spoilt}) >= 17
    for p in spoilt:
        p.write_bytes(b"spoilt")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    found = lookup.fetch(spark, folder, ids, "id", ["text"])
    got = {r.owner: (r.n_asked, r.n_missing, r.missing, r.patch) for r in lookup.in_list_order(lists, "owner", "ids", found, "id", "text").collect()}
    assert got == {1: (4, 1, "9999", "a second row\ntext 1500\na second row"), 2: (0, 0, "", ""), 3: (0, 0, "", ""), 4: (2, 1, "", "text 12")}


def test_scan_stops_and_goes_on(spark):
    folder = shared_folder(spark, "scan")
    spark.range(100).repartition(10).write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    where = (f"{folder}/rows", f"{folder}/state")
    first = logs.scan_until(stream(), {"n": F.count("*")}, lambda c: c["n"] >= 25, *where)
    assert [c["n"] for c in first][-2] < 25 <= first[-1]["n"] < 100
    assert logs.scan_until(stream(), {"n": F.count("*")}, lambda c: c["n"] >= 25, *where) == first  # holds already
    rest = logs.scan_until(stream(), {"n": F.count("*")}, lambda c: False, *where)
    assert len(rest) == 10 and rest[: len(first)] == first
    assert sorted(r.id for r in spark.read.parquet(where[0]).collect()) == list(range(100))


def test_other_failures_are_raised(spark):
    folder = shared_folder(spark, "scan")
    spark.range(10).repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def rule(_):
        raise ValueError("a fault of the rule")

    with pytest.raises(Exception, match="a fault of the rule"):
        logs.scan_until(stream, {"n": F.count("*")}, rule, f"{folder}/rows", f"{folder}/state")


def test_shards_merge_only_as_planned(spark):
    folder = shared_folder(spark, "shards")
    df = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(100) if i not in range(40, 60)] + [(None, "a", 7)], "at long, g string, v long")
    plan = shards.plan_of(df, "at", 5)
    ranges = {r.shard: (r.lo, r.hi, r.n) for r in plan.collect()}
    assert ranges == {0: (0, 20, 20), 1: (20, 40, 20), 3: (60, 80, 20), 4: (80, 100, 20)}

    def put(shard, lo, hi, where):
        rows = df.where((F.col("at") >= lo) & (F.col("at") < hi))
        shards.write_shard(rows, shard, lo, hi, ["g"], {"v": F.sum("v")}, where)

    for k, (lo, hi, _) in ranges.items():
        if k == 4:
            with pytest.raises(ValueError, match="4 missing"):
                shards.merge(spark, folder, plan, ["g"], ["v"])
        put(k, lo, hi, folder)
    got = {r.g: (r.n, r.v) for r in shards.merge(spark, folder, plan, ["g"], ["v"]).collect()}
    want = {g: [i for i in range(100) if "ab"[i % 2] == g and i not in range(40, 60)] for g in "ab"}
    assert got == {g: (len(v), sum(v)) for g, v in want.items()}
    with pytest.raises(Exception, match="already exists"):
        put(0, 0, 20, folder)
    other = shared_folder(spark, "shards")
    put(0, 0, 20, other)
    put(1, 15, 40, other)  # overlaps the first
    put(7, 90, 95, other)
    assert {(r.shard, r.problem) for r in shards.problems(plan, shards.manifest(spark, other)).collect()} == {(1, "moved"), (3, "missing"), (4, "missing"), (7, "unplanned")}
    rows = shards.manifest(spark, folder)
    assert [(r.shard, r.problem) for r in shards.problems(plan, rows.unionByName(rows.where("shard = 3"))).collect()] == [(3, "repeated")]
    assert [(r.shard, r.problem) for r in shards.problems(plan, rows.withColumn("n", F.col("n") - (F.col("shard") == 1).cast("int"))).collect()] == [(1, "short")]
    assert shards.plan_of(df.limit(0), "at", 5).count() == 0


def test_probit(spark):
    from statistics import NormalDist

    ps = [k / 997 for k in range(1, 997)] + [10.0**-k for k in range(1, 301, 13)] + [1 - 10.0**-k for k in range(1, 16)] + [0.0, 1.0, -1.0, 2.0, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", statistics.probit(F.col("p")).alias("x")).collect():
        if r.p is None or not 0 < r.p < 1:
            assert r.x is None
        else:
            assert abs(r.x - NormalDist().inv_cdf(r.p)) < 1e-12 * max(1, abs(r.x))


def test_first_marks_and_members(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "s", "t"]), rng.choice([None, "k", "k", "l", str(i)])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, s string, k string").withColumn("copies", F.lit(1))
    first = {}
    for i, s, k in rows:
        first.setdefault((s, k), i)
    assert {r.id: r.kept for r in curation.first_marks(df, ["s", "k"], "id").collect()} == {i: first[s, k] == i for i, s, k in rows}
    groups = {}
    for i, _, k in rows:
        if k is not None:
            groups.setdefault(k, []).append(i)
    want = sorted((g[0], len(g), i) for g in groups.values() if len(g) > 1 for i in g)
    assert sorted(tuple(r) for r in curation.copy_members(df, "k", "id").collect()) == want
    assert curation.copy_members(df.limit(0), "k", "id").count() == 0
