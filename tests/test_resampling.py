"""The bootstrap by trees of binomials against plain numpy resampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import resampling


def clusters(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(("a", None)[i % 3 == 0], i // 2 if i % 50 else None, float(rng.integers(0, 5)), float(rng.integers(1, 9)), i % 4) for i in range(n)]
    return rows, spark.createDataFrame(rows, "arm string, key long, num double, den double, st int").repartition(3)


def test_draws_of_a_cell_are_its_size(spark, monkeypatch):
    """Counts over all blocks sum to the number of clusters in every replicate, at any number of blocks."""
    monkeypatch.setattr(resampling, "BLOCK", 16)
    rows, df = clusters(spark, 300)
    ones = df.withColumns({"one": F.lit(1)})
    got = resampling.resampled_sums(ones, ["arm"], "key", ["one"], 500).collect()
    size = {arm: sum(r[0] == arm for r in rows) for arm in ("a", None)}
    assert len(got) == 1000 and all(r.one == size[r.arm] for r in got)
    assert sorted({(r.arm is None, r.b) for r in got}) == [(x, b) for x in (False, True) for b in range(500)]


def test_counts_are_multinomial():
    """Means, variances and covariances of the counts of clusters in blocks of unequal size."""
    sizes, replicates = np.array([3, 1, 0, 4, 2]), 20_000
    n, taken = sizes.sum(), []
    for block, size in enumerate(sizes):
        if size:
            count = resampling.reaching("c", sizes, block, replicates, "s")
            taken.append(resampling.dealt("c", block, count, np.eye(size), "s"))
    x = np.hstack(taken)
    assert (x.sum(axis=1) == n).all()
    assert np.abs(x.mean(axis=0) - 1).max() < 0.04
    want = np.full((n, n), -1 / n) + np.eye(n)
    assert np.abs(np.cov(x.T) - want).max() < 0.05


@pytest.mark.parametrize("block", [2048, 32])
def test_ends_agree_with_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows, df = clusters(spark, 400)
    got = {r.arm: r for r in resampling.intervals(df, ["arm"], "key", ["num", "den"], F.try_divide("num", "den") - F.lit(0.4)).collect()}
    rng = np.random.default_rng(9)
    for arm in ("a", None):
        x = np.array([r[2:4] for r in rows if r[0] == arm])
        sums = x[rng.integers(0, len(x), (10_000, len(x)))].sum(axis=1)
        stat = sums[:, 0] / sums[:, 1] - 0.4
        se = stat.std()
        lo, hi = np.quantile(stat, [0.025, 0.975])
        assert got[arm].defined == 10_000 and abs(got[arm].lo - lo) < 0.2 * se and abs(got[arm].hi - hi) < 0.2 * se
        assert abs(got[arm].p - min(1, 2 * min((stat <= 0).mean(), (stat >= 0).mean()))) < 0.05


def test_strata_are_resampled_apart(spark):
    rows, df = clusters(spark, 200)
    got = resampling.intervals(df, [], "key", ["num", "den"], F.try_divide("num", "den"), strata=["st"]).first()
    rng = np.random.default_rng(4)
    sums = np.zeros((10_000, 2))
    for st in range(4):
        x = np.array([r[2:4] for r in rows if r[4] == st])
        sums += x[rng.integers(0, len(x), (10_000, len(x)))].sum(axis=1)
    stat = sums[:, 0] / sums[:, 1]
    assert all(abs(a - b) < 0.2 * stat.std() for a, b in zip((got.lo, got.hi), np.quantile(stat, [0.025, 0.975])))


def test_the_same_however_partitioned(spark):
    _, df = clusters(spark, 150)
    one, two = (sorted(map(tuple, resampling.resampled_sums(x, ["st"], "key", ["num"], 300).collect())) for x in (df, df.repartition(7, "den")))
    assert one == two
    assert one != sorted(map(tuple, resampling.resampled_sums(df, ["st"], "key", ["num"], 300, seed="other").collect()))


def test_edges(spark):
    kind = "arm string, key long, num double, den double"
    empty = spark.createDataFrame([], kind)
    assert resampling.intervals(empty, ["arm"], "key", ["num", "den"], F.try_divide("num", "den")).count() == 0
    rows = [("a", 1, 2.0, 4.0), ("b", 1, None, 0.0), ("b", 2, 1.0, 0.0), ("c", 1, 1.0, 0.0), ("c", 2, 1.0, 1.0)]
    got = {r.arm: r for r in resampling.intervals(spark.createDataFrame(rows, kind), ["arm"], "key", ["num", "den"], F.try_divide("num", "den"), 400).collect()}
    assert set(got) == {"a", "c"}  # b has no value in any replicate
    assert (got["a"].lo, got["a"].hi, got["a"].p, got["a"].defined) == (0.5, 0.5, 0.0, 400)
    assert abs(got["c"].defined / 400 - 0.75) < 0.1 and math.isclose(got["c"].lo, 1.0)


def test_hashed_draws_over_blocks_and_chunks(spark, monkeypatch):
    """Clusters and draws of several blocks and chunks, against draws one by one; a cell with null sums only has no ends."""
    import hashlib

    from sieveline.operators import statistics

    monkeypatch.setattr(statistics, "CHUNK", 16)
    monkeypatch.setattr(statistics, "CLUSTERS", 8)
    rows = [("a", i * 7 % 101, None if i % 9 == 0 else i % 5 - 2, i % 4 + 1) for i in range(101)] + [(None, i, 1, 2) for i in range(3)] + [("n", i, None, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "arm string, key long, num long, den long")
    got = {r.arm: r for r in statistics.clustered_bootstrap(df, ["arm"], "key", "num", "den", 50, "s").collect()}
    draw = lambda b, i, n: int(hashlib.sha256(f"s|{b}|{i}".encode()).hexdigest()[:8], 16) % n
    x = sorted((r for r in rows if r[0] == "a"), key=lambda r: r[1])
    stat = [sum(x[j][2] or 0 for j in d) / sum(x[j][3] for j in d) for b in range(50) for d in [[draw(b, i, 101) for i in range(101)]]]
    assert "n" not in got and np.allclose([got["a"].lo, got["a"].hi], np.quantile(stat, [0.025, 0.975]))
    assert math.isclose(got["a"].p, min(1, 2 * min(np.mean(np.array(stat) <= 0), np.mean(np.array(stat) >= 0))))


def test_clusters_with_equal_sums_are_drawn_together(spark):
    """Counts of three sums that many clusters have, against the multinomial; ends over 60,000 clusters of 20 sums."""
    alike, replicates = np.array([50, 30, 20]), 20_000
    taken = resampling.dealt("c", 0, np.full(replicates, 100), np.eye(3), "s", alike)
    p = alike / 100
    assert (taken.sum(axis=1) == 100).all() and np.abs(taken.mean(axis=0) - alike).max() < 0.2
    assert np.abs(np.cov(taken.T) - 100 * (np.diag(p) - np.outer(p, p))).max() < 0.8
    few = resampling.dealt("c", 0, np.full(replicates, 4), np.eye(3), "s", np.array([2, 1, 1]))  # too few to be alike
    assert (few.sum(axis=1) == 4).all() and np.abs(few.mean(axis=0) - [2, 1, 1]).max() < 0.05
    df = spark.range(60_000).select(F.lit("a").alias("arm"), F.col("id").alias("key"), (F.col("id") % 5 * 0.1).alias("num"), (F.col("id") % 4 + 1).alias("den"))
    got = resampling.intervals(df, ["arm"], "key", ["num", "den"], F.try_divide("num", "den"), 2000).first()
    se = math.sqrt(sum((i % 5 * 0.1 - 0.08 * (i % 4 + 1)) ** 2 for i in range(20)) / 20 / 60_000) / 2.5
    assert abs(got.lo - 0.08 + 1.96 * se) < 0.3 * se and abs(got.hi - 0.08 - 1.96 * se) < 0.3 * se
