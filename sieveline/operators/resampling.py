"""Bootstrap of cluster sums at any number of replicates.

A replicate of n clusters is a multinomial draw: how often each of them is taken, n in all. The counts come from a tree of
binomials. Clusters lie in blocks by hash; a cell's draws are split over halves of its blocks, again and again, each split
seeded by the cell and the node, so every task that walks from the root to its own block finds the same numbers without
asking others. Clusters of a cell with equal sums are interchangeable, so a block holds distinct sums, each with the number
of its clusters, and the work grows with the distinct sums. Inside a block, whose size is bounded, the draws that reached it
are dealt among its clusters, or among their sums by a multinomial draw where many clusters are alike. No draw is a row,
clusters are not numbered, and what leaves a task is one vector of `replicates` slots a cell and sum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import checkpoint

BLOCK = 2048  #: distinct sums of a block, about
ALIKE = 4  #: clusters a sum, on the mean, from which a block is dealt by multinomial draws
DIGITS = 14  #: significant digits by which sums are told apart (whole numbers of so many are exact)
SLOTS = 250  #: replicates of one slice of a vector, and of one matrix of counts


def _rng(*what) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256("|".join(map(str, what)).encode()).digest()[:16], "big")))


def reaching(cell: str, sizes: np.ndarray, block: int, replicates: int, seed: str) -> np.ndarray:
    """How many of a cell's draws reach a block in each replicate, its blocks having so many clusters each."""
    ends = np.append(0, np.cumsum(sizes))
    lo, hi = 0, len(sizes)
    count = np.full(replicates, ends[-1], np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, all_ = int(ends[mid] - ends[lo]), int(ends[hi] - ends[lo])
        here = _rng(seed, cell, lo, hi).binomial(count, left / all_ if all_ else 0.0)
        if block < mid:
            count, hi = here, mid
        else:
            count, lo = count - here, mid
    return count


def dealt(cell: str, block: int, count: np.ndarray, values: np.ndarray, seed: str, alike: np.ndarray | None = None) -> np.ndarray:
    """Sums of values over count[b] draws of the block's clusters with replacement, for each replicate b; a row of values
    stands for one cluster, or for alike of them."""
    out = np.empty((len(count), values.shape[1]))
    rng, n = _rng(seed, cell, "block", block), len(values)
    ends = np.arange(1, n + 1) if alike is None else np.cumsum(alike)
    for a in range(0, len(count), SLOTS):
        some = count[a : a + SLOTS]
        if ends[-1] >= ALIKE * n:
            taken = rng.multinomial(some, alike / ends[-1])
        else:
            row = np.repeat(np.arange(len(some)), some)
            at = rng.integers(0, ends[-1], len(row))
            if ends[-1] > n:
                at = np.searchsorted(ends, at, side="right")
            taken = np.bincount(row * n + at, minlength=len(some) * n).reshape(len(some), n)
        out[a : a + SLOTS] = taken @ values
    return out


def _vectors(sizes: dict, sums: list[str], replicates: int, seed: str):
    """Rows (cell, block, alike, sums...), whole blocks together and sorted: (cell, slice, sums as bytes)."""

    def run(batches):
        total: dict[str, np.ndarray] = {}

        def done(pdf: pd.DataFrame) -> None:
            for (cell, block), mine in pdf.groupby(["cell", "block"], sort=False):
                count = reaching(cell, sizes[cell], int(block), replicates, seed)
                total.setdefault(cell, np.zeros((replicates, len(sums))))
                total[cell] += dealt(cell, int(block), count, mine[sums].to_numpy(np.float64), seed, mine["alike"].to_numpy(np.int64))

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            end = pdf.iloc[-1]
            last = ((pdf["cell"] == end["cell"]) & (pdf["block"] == end["block"])).to_numpy()  # may go on
            done(pdf[~last])
            rest = pdf[last]
        if rest is not None and len(rest):
            done(rest)
        for cell, x in total.items():
            yield pd.DataFrame([(cell, a, x[a : a + SLOTS].tobytes()) for a in range(0, replicates, SLOTS)], columns=["cell", "slice", "x"])

    return run


def _added(sums: list[str]):
    """The vectors of all tasks for one slice of one cell, added: a row a replicate."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(0)
        for raw in pdf.sort_values("x")["x"]:  # in an order that no task decides
            part = np.frombuffer(raw)
            x = part.copy() if not len(x) else x + part
        x = x.reshape(-1, len(sums))
        out = pd.DataFrame(x, columns=sums)
        out.insert(0, "b", np.arange(len(x)) + pdf["slice"].iloc[0])
        out.insert(0, "cell", pdf["cell"].iloc[0])
        return out

    return run


def resampled_sums(clusters: DataFrame, by: list[str], key: str, sums: list[str], replicates: int = 10_000, seed: str = "boot") -> DataFrame:
    """(by, b, sums...): the sums over the clusters that replicate b takes; b from 0.

    clusters has a row for each cluster of a cell, named by key, with its sums; cells are resampled apart. Null sums count
    as 0 and sums are taken to DIGITS digits; a null key is a cluster like any other; an empty table gives no rows. The same seed gives the same draws however the rows
    are partitioned (sums of doubles that are no integers may differ in the last bits).
    """
    spark = clusters.sparkSession
    cell = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"}) if by else F.lit("{}")
    names = [f"s{i}" for i in range(len(sums))]
    told = [F.format_string(f"%.{DIGITS - 1}e", F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + 0.0).alias(n) for c, n in zip(sums, names)]
    rows = checkpoint(clusters.select(cell.alias("cell"), *told).groupBy("cell", *names).agg(F.count("*").alias("alike")))
    number = {r.cell: max(1, -(-r["count"] // BLOCK)) for r in rows.groupBy("cell").count().orderBy("cell").collect()}  # few: each returns all replicates
    if not number:
        return spark.createDataFrame([], ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in clusters.select(*by).schema] + ["b long"] + [f"`{s}` double" for s in sums]))
    blocks = F.create_map(*[x for c in number for x in (F.lit(c), F.lit(number[c]))])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *names), F.element_at(blocks, F.col("cell"))).cast("int"))
    sizes = {c: np.zeros(number[c], np.int64) for c in number}
    for r in rows.groupBy("cell", "block").agg(F.sum("alike").alias("n")).collect():  # a number for BLOCK distinct sums
        sizes[r.cell][r.block] = r["n"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(number.values()) // 8)
    dealt_out = rows.select("cell", "block", "alike", *[F.col(n).cast("double").alias(n) for n in names]).repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", *names)
    vectors = dealt_out.mapInPandas(_vectors(sizes, names, replicates, seed), "cell string, slice long, x binary")
    found = vectors.groupBy("cell", "slice").applyInPandas(_added(names), "cell string, b long, " + ", ".join(f"{n} double" for n in names))
    kinds = {f.name: f.dataType for f in clusters.select(*by).schema}
    back = [F.get_json_object("cell", f"$.c{i}").cast(kinds[c]).alias(c) for i, c in enumerate(by)]
    return found.select(*back, F.col("b").cast("long").alias("b"), *[F.col(f"s{i}").alias(s) for i, s in enumerate(sums)])


def intervals(clusters: DataFrame, by: list[str], key: str, sums: list[str], statistic: Column, replicates: int = 10_000, seed: str = "boot", level: float = 0.95, strata: list[str] | None = None) -> DataFrame:
    """(by, lo, hi, p, defined): percentile interval of a statistic of the resampled sums, the two-sided share of
    replicates beyond 0 (at most 1), and how many replicates have a value; others are left out.

    statistic is an expression over the names in sums. With strata, clusters are resampled inside each stratum of a cell
    and the sums added before the statistic is taken.
    """
    drawn = resampled_sums(clusters, [*by, *(strata or [])], key, sums, replicates, seed)
    if strata:
        drawn = drawn.groupBy(*by, "b").agg(*[F.sum(s).alias(s) for s in sums])
    stat = drawn.withColumn("stat", statistic.cast("double")).where("stat is not null and not isnan(stat)")
    beyond = lambda c: F.avg(c.cast("double"))
    return stat.groupBy(*by).agg(
        F.percentile("stat", F.lit((1 - level) / 2)).alias("lo"),
        F.percentile("stat", F.lit((1 + level) / 2)).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(beyond(F.col("stat") <= 0), beyond(F.col("stat") >= 0))).alias("p"),
        F.count("*").alias("defined"),
    )
