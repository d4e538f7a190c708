"""Inference statistics as aggregations and closed forms; resamples are drawn by hash, so they repeat exactly."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import checkpoint


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the score interval of a rate, within 0 and 1; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    center = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(k == 0, center * 0).otherwise(F.greatest(center - half, F.lit(0.0))), F.when(k == n, center * 0 + 1).otherwise(F.least(center + half, F.lit(1.0)))


def _binomial_tail(n: Column, m: Column) -> Column:
    """P(at most m of n) at one half, as one sum over m + 1 terms: ln C(n, i + 1) = ln C(n, i) + ln(n - i) - ln(i + 1)."""
    half = n * F.ln(F.lit(2.0))
    step = lambda s, i: F.struct((s["tail"] + F.exp(s["log"] - half)).alias("tail"), (s["log"] + F.ln((n - i).cast("double")) - F.ln((i + 1).cast("double"))).alias("log"))
    return F.aggregate(F.sequence(F.lit(0), m), F.struct(F.lit(0.0).alias("tail"), F.lit(0.0).alias("log")), step, lambda s: s["tail"])


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial p of wins against losses at one half; 1 without any."""
    n, m = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.when(wins == losses, 1.0).otherwise(2 * _binomial_tail(n, m))))


def sign_test_one_sided(wins: Column, losses: Column) -> Column:
    """P(at least so many wins) at one half; 1 without any."""
    n = (wins + losses).cast("int")
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), _binomial_tail(n, losses.cast("int"))))


def holm(df: DataFrame, p: str, family: list[str], key: str) -> DataFrame:
    """df with `p_holm`: step-down adjusted p values inside each family, running maximum of p * (m - rank)."""
    w = Window.partitionBy(*family).orderBy(p, key)
    rank = F.row_number().over(w) - 1
    m = F.count("*").over(Window.partitionBy(*family))
    raw = df.withColumn("raw", F.least(F.lit(1.0), F.col(p) * (m - rank)))
    return raw.withColumn("p_holm", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def running_before(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with `before`: the sum of value over the rows of its group that come before it in order (a total order inside
    a group). Rows are dealt by ranges of (by, order), summed up inside each range, and each range starts after those
    before it in its group, so a group of any size is many tasks."""
    placed = checkpoint(df.repartitionByRange(*by, order).withColumn("sieve_part", F.spark_partition_id()))
    upto = Window.unboundedPreceding
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "sieve_part").orderBy(order).rowsBetween(upto, -1)), F.lit(0))
    sums = placed.groupBy(*[F.col(c).alias(f"sieve_{i}") for i, c in enumerate(by)], F.col("sieve_part").alias("sieve_p")).agg(F.sum(value).alias("sieve_sum"))
    start = F.coalesce(F.sum("sieve_sum").over(Window.partitionBy(*[f"sieve_{i}" for i in range(len(by))]).orderBy("sieve_p").rowsBetween(upto, -1)), F.lit(0))
    sums = sums.withColumn("sieve_start", start).drop("sieve_sum")
    same = F.col("sieve_part") == F.col("sieve_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"sieve_{i}"))
    return placed.withColumn("sieve_in", inside).join(sums, same).withColumn("before", F.col("sieve_in") + F.col("sieve_start")).select(*df.columns, "before")


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Exact area under the ROC curve with half credit for ties; null with one class. Ranks come from counts of distinct
    scores, so equal scores are one row."""
    per = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = running_before(per, by, "s", "neg")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("before") + F.col("neg") / F.lit(2.0))), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, rank): the rank of each distinct value, ties averaged, from counts of the values."""
    counts = df.groupBy(*by, value).agg(F.sum("sieve_n").alias("sieve_n"))
    return running_before(counts, by, value, "sieve_n").select(*by, value, (F.col("before") + (F.col("sieve_n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, spearman, pearson); null on a constant column. Equal rows are counted first, and ranks come from counts."""
    cells = df.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("sieve_n"))
    rows = cells
    for c in ("x", "y"):
        ranks = average_ranks(cells, by, c).select(*[F.col(b).alias(f"sieve_b{i}") for i, b in enumerate(by)], F.col(c).alias("sieve_v"), F.col("rank").alias(f"r{c}"))
        same = F.col(c).eqNullSafe(F.col("sieve_v"))
        for i, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"sieve_b{i}"))
        rows = rows.join(ranks, same).drop("sieve_v", *[f"sieve_b{i}" for i in range(len(by))])
    n, names = F.col("sieve_n"), ("x", "y", "rx", "ry")
    means = rows.groupBy(*[F.col(b).alias(f"sieve_b{i}") for i, b in enumerate(by)]).agg(*[(F.sum(F.col(c) * n) / F.sum(n)).alias(f"mean_{c}") for c in names])
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"sieve_b{i}"))
    centered = rows.join(means, same).select(*by, "sieve_n", *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in names])

    def corr(a: str, b: str) -> Column:
        a, b = F.col(a), F.col(b)
        return F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a) * F.sum(n * b * b)))

    return centered.groupBy(*by).agg(corr("rx", "ry").alias("spearman"), corr("x", "y").alias("pearson"))


def calibration(df: DataFrame, p: str, y: str, by: list[str], bins: int = 5) -> DataFrame:
    """(n, nll, brier, ece): equal-width bins, the last one closed. Bins are pre-aggregated with sums, then combined."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    nll = -(F.col(y) * F.ln(clipped) + (1 - F.col(y)) * F.ln(1 - clipped))
    per = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).groupBy(*by, "bin").agg(F.count("*").alias("m"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(nll).alias("sn"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("sb"))
    return per.groupBy(*by).agg(F.sum("m").alias("n"), (F.sum("sn") / F.sum("m")).alias("nll"), (F.sum("sb") / F.sum("m")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("m")).alias("ece"))


CHUNK = 1 << 18  #: draws of one row of work
CLUSTERS = 1 << 16  #: clusters of one block


def _numbered(groups: DataFrame, by: list[str], key: str) -> DataFrame:
    """groups with j, its number in its cell by order of key from 0, counted by ranges of the order: no task sees a cell whole."""
    ranges = checkpoint(groups.repartitionByRange(*by, key)).withColumn("sieve_p", F.spark_partition_id())
    counts = ranges.groupBy(*by, "sieve_p").agg(F.count("*").alias("sieve_n"))
    before = F.sum("sieve_n").over(Window.partitionBy(*by).orderBy("sieve_p")) - F.col("sieve_n")
    inside = ranges.withColumn("j", F.row_number().over(Window.partitionBy(*by, "sieve_p").orderBy(key)))
    return inside.join(F.broadcast(counts.withColumn("sieve_n", before)), [*by, "sieve_p"]).withColumn("j", F.col("j") + F.col("sieve_n") - 1).drop("sieve_p", "sieve_n")


def _drawn(size: int, width: int):
    """Rows (cell, prefix, n, b, chunk): the draws of a chunk of size, hash(prefix, i) mod n, as (cell, block, b, places
    in the block of width clusters as 16-bit numbers)."""

    def run(batches):
        for pdf in batches:
            for cell, prefix, n, b, chunk in zip(pdf["cell"], pdf["prefix"], pdf["n"], pdf["b"], pdf["chunk"]):
                start = prefix.encode()
                raw = b"".join([hashlib.sha256(start + b"%d" % i).digest()[:4] for i in range(chunk * size, min(n, (chunk + 1) * size))])
                j = np.sort(np.frombuffer(raw, ">u4").astype(np.int64) % n)
                blocks, at = np.unique(j // width, return_index=True)
                parts = [p.astype(np.uint16).tobytes() for p in np.split(j % width, at[1:])]
                yield pd.DataFrame({"cell": cell, "block": blocks, "b": b, "places": parts})

    return run


def _block_sums(width: int):
    """(cell, b, num, den, how many of each are not null) over the clusters of a block that each replicate draws there."""

    def run(key: tuple, clusters: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((width, 4))
        both = clusters[["num", "den"]].to_numpy(np.float64, na_value=np.nan)
        values[clusters["j"].to_numpy() % width] = np.hstack([np.nan_to_num(both, nan=0.0), ~np.isnan(both)])
        found = [(b, *values[np.frombuffer(p, np.uint16)].sum(axis=0)) for b, p in zip(draws["b"], draws["places"])]
        out = pd.DataFrame(found, columns=["b", "num", "den", "n_num", "n_den"]).groupby("b", as_index=False).sum()
        out.insert(0, "cell", key[0])
        return out

    return run


def _replicates(groups: DataFrame, by: list[str], key: str, numerator: str, denominator: str, replicates: int, seed: list) -> DataFrame:
    """(by, b, num, den): the sums of replicate b, in which draw i takes cluster number hash(seed, b, i) mod n of its cell.

    No draw is a row: a task draws a chunk and sends each block of clusters the places drawn there, two bytes a draw; the
    sums of a block leave its task as one row a replicate."""
    cell = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"})
    numbered = _numbered(groups.select(*by, key, F.col(numerator).cast("double").alias("num"), F.col(denominator).cast("double").alias("den")), by, key)
    sizes = groups.groupBy(*by).agg(F.count("*").alias("n")).withColumn("cell", cell)
    prefix = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in [*seed, F.col("b")]], F.lit(""))
    each = sizes.crossJoin(F.broadcast(groups.sparkSession.range(replicates).withColumnRenamed("id", "b")))
    work = each.select("cell", prefix.alias("prefix"), "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    cores = groups.sparkSession.sparkContext.defaultParallelism
    draws = work.repartition(4 * cores, "cell", "b", "chunk").mapInPandas(_drawn(CHUNK, CLUSTERS), "cell string, block long, b long, places binary")
    clusters = numbered.select(cell.alias("cell"), F.floor(F.col("j") / CLUSTERS).alias("block"), F.col("j").cast("long").alias("j"), "num", "den")
    blocks = clusters.groupBy("cell", "block").cogroup(draws.groupBy("cell", "block")).applyInPandas(_block_sums(CLUSTERS), "cell string, b long, num double, den double, n_num double, n_den double")
    some = lambda c: F.when(F.sum(f"n_{c}") > 0, F.sum(c)).alias(c)
    return blocks.groupBy("cell", "b").agg(some("num"), some("den")).join(F.broadcast(sizes.select("cell", *by)), "cell").drop("cell")


def clustered_bootstrap(groups: DataFrame, by: list[str], key: str, numerator: str, denominator: str, replicates: int, seed: str) -> DataFrame:
    """Source-clustered bootstrap of a ratio of sums: (by, lo, hi, p_two_sided).

    groups has one pre-aggregated row a cluster: its sums of numerator and denominator. In replicate b draw i takes
    cluster number hash(seed, b, i) mod n of its cell, so a replicate is n draws with replacement. Clusters are
    numbered once, by key. Undefined replicates are dropped.
    """
    sums = _replicates(groups, by, key, numerator, denominator, replicates, [seed])
    stat = sums.select(*by, F.try_divide("num", "den").alias("stat")).where("stat is not null")
    return stat.groupBy(*by).agg(
        F.percentile("stat", F.lit(0.025)).alias("lo"),
        F.percentile("stat", F.lit(0.975)).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("stat") <= 0).cast("double")), F.avg((F.col("stat") >= 0).cast("double")))).alias("p"),
    )


def leave_one_out(df: DataFrame, group: str, value: str, cell: list[str]) -> DataFrame:
    """(cell, group, n, loo_mean): the mean of all other groups of the cell; sums of groups are windowed, not rows."""
    per = df.groupBy(*cell, group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(*cell)
    return per.withColumn("loo_mean", (F.sum("s").over(w) - F.col("s")) / F.greatest(F.sum("n").over(w) - F.col("n"), F.lit(1)))


def best_threshold(df: DataFrame, score: str, positive: str, floor: float, by: list[str], grid: tuple[float, float, float] = (0.05, 0.95, 0.01)) -> DataFrame:
    """The grid threshold t (flag score >= t) with the highest recall of positives among those that keep at least floor
    of the negatives; ties go to higher precision, then the lower t.

    Rows are first counted by grid cell; cumulative sums over at most a hundred cells give every threshold's counts.
    """
    lo, hi, step = grid
    cells = int(round((hi - lo) / step))
    cell = F.least(F.greatest(F.floor((F.col(score) - lo) / step + 1e-9), F.lit(-1)), F.lit(cells)).cast("int")
    per = df.groupBy(*by, cell.alias("c")).agg(F.count_if(F.col(positive) == 1).alias("pos"), F.count_if(F.col(positive) == 0).alias("neg"))
    every = per.select(*by).distinct().crossJoin(F.broadcast(df.sparkSession.range(-1, cells + 1).select(F.col("id").cast("int").alias("c"))))
    full = every.join(per, [*by, "c"], "left").na.fill(0, ["pos", "neg"])
    w = Window.partitionBy(*by)
    up = w.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    t = full.select(*by, "c", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(w).alias("p"), F.sum("neg").over(w).alias("n")).where("c >= 0")
    t = t.withColumn("recall", F.try_divide("tp", "p")).withColumn("keep_recall", F.try_divide(F.col("n") - F.col("fp"), F.col("n"))).withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)))
    best = F.max_by(F.struct("c", "recall", "keep_recall", "precision"), F.struct(F.round("recall", 9), F.round("precision", 9), -F.col("c")))
    return t.where(F.col("keep_recall") >= floor).groupBy(*by).agg(best.alias("x")).select(*by, F.round(lo + F.col("x.c") * step, 2).alias("threshold"), "x.recall", "x.keep_recall", "x.precision")


def shapley_two(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts(by..., arm 0 or 1, n, hard, right_hard, right_easy) -> the gap in accuracy between the arms split into the
    part of the mix and the part of skill; the parts sum to the gap. With 0.5 smoothing of the rates."""
    c = F.col
    rates = counts.select(*by, "arm", ((c("hard") + 0.5) / (c("n") + 1.0)).alias("h"), ((c("right_hard") + 0.5) / (c("hard") + 1.0)).alias("rh"), ((c("right_easy") + 0.5) / (c("n") - c("hard") + 1.0)).alias("re"))
    wide = rates.groupBy(*by).agg(*[F.max(F.when(c("arm") == a, c(x))).alias(f"{x}{a}") for a in (0, 1) for x in ("h", "rh", "re")])
    acc = lambda mix, skill: c(f"h{mix}") * c(f"rh{skill}") + (1 - c(f"h{mix}")) * c(f"re{skill}")
    mix = ((acc(1, 0) - acc(0, 0)) + (acc(1, 1) - acc(0, 1))) / 2
    skill = ((acc(0, 1) - acc(0, 0)) + (acc(1, 1) - acc(1, 0))) / 2
    return wide.select(*by, (acc(1, 1) - acc(0, 0)).alias("gap"), mix.alias("mix_part"), skill.alias("skill_part"))


def classification(df: DataFrame, y: str, predicted: str, by: list[str]) -> DataFrame:
    """Counts and rates of a binary prediction in one aggregation; a rate over nothing is null."""
    tp, fp, fn, tn = (F.count_if((F.col(y) == a) & (F.col(predicted) == b)) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    return df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), r(tp, tp + fn).alias("recall"), r(tn, tn + fp).alias("specificity"), r(tp, tp + fp).alias("precision"), F.round((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"))


def stratified_bootstrap(groups: DataFrame, strata: list[str], key: str, numerator: str, denominator: str, replicates: int, seed: str) -> DataFrame:
    """One row (lo, hi): a ratio of sums where clusters are resampled inside each stratum. The ends are order
    statistics, the floor(0.025 B)th and ceil(0.975 B) - 1th replicate from 0, not interpolated."""
    sums = _replicates(groups, strata, key, numerator, denominator, replicates, [seed, *[F.col(c) for c in strata]])
    stat = sums.groupBy("b").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("stat")).where("stat is not null")
    ranked = stat.agg(F.array_sort(F.collect_list("stat")).alias("x"))  # one number a replicate
    n = F.size("x")
    return ranked.select(F.get("x", F.floor(n * 0.025).cast("int")).alias("lo"), F.get("x", (F.ceil(n * 0.975) - 1).cast("int")).alias("hi"))


def recall_estimate(flagged: Column, precision_k: Column, precision_n: Column, unflagged: Column, miss_k: Column, miss_n: Column) -> Column:
    """struct(recall, low, high) from a sample of each stratum: true positives over true positives and misses, with the
    Wilson ends of both rates against each other."""
    p, m = precision_k / precision_n, miss_k / miss_n
    (p_lo, p_hi), (m_lo, m_hi) = wilson(precision_k, precision_n), wilson(miss_k, miss_n)
    of = lambda a, b: F.try_divide(flagged * a, flagged * a + unflagged * b)
    return F.struct(of(p, m).alias("recall"), of(p_lo, m_hi).alias("low"), of(p_hi, m_lo).alias("high"))


def non_inferior(lower: Column, margin: float) -> Column:
    """Whether the lower end of an interval of the difference lies above the margin."""
    return lower > margin


def logit(p: Column, least: float = 1e-6) -> Column:
    """Log-odds of a probability, clipped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.ln(q / (1 - q))


#: Wichura's AS 241 (1988), coefficients of the normal quantile, highest power first: numerator and
#: denominator of the middle, of the tails, and of the far tails.
AS241 = {
    "middle": (
        (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
        (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
    ),
    "tail": (
        (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
        (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
    ),
    "far": (
        (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
    ),
}


def probit(p: Column) -> Column:
    """The quantile of the normal distribution, to about 1e-15 of its size; null outside of 0 to 1, both ends included."""

    def ratio(part: str, r: Column) -> Column:
        up, down = (reduce(lambda acc, c: acc * r + F.lit(c), rest, F.lit(first)) for first, *rest in AS241[part])
        return up / down

    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q <= 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, ratio("tail", r - 1.6)).otherwise(ratio("far", r - 5))
    return F.when((p <= 0) | (p >= 1), F.lit(None)).when(F.abs(q) <= 0.425, q * ratio("middle", 0.180625 - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def shapley_factors(counts: DataFrame, by: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """(by, factor, part): what position bias and each group of invalid outcomes take from a judge's accuracy.

    counts(by..., r, o, n): judgments by the place of the right solution, A or B, and the outcome, A, B or an invalid
    kind; groups name the kinds of each factor. The model picks A with probability logistic(beta + delta) if A is right
    and logistic(beta - delta) if B is, unless the outcome is invalid; removing the bias sets beta to 0 and evens the
    invalid shares over the places, removing a group sets its shares to 0. A part is the mean gain of removing the
    factor over all orders, so the parts sum to the whole gap. Counts meet in one aggregation, with 0.5 smoothing.
    """
    from itertools import combinations
    from math import factorial

    def count(side: str, kinds: list[str]) -> Column:
        return F.coalesce(F.sum(F.when((F.col("r") == side) & F.col("o").isin(kinds), F.col("n"))), F.lit(0))

    shares = [F.try_divide(count(s, kinds), F.sum(F.when(F.col("r") == s, F.col("n")))).alias(f"{g}_{s}") for g, kinds in groups.items() for s in "AB"]
    rates = [((count(s, ["A"]) + 0.5) / (count(s, ["A", "B"]) + 1)).alias(f"rate_{s}") for s in "AB"]
    fitted = counts.groupBy(*by).agg(*rates, *shares)
    odds = {s: F.ln(F.col(f"rate_{s}") / (1 - F.col(f"rate_{s}"))) for s in "AB"}
    fitted = fitted.withColumn("beta", (odds["A"] + odds["B"]) / 2).withColumn("delta", (odds["A"] - odds["B"]) / 2)
    factors = ["bias", *groups]

    def value(removed: frozenset) -> Column:
        def valid(side: str) -> Column:
            lost = F.lit(0.0)
            for g in groups:
                if g not in removed:
                    lost = lost + ((F.col(f"{g}_A") + F.col(f"{g}_B")) / 2 if "bias" in removed else F.col(f"{g}_{side}"))
            return 1 - lost

        beta = F.lit(0.0) if "bias" in removed else F.col("beta")
        return 0.5 * (valid("A") * logistic(beta + F.col("delta")) + valid("B") * logistic(F.col("delta") - beta))

    every = [frozenset(s) for m in range(len(factors) + 1) for s in combinations(factors, m)]
    names = {s: f"v{i}" for i, s in enumerate(every)}
    valued = fitted.select(*by, *[value(s).alias(names[s]) for s in every])

    def part(f: str) -> Column:
        out = F.lit(0.0)
        for s in every:
            if f not in s:
                weight = factorial(len(s)) * factorial(len(factors) - len(s) - 1) / factorial(len(factors))
                out = out + weight * (F.col(names[s | {f}]) - F.col(names[s]))
        return out

    rows = F.array(*[F.struct(F.lit(f).alias("factor"), part(f).alias("part")) for f in factors])
    return valued.select(*by, F.explode(rows).alias("x")).select(*by, "x.factor", "x.part")
