"""Evaluation and statistics queries.

The answers of a study are stood in for by the order lines: an order is a problem, a line an attempt, its answer is
the quantity mod 5 (null where the part is divisible by 11), and it is right where it equals the customer mod 5. The
pick of a judge is drawn by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.answers import perturbed, reward
from sieveline.functions.hashing import hash_int
from sieveline.operators import curation, evaluation, resampling, statistics
from sieveline.plans.corpus import t
from sieveline.plans.registry import query
from sieveline.session import checkpoint


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("part"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    answer = F.when(F.col("part") % 11 != 0, (F.col("q").cast("long") % 5).cast("string"))
    return a.select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("k"), answer.alias("answer"), F.coalesce(answer == (F.col("o_custkey") % 5).cast("string"), F.lit(False)).alias("ok"), F.col("o_custkey").alias("cust"), F.col("part"))


ATT = """
WITH att AS MATERIALIZED (
  SELECT l_orderkey AS pid, l_linenumber AS k, CASE WHEN p % 11 <> 0 THEN (q::BIGINT % 5)::VARCHAR END AS answer,
    coalesce(CASE WHEN p % 11 <> 0 THEN (q::BIGINT % 5)::VARCHAR END = (o_custkey % 5)::VARCHAR, FALSE) AS ok, o_custkey AS cust, p AS part
  FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey
)"""
WIDE = ATT + """, w5 AS (
  SELECT pid, list(answer ORDER BY k) AS a, list(ok ORDER BY k) AS o FROM att WHERE k <= 5 GROUP BY 1 HAVING count(*) = 5
)"""


def _support(i: int, n: int) -> str:
    return "(CASE WHEN a[%d] IS NULL THEN 0 ELSE %s END)" % (i, " + ".join(f"coalesce((a[{i}] = a[{j}])::INT, 0)" for j in range(1, n + 1)))


def _vote(n: int, priority: list[int]) -> str:
    best = f"greatest({', '.join(_support(i, n) for i in range(1, n + 1))})"
    return "(CASE " + " ".join(f"WHEN {_support(i + 1, n)} = {best} THEN {i}" for i in priority) + " END)"


STRATEGY = WIDE + f""", s AS (
  SELECT pid, o[1] AS keep, o[2] AS blind1, o[{_vote(3, [1, 2, 0])} + 1] AS maj3, o[{_vote(5, [1, 2, 3, 4, 0])} + 1] AS maj5, coalesce(a[1] = a[2], FALSE) AS agree, list_bool_or(o[1:5]) AS oracle FROM w5
), g AS (SELECT *, CASE WHEN agree THEN keep ELSE maj3 END AS agree_gated FROM s)"""


@query(WIDE + f" SELECT pid, {_vote(5, [1, 2, 3, 4, 0])}::INT AS chosen FROM w5")
def plurality_vote(spark, sf_dir):
    """Plurality with a priority order for ties."""
    wide = evaluation.wide_attempts(attempts(spark, sf_dir), [1, 2, 3, 4, 5])
    return wide.select("pid", evaluation.plurality(F.col("answers"), [1, 2, 3, 4, 0]).alias("chosen"))


NAMES = ["keep", "blind1", "maj3", "maj5", "agree_gated", "oracle"]


@query(STRATEGY + " " + " UNION ALL ".join(f"SELECT '{s}' AS strategy, count(*) AS n, round(avg({s}::INT), 6) AS accuracy, count(*) FILTER ({s} AND NOT keep) AS fixes, count(*) FILTER (NOT {s} AND keep) AS harms, count(*) FILTER ({s} AND NOT keep) - count(*) FILTER (NOT {s} AND keep) AS net FROM g" for s in NAMES))
def strategy_scores(spark, sf_dir):
    """Accuracy, fixes and harms of each strategy; agree_gated equals maj3."""
    scored = evaluation.strategies(evaluation.wide_attempts(attempts(spark, sf_dir), [1, 2, 3, 4, 5]), [1, 2, 0], [1, 2, 3, 4, 0])
    return evaluation.strategy_table(scored, NAMES)


@query(STRATEGY + """, c AS (SELECT count(*) FILTER (maj5 AND NOT keep) AS w, count(*) FILTER (NOT maj5 AND keep) AS l, count(*) FILTER (maj5 AND keep) AS both_right, count(*) FILTER (NOT maj5 AND NOT keep) AS neither, count(*) AS n, avg(CASE WHEN agree THEN 2 ELSE 3 END) AS calls FROM g)
SELECT w AS wins, l AS losses, both_right, neither, w - l AS net, round(CASE WHEN w + l = 0 OR w = l THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2::DOUBLE))) FROM range(0, least(w, l) + 1) r(i))) END, 6)::DOUBLE AS p,
round(calls, 6) AS mean_calls FROM c""")
def discordant_sign_test(spark, sf_dir):
    """Wins, losses, the 2x2 table, the exact two-sided test and mean calls."""
    s = evaluation.strategies(evaluation.wide_attempts(attempts(spark, sf_dir), [1, 2, 3, 4, 5]), [1, 2, 0], [1, 2, 3, 4, 0])
    row = s.agg(F.count_if(F.col("maj5") & ~F.col("keep")).alias("wins"), F.count_if(~F.col("maj5") & F.col("keep")).alias("losses"), F.count_if(F.col("maj5") & F.col("keep")).alias("both_right"), F.count_if(~F.col("maj5") & ~F.col("keep")).alias("neither"), F.round(F.avg("calls"), 6).alias("mean_calls"))
    return row.select("wins", "losses", "both_right", "neither", (F.col("wins") - F.col("losses")).alias("net"), F.round(statistics.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"), "mean_calls")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluation.disagreement_pairs(attempts(spark, sf_dir)).where(F.col("first_ok") != F.col("other_ok"))
    h = hash_int("judge", F.col("pid"), F.col("k"), F.col("ord")) % 10
    return pairs.select("pid", "k", "ord", F.when(h < 4, "A").when(h < 8, "B").otherwise("invented").alias("pick"), F.when(F.col("first_ok"), "first").otherwise("other").alias("right"))


JUDGE = ATT + """, p AS (
  SELECT a.pid, b.k, o.ord, CASE WHEN a.ok THEN 'first' ELSE 'other' END AS "right",
    ('0x' || substr(sha256('judge|' || a.pid::VARCHAR || '|' || b.k::VARCHAR || '|' || o.ord), 1, 8))::BIGINT % 10 AS h
  FROM att a JOIN att b ON a.pid = b.pid AND a.k = 1 AND b.k > 1 CROSS JOIN (VALUES ('ab'), ('ba')) o(ord) WHERE NOT coalesce(a.answer = b.answer, FALSE) AND a.ok <> b.ok
), q AS (SELECT pid, k, any_value("right") AS "right", max(CASE WHEN ord = 'ab' THEN CASE WHEN h < 4 THEN 'A' WHEN h < 8 THEN 'B' ELSE 'invented' END END) AS ab, max(CASE WHEN ord = 'ba' THEN CASE WHEN h < 4 THEN 'A' WHEN h < 8 THEN 'B' ELSE 'invented' END END) AS ba FROM p GROUP BY 1, 2
), x AS (SELECT *, CASE ab WHEN 'A' THEN 'first' WHEN 'B' THEN 'other' END AS xa, CASE ba WHEN 'A' THEN 'other' WHEN 'B' THEN 'first' END AS xb FROM q
), j AS (SELECT *, CASE WHEN xa = xb THEN xa ELSE 'inconsistent' END AS verdict, CASE WHEN "right" = 'first' THEN 'A' ELSE 'B' END AS ra, CASE WHEN "right" = 'first' THEN 'B' ELSE 'A' END AS rb FROM x)"""


@query(JUDGE + " SELECT pid, k, verdict FROM j")
def order_swap_consistency(spark, sf_dir):
    """Pairs whose two display orders name the same solution."""
    return evaluation.order_swapped(judgments(spark, sf_dir)).select("pid", "k", "verdict")


_HIT = "((ab = ra)::INT + (ba = rb)::INT)"


def _rate(p: str, v: str) -> str:
    return f"(sum((ra = '{p}' AND ab = '{v}')::INT + (rb = '{p}' AND ba = '{v}')::INT) / nullif(sum((ra = '{p}')::INT + (rb = '{p}')::INT), 0)::DOUBLE)"


@query(JUDGE + f""" SELECT (k % 2)::INT AS judge, count(*) AS n_pairs, round(avg({_HIT} / 2.0::DOUBLE), 6) AS single_accuracy, round({_rate('A', 'A')} - {_rate('B', 'A')}, 6) AS skill_index,
  round(sum((ab = 'B')::INT + (ba = 'B')::INT) / nullif(sum((ab IN ('A', 'B'))::INT + (ba IN ('A', 'B'))::INT), 0)::DOUBLE, 6) AS position_2_rate, round({_rate('B', 'B')} - {_rate('A', 'A')}, 6) AS asymmetry,
  round(avg(((ab = 'invented')::INT + (ba = 'invented')::INT) / 2.0::DOUBLE), 6) AS invented_rate, round(avg((verdict <> 'inconsistent')::INT), 6) AS coverage,
  round(avg(CASE WHEN verdict <> 'inconsistent' THEN (verdict = "right")::INT END), 6) AS consistent_accuracy, round(avg(CASE WHEN verdict = "right" THEN 1.0::DOUBLE WHEN verdict = 'inconsistent' THEN 0.5::DOUBLE ELSE 0 END), 6) AS tie_break,
  round(avg(CASE WHEN verdict = "right" THEN 1.0::DOUBLE WHEN verdict = 'inconsistent' THEN 0.5::DOUBLE ELSE 0 END) - avg({_HIT} / 2.0::DOUBLE), 6) AS tie_minus_single,
  round(avg(CASE WHEN {_HIT} = 0 AND (ab = 'invented' OR ba = 'invented') THEN 0.5::DOUBLE ELSE 0 END), 6) AS invented_artifact FROM j GROUP BY 1""")
def judge_metrics(spark, sf_dir):
    """All metrics of a judge in one aggregation."""
    pairs = evaluation.order_swapped(judgments(spark, sf_dir)).withColumn("judge", (F.col("k") % 2).cast("int"))
    return evaluation.judge_metrics(pairs, ["judge"])


@query(JUDGE + """, c AS (SELECT CASE WHEN xa = xb THEN CASE WHEN xa = "right" THEN 'consistent_right' ELSE 'consistent_wrong' END WHEN ab = 'A' AND ba = 'A' THEN 'locked_A' WHEN ab = 'B' AND ba = 'B' THEN 'locked_B'
  WHEN coalesce(xa = "right" OR xb = "right", FALSE) THEN 'invented_with_right' ELSE 'invented_without_right' END AS outcome FROM j)
SELECT outcome, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM c GROUP BY 1""")
def outcome_classes(spark, sf_dir):
    """Classes of a pair's two picks, with shares."""
    pairs = evaluation.order_swapped(judgments(spark, sf_dir)).select(evaluation.outcome_class(F.col("ab"), F.col("ba"), F.col("right")).alias("outcome"))
    per = pairs.groupBy("outcome").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total")))).select("outcome", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(ATT + """, x AS (SELECT a.pid, a.ok AS i, b.ok AS f, a.answer IS DISTINCT FROM b.answer AS c FROM att a JOIN att b ON a.pid = b.pid AND a.k = 1 AND b.k = 2)
SELECT CASE WHEN i AND NOT c THEN 'kept_right' WHEN i AND c AND f THEN 'changed_stayed_right' WHEN i AND c THEN 'harmed' WHEN NOT c THEN 'kept_wrong' WHEN f THEN 'fixed' ELSE 'changed_stayed_wrong' END AS outcome, count(*) AS n,
sum(CASE WHEN i AND f AND NOT c THEN 1 WHEN NOT i AND f THEN 1 WHEN i AND NOT f THEN -1 ELSE 0 END)::DOUBLE AS reward FROM x GROUP BY 1""")
def transition_matrix(spark, sf_dir):
    """Outcomes of (was right, was changed, is right) with their reward."""
    a = attempts(spark, sf_dir)
    x = a.where("k = 1").select("pid", F.col("ok").alias("i"), F.col("answer").alias("a1")).join(a.where("k = 2").select("pid", F.col("ok").alias("f"), F.col("answer").alias("a2")), "pid")
    changed = ~F.col("a1").eqNullSafe(F.col("a2"))
    act = F.when(changed, "REVISE").otherwise("KEEP")
    return x.groupBy(evaluation.transition(F.col("i"), changed, F.col("f")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(reward(F.col("i"), F.col("f"), act)).alias("reward"))


@query(ATT + """, r AS (SELECT pid, k, ok, lag(ok) OVER (PARTITION BY pid ORDER BY k) AS prev, first_value(ok) OVER (PARTITION BY pid ORDER BY k) AS start FROM att)
SELECT k AS round, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, count(*) FILTER (ok AND NOT prev) AS fixes, count(*) FILTER (NOT ok AND prev) AS harms, count(*) FILTER (ok AND NOT start) AS total_fixes, count(*) FILTER (NOT ok AND start) AS total_harms FROM r GROUP BY 1""")
def rounds_fixes_harms(spark, sf_dir):
    """Accuracy and consecutive and cumulative changes by round."""
    from pyspark.sql import Window

    w = Window.partitionBy("pid").orderBy("k")
    r = attempts(spark, sf_dir).select("pid", "k", "ok", F.lag("ok").over(w).alias("prev"), F.first("ok").over(w).alias("start"))
    return r.groupBy(F.col("k").alias("round")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"), F.count_if(F.col("ok") & ~F.col("prev")).alias("fixes"), F.count_if(~F.col("ok") & F.col("prev")).alias("harms"), F.count_if(F.col("ok") & ~F.col("start")).alias("total_fixes"), F.count_if(~F.col("ok") & F.col("start")).alias("total_harms"))


SCORED = """
WITH d AS (SELECT d.doc_id, lang, least(0.999, greatest(0.001, (n_chars % 1000) / 1000.0::DOUBLE)) AS p, q AS y FROM documents d JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) l USING (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("y"))
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), (F.col("n_chars") % 1000) / F.lit(1000.0)))
    return t(spark, sf_dir, "documents").select("doc_id", "lang", p.alias("p")).join(labels, "doc_id")


@query(SCORED + """, c AS (SELECT lang, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM d GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT lang, round(sum(pos * (below + neg / 2::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE, 6) AS auc FROM b GROUP BY 1""")
def auc_by_language(spark, sf_dir):
    """Exact AUC with half credit for ties."""
    return statistics.auc(scored(spark, sf_dir), "p", "y", ["lang"]).withColumn("auc", F.round("auc", 6))


@query(SCORED + """, b AS (SELECT lang, least(floor(p * 5), 4) AS bin, count(*) AS m, sum(p) AS sp, sum(y) AS sy, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS sn, sum((p - y) * (p - y)) AS sb FROM d GROUP BY 1, 2)
SELECT lang, sum(m)::BIGINT AS n, round(sum(sn) / sum(m), 6) AS nll, round(sum(sb) / sum(m), 6) AS brier, round(sum(abs(sp - sy)) / sum(m), 6) AS ece FROM b GROUP BY 1""")
def calibration(spark, sf_dir):
    """Negative log-likelihood, Brier score and expected calibration error."""
    c = statistics.calibration(scored(spark, sf_dir), "p", "y", ["lang"])
    return c.select("lang", "n", *[F.round(x, 6).alias(x) for x in ("nll", "brier", "ece")])


@query(SCORED + """, r AS (SELECT lang, p, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0::DOUBLE AS ry FROM d)
SELECT lang, round(corr(rx, ry), 6) AS spearman, round(corr(p, y), 6) AS pearson FROM r GROUP BY 1""")
def correlations(spark, sf_dir):
    """Rank and linear correlation."""
    c = statistics.spearman(scored(spark, sf_dir), "p", "y", ["lang"])
    return c.select("lang", F.round("spearman", 6).alias("spearman"), F.round("pearson", 6).alias("pearson"))


@query(SCORED + """, k AS (SELECT lang, count(*) AS n, sum(y) AS k FROM d GROUP BY 1)
SELECT lang, n, k::BIGINT AS k, round(greatest((k / n::DOUBLE + 1.959963984540054 ^ 2 / (2 * n)) / (1 + 1.959963984540054 ^ 2 / n) - 1.959963984540054 / (1 + 1.959963984540054 ^ 2 / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.959963984540054 ^ 2 / (4 * n::DOUBLE * n)), 0), 6) AS lo,
round(least((k / n::DOUBLE + 1.959963984540054 ^ 2 / (2 * n)) / (1 + 1.959963984540054 ^ 2 / n) + 1.959963984540054 / (1 + 1.959963984540054 ^ 2 / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.959963984540054 ^ 2 / (4 * n::DOUBLE * n)), 1), 6) AS hi FROM k""")
def wilson_intervals(spark, sf_dir):
    """Score intervals of rates."""
    k = scored(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    lo, hi = statistics.wilson(F.col("k"), F.col("n"))
    return k.select("lang", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(SCORED + """, s AS (SELECT lang, count(*) FILTER (p >= 0.5 AND y = 1) AS w, count(*) FILTER (p >= 0.5 AND y = 0) AS l FROM d GROUP BY 1
), r AS (SELECT lang, round(CASE WHEN w + l = 0 OR w = l THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2::DOUBLE))) FROM range(0, least(w, l) + 1) x(i))) END, 9)::DOUBLE AS p FROM s
), h AS (SELECT lang, p, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, lang) + 1)) AS raw FROM r)
SELECT lang, round(p, 6) AS p, round(max(raw) OVER (ORDER BY p, lang ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""")
def holm_adjusted(spark, sf_dir):
    """Exact tests of each language, adjusted step-down."""
    s = scored(spark, sf_dir).groupBy("lang").agg(F.count_if((F.col("p") >= 0.5) & (F.col("y") == 1)).alias("w"), F.count_if((F.col("p") >= 0.5) & (F.col("y") == 0)).alias("l"))
    p = s.select("lang", F.lit("all").alias("family"), F.round(statistics.sign_test(F.col("w"), F.col("l")), 9).alias("p"))
    return statistics.holm(p, "p", ["family"], "lang").select("lang", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query(SCORED + """ SELECT lang, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn,
round(count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (y = 0 AND p < 0.5) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE, 6) AS specificity,
round(count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (p >= 0.5), 0)::DOUBLE, 6) AS "precision",
round((count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE + count(*) FILTER (y = 0 AND p < 0.5) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE) / 2, 6) AS balanced_accuracy FROM d GROUP BY 1""")
def classification_metrics(spark, sf_dir):
    """The confusion matrix and its rates."""
    d = scored(spark, sf_dir).withColumn("flag", (F.col("p") >= 0.5).cast("int"))
    return statistics.classification(d, "y", "flag", ["lang"])


@query(SCORED + """, g AS (SELECT round(0.05 + i * 0.01, 2)::DOUBLE AS t, i FROM range(0, 91) r(i)
), b AS (SELECT lang, y, least(greatest(floor((p - 0.05) / 0.01 + 1e-9), -1), 90) AS c FROM d
), m AS (SELECT lang, t, i, count(*) FILTER (y = 1 AND c >= i) AS tp, count(*) FILTER (y = 0 AND c >= i) AS fp, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM b, g GROUP BY 1, 2, 3
), r AS (SELECT lang, t, tp / nullif(p, 0)::DOUBLE AS recall, (n - fp) / nullif(n, 0)::DOUBLE AS keep_recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS prec, i FROM m)
SELECT lang, t AS threshold, round(recall, 6) AS recall, round(keep_recall, 6) AS keep_recall, round(prec, 6) AS "precision" FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(recall, 9) DESC, round(prec, 9) DESC, i) AS k FROM r WHERE keep_recall >= 0.5) WHERE k = 1""")
def best_threshold(spark, sf_dir):
    """The threshold with the best recall under a floor; counts by grid cell, no row meets the grid."""
    b = statistics.best_threshold(scored(spark, sf_dir), "p", "y", 0.5, ["lang"])
    return b.select("lang", "threshold", *[F.round(c, 6).alias(c) for c in ("recall", "keep_recall", "precision")])


@query("""WITH s AS (SELECT c_mktsegment AS segment, o_orderpriority AS prio, sum(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT segment, prio, n, round((sum(s) OVER (PARTITION BY segment) - s) / greatest(sum(n) OVER (PARTITION BY segment) - n, 1), 4) AS loo_mean FROM s""")
def leave_one_group_out(spark, sf_dir):
    """The mean of all other groups of a cell."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("prio"), "o_totalprice")
    return statistics.leave_one_out(o, "prio", "o_totalprice", ["segment"]).select("segment", "prio", "n", F.round("loo_mean", 4).alias("loo_mean"))


@query("""WITH g AS (SELECT o_orderpriority AS arm, o_custkey % 97 AS j0, sum((o_orderstatus = 'F')::INT) AS num, count(*) AS den FROM orders GROUP BY 1, 2
), n AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY j0) - 1 AS j, count(*) OVER (PARTITION BY arm) AS n FROM g
), d AS (SELECT arm, b, ('0x' || substr(sha256('boot|' || b::VARCHAR || '|' || i::VARCHAR), 1, 8))::BIGINT % n AS j FROM (SELECT arm, any_value(n) AS n FROM n GROUP BY 1) c, range(0, 200) r(b), range(0, 97) q(i) WHERE i < n
), s AS (SELECT arm, b, sum(num) / sum(den)::DOUBLE AS stat FROM d JOIN n USING (arm, j) GROUP BY 1, 2)
SELECT arm, round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi, count(*) AS replicates FROM s GROUP BY 1""")
def clustered_bootstrap(spark, sf_dir):
    """A bootstrap whose draws are hashes that SQL repeats, of 200 replicates; see bootstrap_intervals for 10,000."""
    g = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 97).alias("j0")).agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("num"), F.count("*").alias("den"))
    out = statistics.clustered_bootstrap(g, ["arm"], "j0", "num", "den", 200, "boot")
    return out.select("arm", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.lit(200).cast("long").alias("replicates"))


@query("""WITH g AS (SELECT o_orderpriority AS cell, (o_custkey % 2)::INT AS arm, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS hard, count(*) FILTER (o_totalprice > 150000 AND o_orderstatus = 'F') AS rh, count(*) FILTER (o_totalprice <= 150000 AND o_orderstatus = 'F') AS re FROM orders GROUP BY 1, 2
), r AS (SELECT cell, arm, (hard + 0.5::DOUBLE) / (n + 1) AS h, (rh + 0.5::DOUBLE) / (hard + 1) AS rh, (re + 0.5::DOUBLE) / (n - hard + 1) AS re FROM g
), w AS (SELECT cell, max(CASE WHEN arm = 0 THEN h END) AS h0, max(CASE WHEN arm = 1 THEN h END) AS h1, max(CASE WHEN arm = 0 THEN rh END) AS a0, max(CASE WHEN arm = 1 THEN rh END) AS a1, max(CASE WHEN arm = 0 THEN re END) AS b0, max(CASE WHEN arm = 1 THEN re END) AS b1 FROM r GROUP BY 1
), v AS (SELECT cell, h0 * a0 + (1 - h0) * b0 AS v00, h1 * a0 + (1 - h1) * b0 AS v10, h0 * a1 + (1 - h0) * b1 AS v01, h1 * a1 + (1 - h1) * b1 AS v11 FROM w)
SELECT cell, round(v11 - v00, 6) AS gap, round(((v10 - v00) + (v11 - v01)) / 2, 6) AS mix_part, round(((v01 - v00) + (v11 - v10)) / 2, 6) AS skill_part FROM v""")
def shapley_decomposition(spark, sf_dir):
    """The gap between two arms split into mix and skill."""
    o = t(spark, sf_dir, "orders")
    hard, right = F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F"
    g = o.groupBy(F.col("o_orderpriority").alias("cell"), (F.col("o_custkey") % 2).cast("int").alias("arm")).agg(F.count("*").alias("n"), F.count_if(hard).alias("hard"), F.count_if(hard & right).alias("right_hard"), F.count_if(~hard & right).alias("right_easy"))
    s = statistics.shapley_two(g, ["cell"])
    return s.select("cell", *[F.round(c, 6).alias(c) for c in ("gap", "mix_part", "skill_part")])


@query(ATT + """, w AS (SELECT pid, k, answer, ((part % 13) + 1)::DOUBLE AS weight FROM att), s AS (SELECT pid, answer, sum(weight) AS support FROM w WHERE answer IS NOT NULL GROUP BY 1, 2
), v AS (SELECT w.pid, k, coalesce(support, weight) AS support FROM w LEFT JOIN s ON s.pid = w.pid AND s.answer = w.answer)
SELECT pid, k FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY support DESC, k) AS r FROM v) WHERE r = 1""")
def weighted_vote(spark, sf_dir):
    """Votes weighted by a score."""
    a = attempts(spark, sf_dir).withColumn("weight", ((F.col("part") % 13) + 1).cast("double"))
    return evaluation.weighted_vote(a.select("pid", "k", "answer", "weight"))


@query(ATT + " SELECT pid, arg_min(answer, k) FILTER (ok) AS answer FROM att GROUP BY 1")
def first_passing_attempt(spark, sf_dir):
    """The first attempt that verifies, null where none does."""
    return evaluation.first_passing(attempts(spark, sf_dir), "pid", "k", "ok", "answer")


@query(ATT + """, p AS (SELECT cust, k, avg(ok::INT) >= 0.2 AS pass FROM att GROUP BY 1, 2), n AS (SELECT cust, k, pass AND coalesce(lead(pass) OVER (PARTITION BY cust ORDER BY k), FALSE) AS onset FROM p)
SELECT cust, min(k) FILTER (onset) AS onset FROM n GROUP BY 1""")
def onset_levels(spark, sf_dir):
    """The first level that passes and whose successor passes too."""
    from pyspark.sql import Window

    p = attempts(spark, sf_dir).groupBy("cust", "k").agg((F.avg(F.col("ok").cast("int")) >= 0.2).alias("pass"))
    nxt = F.coalesce(F.lead("pass").over(Window.partitionBy("cust").orderBy("k")), F.lit(False))
    return p.withColumn("onset", F.col("pass") & nxt).groupBy("cust").agg(F.min(F.when(F.col("onset"), F.col("k"))).alias("onset"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN (l_quantity::BIGINT + 1)::VARCHAR ELSE printf('%.2f', l_discount + 1) END AS value FROM lineitem""")
def perturbed_answers(spark, sf_dir):
    """Answers off by one."""
    k = F.col("l_linenumber") % 3
    a = F.when(k == 0, "none").when(k == 1, F.col("l_quantity").cast("long").cast("string")).otherwise(F.format_string("%.2f", F.col("l_discount")))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", perturbed(a).alias("value"))


@query("""WITH a AS (SELECT o_orderpriority AS cell, count(*) AS n, round(avg(o_totalprice), 2) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderpriority AS cell, count(*) AS n, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1)
SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.n = b.n, FALSE) AS same_n, coalesce(abs(a.m - b.m) <= 0.01 * abs(b.m), FALSE) AS close_mean FROM a FULL JOIN b ON a.cell = b.cell""")
def tolerance_join(spark, sf_dir):
    """Expected against observed figures, integers exactly, others within a tolerance."""
    per = lambda df: df.groupBy(F.col("o_orderpriority").alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("m"))
    o = t(spark, sf_dir, "orders")
    a, b = per(o.where("o_orderkey % 2 = 0")).toDF("cell", "na", "ma"), per(o).toDF("cell", "nb", "mb")
    return a.join(b, "cell", "full_outer").select("cell", F.coalesce(F.col("na") == F.col("nb"), F.lit(False)).alias("same_n"), F.coalesce(F.abs(F.col("ma") - F.col("mb")) <= 0.01 * F.abs("mb"), F.lit(False)).alias("close_mean"))


@query("""SELECT o_custkey AS cust, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS upper_anchor, max(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS upper_added, count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) = 2 AS complete FROM orders GROUP BY 1""")
def boundary_pairs(spark, sf_dir):
    """The two parts of a pair side by side by key, never by position."""
    kind = F.col("o_orderpriority")
    two = kind.isin("1-URGENT", "5-LOW")
    return t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.max(F.when(kind == "1-URGENT", F.col("o_totalprice"))).alias("upper_anchor"), F.max(F.when(kind == "5-LOW", F.col("o_totalprice"))).alias("upper_added"), (F.count_distinct(F.when(two, kind)) == 2).alias("complete"))


@query(JUDGE + """, m AS (SELECT pid, "right" = 'first' AS fr, (('0x' || substr(sha256('m|ab|' || pid::VARCHAR || '|' || k::VARCHAR), 1, 8))::BIGINT % 21 - 8)::DOUBLE AS ma, (('0x' || substr(sha256('m|ba|' || pid::VARCHAR || '|' || k::VARCHAR), 1, 8))::BIGINT % 21 - 8)::DOUBLE AS mb FROM j
), g AS (SELECT pid, sum((ma + mb) / 2) AS gs, count(*) AS gn FROM m GROUP BY 1), l AS (SELECT pid, (sum(gs) OVER () - gs) / greatest(sum(gn) OVER () - gn, 1) AS loo FROM g
), r AS (SELECT CASE WHEN ma = 0 THEN 0.5 ELSE ((ma > 0) = fr)::INT END AS sa, CASE WHEN mb = 0 THEN 0.5 ELSE ((mb > 0) = NOT fr)::INT END AS sb, CASE WHEN ma - loo = 0 THEN 0.5 ELSE ((ma - loo > 0) = fr)::INT END AS ca, CASE WHEN mb - loo = 0 THEN 0.5 ELSE ((mb - loo > 0) = NOT fr)::INT END AS cb,
  CASE WHEN ma = mb THEN 0.5 ELSE ((ma > mb) = fr)::INT END AS d, (ma + mb) / 2 AS bias FROM m JOIN l USING (pid))
SELECT count(*) AS n, round(avg((sa + sb) / 2.0::DOUBLE), 6) AS single, round(avg((ca + cb) / 2.0::DOUBLE), 6) AS corrected, round(avg(d::DOUBLE), 6) AS debiased, round(avg(bias), 6) AS bias FROM r""")
def log_prob_debiasing(spark, sf_dir):
    """Margins of both orders, with the position bias of all other sources taken off."""
    pairs = judgments(spark, sf_dir).where("ord = 'ab'")
    margin = lambda o: (hash_int("m", o, F.col("pid"), F.col("k")) % 21 - 8).cast("double")
    m = pairs.select("pid", margin("ab").alias("m_ab"), margin("ba").alias("m_ba"), (F.col("right") == "first").alias("first_right"))
    out = evaluation.log_prob_debiasing(m, "pid")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("single", "corrected", "debiased", "bias")])


@query("""WITH g AS (SELECT o_orderstatus AS st, o_custkey % 53 AS j0, sum((o_totalprice > 150000)::INT) AS num, count(*) AS den FROM orders GROUP BY 1, 2
), n AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY j0) - 1 AS j FROM g), c AS (SELECT st, count(*) AS n FROM g GROUP BY 1
), d AS (SELECT st, b, ('0x' || substr(sha256('sb|' || st || '|' || b::VARCHAR || '|' || i::VARCHAR), 1, 8))::BIGINT % n AS j FROM c, range(0, 200) r(b), range(0, 53) q(i) WHERE i < n
), s AS (SELECT b, sum(num) / sum(den)::DOUBLE AS stat FROM d JOIN n USING (st, j) GROUP BY 1), l AS (SELECT list_sort(list(stat)) AS x FROM s)
SELECT round(x[6], 6) AS lo, round(x[195], 6) AS hi FROM l""")
def stratified_bootstrap(spark, sf_dir):
    """Clusters resampled inside strata, ends as order statistics."""
    g = t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("st"), (F.col("o_custkey") % 53).alias("j0")).agg(F.sum((F.col("o_totalprice") > 150000).cast("int")).alias("num"), F.count("*").alias("den"))
    return statistics.stratified_bootstrap(g, ["st"], "j0", "num", "den", 200, "sb").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("SELECT event_id, event_id % 7 <> 0 AND event_id % 2 = 0 AS found FROM events")
def provenance_references(spark, sf_dir):
    """`path#id=ID` values resolved to rows of another table; malformed ones are never found."""
    e = t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("log/"), F.col("event_type"), F.when(F.col("event_id") % 7 == 0, "#").otherwise("#id="), F.col("event_id").cast("string")).alias("ref"))
    rows = t(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.concat(F.lit("log/"), F.col("event_type")).alias("path"), "event_id")
    return evaluation.resolve_references(e, "ref", rows, "path", "event_id").select("event_id", "found")


def greedy_matches(spark, sf_dir):
    """The nearest unused candidate for each target, in order of length, inside a language."""
    docs = t(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("id"), F.col("n_chars").alias("length"), (F.col("doc_id") % 10 == 0).alias("is_target"))
    return curation.greedy_length_match(docs, "lang")


query()(greedy_matches)


#: Ends of the intervals are held against those of large samples, rate -+ 1.96 standard errors, the error being that of a
#: ratio of cluster sums: by at most so many standard errors. A quantile of 10,000 replicates errs by 0.03.
NEAR = 0.25
RATIO = """, r AS (SELECT {0} AS arm, sum(num) / sum(den)::DOUBLE AS rate, count(*) AS clusters FROM g GROUP BY 1
), e AS (SELECT r.arm, sqrt(sum(pow(num - rate * den, 2))) / sum(den) AS se FROM g JOIN r ON r.arm = {0} GROUP BY 1)
SELECT r.arm, r.clusters, round(rate, 6) AS rate, round(se, 6) AS se, 10000::BIGINT AS replicates, TRUE AS lo_near, TRUE AS hi_near FROM r JOIN e USING (arm)"""


def _against_large_samples(g, ends):
    """(arm, clusters, rate, se, replicates, lo_near, hi_near) of clusters g(arm, num, den) and their interval's ends."""
    rate = g.groupBy("arm").agg((F.sum("num") / F.sum("den")).alias("rate"), F.count("*").alias("clusters"))
    se = g.join(F.broadcast(rate), "arm").groupBy("arm").agg((F.sqrt(F.sum(F.pow(F.col("num") - F.col("rate") * F.col("den"), F.lit(2.0)))) / F.sum("den")).alias("se"))
    both = rate.join(se, "arm").join(ends, "arm")
    near = lambda end, z: F.abs(F.try_divide(F.col(end) - F.col("rate"), F.col("se")) - z) < NEAR
    return both.select("arm", "clusters", F.round("rate", 6).alias("rate"), F.round("se", 6).alias("se"), F.col("defined").alias("replicates"), near("lo", -1.959964).alias("lo_near"), near("hi", 1.959964).alias("hi_near"))


@query("WITH g AS (SELECT o_orderpriority AS arm, o_custkey, sum((o_orderstatus = 'F')::INT) AS num, count(*) AS den FROM orders GROUP BY 1, 2)" + RATIO.format("g.arm"))
def bootstrap_intervals(spark, sf_dir):
    """10,000 replicates over all customers of each arm, by a tree of binomials."""
    g = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), "o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("num"), F.count("*").alias("den"))
    return _against_large_samples(g, resampling.intervals(g, ["arm"], "o_custkey", ["num", "den"], F.try_divide("num", "den")))


@query("""WITH g AS (SELECT l_returnflag AS arm, o_custkey, o_orderstatus AS st, sum(l_discount) AS num, count(*) AS den FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
), h AS (SELECT arm, st, count(*) AS n, avg(num) AS mn, avg(den) AS md FROM g GROUP BY ALL), r AS (SELECT arm, sum(num) / sum(den)::DOUBLE AS rate, count(*) AS clusters FROM g GROUP BY 1
), e AS (SELECT arm, sqrt(sum(pow((num - mn) - rate * (den - md), 2))) / sum(den) AS se FROM g JOIN h USING (arm, st) JOIN r USING (arm) GROUP BY 1)
SELECT arm, clusters, round(rate, 6) AS rate, round(se, 6) AS se, 10000::BIGINT AS replicates, TRUE AS lo_near, TRUE AS hi_near FROM r JOIN e USING (arm)""")
def stratified_intervals(spark, sf_dir):
    """10,000 replicates of customers resampled inside the order status, of each return flag."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("st"))
    g = t(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_returnflag").alias("arm"), "o_custkey", "st").agg(F.sum("l_discount").alias("num"), F.count("*").alias("den"))
    g = checkpoint(g)  # read five times
    ends = resampling.intervals(g, ["arm"], "o_custkey", ["num", "den"], F.try_divide("num", "den"), seed="strata", strata=["st"])
    means = g.groupBy("arm", "st").agg(F.avg("num").alias("mn"), F.avg("den").alias("md"))
    rate = g.groupBy("arm").agg((F.sum("num") / F.sum("den")).alias("rate"), F.count("*").alias("clusters"))
    off = F.col("num") - F.col("mn") - F.col("rate") * (F.col("den") - F.col("md"))
    se = g.join(F.broadcast(means), ["arm", "st"]).join(F.broadcast(rate), "arm").groupBy("arm").agg((F.sqrt(F.sum(off * off)) / F.sum("den")).alias("se"))
    near = lambda end, z: F.abs(F.try_divide(F.col(end) - F.col("rate"), F.col("se")) - z) < NEAR
    return rate.join(se, "arm").join(ends, "arm").select("arm", "clusters", F.round("rate", 6).alias("rate"), F.round("se", 6).alias("se"), F.col("defined").alias("replicates"), near("lo", -1.959964).alias("lo_near"), near("hi", 1.959964).alias("hi_near"))
