"""Identities of the evaluation layer and statistics against closed forms."""

import random

from conftest import SF
from pyspark.sql import functions as F

from sieveline.operators import evaluation, statistics
from sieveline.plans import evaluation as plans


def test_agree_gated_is_maj3(spark):
    wide = evaluation.wide_attempts(plans.attempts(spark, SF), [1, 2, 3, 4, 5])
    s = evaluation.strategies(wide, [1, 2, 0], [1, 2, 3, 4, 0])
    assert s.where("agree_gated <> maj3").count() == 0 and s.count() > 0
    assert s.where("(keep or blind1) and not oracle").count() == 0


def test_tie_break_identity(spark):
    row = plans.judge_metrics(spark, SF).collect()
    assert row and all(abs(r.tie_minus_single - r.invented_artifact) < 1e-5 for r in row)


def test_vote_rules(spark):
    rows = [(["a", "b", "b"], 1), ([None, None, None], 1), (["a", "b", "c"], 1), (["a", None, "a"], 2), (["a", "b", None], 1)]
    df = spark.createDataFrame(rows, "x array<string>, want int")
    assert all(r[0] == r[1] for r in df.select("want", evaluation.plurality(F.col("x"), [1, 2, 0])).collect())


def test_auc_equals_the_cross_join(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6) / 5, rng.randrange(2), rng.randrange(2)) for _ in range(80)]
    got = {r.g: r.auc for r in statistics.auc(spark.createDataFrame(rows, "s double, y int, g int"), "s", "y", ["g"]).collect()}
    for g in (0, 1):
        pos, neg = ([s for s, y, h in rows if y == c and h == g] for c in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-9


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k int, n int")
    lo, hi = statistics.wilson(F.col("k"), F.col("n"))
    rows = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0].lo == 0 and rows[1].hi == 1


def test_shapley_parts_sum_to_the_gap(spark):
    df = spark.createDataFrame([("x", 0, 10, 4, 1, 5), ("x", 1, 12, 9, 6, 3)], "c string, arm int, n int, hard int, right_hard int, right_easy int")
    r = statistics.shapley_two(df, ["c"]).first()
    assert abs(r.gap - r.mix_part - r.skill_part) < 1e-12


def test_token_accounting_groups_attempts_once(spark):
    from conftest import SF

    from sieveline.plans.audits import token_accounting

    plan = token_accounting(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # lines with orders; no second reading of the attempts is joined to the first
