"""Evaluation of repeated answers: votes, strategies, pairwise judgments, transitions.

attempts(pid, k, answer, ok): answer is a canonical value or null (unreadable, equal to nothing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_attempts(attempts: DataFrame, ks: list[int], more: list[str] | None = None) -> DataFrame:
    """One row a problem: pid, answers and oks as arrays in the order of ks, and arrays of more columns by their names;
    problems without all of them are left out."""
    more = more or []
    some = attempts.where(F.col("k").isin(ks)).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("answer", "ok", *more)))).alias("m"))
    full = some.where(F.size("m") == len(ks))
    return full.select("pid", *[F.array(*[F.col("m")[k][c] for k in ks]).alias(name) for c, name in [("answer", "answers"), ("ok", "oks"), *[(c, c) for c in more]]])


def plurality(answers: Column, priority: list[int]) -> Column:
    """Index (from 0) of the answer with the most equal ones, itself included; null answers have support 0. Ties, and
    all null, go to the first index of the priority list."""
    support = F.transform(answers, lambda x: F.when(x.isNull(), 0).otherwise(F.size(F.filter(answers, lambda y: y == x))))
    best = F.array_max(support)
    out = F.lit(None).cast("int")
    for i in reversed(priority):
        out = F.when(F.get(support, i) == best, F.lit(i)).otherwise(out)
    return out


def strategies(wide: DataFrame, priority3: list[int], priority5: list[int], more: list[str] | None = None) -> DataFrame:
    """pid and whether each strategy ends right, from five attempts (the first is the original): keep, blind1, maj3,
    maj5, agree_gated (the original if the first two agree, else maj3), oracle (any right); and more columns."""
    a, ok = F.col("answers"), F.col("oks")
    agree = F.coalesce(F.get(a, 0) == F.get(a, 1), F.lit(False))
    v3, v5 = plurality(F.slice(a, 1, 3), priority3), plurality(F.slice(a, 1, 5), priority5)
    base = wide.select("pid", *(more or []), F.get(ok, 0).alias("keep"), F.get(ok, 1).alias("blind1"), F.element_at(ok, v3 + 1).alias("maj3"), F.element_at(ok, v5 + 1).alias("maj5"), agree.alias("agree"), F.exists(F.slice(ok, 1, 5), lambda x: x).alias("oracle"))
    return base.withColumn("agree_gated", F.when(F.col("agree"), F.col("keep")).otherwise(F.col("maj3"))).withColumn("calls", F.when(F.col("agree"), 2).otherwise(3))


def strategy_table(scored: DataFrame, names: list[str], base: str = "keep") -> DataFrame:
    """(strategy, n, accuracy, fixes, harms, net): against the base strategy; one aggregation, then unpivoted."""
    aggs = []
    for s in names:
        aggs += [F.round(F.avg(F.col(s).cast("double")), 6).alias(f"{s}__a"), F.count_if(F.col(s) & ~F.col(base)).alias(f"{s}__f"), F.count_if(~F.col(s) & F.col(base)).alias(f"{s}__h")]
    row = scored.agg(F.count("*").alias("n"), *aggs)
    items = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col("n"), F.col(f"{s}__a").alias("accuracy"), F.col(f"{s}__f").alias("fixes"), F.col(f"{s}__h").alias("harms"), (F.col(f"{s}__f") - F.col(f"{s}__h")).alias("net")) for s in names])
    return row.select(F.explode(items).alias("x")).select("x.*")


def disagreement_pairs(attempts: DataFrame) -> DataFrame:
    """(pid, k, first, other, first_ok, other_ok, ord): attempt 1 against each later one with another answer, shown in
    both orders; null answers differ from all."""
    a = attempts.where("k = 1").select("pid", F.col("answer").alias("first"), F.col("ok").alias("first_ok"))
    b = attempts.where("k > 1").select("pid", "k", F.col("answer").alias("other"), F.col("ok").alias("other_ok"))
    pairs = a.join(b, "pid").where(~F.coalesce(F.col("first") == F.col("other"), F.lit(False)))
    return pairs.select("pid", "k", "first", "other", "first_ok", "other_ok", F.explode(F.array(F.lit("ab"), F.lit("ba"))).alias("ord"))


def order_swapped(judgments: DataFrame) -> DataFrame:
    """judgments(pid, k, ord, pick, ...) -> a row a pair with ab, ba and verdict: `first` or `other` if both orders name
    the same solution, else `inconsistent`."""
    per = judgments.groupBy("pid", "k").agg(F.max(F.when(F.col("ord") == "ab", F.col("pick"))).alias("ab"), F.max(F.when(F.col("ord") == "ba", F.col("pick"))).alias("ba"), F.max("right").alias("right"))
    x = F.when(F.col("ab") == "A", "first").when(F.col("ab") == "B", "other")
    y = F.when(F.col("ba") == "A", "other").when(F.col("ba") == "B", "first")
    return per.withColumn("verdict", F.when(x == y, x).otherwise("inconsistent"))


def judge_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of a judge over pairs(ab, ba, right, verdict) with one right solution: single-order accuracy, skill index,
    second-position rate, asymmetry, invented rate, coverage, consistent accuracy, tie-break accuracy and its gain, and
    the artifact that must equal the gain."""
    at_ab, at_ba = F.when(F.col("right") == "first", "A").otherwise("B"), F.when(F.col("right") == "first", "B").otherwise("A")
    hit = (F.col("ab") == at_ab).cast("double") + (F.col("ba") == at_ba).cast("double")
    none, invented = hit == 0, (F.col("ab") == "invented") | (F.col("ba") == "invented")
    consistent = F.col("verdict") != "inconsistent"
    tie = F.when(F.col("verdict") == F.col("right"), 1.0).when(~consistent, 0.5).otherwise(0.0)

    def rate(position: str, value: str) -> Column:
        n = F.sum((at_ab == position).cast("int") + (at_ba == position).cast("int"))
        x = F.sum(((at_ab == position) & (F.col("ab") == value)).cast("int") + ((at_ba == position) & (F.col("ba") == value)).cast("int"))
        return F.try_divide(x, n)

    decisive = F.sum(F.col("ab").isin("A", "B").cast("int") + F.col("ba").isin("A", "B").cast("int"))
    second = F.sum((F.col("ab") == "B").cast("int") + (F.col("ba") == "B").cast("int"))
    r = lambda c: F.round(c, 6)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_pairs"),
        r(F.avg(hit / 2)).alias("single_accuracy"),
        r(rate("A", "A") - rate("B", "A")).alias("skill_index"),
        r(F.try_divide(second, decisive)).alias("position_2_rate"),
        r(rate("B", "B") - rate("A", "A")).alias("asymmetry"),
        r(F.avg(((F.col("ab") == "invented").cast("double") + (F.col("ba") == "invented").cast("double")) / 2)).alias("invented_rate"),
        r(F.avg(consistent.cast("double"))).alias("coverage"),
        r(F.avg(F.when(consistent, (F.col("verdict") == F.col("right")).cast("double")))).alias("consistent_accuracy"),
        r(F.avg(tie)).alias("tie_break"),
        r(F.avg(tie) - F.avg(hit / 2)).alias("tie_minus_single"),
        r(F.avg(F.when(none & invented, 0.5).otherwise(0.0))).alias("invented_artifact"),
    )


def outcome_class(ab: Column, ba: Column, right: Column) -> Column:
    """consistent_right, consistent_wrong, locked_A, locked_B, invented_with_right or invented_without_right."""
    x = F.when(ab == "A", "first").when(ab == "B", "other")
    y = F.when(ba == "A", "other").when(ba == "B", "first")
    one = (x == right) | (y == right)
    return (
        F.when(x == y, F.when(x == right, "consistent_right").otherwise("consistent_wrong"))
        .when((ab == "A") & (ba == "A"), "locked_A")
        .when((ab == "B") & (ba == "B"), "locked_B")
        .when(F.coalesce(one, F.lit(False)), "invented_with_right")
        .otherwise("invented_without_right")
    )


def transition(initial_ok: Column, changed: Column, final_ok: Column) -> Column:
    """The named outcome of (was right, was changed, is right)."""
    return (
        F.when(initial_ok & ~changed, "kept_right")
        .when(initial_ok & changed & final_ok, "changed_stayed_right")
        .when(initial_ok & changed & ~final_ok, "harmed")
        .when(~initial_ok & ~changed, "kept_wrong")
        .when(~initial_ok & changed & final_ok, "fixed")
        .otherwise("changed_stayed_wrong")
    )


def weighted_vote(attempts: DataFrame) -> DataFrame:
    """attempts(pid, k, answer, weight) -> (pid, k): the attempt whose equal answers weigh most together; a null answer
    has only its own weight; ties go to the lowest k."""
    total = attempts.where("answer is not null").groupBy("pid", "answer").agg(F.sum("weight").alias("support"))
    scored = attempts.join(total, ["pid", "answer"], "left").withColumn("support", F.coalesce("support", "weight"))
    return scored.groupBy("pid").agg(F.max_by("k", F.struct(F.round("support", 9), -F.col("k"))).alias("k"))


def first_passing(candidates: DataFrame, key: str, order: str, ok: str, value: str) -> DataFrame:
    """(key, value): of the rows that pass, the one that comes first; keys without any are null."""
    return candidates.groupBy(key).agg(F.min_by(F.when(F.col(ok), F.col(value)), F.when(F.col(ok), F.col(order))).alias(value))


def log_prob_debiasing(pairs: DataFrame, source: str) -> DataFrame:
    """One row over pairs(source, m_ab, m_ba, first_right), m being the log-probability margin of A over B in each order:
    accuracy of single orders, of the mean of both (debiased), and of single orders less the position bias of all other
    sources; the gain splits into the removed bias and the second reading. Zero margins count one half."""
    bias = (F.col("m_ab") + F.col("m_ba")) / 2
    per = pairs.groupBy(F.col(source).alias("sieve_g")).agg(F.sum(bias).alias("gs"), F.count("*").alias("gn"))
    total = per.agg(F.sum("gs").alias("ts"), F.sum("gn").alias("tn"))
    loo = per.crossJoin(F.broadcast(total)).select("sieve_g", ((F.col("ts") - F.col("gs")) / F.greatest(F.col("tn") - F.col("gn"), F.lit(1))).alias("loo"))

    def score(m: Column, first_is_a: Column) -> Column:
        return F.when(m == 0, 0.5).otherwise(((m > 0) == first_is_a).cast("double"))

    right = F.col("first_right")
    rows = pairs.join(loo, F.col(source).eqNullSafe(F.col("sieve_g")))
    single = (score(F.col("m_ab"), right) + score(F.col("m_ba"), ~right)) / 2
    corrected = (score(F.col("m_ab") - F.col("loo"), right) + score(F.col("m_ba") - F.col("loo"), ~right)) / 2
    debiased = score((F.col("m_ab") - F.col("m_ba")) / 2, right)
    out = rows.agg(F.count("*").alias("n"), F.avg(single).alias("single"), F.avg(corrected).alias("corrected"), F.avg(debiased).alias("debiased"), F.avg(bias).alias("bias"))
    return out.select("n", "single", "corrected", "debiased", "bias", (F.col("corrected") - F.col("single")).alias("bias_removal"), (F.col("debiased") - F.col("corrected")).alias("two_readings"))


def verdict_log_probs(tokens: Column, prefix: str = "Solution") -> Column:
    """struct(position, A, B) of an array of struct(token, options array<struct(text, logprob)>): the largest
    log-probability of A and of B at the token after the last one that ends the prefix; null parts where there is none."""
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(F.trim(t["token"]).endswith(prefix), i + 1)), lambda i: i.isNotNull())
    at = F.when(F.size(ends) > 0, F.element_at(ends, -1))
    options = F.get(tokens, at)["options"]
    best = lambda side: F.array_max(F.transform(F.filter(options, lambda o: F.trim(o["text"]) == side), lambda o: o["logprob"]))
    return F.struct(at.alias("position"), best("A").alias("A"), best("B").alias("B"))


def resolve_references(refs: DataFrame, reference: str, rows: DataFrame, path: str, key: str) -> DataFrame:
    """refs with `found`: whether `path#id=ID` names a row of rows(path, key, ...); joined on both parts. A malformed
    reference is never found."""
    r = refs.withColumn("sieve_p", F.regexp_extract(reference, "^(.*)#id=(.*)$", 1)).withColumn("sieve_k", F.regexp_extract(reference, "^(.*)#id=(.*)$", 2))
    known = rows.select(F.col(path).alias("sieve_p"), F.col(key).cast("string").alias("sieve_k")).distinct().withColumn("found", F.lit(True))
    return r.join(known, ["sieve_p", "sieve_k"], "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("sieve_p", "sieve_k")


def checked_strategies(scored: DataFrame, verdict: Column, flagged: Column) -> DataFrame:
    """scored (of strategies()) with self_check (where the first two disagree: what the judge's verdict names, `first`
    or `other`, else maj3), probe_blind (the second attempt where the probe flags the first), and expectations:
    judge_or_random (a random one of the first two where the judge is inconsistent) and random_first_two."""
    number = lambda c: F.col(c).cast("double")
    half = (number("keep") + number("blind1")) / 2
    first = F.col("agree") | (F.col("v") == "first")
    rows = scored.withColumn("v", verdict).withColumn("flagged", flagged)
    return rows.select(
        "*",
        F.when(first, F.col("keep")).when(F.col("v") == "other", F.col("blind1")).otherwise(F.col("maj3")).alias("self_check"),
        F.when(F.col("flagged"), F.col("blind1")).otherwise(F.col("keep")).alias("probe_blind"),
        F.when(first, number("keep")).when(F.col("v") == "other", number("blind1")).otherwise(half).alias("judge_or_random"),
        half.alias("random_first_two"),
    )


def expected_table(rows: DataFrame, names: list[str], base: str = "keep") -> DataFrame:
    """(strategy, n, accuracy, gain): means of (expected) correctness, and the gain over the base strategy."""
    mean = {s: F.avg(F.col(s).cast("double")) for s in [*names, base]}
    row = rows.agg(F.count("*").alias("n"), *[F.round(mean[s], 6).alias(s) for s in names], *[F.round(mean[s] - mean[base], 6).alias(f"{s}__g") for s in names])
    items = F.array(*[F.struct(F.lit(s).alias("strategy"), "n", F.col(s).alias("accuracy"), F.col(f"{s}__g").alias("gain")) for s in names])
    return row.select(F.explode(items).alias("x")).select("x.*")


def detectors(rows: DataFrame, detector: str, flag: str, right: str) -> DataFrame:
    """(detector, flagged, wrong_recall, precision, correct_preservation) of flags against right answers."""
    f, ok = F.col(flag), F.col(right)
    rate = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6)
    return rows.groupBy(detector).agg(F.count_if(f).alias("flagged"), rate(f & ~ok, ~ok).alias("wrong_recall"), rate(f & ~ok, f).alias("precision"), rate(~f & ok, ok).alias("correct_preservation"))


def cost_table(rows: DataFrame, costs: dict[str, Column], always: str) -> DataFrame:
    """(strategy, mean_tokens, reduction): mean cost of each strategy, and what it saves against `always`."""
    row = rows.agg(*[F.avg(c).alias(s) for s, c in costs.items()])
    items = F.array(*[F.struct(F.lit(s).alias("strategy"), F.round(s, 4).alias("mean_tokens"), F.round(1 - F.col(s) / F.col(always), 6).alias("reduction")) for s in costs])
    return row.select(F.explode(items).alias("x")).select("x.*")


def position_preference(picks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, net_second, first_rate, lo, hi) of picks A, B or other: the mean of +1 for B and -1 for A, and the rate
    of A among A and B with its score interval."""
    from sieveline.operators.statistics import wilson

    a, b = F.count_if(F.col("pick") == "A"), F.count_if(F.col("pick") == "B")
    per = picks.groupBy(*by).agg(F.count("*").alias("n"), a.alias("a"), b.alias("b"))
    lo, hi = wilson(F.col("a"), F.col("a") + F.col("b"))
    return per.select(*by, "n", F.round((F.col("b") - F.col("a")) / F.col("n"), 6).alias("net_second"), F.round(F.try_divide(F.col("a"), F.col("a") + F.col("b")), 6).alias("first_rate"), lo.alias("lo"), hi.alias("hi"))


def rolled_up(cells: DataFrame, by: list[str], passed: str, majority: int) -> DataFrame:
    """(by, of, passed, verdict): general from `majority` passing cells on, conditional with any, else not supported."""
    n = F.count_if(passed)
    return cells.groupBy(*by).agg(F.count("*").alias("of"), n.alias("passed"), F.when(n >= majority, "general").when(n > 0, "conditional").otherwise("not supported").alias("verdict"))
