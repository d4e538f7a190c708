"""Corpus curation: rejection cascades, duplicates, overlap, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.hashing import sha256
from sieveline.session import checkpoint, shared_folder

#: A side is broadcast only below this many bytes (an upper bound worked out before the join).
BROADCAST_BYTES = 64 << 20


def first_reason(guards: list[tuple[str, Column]]) -> Column:
    """The name of the first guard that holds, null if none: a row is charged to one reason. Their order matters."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in guards], F.lit(None).cast("string"))


def flags(tests: dict[str, str], text: Column) -> dict[str, Column]:
    """Named regex flags of a text, and `all_flags`."""
    out = {name: text.rlike(pattern) for name, pattern in tests.items()}
    every = F.lit(True)
    for c in out.values():
        every = every & c
    return out | {"all_flags": every}


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `rank_in_key`: 1 for the first row of each key in the given total order, more for its duplicates."""
    return df.withColumn("rank_in_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): the smallest order value of each key. An aggregation with a map-side part: a hot key costs one
    row a task, where a window would gather all its rows in one."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def first_marks(df: DataFrame, keys: list[str], id: str) -> DataFrame:
    """(id, kept): whether a row is the one with the smallest id of its keys; null keys are equal. Ids are unique and not
    null. The smallest ids are aggregated and meet the rows by id, so a key that most rows have gathers in no task."""
    first = df.groupBy(*keys).agg(F.min(id).alias("sieve_first")).select("sieve_first")
    return df.select(id).join(first, F.col(id) == F.col("sieve_first"), "left").select(id, F.col("sieve_first").isNotNull().alias("kept"))


def copy_members(df: DataFrame, key: str, id: str) -> DataFrame:
    """(first, copies, id): each row of a key with two rows or more, beside the smallest id and the number of its group; a
    row a member, as a group may be of any size. Null keys form no group."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("sieve_k"), F.col(id).alias("sieve_id"))
    groups = rows.groupBy("sieve_k").agg(F.count("*").alias("copies"), F.min("sieve_id").alias("first")).where("copies > 1")
    return rows.join(groups, "sieve_k").select("first", "copies", F.col("sieve_id").alias(id))


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """(key, copies) of every key with two rows or more."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, rows beyond the first, their share, groups of copies, largest group."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_unique"),
        (F.sum("n") - F.count("*")).alias("n_extra"),
        F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("extra_rate"),
        F.count_if(F.col("n") > 1).alias("n_groups"),
        F.max("n").alias("largest"),
    )


def hash_ranked(df: DataFrame, namespace: str, key: str, strata: list[str]) -> DataFrame:
    """df with `hash_rank` inside its stratum: order by SHA-256 of the namespaced key, then the key. Stands for every
    seeded shuffle or sample.

    A stratum may hold most rows, so none is numbered in one task: rows are numbered inside 4096 ranges of the hash,
    and each range starts after the counts of those before it in its stratum (4096 rows a stratum at most).
    """
    h = df.withColumn("sieve_h", sha256(namespace, F.col(key))).withColumn("sieve_b", F.substring("sieve_h", 1, 3))
    counts = h.groupBy(*[F.col(s).alias(f"sieve_s{i}") for i, s in enumerate(strata)], F.col("sieve_b").alias("sieve_c")).agg(F.count("*").alias("sieve_n"))
    before = F.sum("sieve_n").over(Window.partitionBy(*[f"sieve_s{i}" for i in range(len(strata))]).orderBy("sieve_c")) - F.col("sieve_n")
    start = counts.withColumn("sieve_before", before).drop("sieve_n")
    inside = h.withColumn("sieve_i", F.row_number().over(Window.partitionBy(*strata, "sieve_b").orderBy("sieve_h", key)))
    match = F.col("sieve_b") == F.col("sieve_c")
    for i, s in enumerate(strata):
        match = match & F.col(s).eqNullSafe(F.col(f"sieve_s{i}"))
    return inside.join(start, match).withColumn("hash_rank", F.col("sieve_i") + F.col("sieve_before")).select(*df.columns, "hash_rank")


def quota_sample(df: DataFrame, namespace: str, key: str, strata: list[str], quota: int) -> DataFrame:
    """The first quota rows of each stratum by hash order; Spark keeps quota rows a task before it shuffles."""
    order = Window.partitionBy(*strata).orderBy(sha256(namespace, F.col(key)), F.col(key))
    return df.withColumn("hash_rank", F.row_number().over(order)).where(F.col("hash_rank") <= quota)


def quota_shortfall(df: DataFrame, strata: list[str], quotas: DataFrame) -> DataFrame:
    """(strata, quota, n, missing) of strata that have fewer rows than quotas(strata, quota) ask for."""
    n = df.groupBy(*strata).agg(F.count("*").alias("n"))
    return quotas.join(n, strata, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("missing", F.col("quota") - F.col("n")).where("missing > 0")


def round_robin(df: DataFrame, group: str, namespace: str, key: str) -> DataFrame:
    """df with `turn`: one row of each group in turn, in hash order inside the group; a group of any size is numbered by
    ranges of the hash."""
    return hash_ranked(df, namespace, key, [group]).withColumnRenamed("hash_rank", "turn")


def balanced(df: DataFrame, label: str, namespace: str, key: str) -> DataFrame:
    """As many rows of each label as the rarest has, by hash rank; the count is an aggregation joined back."""
    least = df.groupBy(label).count().agg(F.min("count").alias("least"))
    return hash_ranked(df, namespace, key, [label]).crossJoin(F.broadcast(least)).where("hash_rank <= least").drop("least")


def capped(df: DataFrame, source: str, cap: int, order: list[str]) -> DataFrame:
    return keep_first(df, [source], order).where(F.col("rank_in_key") <= cap).drop("rank_in_key")


def overlap_by_keys(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, matches, kinds): rows of left that share any of the keys with right. One equi-join for each key, then
    a union: an OR join would compare all pairs."""
    parts = [
        left.where(F.col(k).isNotNull()).select(F.col(left_id).alias("l"), F.col(k).alias("k")).join(right.where(F.col(k).isNotNull()).select(F.col(right_id).alias("r"), F.col(k).alias("k")), "k").select("l", "r", F.lit(k).alias("kind"))
        for k in keys
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(F.col("l").alias(left_id)).agg(F.count_distinct("r").alias("matches"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def shared_keys(df: DataFrame, id: str, keys: list[str]) -> DataFrame:
    """(id, matches, kinds): for each row that shares any of the keys with other rows, how many these are, and by which
    keys. No pair is made: rows with the same keys are first put together with their number, and as a row matches by any
    key, its matches are the sums over one key, less those over two, and so on (at most four keys), less itself. A null
    key matches nothing; rows count, so ids should be unique; an empty table gives none."""
    from itertools import combinations

    if not 0 < len(keys) <= 4:
        raise ValueError("one to four keys")
    rows = df.select(F.col(id).alias("sieve_id"), *[F.col(k).alias(f"sieve_k{i}") for i, k in enumerate(keys)])
    names = [f"sieve_k{i}" for i in range(len(keys))]
    folder = shared_folder(df.sparkSession, "keys")  # each key is worked out once, not once a count
    rows.write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    cells = rows.groupBy(*names).agg(F.count("*").alias("sieve_n")).where(F.coalesce(*names).isNotNull())
    total, kinds = -F.lit(1).cast("long"), []
    out = cells
    for size in range(1, len(keys) + 1):
        for some in combinations(range(len(keys)), size):
            on, n = [names[i] for i in some], f"sieve_n{'_'.join(map(str, some))}"
            # all keys: the cell itself, which no other cell equals
            full = F.lit(True)
            for k in on:
                full = full & F.col(k).isNotNull()
            if size == len(keys):
                out = out.withColumn(n, F.when(full, F.col("sieve_n")))
            else:
                out = out.join(cells.where(full).groupBy(*on).agg(F.sum("sieve_n").alias(n)), on, "left")
            total = total + (1 if size % 2 else -1) * F.coalesce(F.col(n), F.lit(0))
            if size == 1:
                kinds.append(F.when(F.col(n) > 1, F.lit(keys[some[0]])))
    found = out.select(*[F.col(k).alias(f"{k}c") for k in names], total.alias("matches"), F.array_join(F.array_sort(F.array_compact(F.array(*kinds))), ",").alias("kinds")).where("matches > 0")
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}c"))
    return rows.join(found, same).select(F.col("sieve_id").alias(id), "matches", "kinds")


def gram_leaks(rows: DataFrame, grams: Column, protected: DataFrame, protected_grams: Column, row_id: str) -> DataFrame:
    """The ids of rows that hold any n-gram of a protected set: a semi-join of hashed n-grams, then exact."""
    keep = protected.select(F.explode(protected_grams).alias("g")).distinct()
    return rows.select(row_id, F.explode(grams).alias("g")).join(keep, "g", "left_semi").select(row_id).distinct()


def nearest(df: DataFrame, key: str, tokens: str, bank: DataFrame, bank_key: str, bank_tokens: str, k: int) -> DataFrame:
    """(key, bank_key, similarity, rank): the k bank rows with the highest Jaccard for each row; zero never counts.

    A bank under BROADCAST_BYTES is sent to the rows, each of which is compared with all of it where it lies: a word
    that all rows have costs nothing more. Beyond that rows meet on shared tokens, and counts give the intersections.
    """
    left = df.select(F.col(key).alias("l"), F.array_distinct(F.col(tokens)).alias("sl"))
    right = bank.select(F.col(bank_key).alias("r"), F.array_distinct(F.col(bank_tokens)).alias("sr"))
    size = right.agg(F.sum(F.octet_length(F.array_join("sr", " ")) + 16 * F.size("sr") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        pairs = left.crossJoin(F.broadcast(right)).withColumn("c", F.size(F.array_intersect("sl", "sr"))).where("c > 0")
        both = pairs.select("l", "r", F.size("sl").alias("nl"), F.size("sr").alias("nr"), "c")
    else:
        a = left.select("l", F.size("sl").alias("nl"), F.explode("sl").alias("t"))
        b = right.select("r", F.size("sr").alias("nr"), F.explode("sr").alias("t"))
        both = a.join(b, "t").groupBy("l", "r", "nl", "nr").agg(F.count("*").alias("c"))
    scored = both.withColumn("similarity", F.col("c") / (F.col("nl") + F.col("nr") - F.col("c")))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("similarity"), "r"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("l").alias(key), F.col("r").alias(bank_key), "similarity", "rank")


def families(edges: DataFrame) -> DataFrame:
    """(node, family) of an edge table (a, b): the smallest node of each connected component.

    Each round every node takes the smallest label among its neighbours and then that label's own label, so long
    chains halve; rounds end when no label changes. The lineage is cut by a checkpoint after each.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(edges.select(F.explode(ways).alias("x")).select("x.a", "x.b").distinct())  # a union would work edges out twice
    labels = checkpoint(both.select(F.col("a").alias("node")).distinct().withColumn("family", F.col("node")))
    while True:
        low = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("family").alias("low"))
        step = labels.join(low, F.col("node") == F.col("a")).select("node", F.least("family", "low").alias("family"), F.col("family").alias("was"))
        jump = step.select(F.col("node").alias("family"), F.col("family").alias("above"))
        new = checkpoint(step.join(jump, "family", "left").select("node", F.coalesce("above", "family").alias("family"), "was"))
        labels = new.select("node", "family")
        if new.where("family <> was").isEmpty():
            return labels


def disjointness(df: DataFrame, key: str, split: str) -> DataFrame:
    """One row: keys, and how many occur in more than one split (0 for a sound split)."""
    per = df.groupBy(key).agg(F.count_distinct(split).alias("n"))
    return per.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_leaking"))


def key_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, only left, only right, and keys repeated on either side."""
    a = left.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("nl"))
    b = right.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("nr"))
    j = a.join(b, "k", "full_outer")
    return j.agg(
        F.count_if(F.col("nl").isNotNull() & F.col("nr").isNotNull()).alias("n_both"),
        F.count_if(F.col("nr").isNull()).alias("n_left_only"),
        F.count_if(F.col("nl").isNull()).alias("n_right_only"),
        F.count_if(F.col("nl") > 1).alias("left_repeated"),
        F.count_if(F.col("nr") > 1).alias("right_repeated"),
    )


def missing_fields(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """(key, missing) of rows that lack required fields; missing names them."""
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.select(key, F.array_join(lacks, ",").alias("missing")).where("missing <> ''")


def constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each named rule; null counts as broken. One pass."""
    row = df.agg(*[F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.rule", "x.violations")


def match_lengths(targets: list, candidates: list) -> list[tuple[int, int, int]]:
    """(target, candidate, gap) of rows (length, id): targets by length take the nearest free candidate, the shorter of
    two as near, and of equal lengths the smallest id."""
    import bisect

    pool = sorted(map(tuple, candidates))
    left, right = list(range(len(pool) + 1)), list(range(len(pool) + 1))  # left: shifted by one, 0 is none

    def free(link: list[int], i: int) -> int:
        root = i
        while link[root] != root:
            root = link[root]
        while link[i] != root:
            link[i], i = root, link[i]
        return root

    out = []
    for length, t in sorted(map(tuple, targets)):
        at = bisect.bisect_left(pool, (length,))
        near = [i for i in (free(left, at) - 1, free(right, at)) if 0 <= i < len(pool)]
        if not near:
            break
        best = min(near, key=lambda i: (abs(pool[i][0] - length), pool[i]))
        if best < at:  # of equal shorter lengths the smallest id that is free
            first = free(right, bisect.bisect_left(pool, (pool[best][0],)))
            best = first if first <= best else best
        left[best + 1], right[best] = best, best + 1
        out.append((t, pool[best][1], abs(pool[best][0] - length)))
    return out


def greedy_length_match(df: DataFrame, stratum: str, schema_key: str = "id") -> DataFrame:
    """(stratum, target, candidate, gap): for each target in order of length the nearest unused candidate.

    df(stratum, id, length, is_target). Sequential by definition inside a stratum, so one task takes a stratum; used
    candidates are passed over by links to the next free one, so a stratum of n rows takes about n log n steps.
    """
    import pandas as pd

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        out = match_lengths(pdf.loc[pdf["is_target"], ["length", schema_key]].values.tolist(), pdf.loc[~pdf["is_target"], ["length", schema_key]].values.tolist())
        return pd.DataFrame([(pdf[stratum].iat[0], *row) for row in out], columns=[stratum, "target", "candidate", "gap"])

    return df.groupBy(stratum).applyInPandas(match, f"{stratum} string, target long, candidate long, gap long")


def shortlist(df: DataFrame, text: Column, wanted: list[str], unwanted: list[str]) -> DataFrame:
    """Rows whose text has all wanted patterns and none of the unwanted ones."""
    keep = F.lit(True)
    for p in wanted:
        keep = keep & text.rlike(p)
    for p in unwanted:
        keep = keep & ~text.rlike(p)
    return df.where(keep)


def level_reasons(df: DataFrame, level: str, allowed: list[str], key: str, prior: DataFrame, prior_key: str) -> DataFrame:
    """df with `reason`: `level` where the level is not allowed, `prior` where the key was used before, else null."""
    used = prior.select(F.col(prior_key).alias("sieve_k")).distinct().withColumn("sieve_used", F.lit(True))
    rows = df.join(used, F.col(key) == F.col("sieve_k"), "left")
    return rows.withColumn("reason", first_reason([("level", ~F.coalesce(F.col(level).isin(allowed), F.lit(False))), ("prior", F.col("sieve_used").isNotNull())])).drop("sieve_k", "sieve_used")


def allowed_split(split: str, allowed: list[str]) -> str:
    """The split, if it may be read; an error before any job runs if not."""
    if split not in allowed:
        raise ValueError(f"split {split!r} is not one of {allowed}")
    return split


def missing_of(present: Column, required: list[str]) -> Column:
    """The required values that an array lacks, in their order; empty if required is a subset."""
    return F.array_except(F.array(*map(F.lit, required)), present)


def union_of(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """All rows of all parts, with the part's name; columns that a part lacks are null."""
    out = None
    for part, df in parts.items():
        rows = df.withColumn(name, F.lit(part))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


#: Reasons for which a pair is rejected, and details that tell of no wrong meaning.
NON_SEMANTIC = r"(?i)syntax|indentation|nameerror|importerror|timeout"


def pair_quality(right: Column, wrong: Column, detail: Column) -> Column:
    """struct(reasons, ratio, similarity, tier) of a right and a wrong program: wrong is short, the same, of another
    length, unlike, fails for other than its meaning, or shares no function name. The tier says how alike they are."""
    from sieveline.functions.text import sequence_ratio

    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:def|class)\s+(\w+)"), F.lit(1)))
    ratio = F.least(F.length(right), F.length(wrong)) / F.greatest(F.length(right), F.length(wrong), F.lit(1))
    alike = sequence_ratio(right, wrong)
    tests = {
        "empty_or_too_short": F.length(wrong) < 30,
        "identical": F.trim(right) == F.trim(wrong),
        "length_ratio_below_0.5": ratio < 0.5,
        "similarity_too_low": alike < 0.4,
        "non_semantic_code_failure": detail.rlike(NON_SEMANTIC),
        "interface_mismatch": (F.size(names(right)) > 0) & ~F.arrays_overlap(names(right), names(wrong)),
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    tier = F.when(alike >= 0.8, "hard").when(alike >= 0.4, "medium").otherwise("easy")
    return F.struct(reasons.alias("reasons"), ratio.alias("ratio"), alike.alias("similarity"), tier.alias("tier"))


def build_episodes(rows: list[tuple]) -> list[tuple]:
    """(teaching, probe, probe, control) ids of rows (id, grams, erred, control) in order: a teaching row takes the first
    two unused erred rows that share no gram with it, and the first unused control, if that shares none either; where
    one is lacking, the teaching row is passed over. Each id is used once."""
    order = [(i, set(g)) for i, g, erred, _ in rows if erred]
    controls = [(i, set(g)) for i, g, _, control in rows if control]
    used, out = set(), []
    for i, grams in order:
        if i in used:
            continue
        used.add(i)
        # a row leaks or not by itself, so the first pair that fits is the first two that do
        free = [j for j, g in order if j not in used and not g & grams][:2]
        control = next(((j, g) for j, g in controls if j not in used and j not in free), None)
        if len(free) == 2 and control is not None and not control[1] & grams:
            used |= {*free, control[0]}
            out.append((i, *free, control[0]))
    return out


def episodes(df: DataFrame, grams: Column) -> DataFrame:
    """(error_type, episode, teaching, probe_1, probe_2, control) of df(id, error_type, erred, control): one task takes
    an error type, as each episode depends on those before it."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = build_episodes(list(zip(pdf["id"].tolist(), pdf["g"], pdf["erred"], pdf["control"])))
        return pd.DataFrame([(pdf["error_type"].iat[0], n, *e) for n, e in enumerate(found)], columns=["error_type", "episode", "teaching", "probe_1", "probe_2", "control"])

    hashed = F.transform(grams, lambda g: F.xxhash64(g))
    return df.select("id", "error_type", "erred", "control", hashed.alias("g")).groupBy("error_type").applyInPandas(run, "error_type string, episode long, teaching long, probe_1 long, probe_2 long, control long")
