"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window (window consecutive words of an item; an item of fewer words is one window) is a set of shingles with their
positions. It occurs in a document exactly if all its shingles do, so of the shingles of a window ordered by rarity
the necessary prefix has |S| - |S| + 1 = 1 token: the rarest. Rarity is the count of a shingle in the corpus.

1. One pass over the texts probes every position, for all shingle lengths at once, in the broadcast shingles of the
   benchmark, and stores each hit (row, position, shingle), and one row per document with its number of words. A hit
   is compared word by word, and no two shingles of the benchmark share a hash (checked; else another seed is taken),
   so from here on a hash stands for its words.
2. Counts of the stored hits order the shingles of each window; hits of the rarest one are candidates, which must pass
   the positional and length bounds: the window starts at the hit's position less the shingle's offset, and ends
   inside the document.
3. A candidate is verified by its other shingles: each must be a hit at its own position. Shingles of a window overlap
   or abut, so that is containment of the window, word for word. Texts are not read again.

The benchmark side is broadcast only in blocks of a bounded size: more shingles mean more passes over the documents,
never a larger broadcast or a shuffle of the corpus.

Texts are compared with A-Z lower-cased and all else as it is. lower() would change letters beyond ASCII too, and
translate() is slow, so UTF-8 bytes are read as Latin-1 characters, and these are lower-cased: bytes that continue a
character (80 to BF) stay, and a first byte that changes still differs from all others by the number of bytes that
follow it, so different texts stay different.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_BYTES, discard_since, mark, scratch, stored

#: A word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose bytes are lower-cased Latin-1 characters.
WORD = r"[0-9a-z\x80-\xFF]++"
#: Upper bound of what a broadcast row takes beside its words (checked, see _blocks).
ROW_BYTES = 200


def words_of(text: Column) -> Column:
    low = F.lower(F.decode(text.cast("string").cast("binary"), "ISO-8859-1"))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, k: int, seed: int) -> Column:
    """Hash of the words at, ..., at + k - 1 (from 0), null where they reach beyond the end."""
    return F.when(at + k <= F.size(words), F.xxhash64(*[F.get(words, at + i) for i in range(k)], F.lit(k), F.lit(seed)))


def windows(items: DataFrame, window: int) -> DataFrame:
    """(win, item_id, words): the distinct windows of each item; win identifies the words."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    w = w.select("item_id", F.slice("w", F.col("at") + 1, window).alias("words"))
    return w.select(F.sha2(F.array_join("words", " "), 256).alias("win"), "item_id", "words").distinct()


def _blocks(table: DataFrame, size: Column) -> list[DataFrame]:
    """table(h, ...) in parts by hash, each of about half of BROADCAST_BYTES, size being a row's bytes beyond ROW_BYTES."""
    total = table.agg(F.sum(size + ROW_BYTES)).first()[0] or 0
    n = max(1, -(-2 * total // BROADCAST_BYTES))
    return [table if n == 1 else table.where(F.pmod("h", F.lit(n)) == i) for i in range(n)]


def _parts(bare: DataFrame, shingle: int) -> tuple[DataFrame, int]:
    """(win, size, k, offset, token, h): the shingles of windows, stored, and the seed under which no two share h."""
    at = bare.withColumn("k", F.least(F.lit(shingle), F.size("words")))
    at = at.select("win", "words", "k", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("offset"))
    for seed in count():
        h = F.coalesce(*[F.when(F.col("k") == k, _shingle(F.col("words"), F.col("offset"), k, seed)) for k in range(1, shingle + 1)])
        parts = stored(at.select("win", F.size("words").alias("size"), "k", "offset", F.slice("words", F.col("offset") + 1, F.col("k")).alias("token"), h.alias("h")), "shingles")
        if parts.select("h", "token").distinct().groupBy("h").count().where("count > 1").isEmpty():
            return parts, seed


def _probe(keyed: DataFrame, tokens: DataFrame, lengths: list[int], seed: int) -> DataFrame:
    """(doc_id, fp, n_words, at, found) in one pass over keyed(doc_id, fp, w): the positions where tokens start, and
    for each row one with at = n_words; found has the hashes by length."""
    size = F.size("w")
    rows = keyed.select("doc_id", "fp", "w", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    for k in lengths:
        side = tokens.where(F.col("k") == k).select(F.col("h").alias(f"h{k}"), F.col("token").alias(f"t{k}"))
        same = (F.col(f"p{k}") == F.col(f"h{k}")) & (F.slice("w", F.col("at") + 1, k) == F.col(f"t{k}"))
        rows = rows.withColumn(f"p{k}", _shingle(F.col("w"), F.col("at"), k, seed)).join(F.broadcast(side), same, "left").drop(f"p{k}", f"t{k}")
    some = reduce(Column.__or__, [F.col(f"h{k}").isNotNull() for k in lengths])
    found = F.array_compact(F.array(*[F.col(f"h{k}") for k in lengths]))
    return rows.where(some | (F.col("at") == size)).select("doc_id", "fp", size.alias("n_words"), "at", found.alias("found"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, fingerprint: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs(doc_id, text, ...); with
    fingerprint also fp, the xxhash64 of the text, which with doc_id tells whose verdict a row is.

    items(item_id, text, ...) is the benchmark. A document word inside any occurrence of a window is hit; n_items
    counts the items with an occurring window; items_sha256 is the hash of their ids, sorted as strings and
    comma-joined (of the empty string where there are none).
    - Null or empty text has no words and is clean; an item without words, or with null text, has no windows.
    - Null doc_id is a value like any other; rows that repeat doc_id and text get equal results, and rows that share
      only a doc_id are judged each by its own text.
    - Items with null id count and sort as the string 'null'. Repeated items count once by id.
    - A very long text is held as its words by one task, at a time; all else about it are rows.
    - Extra columns are ignored; an empty benchmark leaves every document clean.
    """
    also = ["fp"] if fingerprint else []
    keyed = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("fp"), words_of(F.col("text")).alias("w"))
    spark = docs.sparkSession
    kept = [scratch(spark, what) for what in ("probed", "marks")]
    begin = mark()
    wins = stored(windows(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text"), window), "windows")
    parts, seed = _parts(wins.select("win", "words").distinct(), shingle)
    lengths = [r[0] for r in parts.select("k").distinct().orderBy("k").collect()]  # at most `shingle` values
    if not lengths:
        return keyed.select("doc_id", *also, F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))

    tokens = parts.select("k", "h", "token").distinct()
    passes = [stored(_probe(keyed, block, lengths, seed), "probed", None if i else kept[0]) for i, block in enumerate(_blocks(tokens, F.octet_length(F.array_join("token", " ")) + 16 * F.col("k")))]
    sizes = passes[0].where("at = n_words").select("doc_id", "fp", F.col("n_words").cast("long").alias("n_words"))
    hits = reduce(DataFrame.unionByName, passes).select("doc_id", "fp", "n_words", "at", F.explode("found").alias("h"))

    counts = hits.groupBy("h").count()  # of all rows, repeated ones too
    ranked = parts.join(counts, "h").withColumn("order", F.struct("count", "h", "offset"))
    whole = F.first("size") - F.first("k") + 1  # shingles of the window; one that never occurs has no count
    prefix = ranked.groupBy("win").agg(F.min("order").alias("rarest"), F.sort_array(F.collect_list(F.struct("offset", "h"))).alias("tokens"), F.first("size").alias("size"), (F.count("*") == whole).alias("possible"))
    prefix = stored(prefix.where("possible").select("win", "size", F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset"), F.transform("tokens", lambda t: t["h"]).alias("tokens")), "prefix")

    hits = hits.distinct()
    start = F.col("at") - F.col("offset")
    near = [hits.join(F.broadcast(block), "h") for block in _blocks(prefix, 16 * F.size("tokens"))]
    near = reduce(DataFrame.unionByName, near).where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    near = near.select("doc_id", "fp", "win", "size", start.alias("lo"), F.posexplode("tokens").alias("o", "h"))
    near = near.select("doc_id", "fp", "win", "size", "lo", (F.col("lo") + F.col("o")).alias("at"), "h").alias("c")
    seen = hits.select("doc_id", "fp", "at", "h").alias("s")
    met = near.join(seen, (F.col("c.fp") == F.col("s.fp")) & (F.col("c.at") == F.col("s.at")) & (F.col("c.h") == F.col("s.h")) & F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    met = met.groupBy("c.doc_id", "c.fp", "c.win", "c.lo", "c.size").agg(F.count("s.h").alias("met"), F.count("*").alias("all")).where("met = all")
    found = stored(met.select("doc_id", "fp", "win", "lo", (F.col("lo") + F.col("size")).alias("hi")), "found")

    before = Window.partitionBy("doc_id", "fp").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    cover = found.select("doc_id", "fp", "lo", "hi").distinct().withColumn("done", F.coalesce(F.max("hi").over(before), F.lit(0)))
    cover = cover.groupBy("doc_id", "fp").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "done"))).alias("n_hit"))
    # documents with the same windows have the same items, which are thus looked up once a set of windows
    sets = found.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("win")).alias("wins"))
    sets = stored(sets.select("doc_id", "fp", F.sha2(F.array_join("wins", ""), 256).alias("key"), "wins"), "sets")
    which = sets.groupBy("key").agg(F.first("wins").alias("wins")).select("key", F.explode("wins").alias("win")).join(wins.select("win", "item_id"), "win")
    which = which.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    which = which.select("key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    marks = cover.alias("c").join(sets.drop("wins").alias("s"), (F.col("c.fp") == F.col("s.fp")) & F.col("c.doc_id").eqNullSafe(F.col("s.doc_id"))).join(which, "key")
    marks = stored(marks.select(F.col("c.doc_id").alias("d"), F.col("c.fp").alias("f"), "n_hit", "n_items", "items_sha256"), "marks", kept[1])
    discard_since(spark, begin)
    side = F.broadcast(marks) if marks.count() * ROW_BYTES <= BROADCAST_BYTES else marks
    out = sizes.join(side, sizes["doc_id"].eqNullSafe(side["d"]) & (sizes["fp"] == side["f"]), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.sha2(F.lit(""), 256)
    return out.select("doc_id", *also, "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (hit > 0).alias("contaminated"))
