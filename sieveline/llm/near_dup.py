"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts makes the set of word shingles, a fingerprint of the whole set, a MinHash signature and
   the band keys. Documents with the same set form a class at once (an aggregation by fingerprint, so a group of
   exact copies of any size costs one row a task); only one representative of a class goes on.
2. Each band bucket links its members to its smallest member. Those pairs are compared by batches of signature
   values: after each batch the posterior probability that the similarity reaches the threshold, given the matches
   so far and a uniform prior, is P(Bin(n + 1, t) <= m); a pair under the miss probability is pruned. Survivors are
   verified exactly on full sets, and the verified links give the first components.
3. Buckets whose members still lie in several components are compared in full, in blocks of bounded size, but only
   between components and only in the first band that two members share; the same pruning follows. Pairs that
   survive stay packed in arrays: a pack meets the texts of its members once and verifies its pairs on their full
   sets. Every candidate pair of the banding is thus tested or already known to be connected, and no group is ever
   written out as all its pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_BYTES, discard, discard_since, grams, mark, mix, prepare, scratch, stored, word_hashes

BANDS, ROWS = 40, 4  #: a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^40 < 1e-9
MISS = 1e-9  #: posterior probability under which a pair is pruned
BATCH = 16  #: signature values compared at a time
BLOCK = 1024  #: members of a bucket compared with each other in one task at most, twice over
PACK = 1_000_000  #: shingles of the members of a pack at most, beyond two members
PAIRS = 500_000  #: pairs of rows held at a time
ROWS_A_TASK = 8000  #: rows of mixed buckets compared in one task, about
HOT, HOT_CLASSES = 10_000, 100_000  #: a class of more rows, or of more than that share of all, is labelled by broadcast

_seed = np.random.Generator(np.random.PCG64(20240229))
_A = (_seed.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _seed.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_SALT = _seed.integers(1, 2**63, BANDS, dtype=np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence as one where there are fewer words."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(grams(h, min(k, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    """32-bit MinHash values of a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        low = np.minimum(low, (x[i : i + 512, None] * _A + _B).min(axis=0))
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    v = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = _SALT.copy()
    for j in range(ROWS):
        key = mix(key + v[:, j])
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float = MISS, total: int = BANDS * ROWS, batch: int = BATCH) -> tuple:
    """For n = batch, 2 batch, ...: the least m of n matches with P(similarity >= threshold | m, n) >= miss."""
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survive(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (x[a[i]], y[b[i]]) of signature rows no batch prunes."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches(threshold)):
        at = slice(i * BATCH, (i + 1) * BATCH)
        same = same + (x[a[alive], at] == y[b[alive], at]).sum(axis=1)
        keep = same >= least
        alive, same = alive[keep], same[keep]
        if not len(alive):
            break
    return alive


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                if len(s):
                    sig = signature(s)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.astype(np.uint16).tobytes(), band_keys(sig)))
                else:
                    out.append((0, None, None, None))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            made = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_shingles", "fp", "sig", "bands"])

    return run


def _prune(percent: int):
    def run(batches):
        for pdf in batches:
            a = np.frombuffer(b"".join(pdf["sig_a"]), np.uint16).reshape(len(pdf), -1)
            b = np.frombuffer(b"".join(pdf["sig_b"]), np.uint16).reshape(len(pdf), -1)
            at = np.arange(len(pdf))
            yield pdf.iloc[survive(a, b, at, at, percent / 100)][["a", "b"]]

    return run


def _verify(k: int, percent: int):
    """Rows (a, b, text_a, text_b), sorted by a within a partition, so that a hub's set is made once. A document may have
    several texts, each with its rows."""

    def run(batches):
        last, text, s = None, None, None
        for pdf in batches:
            keep = []
            for a, x, y in zip(pdf["a"], pdf["text_a"], pdf["text_b"]):
                if a != last or x != text:
                    last, text, s = a, x, shingle_set(x, k)
                t = shingle_set(y, k)
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(small, large, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def partners(first: np.ndarray, last: np.ndarray, chunk: np.ndarray, alone: np.ndarray):
    """For each row of sorted groups [first, last): the range of rows that it is compared with.

    A group with i = j pairs all its rows; one with two blocks pairs its lower with its higher block.
    """
    row = np.arange(len(first))
    low = chunk == chunk[first]
    high = np.where(np.append(np.diff(chunk) != 0, True), row + 1, 0)  # ends of runs of equal chunk
    high = np.minimum(np.minimum.accumulate(np.where(high > 0, high, len(row))[::-1])[::-1], last)
    start = np.where(alone, row + 1, np.where(low, high, last))
    return start, np.maximum(last - start, 0)


def _cross(percent: int):
    """Rows (key, i, j, chunk, node, comp, n, sig, bands), whole groups (key, i, j) together and sorted by chunk:
    packs of pairs in different components that survive the pruning, each pair in the first band that it shares."""

    def packs(pdf: pd.DataFrame):
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), -1)
        bands = np.stack(pdf["bands"].to_numpy())
        key, i, j, chunk, node, comp, n = (pdf[c].to_numpy() for c in ("key", "i", "j", "chunk", "node", "comp", "n"))
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        first, last = begin[group], np.append(begin[1:], len(pdf))[group]
        start, count = partners(first, last, chunk, i == j)
        ends = np.cumsum(count)
        r = 0
        while r < len(pdf):
            stop = max(r + 1, int(np.searchsorted(ends, (ends[r - 1] if r else 0) + PAIRS, "right")))
            x = np.repeat(np.arange(r, stop), count[r:stop])
            y = np.arange(len(x)) - np.repeat(ends[r:stop] - count[r:stop] - (ends[r - 1] if r else 0), count[r:stop]) + np.repeat(start[r:stop], count[r:stop])
            r = stop
            ok = (comp[x] != comp[y]) & (node[x] != node[y])
            x, y = x[ok], y[ok]
            ok = survive(sig, sig, x, y, percent / 100)
            x, y = x[ok], y[ok]
            shared = (bands[x] == bands[y]).argmax(axis=1)
            ok = bands[x, shared] == key[x]
            x, y = x[ok], y[ok]
            smaller, larger = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y])
            ok = 100 * smaller >= percent * larger
            yield from _packed(x[ok], y[ok], node, n)

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            end = pdf.iloc[-1]
            same = ((pdf["key"] == end["key"]) & (pdf["i"] == end["i"]) & (pdf["j"] == end["j"])).to_numpy()
            cut = int(len(pdf) - np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on
            if cut:
                yield from packs(pdf.iloc[:cut])
            rest = pdf.iloc[cut:]
        if rest is not None and len(rest):
            yield from packs(rest)

    return run


def _packed(x: np.ndarray, y: np.ndarray, node: np.ndarray, n: np.ndarray):
    """Packs (pack, a, b) of pairs of rows x, y: the members of a pack hold about PACK shingles at most."""
    if not len(x):
        return
    out, a, b, members, size = [], [], [], set(), 0
    for p, q in zip(x.tolist(), y.tolist()):
        more = sum(int(n[v]) for v in (p, q) if v not in members)
        if a and size + more > PACK:
            out.append((a, b))
            a, b, members, size = [], [], set(), 0
            more = int(n[p]) + int(n[q])
        a.append(int(node[p]))
        b.append(int(node[q]))
        members.update((p, q))
        size += more
    out.append((a, b))
    yield pd.DataFrame([(uuid.uuid5(uuid.NAMESPACE_OID, f"{a}|{b}").hex, a, b) for a, b in out], columns=["pack", "a", "b"])


def _verify_pack(k: int, percent: int):
    """Texts of a pack's members, and the pack: the links among its pairs, by full sets."""

    def run(texts: pd.DataFrame, pack: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, k) for t in texts["text"]]
        by: dict[int, list[int]] = {}
        for at, node in enumerate(texts["node"].tolist()):  # a document may have several texts
            by.setdefault(node, []).append(at)
        _, ids = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
        size = np.array([len(s) for s in sets], np.int64)
        end = np.cumsum(size)
        inside = np.zeros(len(ids) + 1, bool)
        found = set()
        pairs: dict[int, set[int]] = {}
        for a, b in zip(pack["a"], pack["b"]):
            for p, q in zip(a, b):
                pairs.setdefault(int(p), set()).add(int(q))
        for p, others in pairs.items():
            for u in by.get(p, []):
                mine = ids[end[u] - size[u] : end[u]]
                inside[mine] = True
                for q in others:
                    for v in by.get(q, []):
                        both = int(np.count_nonzero(inside[ids[end[v] - size[v] : end[v]]]))
                        if both and 100 * both >= percent * (size[u] + size[v] - both):
                            found.add((min(p, q), max(p, q)))
                inside[mine] = False
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node on an edge (a, b): comp is the smallest node that it reaches.

    Alternating large-star and small-star steps on a stored edge table: the number of rounds grows with the
    logarithm of the graph, and each is two aggregations by node. Stops when a round changes nothing.
    """
    spark = edges.sparkSession
    path = scratch(spark, "cc")
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", path)
    seen = None
    while True:
        after, begin = scratch(spark, "cc"), mark()
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.where("u <> v").distinct(), "cc", after)
        discard_since(spark, begin)
        discard(spark, path)
        path = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if now == seen:  # a star forest: every node points at its smallest
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. A set holds the distinct k-word shingles, or the whole
    sequence where there are fewer words. Documents whose sets have 100 * intersection >= percent * union are linked.
    - Null or empty text, or one without words: an empty set, linked with nothing.
    - Null doc_id: linked with nothing, component_id null, kept true.
    - Rows that repeat a doc_id are one document: what any of them is linked with, all are.
    - Extra columns are ignored; an empty table gives an empty result. doc_id is a whole number, or a string of one.
    - A very long text is held with its shingles by one task, and again by those that verify its pairs.
    - Shingles are told apart by 64-bit hashes, of full sets as elsewhere: of m distinct ones about m / 2^64 share
      theirs with another, so a pair of sets of a million shingles each is misjudged by one shingle in 10^7 cases.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = [scratch(spark, what) for what in ("sketch", "classes", "final")]
    begin = mark()
    made = stored(docs.mapInArrow(_sketch(k), "doc_id long, n_shingles long, fp binary, sig binary, bands array<long>"), "sketch", kept[0])
    full = made.where("fp is not null and doc_id is not null")
    classes = stored(full.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes", kept[1])
    reps = full.select("doc_id", "fp", "sig", "bands", "n_shingles").join(classes.select("fp", F.col("node").alias("doc_id")), ["fp", "doc_id"])
    # a class whose smallest id comes in several rows has that many equal rows here
    reps = stored(reps.groupBy("fp").agg(F.first("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")).drop("fp"), "reps")
    member = reps.select("node", F.explode("bands").alias("key"))
    heads = member.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    near = stored(member.join(heads, "key"), "buckets")
    sig = reps.select("node", "sig")

    def pruned(pairs: DataFrame) -> DataFrame:
        left = sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
        right = sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInPandas(_prune(percent), "a long, b long").distinct()

    text = docs.join(reps.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        left = text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
        return both.sortWithinPartitions("a").mapInPandas(_verify(k, percent), "a long, b long").distinct()

    star = stored(pruned(near.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()), "star")
    links = stored(verified(star), "links")
    # several texts under one doc_id
    again = full.join(classes.select("fp", "node"), "fp").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).where("a <> b")
    links = links.unionByName(again.select("a", F.explode("all").alias("b")).where("a <> b"))
    first = stored(components(links), "first")

    placed = near.join(first, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low <> high")
    mixed = stored(mixed.select("key", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("g")), "mixed")
    load = mixed.agg(F.sum(F.col("m") * F.col("g"))).first()[0] or 0
    rows = placed.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", "node", "comp", "chunk", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"))
    rows = rows.join(reps.select("node", "sig", "bands", F.col("n_shingles").alias("n")), "node")
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), load // ROWS_A_TASK), "key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk", "node")
    packs = stored(rows.mapInPandas(_cross(percent), "pack string, a array<long>, b array<long>"), "packs")
    members = packs.select("pack", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).join(text.select(F.col("doc_id").alias("node"), "text"), "node")
    more = members.groupBy("pack").cogroup(packs.select(F.col("pack").alias("id"), "a", "b").groupBy("id")).applyInPandas(_verify_pack(k, percent), "a long, b long")
    more = stored(more.distinct(), "more")
    final = components(links.unionByName(more).unionByName(first.select(F.col("comp").alias("a"), F.col("node").alias("b")))) if not more.isEmpty() else first

    final = stored(final, "final", kept[2])
    discard_since(spark, begin)
    if final.count() * 32 <= BROADCAST_BYTES:
        final = F.broadcast(final)
    label = classes.join(final, "node", "left").select("fp", F.coalesce("comp", "node").alias("comp"), "n")
    # rows without a set meet nothing, and those of the largest classes, of which there are few, are not shuffled
    hot = max(HOT, made.count() // HOT_CLASSES)
    few = F.broadcast(label.where(F.col("n") > hot).select("fp", F.col("comp").alias("known")))
    rows = made.select("doc_id", "n_shingles", "fp").join(few, "fp", "left")
    open_rows = F.col("known").isNull() & F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    done = rows.where(~open_rows).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("known")).alias("comp"))
    out = rows.where(open_rows).join(label.where(F.col("n") <= hot), "fp").select("doc_id", "n_shingles", "comp").unionByName(done)
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
