"""Stupid-backoff language-model scores from the counts of the whole corpus.

Documents are dealt into blocks of bounded size, a few together at a time. Each block explodes its n-grams and pre-aggregates them, so a
frequent n-gram costs one entry a block however hot it is, and sends each partition of the count table, a range of
the 64-bit hashes, its distinct n-grams with their counts. A partition adds the counts of all blocks and joins the
totals back to every block that named the n-gram; the block then scores its documents, n-gram by n-gram, and sums them
up. What moves is the text once, the distinct n-grams of each block once, and one number for each of those.

Entries travel packed: of a sorted list of hashes the low bytes as they are and the high bits in unary code, which
takes about five and a half bytes a hash, counts as compressed byte planes, texts as compressed bundles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import grams, prepare

ALPHA = 0.4  #: factor of each step back to a shorter context
BLOCK_BYTES = 12 << 20  #: text of a block, about
BUNDLE_ROWS, BUNDLE_BYTES = 64, 1 << 18  #: documents that are dealt together, and their text, beyond one document
PART_GRAMS = 1_000_000  #: n-grams of a partition of the count table, about, over all blocks


def pack_keys(keys: np.ndarray, part: int, parts: int) -> bytes:
    """Sorted distinct hashes of one part; the width of the low bytes follows from how dense they are."""
    base = -(-(part << 64) // parts)
    offset = keys - np.uint64(base)
    span = (1 << 64) // parts + 1
    low = 7
    while low > 1 and (span >> (8 * (low - 1))) <= 4 * len(keys):
        low -= 1
    high = (offset >> np.uint64(8 * low)).astype(np.int64)
    bits = np.zeros(int(high[-1]) + len(keys), np.bool_)
    bits[high + np.arange(len(keys))] = True
    raw = offset.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()
    return bytes([low]) + raw + np.packbits(bits).tobytes()


def unpack_keys(data: bytes, n: int, part: int, parts: int) -> np.ndarray:
    low = data[0]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :low] = np.frombuffer(data, np.uint8, n * low, 1).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1 + n * low)))[:n] - np.arange(n)
    return (wide.reshape(-1).view("<u8") | (high.astype(np.uint64) << np.uint64(8 * low))) + np.uint64(-(-(part << 64) // parts))


def pack_counts(counts: np.ndarray) -> bytes:
    planes = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


#: Order 0 is the empty n-gram, whose count is the corpus size.
_EMPTY = np.array([0x9E3779B97F4A7C15], np.uint64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys, and where each begins."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], at


def _parts_of(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, first, last) of the parts that sorted keys fall into; part p begins at p * 2^64 / parts, rounded up."""
    cuts = np.searchsorted(keys, np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)).tolist() + [len(keys)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _grams(hashes: list[np.ndarray], n: int) -> np.ndarray:
    """The n-grams of all documents, one after the other."""
    return np.concatenate([grams(h, n) for h in hashes]) if hashes else np.empty(0, np.uint64)


BUNDLE = "block int, ids array<string>, sizes array<long>, texts binary"


def _deal(blocks: int):
    """Bundles of consecutive rows (doc_id, text), each for a block drawn from its place in the input."""

    def bundles(batch):
        size = np.array([len(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()], np.int64)
        ends, i = np.cumsum(size), 0
        while i < batch.num_rows:
            full = int(np.searchsorted(ends, BUNDLE_BYTES + (ends[i - 1] if i else 0), "right"))
            j = min(batch.num_rows, i + BUNDLE_ROWS, max(i + 1, full))
            yield batch.slice(i, j - i), size[i:j].tolist()
            i = j

    def run(batches):
        task, n, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for some, sizes in bundles(batch):
                block = xxhash.xxh3_64_intdigest(f"{task}|{n}") % blocks
                texts = b"".join(x or b"" for x in some.column("text").cast(pa.binary()).to_pylist())
                rows.append((block, some.column("doc_id").to_pylist(), sizes, pack.compress(texts)))
                n += 1
            kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(made, ["block", "ids", "sizes", "texts"])

    return run


def _hashes(bundles: pd.DataFrame) -> list[np.ndarray]:
    """The word hashes of each document; bytes.split() splits at exactly the six bytes that no word holds."""
    out, unpack = [], zstandard.ZstdDecompressor()
    for sizes, texts in zip(bundles["sizes"], bundles["texts"]):
        raw, at = unpack.decompress(texts).lower(), 0
        for size in sizes:
            words = raw[at : at + size].split()
            out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            at += size
    return out


def _count(order: int, parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iat[0])
        hashes = _hashes(pdf)
        where = _parts_of(_EMPTY, parts)[0][0]
        rows = [(block, 0, where, 1, pack_keys(_EMPTY, where, parts), pack_counts(np.array([sum(map(len, hashes))])))]
        for n in range(1, order + 1):
            keys = _grams(hashes, n)
            keys.sort()
            distinct, at = _runs(keys)
            counts = np.diff(np.append(at, len(keys)))
            rows += [(block, n, p, b - a, pack_keys(distinct[a:b], p, parts), pack_counts(counts[a:b])) for p, a, b in _parts_of(distinct, parts)]
            del keys, distinct, at, counts
        return pd.DataFrame(rows, columns=["block", "n", "part", "size", "keys", "counts"])

    return run


def _total(parts: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        keys = np.concatenate([unpack_keys(k, n, part, parts) for k, n in zip(pdf["keys"], pdf["size"])])
        at = np.argsort(keys, kind="stable")
        _, first = _runs(keys[at])
        counts = np.concatenate([unpack_counts(c) for c in pdf["counts"]])
        total = np.empty(len(keys), np.int64)
        total[at] = np.repeat(np.add.reduceat(counts[at], first), np.diff(np.append(first, len(keys))))
        ends = np.cumsum(pdf["size"])
        return pd.DataFrame({"of": pdf["block"], "n": pdf["n"], "part": part, "totals": [pack_counts(total[e - s : e]) for e, s in zip(ends, pdf["size"])]})

    return run


def _elsewhere(keys: np.ndarray, doc: np.ndarray, totals: np.ndarray, others: bool) -> np.ndarray:
    """Corpus count of each n-gram of a block, less its occurrences in its own document; totals are by distinct key."""
    at = np.argsort(keys, kind="stable")  # so documents are in order within a key
    keys = keys[at]
    new = np.append(True, keys[1:] != keys[:-1])
    del keys
    value = totals[np.cumsum(new, dtype=np.int32) - 1]
    del totals
    if others:
        doc = doc[at]
        new[1:] |= doc[1:] != doc[:-1]
        run = np.flatnonzero(new)
        sizes = np.diff(np.append(run, len(new))).astype(np.int32)
        value -= np.repeat(sizes, sizes)
    out = np.empty(len(value), np.int64)
    out[at] = value
    return out


def _score(order: int, alpha: float, others: bool):
    def run(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        hashes = _hashes(pdf)
        sizes = np.array([len(h) for h in hashes], np.int64)
        made = pd.DataFrame({"doc_id": [i for ids in pdf["ids"] for i in ids], "n_words": sizes})
        full = unseen = np.zeros(len(sizes), np.int64)
        total = np.zeros(len(sizes))
        replies = {n: rows.sort_values("part")["totals"] for n, rows in replies.groupby("n")}
        corpus = int(unpack_counts(replies[0].iat[0])[0])
        words = np.cumsum(sizes) - sizes  # where the words of each document begin
        context = base = None
        for n in range(1, order + 1):
            per = np.maximum(sizes - n + 1, 0)
            if not per.any():
                break
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), per)
            count = _elsewhere(_grams(hashes, n), doc, np.concatenate([unpack_counts(t) for t in replies.pop(n)]), others)
            starts = np.cumsum(per) - per
            seen = count > 0
            if n == 1:
                left = np.maximum(corpus - (sizes if others else 0), 0)
                prob = (alpha / (left + 1))[doc]
                np.divide(count, np.maximum(left, 1)[doc], out=prob, where=seen)
                level = seen.astype(np.int8)
            else:
                place = np.arange(len(doc)) - starts[doc]
                context = context[base[doc] + place]
                place += words[doc] + n - 1  # the word that the n-gram ends with
                longer = prob[place] * alpha
                np.divide(count, np.maximum(context, 1, out=context), out=longer, where=seen)
                prob[place] = longer
                level[place[seen]] = n
                del place, longer
            context, base = count, starts
        if sizes.any():
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            total = np.bincount(doc, np.log(prob, out=prob), len(sizes))
            full, unseen = (np.bincount(doc, level == x, len(sizes)).astype(np.int64) for x in (order, 0))
        return made.assign(n_full=full, n_unseen=unseen, log_prob=total)

    return run


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = ALPHA, others: bool = True) -> DataFrame:
    """(doc_id, n_words, n_full, n_unseen, log_prob, score) for each row of docs(doc_id, text, ...).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; n-grams stay inside a document. S(w | context) is
    count(context w) / count(context) if the n-gram was counted, else alpha * S(w | shorter context); at the end
    count(w) / N, or alpha / (N + 1) for a word not counted. With others, the counts leave out the document's own
    occurrences, so that a document doesn't vouch for itself; its copies do. Words near the start have the context
    that there is. n_full counts words found with the whole context, n_unseen words not counted at all; log_prob is
    the sum of ln S, score its mean over the words.
    - Null or empty text: no words, log_prob 0, score null. Null doc_id is a value like any other.
    - Repeated rows are scored one by one and support each other; rows are dealt by their place in the input, so
      however many are alike, they don't meet in one block. Extra columns are ignored.
    - A text beyond BLOCK_BYTES makes its block so much larger, and is held by one task.
    - Two n-grams are told apart by 64-bit hashes: of m distinct ones about m / 2^64 share their hash with another.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-size // BLOCK_BYTES), min(least, size >> 20))
    parts = max(1, order * size // 8 // PART_GRAMS, min(least, size >> 20))
    keyed = base.mapInArrow(_deal(blocks), BUNDLE).repartition(blocks, "block")
    named = keyed.groupBy("block").applyInPandas(_count(order, parts), "block int, n int, part int, size long, keys binary, counts binary")
    replies = named.repartition(parts, "part").groupBy("part").applyInPandas(_total(parts), "of int, n int, part int, totals binary")
    scored = keyed.groupBy("block").cogroup(replies.repartition(blocks, "of").groupBy("of"))
    scored = scored.applyInPandas(_score(order, alpha, others), "doc_id string, n_words long, n_full long, n_unseen long, log_prob double")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("score", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
