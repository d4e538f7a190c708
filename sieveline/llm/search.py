"""Ranked lexical search by sort-based accumulation.

1. Items become terms with their numbers, in blocks whose dictionaries have a bounded size; each block is one pass over
   the documents, so a larger bank means more passes, not more memory.
2. The pass splits each whole text into terms and keeps, packed, those that an item of the block holds. Numbers of
   documents and terms, and how many documents hold a term, are sums over all documents.
3. A task joins its documents' terms to the items that hold them by concatenating arrays (item, document, impact), sorts
   the packed keys of item and document by radix, and adds the impacts of equal keys. A document lies in one task, so
   sums are whole. Of each item the best `top` so far are kept by a heap.
4. The tasks' candidates are dealt by ranges of (item, score), of which each keeps its best again; the rest, at most
   `top` of an item and range, are ranked.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import discard_since, mark, prepare, scratch, stored

BLOCK_TERMS = 200_000  #: (item, term) pairs of a block, about
TRIPLES = 2_000_000  #: item-document-impact triples held at a time
RANGE_ROWS = 100_000  #: candidates of a range, about

_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters A-Z (lower-cased), a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _item_terms(batches):
    for batch in batches:
        rows = [(i, t, n) for i, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()) for t, n in Counter(terms_of(text)).items()]
        made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, [pa.string(), pa.binary(), pa.int64()])]
        yield pa.RecordBatch.from_arrays(made, ["item", "term", "n"])


def _index(number: dict[bytes, int]):
    """Rows (doc_id, n, terms, tf) of documents that hold a term of the block, n being all terms of the text; one row a
    task with docs and n (documents with a term, and their terms) and, in terms and tf, which terms how many hold."""

    def run(batches):
        held, docs, length = Counter(), 0, 0
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                docs, length = docs + 1, length + len(found)
                mine = [(number[t], c) for t, c in Counter(found).items() if t in number]
                held.update(t for t, _ in mine)
                if mine and key is not None:
                    packed = np.array(mine, "<i8")
                    out.append((key, len(found), None, packed[:, 0].astype("<i4").tobytes(), packed[:, 1].tobytes()))
            yield _batch(out)
        packed = np.array(sorted(held.items()), "<i8").reshape(-1, 2)
        yield _batch([(None, length, docs, packed[:, 0].astype("<i4").tobytes(), packed[:, 1].tobytes())])

    return run


_INDEX = "doc_id long, n long, docs long, terms binary, tf binary"


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "n", "docs", "terms", "tf"])


def _held(batches):
    for batch in batches:
        for terms, tf in zip(batch.column("terms").to_pylist(), batch.column("tf").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i4")), pa.array(np.frombuffer(tf, "<i8"))], ["term", "df"])


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts non-negative keys of so many bits: stable passes over 16 bits each, lowest first, each of
    which numpy does by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum of impacts), sorted by item and doc."""
    if not len(item):
        return item, doc, impact
    width = max(1, int(doc.max()).bit_length())
    keys = (item << width) | doc
    order = radix_order(keys, width + max(1, int(item.max()).bit_length()))
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begin] >> width, keys[begin] & ((1 << width) - 1), np.add.reduceat(impact[order], begin)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, length: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * docs) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _score(first: np.ndarray, items: np.ndarray, times: np.ndarray, weight: np.ndarray, docs: int, length: int, top: int):
    """Items [first[t], first[t + 1]) of items hold term t, times so often. Rows (item, doc_id, score) of the best."""
    degree = np.diff(first)

    def part(best, ids, n, size, term, tf):
        at = np.repeat(np.arange(len(ids)), size)
        value = impacts(tf, n[at], weight[term], docs, length)
        many = degree[term]
        spot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[term], many)
        item, doc, score = accumulate(items[spot], np.repeat(at, many), np.repeat(value, many) * times[spot])
        begin = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else []
        for lo, hi in zip(begin, np.append(begin[1:], len(item))):
            heap = best.setdefault(int(item[lo]), [])
            least = heap[0][0] if len(heap) == top else 1
            for j in (np.flatnonzero(score[lo:hi] >= least) + lo).tolist():
                entry = (int(score[j]), -int(ids[doc[j]]))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            terms, tfs = ([np.frombuffer(v, kind) for v in batch.column(c).to_pylist()] for c, kind in (("terms", "<i4"), ("tf", "<i8")))
            size = np.array([len(t) for t in terms])
            load = np.cumsum([int(degree[t].sum()) for t in terms])
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + TRIPLES, "right")))
                part(best, ids[lo:hi], n[lo:hi], size[lo:hi], np.concatenate(terms[lo:hi]), np.concatenate(tfs[lo:hi]))
                lo = hi
        rows = [(i, -d, s) for i, heap in best.items() for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, [pa.int32(), pa.int64(), pa.int64()])], ["item", "doc_id", "score"])

    return run


def _best(top: int):
    def run(batches):
        best: dict[str, list] = {}
        for pdf in batches:
            for item, doc, score in zip(pdf["item"], pdf["doc_id"], pdf["score"]):
                heap = best.setdefault(item, [])
                entry = (score, -doc)
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        yield pd.DataFrame([(i, -d, s) for i, heap in best.items() for s, d in heap], columns=["item", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row's item of items(item_id, text, ...) the `top` best documents of
    docs(doc_id, text, ...) with a score above 0, equal scores by ascending doc_id; ranks from 1 are unique.

    A document's score sums weight * (10^9 tf div (1000 tf + 12 m)) over the item's terms with repeats, in 64-bit
    integers: weight = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + 25 n N div L.
    - Null or empty texts, and those without a term, are no documents; items like that have no rows.
    - Rows with a null doc_id count in N, L and df but are not ranked; rows that repeat a doc_id are ranked each.
    - Rows that repeat an item_id are one item with the terms of all. A null item_id is left out.
    - A very long text is held with its terms by one task. Extra columns are ignored; an empty table gives no rows.
      doc_id is a whole number, or a string of one.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    kept, begin = scratch(spark, "ranked"), mark()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    asked = stored(asked.mapInArrow(_item_terms, "item string, term binary, n long").groupBy("item", "term").agg(F.sum("n").alias("n")), "items")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("term", "item").collect()  # bounded by the block
        names = sorted({r.item for r in held})
        place = {name: i for i, name in enumerate(names)}
        number: dict[bytes, int] = {}
        for r in held:
            number.setdefault(bytes(r.term), len(number))
        index = stored(docs.mapInArrow(_index(number), _INDEX), "index")
        docs_n, length = index.where("docs is not null").agg(F.sum("docs"), F.sum("n")).first()
        if not docs_n or not held:
            continue
        df = np.zeros(len(number), np.int64)
        for r in index.where("docs is not null").select("terms", "tf").mapInArrow(_held, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weight = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        first = np.append(0, np.cumsum(np.bincount([number[bytes(r.term)] for r in held], minlength=len(number))))
        score = _score(first, np.array([place[r.item] for r in held], np.int64), np.array([r.n for r in held], np.int64), weight, docs_n, length, top)
        named = F.broadcast(spark.createDataFrame(list(place.items()), "name string, item int"))
        best = index.where("docs is null").mapInArrow(score, "item int, doc_id long, score long").join(named, "item").select(F.col("name").alias("item"), "doc_id", "score")
        best = stored(best, "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    ranges = -(-max(1, found.count()) // RANGE_ROWS)
    found = found.repartitionByRange(ranges, "item", F.desc("score"), "doc_id").mapInPandas(_best(top), "item string, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = stored(ranked.select(F.col("item").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked", kept)
    discard_since(spark, begin)
    return ranked
