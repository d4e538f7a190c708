"""Quality classifier: the byte network over overlapping chunks that cover the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import byte_cnn
from sieveline.llm.common import prepare, rank_of, share_of, smallest
from sieveline.llm.language_id import held_out

#: Labelled rows of a class that the training reads at most; the bound holds at every size of the input.
PER_CLASS = 1500
#: Bytes from one chunk to the next; chunks of 256 bytes overlap by 64.
STRIDE = 192


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = byte_cnn.TRAIN_BYTES) -> byte_cnn.Net | None:
    """The network learned from docs(doc_id, text) with labels(doc_id, quality in 0, 1); None without both classes.

    Learned from are per_class rows a class, drawn by hash from the labelled rows of at most `most` bytes, with all
    their chunks. Of several labels of a document the smallest holds. The labels are drawn first, so only the drawn
    documents (about 1.5 * per_class + 40 a class) meet them in a broadcast join, and no text of others is shuffled.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = F.broadcast(share_of(marks, "quality", rank_of("doc_id"), -(-per_class * 6 // 5), 2))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= most)
    found = smallest(texts.join(some, "doc_id"), "quality", rank_of("doc_id", "text"), "text", per_class)
    marks = np.array([int(r["label"]) for r in found])
    if len(set(marks)) < 2:
        return None
    bags = [byte_cnn.cut(r["x"].encode("utf-8", "surrogatepass"), STRIDE) for r in found]
    share = np.bincount(marks, minlength=2) / len(marks)
    return byte_cnn.train(bags, marks, 2, weights=0.5 / share[marks], epochs=4)


def _score(net: byte_cnn.Net | None, columns: list[str], out: str):
    def run(batches):
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("sieve_text").to_pylist()]
            p = byte_cnn.predict(net, raw, STRIDE)[:, 1] if net is not None and raw else np.full(len(raw), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p, pa.float64())], [*columns, out])

    return run


def score(docs: DataFrame, net: byte_cnn.Net | None, keep: list[str], out: str = "score") -> DataFrame:
    """docs(text, keep..., ...) -> keep..., score (or as out names it): the probability of quality 1, from all chunks of the whole text.

    Null text scores as the empty text (one empty chunk); without a network every score is 0.5.
    """
    prepare(docs.sparkSession)
    src = docs.select(*keep, F.col("text").cast("string").alias("sieve_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + f", `{out}` double"
    return src.mapInArrow(_score(net, keep, out), schema)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    Learns only from labels of rows whose crc32(doc_id as text) mod folds is not fold. Null doc_id hashes as the
    empty text and has no label. Repeated rows are scored one by one, alike. Without labels of both classes every
    score is 0.5. Extra columns are ignored; an empty table gives an empty result.
    """
    out = held_out(F.col("doc_id"), folds, fold)
    net = fit(docs.where(~out), labels.where(~out))
    rows = docs.select("doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = score(rows, net, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
