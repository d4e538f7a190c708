"""Language identification by the byte network: multi-width filters, max pooling and softmax over fixed windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm import byte_cnn
from sieveline.llm.common import prepare, rank_of, share_of, smallest

#: Labelled rows of a language that the training reads at most, and languages; both hold at every size of the input.
PER_LANGUAGE, LANGUAGES = 400, 250
#: Windows overlap by the widest filter less one, so that no byte sequence is cut apart.
STRIDE = byte_cnn.LENGTH - max(byte_cnn.WIDTHS) + 1
#: Bytes of the additional examples of a row, so that short texts are learned too.
SHORT = (40, 128)


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, key: str = "doc_id", label: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, most: int = byte_cnn.TRAIN_BYTES) -> tuple[list[str], byte_cnn.Net | None]:
    """Learned languages, sorted, and the network; docs(key, label, text) are the rows to learn from.

    Learned are the `languages` commonest ones, from per_language rows each, drawn by a hash of key and text from those
    of at most `most` bytes; of these rows all windows are examples, and one short cut of each length in SHORT.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.octet_length("text") <= most)
    rank = rank_of("key", "text")
    rows = smallest(share_of(docs, "label", rank, per_language, languages), "label", rank, "text", per_language)
    rows = [r for r in rows if any(map(str.isalpha, r["x"]))]
    names = sorted({r["label"] for r in rows})
    if not names:
        return [], None
    rng = np.random.Generator(np.random.PCG64(11))
    windows, of, weights = [], [], []
    for r in rows:
        raw = r["x"].encode("utf-8", "surrogatepass")
        own = list(byte_cnn.cut(raw, STRIDE)[:, None])
        for n in SHORT:
            at = int(rng.integers(max(1, len(raw) - n + 1)))
            own.append(byte_cnn.cut(raw[at : at + n], STRIDE)[:1])
        windows += own
        of += [names.index(r["label"])] * len(own)
        weights += [1 / np.sqrt(len(own))] * len(own)  # a long text counts for more than a short one, but not in proportion
    return names, byte_cnn.train(windows, np.array(of), len(names), weights=np.array(weights), epochs=3)


def _predict(names: list[str], net: byte_cnn.Net | None, columns: list[str], out: tuple[str, str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("sieve_text").to_pylist()
            ok = [i for i, t in enumerate(texts) if t and net is not None and any(map(str.isalpha, t))]
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if ok:
                p = byte_cnn.predict(net, [texts[i].encode("utf-8", "surrogatepass") for i in ok], STRIDE)
                pred[ok], score[ok] = np.array(names, object)[p.argmax(axis=1)], p.max(axis=1)
            made = [pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], [*columns, *out])

    return run


def identify(docs: DataFrame, names: list[str], net: byte_cnn.Net | None, keep: list[str], out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs(text, keep..., ...) -> keep..., lang_pred, score (or as out names them); only the text is read for a
    prediction, and kept columns pass through as they are.

    The score is the mean softmax over all windows of the whole text, at its largest language.
    Null text, text without a letter, or nothing learned: `und` with score 0. Columns outside keep are ignored.
    """
    prepare(docs.sparkSession)
    src = docs.select(*keep, F.col("text").cast("string").alias("sieve_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + f", `{out[0]}` string, `{out[1]}` double"
    return src.mapInArrow(_predict(names, net, keep, out), schema)


def predict_languages(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang, ...).

    Learns only from rows with a language whose crc32(doc_id as text) mod folds is not fold. A null doc_id hashes as
    the empty text. Repeated rows are predicted one by one, alike. An empty table gives an empty result.
    """
    out = held_out(F.col("doc_id"), folds, fold)
    names, net = fit(docs.where(~out))
    rows = docs.select("doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, names, net, ["doc_id", "held_out"])
