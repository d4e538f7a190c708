"""Quality rules: base counts of a text, and its divergence from the reference of its language.

A reference holds, over all documents of a language, the histogram of character classes and that of its commonest
words. A document's own two histograms are compared with them by the Jensen-Shannon distance (base 2, 0 to 1). Small
samples diverge by chance, about as 1 / sqrt(n), so short texts are not judged and limits fall with the length. Without
a reference of its own language a document is only compared in characters, all letters taken as one class, with all
documents: the words, the case and the script of other languages say nothing about it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_BYTES, grams, prepare, stored

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
TOP = 50  #: common words of a language; all others are one class
LEAST_DOCS = 20  #: a language needs so many documents for a reference, however many there are of others
REFERENCE_BYTES = 2000  #: upper bound of a reference as it is sent to each worker
MIN_WORDS = 50  #: shorter texts pass
CHAR_LIMIT, CHAR_NOISE = 0.24, 0.8  #: a text fails above limit + noise / sqrt(characters)
WORD_LIMIT, WORD_NOISE = 0.27, 1.4  #: the same over words

#: Class of each byte: lower case, upper case, digit, space, other white space, sentence marks, exclamation mark, other
#: ASCII, first byte of a Latin letter, first byte of another character; later bytes of a character (10) don't count.
CLASSES = 10
_CLASS = np.full(256, 9)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c == " " else 4 if _c in "\t\n\x0b\x0c\r" else 5 if _c in ".,;:?'\"-()" else 6 if _c == "!" else 7
_CLASS[0x80:0xC0] = 10
_CLASS[0xC2:0xCA] = 8
#: The same with all letters, and other characters beyond ASCII, as one class.
_FOLD = np.array([0, 0, 1, 2, 3, 4, 5, 6, 0, 0])


def classes(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    total = sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q))
    return float(np.sqrt(min(1.0, max(0.0, total / 2))))


def base_counts(text: str | None) -> tuple[tuple[int, int, int, int, int], bytes, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the UTF-8 text, and the hash of each word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 5:
        _, inverse, counts = np.unique(grams(h, 5), return_inverse=True, return_counts=True)
        twice = (counts > 1)[inverse]
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            edge[: len(twice)] += twice
            edge[5 : 5 + len(twice)] -= twice
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    spaces = len(raw) - len(raw.translate(None, SPACE))
    return (n, len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat), raw, h


def references(docs: DataFrame, top: int = TOP) -> tuple[DataFrame, np.ndarray | None]:
    """A table (lang, ref_chars, ref_words, ref_common) with a row for each language of LEAST_DOCS documents: its class
    histogram, its number of words, and the hashes and counts of its commonest words. And the folded class histogram of
    all documents, with or without a language; null if they are under LEAST_DOCS."""

    def sums(batches):
        for pdf in batches:
            by: dict = {}
            for lang, text in zip(pdf["lang"], pdf["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                by[lang] = by.get(lang, 0) + np.concatenate([classes(raw), [len(raw.split()), 1]])
            yield pd.DataFrame([(k, *map(int, v)) for k, v in by.items()], columns=["lang", *names])

    def hashed(batches):
        for pdf in batches:
            h = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in pdf["w"]]
            yield pd.DataFrame({"lang": pdf["lang"], "h": np.array(h, np.uint64).view(np.int64), "n": pdf["count"]})

    names = [*(f"c{i}" for i in range(CLASSES)), "words", "docs"]
    docs = docs.where("text is not null").select("lang", "text")
    parts = docs.mapInPandas(sums, "lang string, " + ", ".join(f"{n} long" for n in names))
    total = stored(parts.groupBy("lang").agg(*[F.sum(n).alias(n) for n in names]), "references")
    every = total.agg(*[F.sum(n) for n in names]).first()
    rest = fold(np.array(every[:CLASSES], float)) if (every[-1] or 0) >= LEAST_DOCS else None
    total = total.where(F.col("lang").isNotNull() & (F.col("docs") >= LEAST_DOCS))
    kept = total.select("lang")
    words = docs.join(F.broadcast(kept) if _few(kept) else kept, "lang", "left_semi")
    words = words.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").groupBy("lang", "w").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))
    common = words.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "w", "count").mapInPandas(hashed, "lang string, h long, n long")
    common = common.groupBy("lang").agg(F.collect_list(F.struct("h", "n")).alias("ref_common"))
    hist = F.array(*names[:CLASSES]).alias("ref_chars")
    return stored(total.join(common, "lang", "left").select("lang", hist, F.col("words").alias("ref_words"), "ref_common"), "references"), rest


def _few(refs: DataFrame) -> bool:
    return refs.count() * REFERENCE_BYTES <= BROADCAST_BYTES


def _arrays(chars: list, words: int, common: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class histogram, sorted hashes of the common words, their counts with the rest last) of a row of references."""
    h = np.array([x["h"] for x in common or []], np.int64).view(np.uint64)
    n = np.array([x["n"] for x in common or []], float)
    at = np.argsort(h)
    return np.array(chars, float), h[at], np.append(n[at], words - n.sum())


def fold(hist: np.ndarray) -> np.ndarray:
    return np.bincount(_FOLD, hist)


def word_histogram(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Counts of the common words (sorted hashes), and of all others."""
    if not len(common):
        return np.array([len(h)], float)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    hit = common[at] == h
    return np.append(np.bincount(at[hit], minlength=len(common)), len(h) - int(hit.sum())).astype(float)


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def _judge(refs: dict | None, rest: np.ndarray | None, min_words: int):
    """refs: language -> reference; None if the rows bring the reference of their language with them."""

    def run(batches):
        for batch in batches:
            out, known = [], {} if refs is None else refs
            for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())):
                counts, raw, h = base_counts(text)
                n, repeat = counts[0], counts[4]
                failed = n < 10 or 100 * repeat > 20 * n
                char = word = None
                good = True
                if refs is None and lang not in known:
                    chars = batch.column("ref_chars")[i].as_py()
                    known[lang] = chars and _arrays(chars, batch.column("ref_words")[i].as_py(), batch.column("ref_common")[i].as_py())
                ref = known.get(lang)
                if n >= min_words and (ref or rest is not None):
                    hist = classes(raw)
                    char = distance(hist, ref[0]) if ref else distance(fold(hist), rest)
                    good = char <= CHAR_LIMIT + CHAR_NOISE / np.sqrt(hist.sum())
                    if ref:
                        word = distance(word_histogram(h, ref[1]), ref[2])
                        good = good and word <= WORD_LIMIT + WORD_NOISE / np.sqrt(n)
                out.append((*counts, failed, not failed and bool(good), char, word))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            made = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(RESULT), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *RESULT])

    return run


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance,
    word_distance) for each row of docs(doc_id, text, lang, ...).

    Words are [^\\x20\\x09-\\x0D]+. base_failed: under 10 words, or over a fifth of the words lie in 5-word windows that
    occur twice or more. kept: not base_failed, and both distances within their limits, which texts under min_words
    always are (their distances are null).
    - Null or empty text: no words, so base_failed. A document whose language is null or has under LEAST_DOCS documents
      is judged in characters by all documents (word_distance is null); if those are under LEAST_DOCS, nothing diverges.
    - References go to each worker if they are few (BROADCAST_BYTES), else documents are joined to them by language.
    - Repeated rows are judged one by one, alike; null doc_id is kept as it is. Extra columns are ignored.
    """
    prepare(docs.sparkSession)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    refs, rest = references(base)
    if _few(refs):
        by = {r["lang"]: _arrays(r["ref_chars"], r["ref_words"], r["ref_common"]) for r in refs.collect()}
        return base.mapInArrow(_judge(by, rest, min_words), schema)
    return base.join(refs, "lang", "left").mapInArrow(_judge(None, rest, min_words), schema)
