"""What the operators of this subpackage share: session settings, shared storage, hashing and bounded samples."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: Python workers hold one batch of texts at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: A side is broadcast only below this many bytes (an upper bound worked out before the join).
BROADCAST_BYTES = 64 << 20

_made: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session; smaller settings stay. What operators return is computed later, so the
    bounds are not taken back."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may name none (tests): it gets a temporary one,
    while elsewhere executors would not see the driver's folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(where)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", where):  # as Spark would read it, so that Python reads the same place
        where = _place(spark, where)[0].makeQualified(_place(spark, where)[1]).toString()
    return re.sub("^file:/(?!/)", "file:///", where).rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path as Spark reads it."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(hadoop), at


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed by discard() or when the driver ends."""
    path = f"{shared_dir(spark)}/sieveline-{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing still to be computed reads."""
    for path in list(paths):
        fs, at = _place(spark, path)
        fs.delete(at, True)
        _made.remove(path)


def mark() -> int:
    return len(_made)


def discard_since(spark: SparkSession, begin: int) -> None:
    """Removes what was stored since mark() gave begin; what is to stay has a path from scratch() from before."""
    discard(spark, *_made[begin:])


def _clear() -> None:
    for path in _made:
        try:
            fs, at = pafs.FileSystem.from_uri(path)
            fs.delete_dir(at)
        except Exception:  # noqa: BLE001  the folder may be gone or need another client
            pass


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; lower() does that by itself where every character is one byte."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word [^\\x20\\x09-\\x0D]+, in order; bytes.split() splits at exactly these six bytes."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m] + np.uint64(n)
    for i in range(1, n):
        out = mix(out) + h[i : i + m]
    return mix(out)


def share_of(df: DataFrame, label: str, rank: Column, per_label: int, labels: int) -> DataFrame:
    """About per_label rows of each of the `labels` commonest labels of df (all of a rarer one): those whose rank, a
    64-bit hash, is low enough. Counts first; what passes is about 1.25 * per_label + 40 rows a label at every size of
    the input, the same ones on every run, but for rows of equal rank, which come or stay away together."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(labels)
    top = 2.0**63
    limit = -top + 2 * top * F.least(F.lit(1.0), F.lit(1.25 * per_label + 40) / F.col("count"))
    bound = sizes.select(F.col(label).alias("sieve_label"), limit.alias("sieve_limit"))
    found = df.join(F.broadcast(bound), F.col(label) == F.col("sieve_label"))
    return found.where(rank.cast("double") <= F.col("sieve_limit")).drop("sieve_label", "sieve_limit")


def rank_of(key: str, *more: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), *[F.col(c) for c in more], F.lit("sample"))


def smallest(df: DataFrame, label: str, rank: Column, payload: str, per_label: int) -> list:
    """Rows (label, h, x) with the per_label smallest ranks of each label, sorted. Rows of equal rank count once, which
    the tasks see to before anything is sent, so many equal rows don't meet."""
    rows = df.select(F.col(label).alias("label"), rank.alias("h"), F.col(payload).alias("x")).groupBy("label", "h").agg(F.first("x").alias("x"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return rows.withColumn("place", place).where(F.col("place") <= per_label).orderBy("label", "h").select("label", "h", "x").collect()
