"""Incremental inputs: ordered append logs, micro-batches, seen-id ledgers, stop rules and windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, files_a_batch: int = 64) -> DataFrame:
    """A stream over JSONL files that are added to a folder; offsets and commits live in the query's checkpoint."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("lineSep", "\n").json(path)


def drain(stream: DataFrame, table: str, checkpoint: str, path: str) -> None:
    """Takes all that is there in micro-batches into a Parquet folder and ends; run again, it goes on where it stopped."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(table).start()
    query.awaitTermination()


def new_rows(batch: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key that the ledger has not seen."""
    return batch.dropDuplicates(keys).join(ledger.select(*keys).distinct(), keys, "left_anti")


def _until(stream: DataFrame, step: Callable[[DataFrame, int], bool], checkpoint: str) -> None:
    """Runs step(batch, id) over all that is there and ends before the batch that follows a step that says so. That batch
    is refused by an error of its own, so its offsets are not committed and a later run starts with it; a batch that
    ended well is never run again. Any other failure is raised."""
    refusal = f"stopped by rule {uuid.uuid4().hex}"
    over = []

    def guarded(batch: DataFrame, i: int) -> None:
        if over:
            raise StopIteration(refusal)
        if step(batch, i):
            over.append(i)

    query = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if refusal not in str(e):
            raise


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a Parquet folder, none if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def drain_once(stream: DataFrame, keys: list[str], path: str, checkpoint: str, stop: Callable[[DataFrame], bool] | None = None) -> int:
    """Appends rows with unseen keys, batch by batch, and returns how many batches ran. A batch that is tried again
    after a failure adds nothing twice, as its keys are in the target then. stop(rows so far) ends the query after the
    batch in which it first holds; the rest stays for a later run."""
    spark = stream.sparkSession
    ran = []

    def step(batch: DataFrame, i: int) -> bool:
        new_rows(batch, _stored(spark, path, batch.schema), keys).write.mode("append").parquet(path)
        ran.append(i)
        return bool(stop and stop(spark.read.parquet(path)))

    _until(stream, step, checkpoint)
    return len(ran)


def scan_until(stream: DataFrame, counters: dict[str, Column], done: Callable[[dict[str, int]], bool], path: str, checkpoint: str) -> list[dict[str, int]]:
    """Scans a stream into a folder a batch until done(counters so far) holds, and returns the counters after each batch
    of this and of earlier runs with the same folder and checkpoint. Counters are aggregates that add up; each batch's are
    stored beside its rows (one row a batch), so no earlier row is read again. A batch tried again replaces its own
    folder. If the rule holds at the start, nothing is read."""
    spark = stream.sparkSession
    counts, schema = f"{path}-counters", T.StructType([T.StructField(c, T.LongType()) for c in ("batch", *counters)])

    def totals() -> list[dict[str, int]]:
        out: list[dict[str, int]] = []
        for r in sorted(_stored(spark, counts, schema).collect(), key=lambda r: r["batch"]):
            out.append({c: (r[c] or 0) + (out[-1][c] if out else 0) for c in counters})
        return out

    def step(batch: DataFrame, i: int) -> bool:
        folder = f"{path}/part={i}"
        batch.write.mode("overwrite").parquet(folder)
        row = spark.read.schema(batch.schema).parquet(folder).agg(*[c.cast("long").alias(n) for n, c in counters.items()])
        row.coalesce(1).withColumn("batch", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{counts}/part={i}")
        return done(totals()[-1])

    so_far = totals()
    if not so_far or not done(so_far[-1]):
        _until(stream, step, checkpoint)
    return totals()


def deduplicated(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once; with a time column the state is bounded by the watermark."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by event-time window; rows later than the delay are left out of a stream."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, time: str, by: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    return df.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def prefix_check(done: DataFrame, expected: DataFrame, index: str, key: str) -> DataFrame:
    """One row: n finished rows, and whether they are exactly the first n expected ones; resuming needs it to hold."""
    joined = done.select(index, F.col(key).alias("got")).join(expected.select(index, F.col(key).alias("want")), index, "left")
    return joined.agg(F.count("*").alias("n"), F.coalesce(F.max(index) + 1, F.lit(0)).alias("reach"), F.count_if(~F.coalesce(F.col("got") == F.col("want"), F.lit(False))).alias("wrong")).select("n", ((F.col("n") == F.col("reach")) & (F.col("wrong") == 0)).alias("is_prefix"))


def complete_lines(lines: DataFrame, file: str, number: str, text: str) -> DataFrame:
    """Lines with `complete`: only the last line of a file may be cut (no valid JSON), and is then kept as evidence;
    any other bad line is an error row (complete is null)."""
    good = F.try_parse_json(F.col(text)).isNotNull()
    last = F.col(number) == F.max(number).over(Window.partitionBy(file))
    return lines.withColumn("complete", F.when(good, True).when(last, False))


def stale_entries(cache: DataFrame, requests: DataFrame, key: str, digest: str) -> DataFrame:
    """Requests with `state`: hit (same digest), stale (same key, other digest: fatal to reuse) or miss."""
    c = cache.select(key, F.col(digest).alias("cached"))
    state: Column = F.when(F.col("cached").isNull(), "miss").when(F.col("cached") == F.col(digest), "hit").otherwise("stale")
    return requests.join(c, key, "left").withColumn("state", state).drop("cached")
