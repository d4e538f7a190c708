"""Incremental queries over events; each is checked against its batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.plans.corpus import t
from sieveline.plans.registry import query
from sieveline.session import shared_folder
from sieveline.streaming import logs


def stream_of(spark, sf_dir: str):
    schema = t(spark, sf_dir, "events").schema
    # a file source takes a folder: the table's own folder, narrowed to its files
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    """ST09: daily windows with a watermark."""
    return logs.windowed(t(spark, sf_dir, "events"), "ts", ["event_type"], "1 day")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def sliding_counts(spark, sf_dir):
    """ST09: windows of two hours, one every hour."""
    return logs.windowed(t(spark, sf_dir, "events"), "ts", ["event_type"], "2 hours", "1 hour")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events), g AS (SELECT *, sum((prev IS NULL OR ts >= prev + INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def session_counts(spark, sf_dir):
    """ST09: sessions of a user with gaps under six hours."""
    return logs.sessions(t(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def streamed_totals(spark, sf_dir):
    """ST01 ST02 ST04: events streamed in micro-batches into a table with a ledger of seen ids, then summed; running
    the stream again adds nothing."""
    folder = shared_folder(spark, "events")
    for _ in range(2):
        logs.drain_once(stream_of(spark, sf_dir), ["event_id"], f"{folder}/rows", f"{folder}/checkpoint")
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH p AS (SELECT event_id - (SELECT min(event_id) FROM events) AS i, event_type AS key, (SELECT count(*) FROM events) AS n FROM events
), l AS (SELECT 'all' AS log, i, key, key AS want FROM p UNION ALL SELECT 'first half', i, key, key FROM p WHERE 2 * i < n
  UNION ALL SELECT 'with a hole', i, key, key FROM p WHERE 2 * i < n AND i <> 3 UNION ALL SELECT 'other keys', i, CASE WHEN i % 5 = 2 THEN 'other' ELSE key END, key FROM p WHERE 2 * i < n)
SELECT log, count(*) AS n, count(*) = max(i) + 1 AND count(*) FILTER (key <> want) = 0 AS is_prefix FROM l GROUP BY 1""")
def resumable_prefix(spark, sf_dir):
    """ST01 W09: finished rows must be the first ones of the plan, the events numbered in order. Four logs, written and
    read back, are checked: all of it, its first half, that with a hole, and that with other keys."""
    folder = shared_folder(spark, "log")
    e = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"))
    ends = e.agg(F.min("event_id").alias("least"), F.count("*").alias("n")).first()
    plan = e.select((F.col("event_id") - F.lit(ends.least)).alias("i"), "key")
    half = plan.where(F.col("i") * 2 < ends.n)
    written = {"all": plan, "first half": half, "with a hole": half.where("i <> 3"), "other keys": half.withColumn("key", F.when(F.col("i") % 5 == 2, "other").otherwise(F.col("key")))}
    out = None
    for k, (name, rows) in enumerate(written.items()):
        rows.repartition("key").write.parquet(f"{folder}/{k}")
        one = logs.prefix_check(spark.read.parquet(f"{folder}/{k}"), plan, "i", "key").select(F.lit(name).alias("log"), "n", "is_prefix")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'hit' WHEN event_id % 3 = 1 THEN 'stale' ELSE 'miss' END AS state, count(*) AS n FROM events GROUP BY 1")
def cache_states(spark, sf_dir):
    """ST05 ST07: requests against a content-keyed cache."""
    e = t(spark, sf_dir, "events").select("event_id", F.sha2(F.col("props"), 256).alias("digest"))
    cache = e.where("event_id % 3 < 2").withColumn("digest", F.when(F.col("event_id") % 3 == 0, F.col("digest")).otherwise("old"))
    return logs.stale_entries(cache, e, "event_id", "digest").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT props) AS distinct_props FROM events GROUP BY 1")
def catalog_profile(spark, sf_dir):
    """Rows and exact distinct counts."""
    from sieveline.sources.readers import profile

    return profile(t(spark, sf_dir, "events"), ["event_type"], ["user_id", "props"]).withColumnRenamed("rows", "n")
