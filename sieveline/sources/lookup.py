"""Rows by lists of ids: a layout in which a list reads only the folders that can hold its ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "sieve_bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store(df: DataFrame, key: str, folder: str, rows_a_bucket: int = 1_000_000) -> None:
    """Writes df once into folders by hash of the key (cast to a string), sorted by it inside, with a Bloom filter of it
    in each file. The number of folders grows with the rows. Rows without a key can't be asked for and are left out."""
    rows = df.where(F.col(key).isNotNull())
    buckets = max(1, -(-rows.count() // rows_a_bucket))
    dealt = rows.withColumn(BUCKET, _bucket(F.col(key).cast("string"), buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, key)
    dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(BUCKET).parquet(f"{folder}/rows")
    df.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{folder}/layout")


def buckets_of(spark: SparkSession, folder: str, ids: DataFrame, id: str) -> tuple[int, list[int]]:
    """How many folders there are, and which of them can hold the ids: at most one number a folder comes to the driver."""
    n = spark.read.parquet(f"{folder}/layout").first()["buckets"]
    some = ids.where(F.col(id).isNotNull()).select(_bucket(F.col(id).cast("string"), n).alias("b")).distinct()
    return n, sorted(r.b for r in some.collect())


def fetch(spark: SparkSession, folder: str, ids: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(id, *columns) of the stored rows whose key is among the ids; ids asked for twice give their rows once. Only the
    folders of these ids are listed for the scan, only the columns named are read, and rows meet by an equi-join."""
    key = spark.read.parquet(f"{folder}/layout").first()["key"]
    n, some = buckets_of(spark, folder, ids, id)
    rows = spark.read.parquet(f"{folder}/rows")
    if len(some) < n:
        rows = rows.where(F.col(BUCKET).isin(some))
    wanted = ids.where(F.col(id).isNotNull()).select(F.col(id).alias("sieve_key")).distinct()
    return rows.join(wanted, F.col(key) == F.col("sieve_key"), "left_semi").select(F.col(key).alias(id), *columns)


def in_list_order(lists: DataFrame, owner: str, ids: str, found: DataFrame, id: str, text: str, sep: str = "\n") -> DataFrame:
    """(owner, n_asked, n_missing, missing, patch): the texts of each owner's list of ids in its order, joined by sep, and
    the ids that are not there, joined by commas. An id that is stored twice gives its smallest text, one that is listed
    twice gives it twice; a null id is missing. Lists are what one owner asks for and fit one row."""
    asked = lists.select(F.col(owner).alias("sieve_owner"), F.posexplode_outer(ids).alias("sieve_at", "sieve_key"))
    one = found.groupBy(F.col(id).alias("sieve_id")).agg(F.min(text).alias("sieve_text"), F.lit(True).alias("sieve_there"))
    both = asked.join(one, F.col("sieve_key") == F.col("sieve_id"), "left").where("sieve_at is not null or sieve_key is null")
    entry = F.when(F.col("sieve_at").isNotNull(), F.struct("sieve_at", F.coalesce("sieve_there", F.lit(False)).alias("there"), F.coalesce(F.col("sieve_key").cast("string"), F.lit("")).alias("key"), F.coalesce("sieve_text", F.lit("")).alias("text")))
    got = both.groupBy("sieve_owner").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    lost = F.filter("l", lambda x: ~x["there"])
    return got.select(
        F.col("sieve_owner").alias(owner),
        F.size("l").cast("long").alias("n_asked"),
        F.size(lost).cast("long").alias("n_missing"),
        F.array_join(F.transform(lost, lambda x: x["key"]), ",").alias("missing"),
        F.array_join(F.transform(F.filter("l", lambda x: x["there"]), lambda x: x["text"]), sep).alias("patch"),
    )
