"""Partial aggregates of shards, stored one by one and merged only if they are just the shards that the plan names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "shard long, lo long, hi long, n long"


def plan_of(df: DataFrame, position: str, shards: int) -> DataFrame:
    """(shard, lo, hi, n): at most that many ranges [lo, hi) of equal width over the positions, and the rows of each;
    ranges without a row are left out. Rows without a position belong to no shard."""
    ends = df.agg(F.min(position).alias("lo"), F.max(position).alias("hi")).first()
    if ends.lo is None:
        return df.sparkSession.createDataFrame([], MANIFEST)
    width = (ends.hi - ends.lo) // shards + 1
    shard = F.floor((F.col(position) - ends.lo) / width).cast("long")
    rows = df.where(F.col(position).isNotNull()).groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))
    return rows.select("shard", (F.col("shard") * width + ends.lo).alias("lo"), ((F.col("shard") + 1) * width + ends.lo).alias("hi"), "n")


def write_shard(df: DataFrame, shard: int, lo: int, hi: int, by: list[str], sums: dict[str, Column], folder: str) -> None:
    """Stores what one shard comes to: a row a group, and a manifest row of its range and rows. A shard is written once;
    the manifest comes last, so a shard that was broken off is a missing one, not a short one."""
    parts = df.groupBy(*by).agg(F.count("*").alias("sieve_n"), *[c.alias(name) for name, c in sums.items()])
    parts.write.mode("errorifexists").parquet(f"{folder}/partials/shard={shard}")
    schema = T.StructType([T.StructField("sieve_n", T.LongType())])
    n = df.sparkSession.read.schema(schema).parquet(f"{folder}/partials/shard={shard}").agg(F.coalesce(F.sum("sieve_n"), F.lit(0)).alias("n"))
    n.select(F.lit(shard).cast("long").alias("shard"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), "n").write.mode("errorifexists").parquet(f"{folder}/manifest/part={shard}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def problems(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """(shard, problem): shards that are `missing`, `unplanned`, `repeated`, `moved` (another range than planned, so
    they leave a gap or overlap) or `short` (another number of rows), the first that holds; none if all is as planned.
    Both are (shard, lo, hi, n)."""
    got = stored.groupBy("shard").agg(F.count("*").alias("copies"), F.min("lo").alias("glo"), F.max("hi").alias("ghi"), F.max("n").alias("gn"))
    both = plan.join(got, "shard", "full_outer")
    kind = (
        F.when(F.col("copies").isNull(), "missing")
        .when(F.col("n").isNull(), "unplanned")
        .when(F.col("copies") > 1, "repeated")
        .when((F.col("glo") != F.col("lo")) | (F.col("ghi") != F.col("hi")), "moved")
        .when(F.col("gn") != F.col("n"), "short")
    )
    return both.select("shard", kind.alias("problem")).where("problem is not null")


def merge(spark: SparkSession, folder: str, plan: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(by, n, sums) of all shards together; an error that names the first problems if they are not those of the plan."""
    wrong = problems(plan, manifest(spark, folder)).orderBy("shard").limit(10).collect()
    if wrong:
        raise ValueError("shards are not as planned: " + ", ".join(f"{r.shard} {r.problem}" for r in wrong))
    return spark.read.parquet(f"{folder}/partials").groupBy(*by).agg(F.sum("sieve_n").alias("n"), *[F.sum(c).alias(c) for c in sums])
