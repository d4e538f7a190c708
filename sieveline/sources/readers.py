"""Sources: JSONL, JSON documents and trees, Parquet, XML, arrays, file hashes and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.web import NestedObjects


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped, with its file as `_file`. strict: a malformed line is an error; else it
    is a row of nulls with the line in `_corrupt_record`. Only \\n ends a line, so other separators inside text stay."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("lineSep", "\n").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return reader.schema(schema).json(path).withColumn("_file", F.col("_metadata.file_path"))


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON artifacts, one row a file (or array element)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_tree(spark: SparkSession, root: str, lines: str = "*.jsonl", documents: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(values, errors) of all .json and .jsonl files under a folder: (file, value VARIANT, text), and unparseable texts.
    A file of the one name pattern gives a value a line, one of the other a single value; nothing is fatal."""
    each = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", lines).text(root).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", documents).option("wholetext", True).text(root).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    both = each.unionByName(whole).where(F.trim("text") != "").withColumn("value", F.try_parse_json("text"))
    return both.where("value is not null"), both.where("value is null").select("file", "text")


def nested_objects(df: DataFrame, column: str) -> DataFrame:
    """Every object at any depth of a JSON text column: df's columns with depth, path and object."""
    return df.lateralJoin(NestedObjects(F.col(column).outer()))


def projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a Parquet table, pruned in the scan; a missing one is an error that names it."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df.select(*columns)


def with_position(df: DataFrame) -> DataFrame:
    """A file-based table with (file, row): stable ids for positional metadata, never the order of rows."""
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("row", F.col("_metadata.row_index"))


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def array_archive(spark: SparkSession, path: str, name: str = "arr") -> DataFrame:
    """(file, row, values array<double>) of a numpy archive's named 2-D array: read as binary files in tasks."""
    import io

    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    a = z[name]
                yield pd.DataFrame({"file": file, "row": range(len(a)), "values": [r.astype(float).ravel() for r in a]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row long, values array<double>")


def file_hashes(spark: SparkSession, path: str, normalize_newlines: bool = False) -> DataFrame:
    """(file, bytes, sha256) of files; with CRLF read as LF on demand."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select(F.col("path").alias("file"), F.col("length").alias("bytes"), content_hash(F.col("content"), normalize_newlines).alias("sha256"))


def content_hash(content: Column, normalize_newlines: bool = False) -> Column:
    """SHA-256 of bytes; with CRLF read as LF on demand."""
    if normalize_newlines:
        content = F.encode(F.replace(F.decode(content, "UTF-8"), F.lit("\r\n"), F.lit("\n")), "UTF-8")
    return F.sha2(content, 256)


def profile(df: DataFrame, by: list[str], distinct: list[str]) -> DataFrame:
    """Rows, and exact distinct counts, of each group of a table."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct])
