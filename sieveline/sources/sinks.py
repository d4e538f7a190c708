"""Sinks: committed JSONL, write-once tables, CSV and Markdown reports, incremental appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sorted columns, one object a line; the committer makes all files visible at once."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").option("lineSep", "\n").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Fails if the target exists: results are opened once."""
    df.write.mode("errorifexists").parquet(path)


def csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """One CSV file with a header; for small samples."""
    (df if limit is None else df.limit(limit)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the target lacks; never recomputes or overwrites. Returns how many."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(*keys).distinct()
        new = df.join(have, keys, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new = df
    new = new.dropDuplicates(keys)
    seen = new.agg(F.count("*")).first()[0]
    if seen:
        new.write.mode("append").parquet(path)
    return seen


def markdown(df: DataFrame, title: str, digits: int = 3, limit: int = 1000) -> str:
    """A small table as Markdown; more rows than the limit is an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([f"## {title}", "", head, *(f"| {' | '.join(map(show, r))} |" for r in rows)]) + "\n"


def latex(df: DataFrame, digits: int = 3, limit: int = 1000) -> str:
    """The same as a LaTeX table."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%")
    body = " \\\\\n".join(" & ".join(map(show, r)) for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(c.replace('_', chr(92) + '_') for c in df.columns)} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}\n"
