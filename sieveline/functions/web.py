"""URLs, JSON payloads and literals: parsed as data, never evaluated, numbers kept as text."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_url(url: Column) -> Column:
    """https, lower-case authority, path without trailing slashes (at least `/`), no query or fragment; null unless
    the url is http or https with an authority."""
    parts = F.regexp_extract(F.trim(url), r"^(?i:https?)://([^/?#]+)", 1)
    path = F.regexp_extract(F.trim(url), r"^(?i:https?)://[^/?#]+([^?#]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    return F.when(parts != "", F.concat(F.lit("https://"), F.lower(parts), F.when(path == "", "/").otherwise(path)))


def io_shape(payload: Column) -> Column:
    """struct(mode, pairs, fn_name) of a JSON payload {inputs, outputs, fn_name?}: missing, malformed, unpaired_or_empty,
    call_based or standard_input. VARIANT keeps numbers of any length from overflowing a typed column."""
    return _io(payload)


@F.pandas_udf(T.StructType().add("mode", T.StringType()).add("pairs", T.IntegerType()).add("fn_name", T.StringType()))
def _io(payload: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_shape(p) for p in payload], columns=["mode", "pairs", "fn_name"])


def _shape(text: str | None) -> tuple[str, int, str | None]:
    if text is None or not text.strip():
        return "missing", 0, None
    try:
        value = json.loads(text, parse_int=float)  # of any length
    except ValueError:
        return "malformed", 0, None
    sides = [value.get(k) for k in ("inputs", "outputs")] if isinstance(value, dict) else [None]
    if not all(isinstance(s, list) for s in sides):
        return "malformed", 0, None
    sizes = [len(s) for s in sides]
    if sizes[0] != sizes[1] or not sizes[0]:
        return "unpaired_or_empty", min(sizes), None
    name = value.get("fn_name")
    if name is not None and not isinstance(name, str):
        return "malformed", sizes[0], None
    return ("call_based" if name else "standard_input"), sizes[0], name or None


@F.pandas_udf(T.ArrayType(T.StringType()))
def string_list(text: pd.Series) -> pd.Series:
    """The strings of a JSON list or a Python list literal; null for anything else. Nothing is evaluated."""

    def one(t: str | None):
        if t is None or not t.strip():
            return None
        for parse in (json.loads, ast.literal_eval):
            try:
                value = parse(t)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
            return [x for x in value if isinstance(x, str)] if isinstance(value, list) else None
        return None

    return text.map(one)


def json_text(payload: Column, path: str) -> Column:
    """A field as text: integers of any length survive."""
    return F.get_json_object(payload, path)


def value_shape(value: Column) -> Column:
    """bool, number, null, str, list or object of a JSON text; malformed text is null."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(kind.isNull(), F.lit(None))
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "null")
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
        .when(kind == "STRING", "str")
        .when(kind.startswith("ARRAY"), "list")
        .otherwise("object")
    )


@F.udtf(returnType=T.StructType().add("depth", T.IntegerType()).add("path", T.StringType()).add("object", T.StringType()))
class NestedObjects:
    """Every object of a JSON text at any depth, with its path: a table function for lateral joins."""

    def eval(self, text: str):
        try:
            todo = [(0, "$", json.loads(text, parse_int=str, parse_float=str))] if text else []
        except ValueError:
            return
        while todo:
            depth, path, node = todo.pop()
            if isinstance(node, dict):
                yield depth, path, json.dumps(node, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
                todo += [(depth + 1, f"{path}.{k}", v) for k, v in sorted(node.items(), reverse=True)]
            elif isinstance(node, list):
                todo += [(depth + 1, f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]
