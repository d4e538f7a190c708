"""Content hashes as ranks, seeds, splits and identifiers; they replace random numbers everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(*parts: Column | str, sep: str = "|") -> Column:
    """Hex SHA-256 of the parts joined by sep; strings are literals, nulls count as empty."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(sep, *cols), 256)


def hash_int(*parts: Column | str, sep: str = "|") -> Column:
    """The first 32 bits of the hash, as a long: a seed (0 to 2^32 - 1)."""
    return F.conv(F.substring(sha256(*parts, sep=sep), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column | str, sep: str = "|") -> Column:
    """A uniform number in [0, 1) from the hash."""
    return hash_int(*parts, sep=sep) / F.lit(4294967296.0)


def hash_split(key: Column, namespace: str, modulus: int = 10, held: int = 0) -> Column:
    """`validation` where the hash of the namespaced key mod modulus is held, else `train`. Key by source, not by row."""
    return F.when(hash_int(namespace, key) % modulus == held, "validation").otherwise("train")


def family_id(prefix: str, parts: Column, length: int = 20) -> Column:
    """prefix + the start of the hash of the sorted distinct parts of an array: equal sets get equal ids."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(parts)), "\0"), 256), 1, length))


def canonical_json_hash(*columns: str) -> Column:
    """SHA-256 of a JSON object of the columns with sorted names and no white space; nulls are kept as null."""
    ordered = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)
