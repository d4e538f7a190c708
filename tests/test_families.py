"""Families of near duplicates over whole texts."""

import random

from sieveline.plans import registry


def test_families_are_near_duplicates_not_shared_openings(spark, tmp_path):
    rng = random.Random(1)
    body = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    a, opening = body(200), body(15)
    rows = [(1, a), (2, "other start " + a), (3, "other start " + a + " end"), (4, "Other START " + a), (5, f"{opening} {body(200)}"), (6, f"{opening} {body(200)}"), (7, ""), (8, None), (9, "!"), (10, "!"), (11, "?")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.family, r.members) for r in registry.QUERIES["near_duplicate_families"](spark, str(tmp_path)).collect()}
    assert got == {(1, 4), (9, 2)}
