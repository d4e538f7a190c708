"""Sources, sinks, incremental inputs and sequential operators on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import curation, models, similarity
from sieveline.sources import readers, sinks
from sieveline.streaming import logs


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1,"t":"x y"}\n\n{"id":2,"t":"z"}\n', encoding="utf-8")
    rows = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").orderBy("id").collect()
    assert [(r.id, r.t) for r in rows] == [(1, "x y"), (2, "z")]
    (tmp_path / "b.jsonl").write_text('{"id":1}\n{bad\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "b.jsonl"), "id int").collect()
    assert readers.jsonl(spark, str(tmp_path / "b.jsonl"), "id int", strict=False).where("id is null").count() == 1


def test_json_tree_and_objects(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text(json.dumps({"q": "one", "in": [{"q": "two"}]}))
    (tmp_path / "b.jsonl").write_text('{"q":"three"}\noops\n')
    values, errors = readers.json_tree(spark, str(tmp_path))
    assert values.count() == 2 and errors.count() == 1
    assert readers.json_document(spark, str(tmp_path / "d/a.json")).first().q == "one"
    objects = readers.nested_objects(values.select("text"), "text")
    assert sorted(r.path for r in objects.collect()) == ["$", "$", "$.in[0]"]


def test_other_sources(spark, tmp_path):
    import numpy as np

    (tmp_path / "p.xml").write_text('<r><Problem ID="a"><Body>x</Body></Problem><Problem ID="b"><Body>y</Body></Problem></r>')
    assert {r["_ID"] for r in readers.xml(spark, str(tmp_path / "p.xml"), "Problem").collect()} == {"a", "b"}
    np.savez(tmp_path / "z.npz", arr=np.arange(6.0).reshape(2, 3))
    assert [list(r["values"]) for r in readers.array_archive(spark, str(tmp_path / "z.npz")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "h.txt").write_bytes(b"a\r\nb")
    (tmp_path / "i.txt").write_bytes(b"a\nb")
    assert len({r.sha256 for r in readers.file_hashes(spark, str(tmp_path / "*.txt"), normalize_newlines=True).collect()}) == 1
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert readers.projected(spark, str(tmp_path / "t"), ["id"]).count() == 3
    assert readers.with_position(spark.read.parquet(str(tmp_path / "t"))).select("file", "row").distinct().count() == 3
    with pytest.raises(ValueError, match="nope"):
        readers.projected(spark, str(tmp_path / "t"), ["nope"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    sinks.jsonl(df, str(tmp_path / "j"))
    assert readers.jsonl(spark, str(tmp_path / "j"), "id int, t string").count() == 2
    sinks.write_once(df, str(tmp_path / "w"))
    with pytest.raises(Exception):
        sinks.write_once(df, str(tmp_path / "w"))
    assert sinks.append_missing(df, str(tmp_path / "m"), ["id"]) == 2
    assert sinks.append_missing(df.union(spark.createDataFrame([(3, "c")], df.schema)), str(tmp_path / "m"), ["id"]) == 1
    sinks.csv(df, str(tmp_path / "c"))
    assert "| 1 | a |" in sinks.markdown(df, "T") and "tabular" in sinks.latex(df)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.jsonl").write_text('{"id":1}\n{"id":2}\n')
    args = (["id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    stream = lambda: logs.read_log(spark, str(tmp_path / "in"), "id int", 1)
    assert logs.drain_once(stream(), *args) == 1
    (tmp_path / "in/1.jsonl").write_text('{"id":2}\n{"id":3}\n')
    (tmp_path / "in/2.jsonl").write_text('{"id":4}\n')
    assert logs.drain_once(stream(), *args, stop=lambda rows: rows.count() >= 3) == 1
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2, 3}
    logs.drain_once(stream(), *args)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2, 3, 4}
    logs.drain(logs.deduplicated(stream(), "id"), "q", str(tmp_path / "cp2"), str(tmp_path / "out2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 4


def test_crash_tail(spark):
    lines = spark.createDataFrame([("f", 0, '{"a":1}'), ("f", 1, '{"a"'), ("g", 0, "{x"), ("g", 1, "{}")], "f string, n int, t string")
    got = {(r.f, r.n): r.complete for r in logs.complete_lines(lines, "f", "n", "t").collect()}
    assert got == {("f", 0): True, ("f", 1): False, ("g", 0): None, ("g", 1): True}


def test_curation(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.family) for r in curation.families(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    rows = spark.createDataFrame([("x", 1, 10, True), ("x", 2, 11, False), ("x", 3, 30, False), ("x", 4, 12, True)], "s string, id long, length long, is_target boolean")
    assert {(r.target, r.candidate, r.gap) for r in curation.greedy_length_match(rows, "s").collect()} == {(1, 2, 1), (4, 3, 18)}
    quotas = spark.createDataFrame([("x", 5), ("y", 1)], "s string, quota long")
    assert {(r.s, r.missing) for r in curation.quota_shortfall(rows, ["s"], quotas).collect()} == {("x", 1), ("y", 1)}
    assert curation.quota_sample(rows, "q", "id", ["s"], 2).count() == 2


def test_similarity_join_is_exact(spark):
    import random

    rng = random.Random(3)
    sets = [(i, rng.sample(range(30), rng.randint(0, 12))) for i in range(60)]
    sets += [(100 + i, s[:-1] if len(s) > 6 else s) for i, s in sets[:30]]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
    df = spark.createDataFrame(sets, "id long, s array<int>")
    assert {(r.a, r.b) for r in similarity.similarity_join(df, "id", "s", 0.8).collect()} == want


def test_models(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(40)], "id long, x double, y int")
    dealt = models.permuted_labels(df, "y", "id", "s")
    assert dealt.agg(F.sum("y")).first()[0] == 20 and dealt.count() == 40
    assert models.platt(df, "x", "y").where("calibrated between 0 and 1").count() == 40


@pytest.mark.parametrize("size", [4 << 20, 500])
def test_json_documents_of_many_rows_lose_none(spark, tmp_path, monkeypatch, size):
    from sieveline.plans import sources

    monkeypatch.setattr(sources, "JSON_BYTES", size)
    said = spark.range(3000, numPartitions=7).select((F.col("id") % 40).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 5 != 0, F.lit("é\n{[")).alias("text"))
    said.write.parquet(str(tmp_path / "conversations.parquet"))
    spread_out = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # rows dealt in turn by several tasks met in one file
    got = {r.conv_id: (r.turns, r.chars) for r in sources.json_documents(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", spread_out)
    assert got == {i: (75, 0 if i % 5 == 0 else 300) for i in range(40)}


def test_sets_are_worked_on_in_slices():
    """A batch of many sets takes little memory beyond itself, and slices change no row."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n = np.append(np.full(10_000, 3, np.int32), [0, similarity.SLICE_TOKENS + 5, 0]).astype(np.int32)
    tokens = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, int(n.sum()), dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(tokens))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), lists], ["id", "s"])
    tracemalloc.start()
    made = []
    for x in similarity._bitmaps(iter([batch])):
        made += zip(x.column("id").to_pylist(), x.column("n").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == list(zip(range(len(n)), n.tolist())) and peak < 64 << 20
