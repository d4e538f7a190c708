"""Round trips through sources and sinks: a table is written in a format, to the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import hashing, text
from sieveline.plans.corpus import t
from sieveline.plans.registry import query
from sieveline.plans.streams import stream_of
from sieveline.session import shared_folder
from sieveline.sources import lookup, readers, shards, sinks
from sieveline.streaming import logs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")


@query("SELECT event_id, event_type, user_id, props FROM events")
def jsonl_round_trip(spark, sf_dir):
    """A table written as committed JSON lines and read back with its schema."""
    folder = shared_folder(spark, "jsonl")
    sinks.jsonl(_events(spark, sf_dir), folder)
    return readers.jsonl(spark, folder, "event_id long, event_type string, user_id long, props string").drop("_file")


#: Bytes of text of one JSON document, about.
JSON_BYTES = 4 << 20


@query("SELECT conv_id, count(*) AS turns, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY 1")
def json_documents(spark, sf_dir):
    """Whole-file JSON arrays, an element a row."""
    folder = shared_folder(spark, "json")
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(64, -(-n_bytes // JSON_BYTES))
    some = rows.withColumn("part", F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(parts))).groupBy("part").agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "text")), {"pretty": "true"}).alias("value"))
    # of a file with several documents only the first would be read
    some.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    back = readers.json_document(spark, folder, "conv_id long, turn long, text string")
    return back.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'value' END AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def json_tree_inventory(spark, sf_dir):
    """A tree of JSON lines in folders, of which some lines cannot be parsed; nothing is fatal."""
    folder = shared_folder(spark, "tree")
    e = t(spark, sf_dir, "events")
    whole = F.to_json(F.struct("user_id", "props"))
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), F.col("user_id").cast("string"))).otherwise(whole)
    parts = e.select(line.alias("value"), (F.col("event_id") % 3).alias("folder"))
    parts.write.partitionBy("folder").text(folder)
    # Spark's text writer names its files .txt, so the inventory takes the files of the tree by that name
    values, errors = readers.json_tree(spark, folder, lines="*.txt")
    good = values.select(F.lit("value").alias("kind"), F.variant_get("value", "$.user_id", "long").alias("user"))
    bad = errors.select(F.lit("error").alias("kind"), F.substring("text", 2, 40).cast("long").alias("user"))
    return good.unionByName(bad).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"))


@query("""SELECT depth, path, count(*) AS n, count(DISTINCT object) AS kinds FROM (
  SELECT 0::INT AS depth, '$' AS path, user_id || '|' || (event_id % 5) AS object FROM events UNION ALL SELECT 1, '$.a', (user_id || '') FROM events
  UNION ALL SELECT 2, '$.b[0]', (event_id % 5)::VARCHAR FROM events) GROUP BY 1, 2""")
def nested_objects(spark, sf_dir):
    """Every object of a JSON text at any depth, by a table function."""
    one = F.format_string('{"a": {"u": %d}, "b": [{"m": %d}]}', "user_id", F.col("event_id") % 5)
    found = readers.nested_objects(t(spark, sf_dir, "events").select(one.alias("j")), "j")
    return found.groupBy("depth", "path").agg(F.count("*").alias("n"), F.count_distinct("object").alias("kinds"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def projected_columns(spark, sf_dir):
    """Named columns of a Parquet table, pruned in the scan."""
    o = readers.projected(spark, f"{sf_dir}/orders.parquet", ["o_orderpriority", "o_totalprice"])
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n, count(*) AS places, count(DISTINCT event_id) AS ids, 0::BIGINT AS misplaced FROM events")
def positional_alignment(spark, sf_dir):
    """Metadata aligned by file and row: written beside the table, joined back by place, never by order."""
    folder = shared_folder(spark, "place")
    e = readers.with_position(t(spark, sf_dir, "events")).select("file", "row", "event_id")
    sinks.write_once(e.withColumnRenamed("event_id", "noted"), folder)
    both = e.join(spark.read.parquet(folder), ["file", "row"])
    return both.agg(F.count("*").alias("n"), F.count_distinct("file", "row").alias("places"), F.count_distinct("event_id").alias("ids"), F.count_if(F.col("event_id") != F.col("noted")).alias("misplaced"))


@query("SELECT count(*) AS scanned, count(*) FILTER (lang = 'en') AS kept, max(doc_id) AS last FROM documents")
def observed_scan(spark, sf_dir):
    """A scan of two columns with its counters, in one pass; an Observation would give the same, but once a session
    has one, fitted models cannot be sent to tasks any more."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.agg(F.count("*").alias("scanned"), F.count_if(F.col("lang") == "en").alias("kept"), F.max("doc_id").alias("last"))


@query("SELECT page_id, url FROM pages")
def xml_round_trip(spark, sf_dir):
    """Rows as XML elements."""
    folder = shared_folder(spark, "xml")
    t(spark, sf_dir, "pages").select("page_id", "url").write.format("xml").option("rowTag", "page").option("rootTag", "pages").save(folder)
    return readers.xml(spark, folder, "page", "page_id long, url string")


@query("SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS most, round(list_min(embedding)::DOUBLE, 6) AS least, len(embedding)::INT AS size FROM embeddings")
def array_archives(spark, sf_dir):
    """Vectors written as archives of dense arrays, a batch each, and read back by row."""
    import io
    import uuid

    import numpy as np
    import pyarrow.fs as pafs

    folder = shared_folder(spark, "npz")

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        for pdf in batches:
            if not len(pdf):
                continue
            raw, name = io.BytesIO(), f"{uuid.uuid4().hex}.npz"
            ids = pdf["vec_id"].to_numpy().astype(float)[:, None]
            np.savez(raw, arr=np.concatenate([ids, np.stack(pdf["embedding"]).astype(float)], axis=1))
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(raw.getvalue())
            pdf["file"] = name
            yield pdf[["vec_id", "file"]]

    index = f"{folder}-index"  # of the attempts that were committed; files of lost ones are not in it
    t(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(write, "vec_id long, file string").write.parquet(index)
    names = spark.read.parquet(index).select("file").distinct()
    rows = readers.array_archive(spark, folder).withColumn("file", F.element_at(F.split("file", "/"), -1)).join(names, "file", "left_semi")
    values = F.slice("values", 2, F.size("values") - 1)
    return rows.select(F.get("values", 0).cast("long").alias("vec_id"), F.round(F.array_max(values), 6).alias("most"), F.round(F.array_min(values), 6).alias("least"), F.size(values).alias("size"))


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS first, count(*) FILTER (event_id % 2 = 1) AS second, 0::BIGINT AS third, TRUE AS refused FROM events")
def append_and_refuse(spark, sf_dir):
    """Rows appended where their keys are missing, and a target that may be written once only."""
    folder = shared_folder(spark, "append")
    e = t(spark, sf_dir, "events").select("event_id", "event_type")
    added = [sinks.append_missing(x, folder, ["event_id"]) for x in (e.where("event_id % 2 = 0"), e, e)]
    refused = False
    try:
        sinks.write_once(e, folder)
    except Exception as error:  # noqa: BLE001
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        refused = True
    return spark.read.parquet(folder).agg(F.count("*").alias("n"), *[F.lit(n).cast("long").alias(name) for n, name in zip(added, ("first", "second", "third"))], F.lit(refused).alias("refused"))


@query("SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region")
def csv_round_trip(spark, sf_dir):
    """A small table as one CSV file with a header."""
    folder = shared_folder(spark, "csv")
    sinks.csv(t(spark, sf_dir, "region").select("r_regionkey", "r_name"), folder)
    return spark.read.option("header", True).csv(folder).select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))


@query("""WITH r AS (SELECT r_regionkey AS k, r_name AS n FROM region)
SELECT 'markdown' AS kind, '## Regions' || chr(10) || chr(10) || '| k | n |' || chr(10) || '|---|---|' || chr(10) || (SELECT string_agg('| ' || k || ' | ' || n || ' |', chr(10) ORDER BY k) FROM r) || chr(10) AS report
UNION ALL SELECT 'latex', '\\begin{tabular}{ll}' || chr(10) || 'k & n \\\\' || chr(10) || '\\hline' || chr(10) || (SELECT string_agg(k || ' & ' || n, ' \\\\' || chr(10) ORDER BY k) FROM r) || ' \\\\' || chr(10) || '\\end{tabular}' || chr(10)""")
def report_texts(spark, sf_dir):
    """A small table as Markdown and as LaTeX."""
    r = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")).orderBy("k")
    return spark.createDataFrame([("markdown", sinks.markdown(r, "Regions")), ("latex", sinks.latex(r))], "kind string, report string")


@query(r"SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS bytes, sha256(replace(coalesce(html, ''), chr(13) || chr(10), chr(10))) AS sha256 FROM pages")
def payload_hashes(spark, sf_dir):
    """Sizes and hashes of contents, with CRLF read as LF."""
    html = F.coalesce("html", F.lit(""))
    return t(spark, sf_dir, "pages").select("page_id", F.octet_length(html).cast("long").alias("bytes"), readers.content_hash(F.encode(html, "UTF-8"), True).alias("sha256"))


@query("SELECT count(*) AS n, count(*) AS again, 2::BIGINT AS runs FROM events")
def stop_rule(spark, sf_dir):
    """ST03: a stream that ends by a rule on what it has, and takes up the rest in a later run."""
    folder = shared_folder(spark, "stop")
    rows, state = f"{folder}/rows", f"{folder}/checkpoint"
    runs = 0
    for stop in (lambda have: have.count() > 0, None):
        logs.drain_once(stream_of(spark, sf_dir), ["event_id"], rows, state, stop)
        runs += 1
    back = spark.read.parquet(rows)
    return back.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("again"), F.lit(runs).cast("long").alias("runs"))


@query("""SELECT CASE WHEN event_id % 13 = 0 THEN CASE WHEN event_id = m THEN 'cut' ELSE 'error' END ELSE 'complete' END AS state, count(*) AS n
FROM events JOIN (SELECT user_id % 50 AS f, max(event_id) AS m FROM events GROUP BY 1) g ON g.f = user_id % 50 GROUP BY 1""")
def crash_tails(spark, sf_dir):
    """ST06: only the last line of a log may be cut; any other bad line is an error."""
    line = F.when(F.col("event_id") % 13 == 0, '{"a": ').otherwise('{"a": 1}')
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("f"), F.col("event_id").alias("i"), line.alias("l"))
    state = logs.complete_lines(e, "f", "i", "l").select(F.when(F.col("complete").isNull(), "error").when(F.col("complete"), "complete").otherwise("cut").alias("state"))
    return state.groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')))) AS key FROM documents ORDER BY sha256('take|' || doc_id::VARCHAR), doc_id LIMIT 100""")
def hash_ordered_budget(spark, sf_dir):
    """The first hundred documents of a seeded shuffle (a budget is the feature): a limit after a total order."""
    from sieveline.functions.hashing import sha256

    docs = t(spark, sf_dir, "documents").select("doc_id", text.dedup_key(F.col("text")).alias("key"))
    return docs.orderBy(sha256("take", F.col("doc_id")), "doc_id").limit(100)


@query("""WITH a AS (SELECT item_id, j, ('0x' || substr(sha256('ask|' || item_id::VARCHAR || '|' || j::VARCHAR), 1, 8))::BIGINT % (SELECT 2 * count(*) FROM documents) AS id FROM benchmark, range(0, 5) r(j)
), d AS (SELECT doc_id, min(text) AS text FROM documents GROUP BY 1), x AS (SELECT item_id, j, id, doc_id IS NOT NULL AS there, coalesce(text, '') AS text FROM a LEFT JOIN d ON doc_id = id)
SELECT item_id, count(*) AS n_asked, count(*) FILTER (NOT there) AS n_missing, coalesce(string_agg(id::VARCHAR, ',' ORDER BY j) FILTER (NOT there), '') AS missing, sha256(coalesce(string_agg(text, chr(10) ORDER BY j) FILTER (there), '')) AS patch_sha256 FROM x GROUP BY 1""")
def listed_documents(spark, sf_dir):
    """The texts of each item's list of document ids, in its order, out of a layout by hash of the id; about half of
    the ids are no document's and are reported."""
    folder = shared_folder(spark, "lookup")
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    lookup.store(docs, "doc_id", folder, 4096)
    span = 2 * docs.count()
    asked = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: hashing.hash_int("ask", F.col("item_id"), j) % F.lit(max(span, 1)))
    lists = t(spark, sf_dir, "benchmark").select("item_id", asked.alias("ids"))
    found = lookup.fetch(spark, folder, lists.select(F.explode("ids").alias("doc_id")), "doc_id", ["text"])
    rows = lookup.in_list_order(lists, "item_id", "ids", found, "doc_id", "text")
    return rows.select("item_id", "n_asked", "n_missing", "missing", F.sha2("patch", 256).alias("patch_sha256"))


@query("SELECT count(*) AS scanned, count(*) FILTER (lang = 'en') AS kept, count(DISTINCT doc_id) AS ids, TRUE AS stopped_by_rule, TRUE AS resumed FROM documents")
def stopped_scan(spark, sf_dir):
    """S08 ST02 ST03: a streaming scan of eight files with a funnel of counters, which ends with the batch that brings
    the kept rows to a third of all, and later takes up the remainder; no row is lost or read twice."""
    folder = shared_folder(spark, "scan")
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.repartition(8).write.parquet(f"{folder}/landed")
    stream = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    size = docs.agg(F.count("*").alias("n"), F.count_if(english).alias("k")).first()
    quota = size.k // 3 + 1
    counters = {"scanned": F.count("*"), "kept": F.count_if(english)}
    first = logs.scan_until(stream(), counters, lambda c: c["kept"] >= quota, f"{folder}/rows", f"{folder}/checkpoint")
    rest = logs.scan_until(stream(), counters, lambda c: False, f"{folder}/rows", f"{folder}/checkpoint")
    by_rule = first[-1]["kept"] >= quota and (len(first) < 2 or first[-2]["kept"] < quota) and first[-1]["scanned"] < size.n
    on = len(rest) > len(first) and rest[: len(first)] == first and rest[-1]["scanned"] == size.n
    back = spark.read.schema("doc_id long, lang string").parquet(f"{folder}/rows")
    return back.agg(F.count("*").alias("scanned"), F.count_if(english).alias("kept"), F.count_distinct("doc_id").alias("ids"), F.lit(bool(by_rule)).alias("stopped_by_rule"), F.lit(bool(on)).alias("resumed"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, 'missing' AS without_last, 'repeated' AS with_one_twice FROM documents GROUP BY 1")
def merged_shards(spark, sf_dir):
    """Partial sums of six ranges of documents, each stored by a run of its own, merged after a check against the
    plan; with a shard left out or stored twice the same merge is refused."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    plan = shards.plan_of(docs, "doc_id", 6)
    folder, listed = shared_folder(spark, "shards"), plan.orderBy("shard").collect()  # six rows at most
    refused = None
    for r in listed:
        if r is listed[-1]:
            try:
                shards.merge(spark, folder, plan, ["lang"], ["chars"])
            except ValueError as e:
                refused = str(e).rsplit(" ", 1)[1]
        part = docs.where((F.col("doc_id") >= r.lo) & (F.col("doc_id") < r.hi))
        shards.write_shard(part, r.shard, r.lo, r.hi, ["lang"], {"chars": F.sum("n_chars")}, folder)
    stored = shards.manifest(spark, folder)
    twice = shards.problems(plan, stored.unionByName(stored.where(F.col("shard") == listed[0].shard))).first()
    merged = shards.merge(spark, folder, plan, ["lang"], ["chars"])
    return merged.select("lang", "n", "chars", F.lit(refused).alias("without_last"), F.lit(twice.problem).alias("with_one_twice"))
