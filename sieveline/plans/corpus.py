"""Curation queries over documents, benchmark, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import answers, hashing, text, web
from sieveline.operators import curation, similarity
from sieveline.plans.registry import query
from sieveline.session import checkpoint, spread


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shared pieces of the SQL below.
NORM = r"trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))"
KEY = f"sha256({NORM})"
NWORDS = r"len(regexp_extract_all(text, '[^ \t\r\n]+'))"
GRAM5 = r"CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


def _n_words(c: str = "text"):
    return F.regexp_count(c, F.lit(r"[^ \t\r\n]+"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with key, first_id, and the first reason that rejects them."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.dedup_key(F.col("text")).alias("key"), _n_words().alias("n_words"), (F.trim("text") == "").alias("blank"))
    first = curation.first_ids(docs, "key", "doc_id").withColumnRenamed("first", "first_id")
    prior = t(spark, sf_dir, "benchmark").select(text.dedup_key(F.col("text")).alias("key"), F.lit(True).alias("prior")).distinct()
    rows = docs.join(first, "key").join(prior, "key", "left")
    n = F.col("n_words")
    reason = curation.first_reason([("empty", F.col("blank")), ("short", n < 20), ("long", n > 5000), ("prior", F.col("prior").isNotNull()), ("duplicate", F.col("doc_id") != F.col("first_id"))])
    return rows.withColumn("reason", reason)


POOL = f"""
WITH d AS (SELECT *, {KEY} AS key, {NWORDS} AS n_words FROM documents
), f AS (SELECT key, min(doc_id) AS first_id FROM d GROUP BY key
), p AS (SELECT DISTINCT {KEY} AS key FROM benchmark
), pool AS (
  SELECT d.*, CASE WHEN trim(text) = '' THEN 'empty' WHEN n_words < 20 THEN 'short' WHEN n_words > 5000 THEN 'long'
    WHEN p.key IS NOT NULL THEN 'prior' WHEN doc_id <> first_id THEN 'duplicate' END AS reason
  FROM d JOIN f USING (key) LEFT JOIN p ON p.key = d.key
)
"""


@query(f"""{POOL}, r AS (
  SELECT doc_id, lang, source, n_words, row_number() OVER (PARTITION BY lang ORDER BY sha256('pool|' || doc_id::VARCHAR), doc_id) AS rank FROM pool WHERE reason IS NULL
)
SELECT doc_id, lang, source, n_words::BIGINT AS n_words, rank::BIGINT AS rank, CASE WHEN rank <= 50 THEN 'dev' ELSE 'main' END AS part,
  CASE WHEN ('0x' || substr(sha256('split|' || source), 1, 8))::BIGINT % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM r""")
def freeze_source_pool(spark, sf_dir):
    """Accepted documents with hash rank, dev quota and split by source."""
    kept = _pool(spark, sf_dir).where("reason is null").select("doc_id", "lang", "source", F.col("n_words").cast("long").alias("n_words"))
    ranked = curation.hash_ranked(kept, "pool", "doc_id", ["lang"])
    return ranked.select("doc_id", "lang", "source", "n_words", F.col("hash_rank").cast("long").alias("rank"), F.when(F.col("hash_rank") <= 50, "dev").otherwise("main").alias("part"), hashing.hash_split(F.col("source"), "split").alias("split"))


@query(f"{POOL} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM pool GROUP BY 1")
def rejection_reasons(spark, sf_dir):
    """How many rows each reason takes."""
    return _pool(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT {KEY} AS key, count(*) AS n FROM documents GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, (sum(n) - count(*))::BIGINT AS n_extra, round((sum(n) - count(*)) / sum(n)::DOUBLE, 6) AS extra_rate,
count(*) FILTER (n > 1) AS n_groups, max(n) AS largest FROM p""")
def exact_duplicate_stats(spark, sf_dir):
    """Duplicate statistics of normalized texts."""
    return curation.duplicate_summary(t(spark, sf_dir, "documents").select(text.dedup_key(F.col("text")).alias("key")), "key")


@query(f"SELECT {KEY} AS key, count(*) AS copies, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """Groups of copies with their members in one list each, for groups that fit a row; duplicate_members has any."""
    docs = t(spark, sf_dir, "documents").select("doc_id", text.dedup_key(F.col("text")).alias("key"))
    groups = docs.groupBy("key").agg(F.count("*").alias("copies"), F.sort_array(F.collect_list("doc_id")).alias("ids")).where("copies > 1")
    return groups.select("key", "copies", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"SELECT * FROM (SELECT min(doc_id) OVER w AS first, count(*) OVER w AS copies, doc_id FROM (SELECT doc_id, {KEY} AS key FROM documents) WHERE key IS NOT NULL WINDOW w AS (PARTITION BY key)) WHERE copies > 1")
def duplicate_members(spark, sf_dir):
    """Groups of copies as rows of representative and member, which hold a group of any size."""
    docs = t(spark, sf_dir, "documents").select("doc_id", text.dedup_key(F.col("text")).alias("key"))
    return curation.copy_members(docs, "key", "doc_id")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY source, {KEY} ORDER BY doc_id) = 1 AS kept FROM documents")
def within_source_first(spark, sf_dir):
    """The first row of each text inside its source is kept."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", text.dedup_key(F.col("text")).alias("key"))
    return curation.first_marks(docs, ["source", "key"], "doc_id")


@query(f"SELECT {KEY} AS key, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_duplicates(spark, sf_dir):
    """Texts that several sources share."""
    pairs = t(spark, sf_dir, "documents").select("source", text.dedup_key(F.col("text")).alias("key")).distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n_sources"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources")).where("n_sources > 1")


@query(f"""WITH d AS (SELECT doc_id, list_distinct(g) AS g FROM (SELECT doc_id, {GRAM5} AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) WHERE len(g) > 0
), k AS MATERIALIZED (SELECT doc_id, g, min(doc_id) OVER (PARTITION BY list_sort(g)) AS f FROM d
), s AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM k WHERE doc_id = f
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, round(c / (p.n + q.n - c)::DOUBLE, 6) AS similarity FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8 - 1e-12
UNION ALL SELECT f, doc_id, 1 FROM k WHERE f <> doc_id""")
def near_duplicate_pairs(spark, sf_dir):
    """5-gram Jaccard of at least 0.8, exact, by a prefix-filtered join: links from the first document of
    each set of equal ones to the others, and pairs between the first ones."""
    docs = spread(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.select("doc_id", text.gram_hashes(text.words(F.col("text")), 5).alias("grams"))
    return similarity.similarity_classes(docs, "doc_id", "grams", 0.8).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE k AS MATERIALIZED (SELECT doc_id, {KEY} AS k1, nullif(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' '), '') AS k2 FROM documents
), e AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (k1) UNION SELECT x.doc_id, y.doc_id FROM k x JOIN k y USING (k2)
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), f AS (SELECT a AS node, min(b) AS family FROM r GROUP BY 1)
SELECT family, count(*) AS members FROM f GROUP BY 1 HAVING count(*) > 1""")
def duplicate_families(spark, sf_dir):
    """Components of documents linked by equal whole texts or equal words in order; links are stars, not pairs."""
    w = text.words(F.col("text"))
    docs = t(spark, sf_dir, "documents").select("doc_id", text.dedup_key(F.col("text")).alias("k1"), F.when(F.size(w) > 0, F.sha2(F.array_join(w, " "), 256)).alias("k2"))
    stars = [docs.join(curation.first_ids(docs.where(F.col(k).isNotNull()), k, "doc_id"), k).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).where("a <> b") for k in ("k1", "k2")]
    return curation.families(stars[0].unionByName(stars[1])).groupBy("family").agg(F.count("*").alias("members"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents
), s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({GRAM5})) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), k AS (SELECT doc_id, {KEY} AS k FROM documents
), e AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (k)
  UNION SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8 - 1e-12
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), f AS (SELECT a AS node, min(b) AS family FROM r GROUP BY 1)
SELECT family, count(*) AS members FROM f GROUP BY 1 HAVING count(*) > 1""")
def near_duplicate_families(spark, sf_dir):
    """Components of documents linked by equal texts or 5-gram Jaccard of at least 0.8 over whole texts; equal
    texts and equal sets are stars, and near copies are compared between components only."""
    docs = t(spark, sf_dir, "documents")
    keys = checkpoint(spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", text.dedup_key(F.col("text")).alias("k1")))
    star = keys.join(curation.first_ids(keys, "k1", "doc_id"), "k1").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    grams = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", text.gram_hashes(text.words(F.col("text")), 5).alias("grams"))
    near = similarity.similarity_links(grams, "doc_id", "grams", 0.8)
    return curation.families(star.unionByName(near)).groupBy("family").agg(F.count("*").alias("members"))


@query(r"""WITH g AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) >= 8
), d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 8)
SELECT DISTINCT doc_id FROM d JOIN g USING (g)""")
def contamination_8gram(spark, sf_dir):
    """Documents that hold any 8-gram of the benchmark."""
    grams = text.word_grams(text.words(F.col("text")), 8, "empty")
    return curation.gram_leaks(t(spark, sf_dir, "documents"), grams, t(spark, sf_dir, "benchmark"), grams, "doc_id")


@query(r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE doc_id % 50 = 0
), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark
), s AS (SELECT doc_id, item_id, len(list_intersect(d.w, b.w)) AS c, len(d.w) AS nl, len(b.w) AS nr FROM d, b
), r AS (SELECT doc_id, item_id, c / (nl + nr - c)::DOUBLE AS similarity FROM s WHERE c > 0)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS rank FROM r) WHERE rank <= 10""")
def nearest_benchmark_items(spark, sf_dir):
    """The ten most similar benchmark items of each queried document (a stated query set: ids divisible by 50)."""
    docs = t(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("doc_id", text.words(F.col("text")).alias("w"))
    bank = t(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("w"))
    return curation.nearest(docs, "doc_id", "w", bank, "item_id", "w", 10).withColumn("similarity", F.round("similarity", 6))


GATES = {"has_number": "[0-9]", "has_license": "(?i)licensed? under", "has_email": "[a-z0-9.]+@[a-z0-9.]+", "has_table": r" \| ", "shouts": "[A-Z]{4,}!!"}


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in GATES.items()) + ", count(*) FILTER (" + " AND ".join(f"regexp_matches(text, '{p}')" for p in GATES.values()) + ") AS all_flags FROM documents GROUP BY lang")
def regex_gates(spark, sf_dir):
    """Counts of named regex flags and of their conjunction."""
    cols = curation.flags(GATES | {"has_license": "(?i)licen[sſ]ed? under"}, F.col("text"))  # without case SQL takes the long s for s
    return t(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count_if(c).alias(n) for n, c in cols.items()])


@query(f"""WITH d AS (SELECT doc_id, {NWORDS} AS n FROM documents), b AS (SELECT doc_id, n, CASE WHEN n < 100 THEN 'short' WHEN n < 500 THEN 'medium' WHEN n < 2000 THEN 'long' ELSE 'very_long' END AS bin FROM d)
SELECT bin, count(*) AS n, min(n)::BIGINT AS lo, median(n)::DOUBLE AS mid, round(avg(n), 3) AS mean, max(n)::BIGINT AS hi, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM b GROUP BY bin""")
def length_bins(spark, sf_dir):
    """Named half-open bins with five-number distributions and shares."""
    docs = t(spark, sf_dir, "documents").select(_n_words().alias("n")).withColumn("bin", text.bins(F.col("n"), [("short", 100), ("medium", 500), ("long", 2000)], "very_long"))
    per = docs.groupBy("bin").agg(F.count("*").alias("c"), F.min("n").cast("long").alias("lo"), F.median("n").alias("mid"), F.round(F.avg("n"), 3).alias("mean"), F.max("n").cast("long").alias("hi"))
    total = docs.agg(F.count("*").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("bin", F.col("c").alias("n"), "lo", "mid", "mean", "hi", F.round(F.col("c") / F.col("all"), 6).alias("share"))


@query("""WITH b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('rr|' || doc_id::VARCHAR), doc_id) AS turn FROM documents)
SELECT doc_id, lang, turn::BIGINT AS turn, ((turn - 1) % 6)::BIGINT AS template, printf('pool_%05d', turn) AS label FROM b""")
def round_robin_templates(spark, sf_dir):
    """Turns of an interleave by language, templates assigned modulo 6, sequential labels."""
    docs = t(spark, sf_dir, "documents")
    turned = curation.round_robin(docs, "lang", "rr", "doc_id")
    return turned.select("doc_id", "lang", F.col("turn").cast("long").alias("turn"), ((F.col("turn") - 1) % 6).cast("long").alias("template"), F.format_string("pool_%05d", F.col("turn")).alias("label"))


@query("""WITH s AS (SELECT DISTINCT source, CASE WHEN ('0x' || substr(sha256('fold|' || source), 1, 8))::BIGINT % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents)
SELECT split, count(*) AS n_sources, (SELECT count(*) FROM (SELECT source FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n_leaking FROM s GROUP BY split""")
def hash_split_audit(spark, sf_dir):
    """Sources by split, and how many leak into both."""
    s = t(spark, sf_dir, "documents").select("source", hashing.hash_split(F.col("source"), "fold").alias("split")).distinct()
    audit = curation.disjointness(s, "source", "split").select("n_leaking")
    return s.groupBy("split").agg(F.count("*").alias("n_sources")).crossJoin(F.broadcast(audit))


@query("""WITH l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM l GROUP BY quality)
), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('bal|' || doc_id::VARCHAR), doc_id) AS rank FROM l)
SELECT doc_id, quality FROM r, m WHERE rank <= m""")
def balanced_truncation(spark, sf_dir):
    """As many documents of each label as the rarer label has."""
    labels = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return curation.balanced(labels, "quality", "bal", "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 2")
def per_source_caps(spark, sf_dir):
    """The two longest documents of each source."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", (-F.col("n_chars")).alias("neg"))
    return curation.capped(docs, "source", 2, ["neg", "doc_id"]).select("doc_id", "source")


@query("""WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT l.lang, s.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN n ON n.lang IS NOT DISTINCT FROM l.lang AND n.source IS NOT DISTINCT FROM s.source""")
def dense_counts(spark, sf_dir):
    """Counts of every (lang, source) cell, zeros too; the cells are two small distinct sets."""
    docs = t(spark, sf_dir, "documents")
    n = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    cells = n.select("lang").distinct().crossJoin(n.select("source").distinct())
    return cells.join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT lang, source, count(*) AS n, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def grouping_sets(spark, sf_dir):
    """Several groupings in one pass."""
    docs = t(spark, sf_dir, "documents")
    return docs.groupingSets([[F.col("lang")], [F.col("source")], [F.col("lang"), F.col("source")], []], "lang", "source").agg(F.count("*").alias("n"), F.grouping_id("lang", "source").alias("level")).select("lang", "source", "n", "level")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i:https?)://[^/?#]+') THEN 'https://' || lower(regexp_extract(trim(url), '^(?i:https?)://([^/?#]+)', 1)) ||
  CASE WHEN regexp_replace(regexp_extract(trim(url), '^(?i:https?)://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(trim(url), '^(?i:https?)://[^/?#]+([^?#]*)', 1), '/+$', '') END END AS url FROM pages""")
def url_canonical(spark, sf_dir):
    """Canonical urls."""
    return t(spark, sf_dir, "pages").select("page_id", web.canonical_url(F.col("url")).alias("url"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid, sum((json_extract_string(props, '$.k'))::BIGINT)::BIGINT AS total, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1")
def json_props_profile(spark, sf_dir):
    """JSON validity, text-safe numbers and exact distinct counts."""
    e = t(spark, sf_dir, "events")
    k = web.json_text(F.col("props"), "$.k")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"), F.sum(k.cast("long")).alias("total"), F.count_distinct(k).alias("kinds"))


_COUNT = r"len(regexp_extract_all(text, '{}'))"


@query(rf"""WITH d AS (SELECT doc_id, text, greatest(length(text), 1)::DOUBLE AS n, {_COUNT.format(r'[\p{L}\p{N}_]+')} AS w FROM documents)
SELECT doc_id, round(ln(1 + n), 6) AS log_chars, round(ln(1 + w), 6) AS log_words, round(ln(2 + {_COUNT.format(chr(10))}), 6) AS log_lines, round({_COUNT.format(r'\p{Nd}')} / n, 6) AS digit_share,
  round({_COUNT.format(r'\p{Lu}')} / n, 6) AS upper_share, round({_COUNT.format(r'[^\p{L}\p{N}\s]')} / n, 6) AS punct_share,
  round(len(regexp_extract_all(lower(text), '\b(?:clearly|obviously|therefore|thus|certainly|correct|final)\b')) / greatest(w, 1)::DOUBLE, 6) AS confident_share, contains(text, '```') AS has_fence FROM d""")
def surface_features(spark, sf_dir):
    """Logs of sizes, shares of classes and of confident words, a flag."""
    f = text.surface_features(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) if n == "has_fence" else F.round(c, 6).alias(n) for n, c in f.items()])


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents), c AS (SELECT doc_id, l, count(*) AS n FROM l WHERE length(l) >= 15 GROUP BY 1, 2)
SELECT d.doc_id, coalesce(max(n), 0)::INT AS most FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def repeated_lines(spark, sf_dir):
    """How often the commonest line of 15 characters occurs in a document; inside the row, without a shuffle."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= 15)
    return t(spark, sf_dir, "documents").select("doc_id", text.most_repeated(lines).alias("most"))


_EN, _VI = (f"[{', '.join(repr(w) for w in ws)}]" for ws in (text.ENGLISH, text.VIETNAMESE))


@query(rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '(?s)\$[^$]*\$|\\\[.*?\\\]|\\begin\{{.*?\\end\{{[^}}]*\}}', ' ', 'g')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents), c AS (
  SELECT doc_id, len(list_filter(w, lambda x: list_contains({_EN}, x))) AS en, len(list_filter(w, lambda x: list_contains({_VI}, x))) AS vi FROM d)
SELECT doc_id, CASE WHEN en + vi < 8 THEN NULL WHEN en > 2 * vi THEN 'en' WHEN vi > 2 * en THEN 'vi' END AS lang FROM c""")
def function_word_language(spark, sf_dir):
    """Language by function words."""
    return t(spark, sf_dir, "documents").select("doc_id", text.function_word_language(F.col("text")).alias("lang"))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '-?\d+(?:[.,]\d+)?') AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN x[len(x)] END AS answer, len(list_distinct(list_transform(x, lambda v: replace(v, ',', '.'))))::INT AS n_numbers FROM c""")
def answer_extraction(spark, sf_dir):
    """The last number of each turn (no turn has a label or a box), and its distinct numbers."""
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", answers.extract_answer(F.col("text")).alias("answer"), F.size(answers.numbers(F.col("text"))).alias("n_numbers"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '$' || printf('%d', l_quantity::BIGINT * 1000) WHEN 1 THEN printf('%d', l_quantity::BIGINT) || ',5' WHEN 2 THEN printf('%d', l_quantity::BIGINT) || ' cm' ELSE 'none' END AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN substr(a, 2) WHEN 1 THEN replace(a, ',', '.') WHEN 2 THEN replace(a, ' cm', '') END AS value FROM x""")
def numeric_answers(spark, sf_dir):
    """Currency, decimal commas and units read as plain numbers; anything else is null. JVM-only."""
    q = F.col("l_quantity").cast("long").cast("string")
    k = F.col("l_linenumber") % 4
    a = F.when(k == 0, F.concat(F.lit("$"), (F.col("l_quantity").cast("long") * 1000).cast("string"))).when(k == 1, F.concat(q, F.lit(",5"))).when(k == 2, F.concat(q, F.lit(" cm"))).otherwise("none")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answers.decimal_text(a).alias("value"))


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), c AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) FILTER (c.n IS NOT NULL AND b.n IS NOT NULL) AS n_both, count(*) FILTER (b.n IS NULL) AS n_left_only, count(*) FILTER (c.n IS NULL) AS n_right_only,
count(*) FILTER (c.n > 1) AS left_repeated, count(*) FILTER (b.n > 1) AS right_repeated FROM c FULL JOIN b USING (doc_id)""")
def key_set_audit(spark, sf_dir):
    """How the keys of two tables meet."""
    return curation.key_audit(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT lang, source FROM (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 3 = 0) INTERSECT SELECT DISTINCT lang, source FROM documents WHERE doc_id % 3 = 1""")
def shared_cells(spark, sf_dir):
    """(lang, source) cells that two thirds of the ids share."""
    docs = t(spark, sf_dir, "documents")
    return docs.where("doc_id % 3 = 0").select("lang", "source").intersect(docs.where("doc_id % 3 = 1").select("lang", "source"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_documents(spark, sf_dir):
    """Documents without a label."""
    return t(spark, sf_dir, "documents").select("doc_id").subtract(t(spark, sf_dir, "labels").select("doc_id"))


@query("""SELECT conv_id, concat_ws(',', CASE WHEN role IS NULL THEN 'role' END, CASE WHEN nullif(text, '') IS NULL THEN 'text' END, CASE WHEN nullif(role, 'system') IS NULL THEN 'speaker' END) AS missing FROM conversations
WHERE role IS NULL OR nullif(text, '') IS NULL OR nullif(role, 'system') IS NULL""")
def missing_fields(spark, sf_dir):
    """rows that lack required fields, and which."""
    rows = t(spark, sf_dir, "conversations").select("conv_id", "role", F.expr("nullif(text, '')").alias("text"), F.expr("nullif(role, 'system')").alias("speaker"))
    return curation.missing_fields(rows, ["role", "text", "speaker"], "conv_id")


@query("""SELECT 'positive_id' AS rule, count(*) FILTER (NOT coalesce(doc_id >= 0, FALSE)) AS violations FROM documents UNION ALL
SELECT 'known_lang', count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr'), FALSE)) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (NOT coalesce(n_chars = length(text), FALSE)) FROM documents""")
def constraint_report(spark, sf_dir):
    """Violations of named rules in one pass."""
    docs = t(spark, sf_dir, "documents")
    return curation.constraints(docs, {"positive_id": F.col("doc_id") >= 0, "known_lang": F.col("lang").isin("en", "de", "fr"), "n_chars": F.col("n_chars") == F.length("text")})


@query("""WITH x AS (SELECT conv_id, turn, role, text FROM conversations), m AS (SELECT conv_id, string_agg(role || ':' || length(text)::VARCHAR, ' ' ORDER BY turn) AS chat, count(*) AS n FROM x GROUP BY 1) SELECT * FROM m""")
def chat_records(spark, sf_dir):
    """Rows assembled into ordered message arrays."""
    m = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["size"].cast("string"))), " ").alias("chat"), F.size("m").cast("long").alias("n"))


@query("""SELECT source, n_docs, round(rate, 6) AS rate FROM (SELECT source, count(*) AS n_docs, count(*) FILTER (lang = 'en') / count(*)::DOUBLE AS rate FROM documents GROUP BY 1) WHERE n_docs >= 5 AND rate >= 0.5""")
def minimum_rate_sources(spark, sf_dir):
    """groups kept by a minimum size and rate."""
    g = t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), (F.count_if(F.col("lang") == "en") / F.count("*")).alias("rate"))
    return g.where("n_docs >= 5 and rate >= 0.5").withColumn("rate", F.round("rate", 6))


@query("""SELECT d.doc_id, 'fam_' || substr(sha256(array_to_string(list_sort(list_distinct([lang, source])), chr(1))), 1, 20) AS family, sha256('{"doc_id":' || doc_id::VARCHAR || ',"lang":"' || lang || '"}') AS row_hash,
('0x' || substr(sha256('seed|' || doc_id::VARCHAR), 1, 8))::BIGINT AS seed FROM documents d""")
def stable_identifiers(spark, sf_dir):
    """Family ids, canonical row hashes and seeds."""
    docs = t(spark, sf_dir, "documents")
    fam = F.concat(F.lit("fam_"), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(F.array("lang", "source"))), "\x01"), 256), 1, 20))
    return docs.select("doc_id", fam.alias("family"), hashing.canonical_json_hash("doc_id", "lang").alias("row_hash"), hashing.hash_int("seed", F.col("doc_id")).alias("seed"))
