"""Answer-reading queries. No table holds model answers, so lines of orders are written out as answers by templates, one
for each form that a reader must tell apart; the SQL gives what each form reads as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import answers, text, web
from sieveline.plans.corpus import t
from sieveline.plans.registry import query

#: The lines, with their quantity as q, in SQL; templates go by k.
LINES = "WITH x AS (SELECT l_orderkey AS o, l_linenumber AS k, l_partkey AS p, l_quantity::BIGINT AS q FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), q.alias("q"))


def by_template(modulus: int, forms: list[Column | str | None], of: str = "k") -> Column:
    """The form number of % modulus."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, form in enumerate(forms):
        out = out.when(F.col(of) % modulus == i, form if isinstance(form, Column) else F.lit(form).cast("string"))
    return out


def said(form: str) -> Column:
    """A text with the quantity in place of @."""
    parts = form.split("@")
    out: list[Column] = [F.lit(parts[0])]
    for part in parts[1:]:
        out += [F.col("q").cast("string"), F.lit(part)]
    return F.concat(*out)


@query(LINES + r""" SELECT o, k, CASE k % 5 WHEN 0 THEN '\frac{' || q || '}{2}' WHEN 1 THEN '{a{b{c{d{' || q || '}}}}}' END AS box,
  CASE k % 5 WHEN 0 THEN '\frac{' || q || '}{2}' WHEN 1 THEN '{a{b{c{d{' || q || '}}}}}' WHEN 3 THEN q || ' cm' END AS strict,
  CASE k % 5 WHEN 0 THEN '\frac{' || q || '}{2}' WHEN 1 THEN '{a{b{c{d{' || q || '}}}}}' WHEN 3 THEN q || ' cm' ELSE q::VARCHAR END AS lenient,
  CASE k % 5 WHEN 0 THEN '\frac{' || q || '}{2}' WHEN 1 THEN '{a{b{c{d{' || q || '}}}}}' ELSE q::VARCHAR END AS rescued FROM x""")
def boxed_answers(spark, sf_dir):
    """The last balanced box at any depth, labels and bare numbers, in the three modes."""
    forms = [said(r"so \boxed{\frac{@}{2}} it is, not 7"), said(r"\boxed{1}, then \boxed{ {a{b{c{d{@}}}}} } and 7 more"), said(r"cut off: \boxed{@"), said("Answer: @ cm"), said("first 3, then @")]
    x = lines(spark, sf_dir).withColumn("a", by_template(5, forms))
    a = F.col("a")
    return x.select("o", "k", answers.boxed(a).alias("box"), *[answers.extract_answer(a, m).alias(m) for m in ("strict", "lenient", "rescued")])


@query(LINES + r""", v AS (SELECT o, k, CASE k % 6 WHEN 0 THEN (q // gcd(q, 4)) || CASE WHEN gcd(q, 4) = 4 THEN '' ELSE '/' || (4 // gcd(q, 4)) END
    WHEN 1 THEN q::VARCHAR WHEN 2 THEN (q * 1000)::VARCHAR WHEN 4 THEN '(' || q || ',1/2)' WHEN 5 THEN '2*sqrt3' END AS a,
  CASE k % 6 WHEN 0 THEN (q // gcd(q, 4)) || CASE WHEN gcd(q, 4) = 4 THEN '' ELSE '/' || (4 // gcd(q, 4)) END
    WHEN 1 THEN (q + 1)::VARCHAR WHEN 2 THEN (q * 1000)::VARCHAR WHEN 3 THEN q::VARCHAR WHEN 4 THEN '(' || q || ',1/2)' WHEN 5 THEN '2*sqrt3' END AS b FROM x)
SELECT o, k, a, b, coalesce(a = b, FALSE) AS same FROM v""")
def answer_equality(spark, sf_dir):
    """Exact values of fractions, decimals, thousands, tuples and roots; a null equals nothing."""
    left = [said(r"\frac{@}{4}"), said("@"), said("$@,000"), "none", said("(@, 1/2)"), r"\sqrt{12}"]
    right = [F.format_string("%.2f", F.col("q") / 4), (F.col("q") + 1).cast("string"), said("@000"), said("@"), said("(@,0.5)"), r"2\sqrt{3}"]
    x = lines(spark, sf_dir).select("o", "k", answers.exact_value(by_template(6, left)).alias("a"), answers.exact_value(by_template(6, right)).alias("b"))
    return x.select("o", "k", "a", "b", answers.same_answer(F.col("a"), F.col("b")).alias("same"))


@query(LINES + """ SELECT o, k, (2 * q + k)::VARCHAR AS final, 2::INT AS n_steps, (2 * q)::VARCHAR AS first_value, (2 * q) || '/' || 7 AS ratio,
  CASE WHEN k % 3 = 0 THEN q || '*2' WHEN k % 3 = 1 THEN (2 * q) || '+' || k END AS missing FROM x WHERE 2 * q % 7 <> 0""")
def gsm8k_steps(spark, sf_dir):
    """The final answer and calculation steps of a worked solution, exact arithmetic, and the first step
    whose value an attempt lacks."""
    q, k = F.col("q"), F.col("k")
    twice, total = (2 * q).cast("string"), (2 * q + k).cast("string")
    solution = F.concat(F.lit("Twice <<"), said("@*2="), twice, F.lit(">> and <<"), twice, F.lit("+"), k.cast("string"), F.lit("="), total, F.lit(">>\n#### "), total)
    attempt = by_template(3, [F.lit("nothing"), F.concat(F.lit("only "), twice), F.concat(F.lit("both "), twice, F.lit(" and "), total)])
    x = lines(spark, sf_dir).where("2 * q % 7 <> 0").select("o", "k", "q", answers.gsm8k(solution).alias("g"), attempt.alias("attempt"))
    first = F.get("g.steps", 0)
    ratio = answers.arithmetic(F.concat(first["expr"], F.lit("/(3 + 4.0)")))
    return x.select("o", "k", F.col("g.final").alias("final"), F.size("g.steps").alias("n_steps"), answers.arithmetic(first["expr"]).alias("first_value"), ratio.alias("ratio"), answers.first_missing_step(F.col("g.steps"), F.col("attempt"))["expr"].alias("missing"))


@query(LINES + """ SELECT o, k, coalesce(k % 3 < 2, FALSE) AS passed, CASE k % 3 WHEN 2 THEN CASE WHEN p % 2 = 0 THEN 'no readable answer' ELSE 'got ' || (q + 1) || ' want ' || q END ELSE 'equal' END AS detail,
  TRUE AS verifiable FROM x WHERE k <> 7""")
def reference_verification(spark, sf_dir):
    """Answers verified against references, after references that do not verify against themselves are dropped."""
    wrong = F.when(F.col("p") % 2 == 0, "no idea").otherwise(F.concat(F.lit("Answer: "), (F.col("q") + 1).cast("string")))
    reference = F.when(F.col("k") == 7, "unknown").otherwise(said("@"))
    x = lines(spark, sf_dir).withColumn("r", reference).withColumn("a", by_template(3, [said(r"\boxed{@.0}"), said("Answer: @"), wrong]))
    own = answers.exact_value(F.col("r"))
    x = x.withColumn("verifiable", answers.same_answer(own, own)).where("verifiable")
    v = answers.verify(F.col("r"), F.col("a"))
    return x.select("o", "k", v["passed"].alias("passed"), v["detail"].alias("detail"), "verifiable")


@query(LINES + """, c AS (SELECT o, k, CASE k % 5 WHEN 0 THEN (q * 1000)::VARCHAR WHEN 1 THEN q || '.5' WHEN 2 THEN q::VARCHAR END AS constant FROM x) SELECT * FROM c WHERE constant IS NOT NULL""")
def canonical_constants(spark, sf_dir):
    """Answers that are one constant, in canonical form; mixed numbers and free symbols go."""
    forms = [said("$@,000"), said("@,5"), said("@ kg"), said("@ 1/2"), said("@x")]
    return lines(spark, sf_dir).select("o", "k", answers.constant_text(by_template(5, forms)).alias("constant")).where("constant is not null")


@query(LINES + """ SELECT o, k, CASE k % 4 WHEN 0 THEN 'top_level' WHEN 1 THEN 'Solution_method' END AS form, CASE k % 4 WHEN 0 THEN 'f' || q WHEN 1 THEN 'go' END AS entry,
  CASE k % 4 WHEN 0 THEN length('def f' || q || '(a):' || chr(10) || '    return a' || chr(10)) WHEN 1 THEN length('class Solution:' || chr(10) || '    def go(self):' || chr(10) || '        pass' || chr(10)) WHEN 2 THEN 6 ELSE 5 END::INT AS size FROM x""")
def code_forms(spark, sf_dir):
    """The fenced block, its first function and where that is defined; code is parsed, never run."""
    forms = [said("see\n```python\ndef f@(a):\n    return a\n```\nend"), "```\nclass Solution:\n    def go(self):\n        pass\n```", "```py\nx = 1\n```\n```\ndef g():\n    pass\n```", "def ("]
    code = answers.code_block(by_template(4, forms))
    x = lines(spark, sf_dir).select("o", "k", code.alias("c"))
    return x.select("o", "k", answers.code_form(F.col("c")).alias("form"), answers.entry_point(F.col("c")).alias("entry"), F.length("c").alias("size"))


@query(LINES + """ SELECT o, k, CASE k % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN CASE WHEN p % 2 = 0 THEN 'A' ELSE 'B' END ELSE 'invented' END AS pick,
  CASE k % 5 WHEN 0 THEN 'Solution A or Solution B? Verdict: Solution B' WHEN 1 THEN 'verdict - solution b' END AS swapped FROM x""")
def verdict_parsing(spark, sf_dir):
    """A judge's pick by its last verdict, else by its own answer, else invented; labels swapped at once."""
    forms = ["Solution B or Solution A? Verdict: Solution A", "verdict - solution b", said(r"I get \boxed{@}"), "no opinion", "about 999"]
    x = lines(spark, sf_dir).withColumn("s", by_template(5, forms))
    own, other = said("@"), (F.col("q") + 1).cast("string")
    a, b = F.when(F.col("p") % 2 == 0, own).otherwise(other), F.when(F.col("p") % 2 == 0, other).otherwise(own)
    return x.select("o", "k", answers.verdict_pick(F.col("s"), a, b).alias("pick"), F.when(F.col("k") % 5 < 2, answers.swapped_labels(F.col("s"))).alias("swapped"))


@query(LINES + """ SELECT k % 5 AS form, count(*) AS n, CASE k % 5 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'REVISE' ELSE 'INVALID' END AS strict, CASE k % 5 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'REVISE' WHEN 2 THEN 'REVISE' WHEN 3 THEN 'REVISE' ELSE 'INVALID' END AS lenient FROM x GROUP BY 1""")
def action_contract(spark, sf_dir):
    """Actions by the strict and the lenient contract."""
    forms = [" KEEP ", said("REVISE\nit is @"), "KEEP, no: REVISE", "REVISE\n \n", "keep"]
    x = lines(spark, sf_dir).withColumn("s", by_template(5, forms))
    x = x.select((F.col("k") % 5).alias("form"), answers.action(F.col("s")).alias("strict"), answers.action(F.col("s"), False).alias("lenient"))
    return x.groupBy("form", "strict", "lenient").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'unpaired_or_empty' WHEN 3 THEN 'standard_input' WHEN 4 THEN 'call_based' ELSE 'malformed' END AS mode,
  CASE event_id % 7 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END::INT AS pairs, CASE WHEN event_id % 7 = 4 THEN 'f' || user_id END AS fn_name,
  CASE event_id % 7 WHEN 1 THEN NULL WHEN 2 THEN 2 WHEN 6 THEN 1 END::INT AS n_strings FROM events""")
def io_shapes(spark, sf_dir):
    """Shapes of input and output payloads, whose numbers may have any length; and lists read from text."""
    forms = [" ", "{", '{"inputs": [1], "outputs": []}', '{"inputs": [123456789012345678901234567890, 2], "outputs": [3, 4]}', F.concat(F.lit('{"inputs": [1], "outputs": [2], "fn_name": "f'), F.col("user_id").cast("string"), F.lit('"}')), '{"inputs": [1], "outputs": [2], "fn_name": 3}', "[1]"]
    literal = ["", "not a list", '["a", "b", 3]', "{'a': 1}", "7", None, "['it''s']"]
    e = t(spark, sf_dir, "events").select("event_id", web.io_shape(by_template(7, forms, "event_id")).alias("s"), web.string_list(by_template(7, literal, "event_id")).alias("l"))
    return e.select("event_id", "s.mode", "s.pairs", "s.fn_name", F.when(F.col("l").isNotNull(), F.size("l")).alias("n_strings"))


@query("""SELECT CASE event_id % 8 WHEN 0 THEN 'bool' WHEN 1 THEN 'null' WHEN 2 THEN 'number' WHEN 3 THEN 'number' WHEN 4 THEN 'str' WHEN 5 THEN 'list' WHEN 6 THEN 'object' END AS shape, count(*) AS n FROM events GROUP BY 1""")
def value_shapes(spark, sf_dir):
    """The kinds of JSON values; malformed ones have none."""
    forms = ["true", "null", F.col("event_id").cast("string"), "1.5e3", '"x"', "[1]", '{"a": []}', "{"]
    return t(spark, sf_dir, "events").groupBy(web.value_shape(by_template(8, forms, "event_id")).alias("shape")).agg(F.count("*").alias("n"))


@query(LINES + """, l AS (SELECT CASE k % 7 WHEN 0 THEN 'c' WHEN 1 THEN 'b' WHEN 2 THEN 'b' WHEN 3 THEN 'd' WHEN 4 THEN 'c' WHEN 5 THEN 'c' ELSE 'a' END AS label FROM x WHERE q > 25)
SELECT label, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM l GROUP BY 1""")
def degeneration_labels(spark, sf_dir):
    """What became of outputs that ran into a cap (here: large quantities), as shares of labels."""
    english = "the answer is that we have to find this and so it is not the number "
    vietnamese = "ta có số này và không được tính vì các bài với một bước "
    forms = [
        F.concat(F.lit("well "), F.repeat(F.lit("z"), 31)),
        F.repeat(F.concat(F.lit("a segment that comes again and again number "), F.col("q").cast("string"), F.lit(". ")), 3),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("line of some length "), i.cast("string"))), "\n"),
        F.concat(F.lit("Now I look at it once more, slowly and with care, before I say anything.\n"), F.lit("Step 1 count the apples\n2. add the pears\n3. done")),
        F.concat(F.lit("latin text "), F.lit("по-русски")),
        F.concat(F.lit(english), F.lit("0123456789 " * 4), F.lit(vietnamese)),
        said("A short and sound note about @ things."),
    ]
    x = lines(spark, sf_dir).where("q > 25").groupBy(by_template(7, forms).alias("a")).agg(F.count("*").alias("n"))  # equal outputs are judged once
    per = x.groupBy(text.degeneration(F.col("a"), F.lit(True)).alias("label")).agg(F.sum("n").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("all")))).select("label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(LINES + """ SELECT o, k, k % 4 <> 3 AS same, CASE k % 3 WHEN 0 THEN 'note ' || q WHEN 1 THEN 'one  two' ELSE 'plain' END AS bare, k % 2 = 0 AS substantive,
  CASE WHEN k % 2 = 0 THEN 'so many words that this one i…' ELSE 'few' END AS short FROM x""")
def output_texts(spark, sf_dir):
    """Program outputs compared token by token, thinking blocks taken out, texts told substantive and cut."""
    got = by_template(4, [said("@ 1.0000001"), said(" @\n2 "), said("a @"), said("@ 1")])
    want = by_template(4, [said("@ 1"), said("@ 2.0"), said("a  @"), said("@ 2")])
    thought = by_template(3, [said("<thinking>a\nb</thinking> note @ "), "one <thinking>x</thinking> two", "plain"])
    long = F.when(F.col("k") % 2 == 0, "so many words that this one is surely taken for a substantive text").otherwise("few")
    x = lines(spark, sf_dir)
    return x.select("o", "k", text.same_output(got, want).alias("same"), text.without_thinking(thought).alias("bare"), text.substantive(long).alias("substantive"), text.abbreviated(long, 30).alias("short"))


@query(LINES + """ SELECT k % 7 AS form, CASE k % 7 WHEN 0 THEN 'verified_correct' WHEN 1 THEN 'timeout' WHEN 2 THEN 'compile_or_syntax' WHEN 3 THEN 'runtime_error' WHEN 5 THEN 'runtime_error' WHEN 6 THEN 'wrong_math_answer' ELSE 'executable_test_failure' END AS kind,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Timeout after 5 s' WHEN 2 THEN 'File "<tmp>", SyntaxError' WHEN 3 THEN 'NameError: f is not defined' WHEN 4 THEN 'AssertionError: 1 != 2' WHEN 5 THEN 'exception in <tmp>:3' ELSE 'killed' END AS clean, count(*) AS n FROM x GROUP BY 1""")
def error_kinds(spark, sf_dir):
    """Failures by kind, with temporary paths masked."""
    forms = [None, "Timeout after 5 s", said('File "/tmp/run@/a.py", SyntaxError'), "NameError: f is not defined", "AssertionError: 1 != 2", said("exception in /tmp/x@.py:3"), "killed"]
    x = lines(spark, sf_dir).withColumn("d", by_template(7, forms))
    form = F.col("k") % 7
    kind = text.error_type(F.col("d"), F.when(form == 0, "KEEP").otherwise("REVISE"), F.when(form == 6, "math").otherwise("code"))
    return x.groupBy(form.alias("form"), kind.alias("kind"), text.sanitized(F.col("d")).alias("clean")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, 'strasse fi ' || page_id AS folded FROM pages""")
def unicode_folded(spark, sf_dir):
    """Compatibility forms, full case folding and white space, beyond what lower() does."""
    return t(spark, sf_dir, "pages").select("page_id", text.folded(F.concat(F.lit(" Straße ﬁ\n "), F.col("page_id").cast("string"))).alias("folded"))
