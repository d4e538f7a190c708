"""Functions against documented cases."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions import answers, text, web
from sieveline.operators import curation


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


EQUAL = [
    ("$18", "18", True), ("84 cm²", "84", True), ("$70,000", "70000", True), ("1,234,567", "1234567", True), ("84,5", "84.5", True), ("17", "18", False),
    (r"\frac{1}{2}", "0.5", True), (r"\dfrac{14}{3}", "14/3", True), (r"3\pi", r"3\pi", True), (r"\sqrt{4}", "2", True), ("(3, pi/2)", "(3, pi/2)", True), ("(6, pi/4)", "(3, pi/2)", False),
    ("abc", "abc", False), (None, None, False),
]


def test_answer_equality(spark):
    same = answers.same_answer(answers.exact_value(F.col("a")), answers.exact_value(F.col("b")))
    assert one(spark, EQUAL, "a string, b string, want boolean", "want", same) == [(w, w) for _, _, w in EQUAL]


def test_extraction(spark):
    rows = [
        (r"so \boxed{1} then \boxed{\frac{1}{2}} done", r"\frac{1}{2}"), ("Answer: 12 apples\nthen 5", "12 apples"), ("we get 3, then 4.5", "4.5"), ("none", None), (r"\boxed{\boxed{", None), ("Đáp số:\nĐáp số: 15", "15"),
    ]
    assert one(spark, rows, "t string, want string", "want", answers.extract_answer(F.col("t"))) == [(w, w) for _, w in rows]
    deep = r"\boxed{\frac{\sqrt{\frac{a_{1_{2}}}{b}}}{c}} and 7 more"
    assert one(spark, [(deep,)], "t string", answers.extract_answer(F.col("t"))) == [(r"\frac{\sqrt{\frac{a_{1_{2}}}{b}}}{c}",)]
    strict = one(spark, rows, "t string, want string", answers.extract_answer(F.col("t"), "strict"))
    assert strict[2] == (None,)
    assert one(spark, rows, "t string, want string", answers.extract_answer(F.col("t"), "rescued"))[1] == ("12",)


def test_verify_and_arithmetic(spark):
    rows = [("18", "The answer is 18.", True), ("18", r"\boxed{17}", False), ("18", "nothing", False)]
    assert one(spark, rows, "r string, t string, want boolean", "want", answers.verify(F.col("r"), F.col("t"))["passed"]) == [(w, w) for *_, w in rows]
    cases = [("1/3+1/6", "1/2"), ("2*(3-5)", "-4"), ("1/0", None), ("__import__('os')", None), ("0.1+0.2", "3/10")]
    assert one(spark, cases, "e string, want string", "want", answers.arithmetic(F.col("e"))) == [(w, w) for _, w in cases]


def test_gsm8k_and_steps(spark):
    rows = [("a <<2*3=6>> b <<6+1=7>> c\n#### 1,007", "x 6 y")]
    g = answers.gsm8k(F.col("a"))
    got = one(spark, rows, "a string, t string", g["final"], g["steps"], answers.first_missing_step(g["steps"], F.col("t")))[0]
    assert got[0] == "1007" and [tuple(s) for s in got[1]] == [("2*3", "6"), ("6+1", "7")] and tuple(got[2]) == ("6+1", "7")


def test_verdicts(spark):
    rows = [("x Verdict: Solution A ... Verdict: Solution B", "1", "2", "B"), ("Answer: 1", "1", "1", "A"), ("Answer: 9", "1", "2", "invented")]
    assert one(spark, rows, "t string, a string, b string, w string", "w", answers.verdict_pick(F.col("t"), F.col("a"), F.col("b"))) == [(r[3], r[3]) for r in rows]
    assert one(spark, [("Solution A beats Solution B",)], "t string", answers.swapped_labels(F.col("t"))) == [("Solution B beats Solution A",)]
    assert one(spark, [("KEEP",), ("REVISE\n5",), ("I KEEP it",)], "t string", answers.action(F.col("t"))) == [("KEEP",), ("REVISE",), ("INVALID",)]
    assert one(spark, [("I KEEP it",)], "t string", answers.action(F.col("t"), strict=False)) == [("KEEP",)]


def test_code(spark):
    rows = [("x\n```python\ndef f(a):\n  return a\n```\n", "f", "top_level"), ("class Solution:\n  def g(self): pass\n", "g", "Solution_method"), ("1 +", None, None)]
    code = answers.code_block(F.col("t"))
    assert one(spark, rows, "t string, e string, f string", answers.entry_point(code), answers.code_form(code)) == [(e, f) for _, e, f in rows]


def test_urls_and_json(spark):
    urls = [("http://CodeForces.com/problemset/problem/1/A/?utm=x#part", "https://codeforces.com/problemset/problem/1/A"), ("file:///tmp/problem", None), ("https://a.b", "https://a.b/"), (None, None)]
    assert one(spark, urls, "u string, w string", "w", web.canonical_url(F.col("u"))) == [(w, w) for _, w in urls]
    big = '{"inputs":["1"],"outputs":[' + "9" * 5000 + "]}"
    shapes = [
        ('{"inputs":[[1]],"outputs":[2],"fn_name":"f"}', ("call_based", 1, "f")), ('{"inputs":["1"],"outputs":["2"]}', ("standard_input", 1, None)), ('{"inputs":[1],"outputs":[]}', ("unpaired_or_empty", 0, None)), ("not json", ("malformed", 0, None)),
        (big, ("standard_input", 1, None)), ("", ("missing", 0, None)),
    ]
    got = one(spark, [(s,) for s, _ in shapes], "p string", web.io_shape(F.col("p")))
    assert [tuple(g[0]) for g in got] == [w for _, w in shapes]
    lists = [("['arrays', 'sorting']", ["arrays", "sorting"]), ('["a", 1]', ["a"]), ("__import__('os').listdir()", None), ("{}", None)]
    assert one(spark, [(s,) for s, _ in lists], "p string", web.string_list(F.col("p"))) == [(w,) for _, w in lists]
    kinds = [("true", "bool"), ("1", "number"), ("null", "null"), ('"x"', "str"), ("[1]", "list"), ('{"a":1}', "object"), ("{", None)]
    assert one(spark, kinds, "p string, w string", "w", web.value_shape(F.col("p"))) == [(w, w) for _, w in kinds]


def test_text(spark):
    assert one(spark, [(" A  B\nC ",)], "t string", text.normalized(F.col("t")), text.folded(F.lit("Straße ﬁ"))) == [("a b c", "strasse fi")]
    w = text.words(F.col("t"))
    rows = one(spark, [("a b c",), ("a b",), ("",)], "t string", text.word_grams(w, 3), text.word_grams(w, 3, "empty"))
    assert rows == [(["a b c"], ["a b c"]), (["a b"], []), ([], [])]
    assert one(spark, [(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>", F.round(text.jaccard(F.col("a"), F.col("b")), 4)) == [(0.3333,), (0.0,)]
    assert one(spark, [("x" * 40,), ("the cat. " * 3,), ("fine",)], "t string", text.degeneration(F.col("t"), F.lit(False))) == [("c",), ("a",), ("a",)]
    assert one(spark, [("1 2.0000001", "1 2", True), ("1 2", "1 3", False), ("a", "a b", False)], "a string, b string, w boolean", "w", text.same_output(F.col("a"), F.col("b"))) == [(True, True), (False, False), (False, False)]
    assert one(spark, [("a<thinking>x\ny</thinking>b",)], "t string", text.without_thinking(F.col("t"))) == [("ab",)]
    assert one(spark, [("NameError: x is not defined",), ("timed out",), (None,)], "t string", text.error_type(F.col("t"), F.lit("REVISE"), F.lit("code"))) == [("runtime_error",), ("executable_test_failure",), ("executable_test_failure",)]
    assert one(spark, [("abcd", "abcd")], "a string, b string", text.sequence_ratio(F.col("a"), F.col("b")), text.text_similarity(F.col("a"), F.col("b"))) == [(1.0, 1.0)]


@pytest.mark.parametrize("k,n", [(0, 0), (3, 3), (5, 9)])
def test_sign_test(spark, k, n):
    from math import comb

    from sieveline.operators.statistics import sign_test

    w, l = k, n - k  # noqa: E741
    want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(min(w, l) + 1)) / 2**n)
    got = one(spark, [(w, l)], "w int, l int", sign_test(F.col("w"), F.col("l")))[0][0]
    assert abs(got - want) < 1e-9


def test_edit_gate_and_flags(spark):
    rule = "always check the sign of every term before adding them up"
    rows = [(f"1. {rule}\n\nIdeal response template: state each step and then say which one is wrong\nVerdict: Solution A", "normalize"), (f"{rule}\n\nstate each step and then say which one is wrong here", "accept"), ("short", "retry"), ("", "retry")]
    g = answers.edit_gate(F.col("t"))
    got = one(spark, rows, "t string, w string", "w", g["action"], g["reasons"], g["text"])
    assert [x[:2] for x in got] == [(w, w) for _, w in rows]
    assert got[0][2] == ["list_markers", "committed_side"] and "Verdict" not in got[0][3] and got[0][3].startswith("- ")
    flags = one(spark, [("Answer: 2.5", False), ("x\nx\nx\nx", True)], "t string, c boolean", answers.output_flags(F.col("t"), F.col("c")))
    assert flags == [(["S-integer"],), (["S-format", "S-loop"],)]


def test_verdict_log_probs(spark):
    from sieveline.operators.evaluation import verdict_log_probs
    from sieveline.operators.statistics import recall_estimate

    kind = "x array<struct<token:string,options:array<struct<text:string,logprob:double>>>>"
    row = [(" Solution", []), (" A", [("A", -2.0)]), ("Solution", []), (" B", [(" A", -1.5), ("A", -3.0), ("B", -0.2)])]
    got = one(spark, [(row,), ([],)], kind, verdict_log_probs(F.col("x")))
    assert tuple(got[0][0]) == (3, -1.5, -0.2) and tuple(got[1][0]) == (None, None, None)
    r = spark.range(1).select(recall_estimate(F.lit(100), F.lit(9), F.lit(10), F.lit(900), F.lit(1), F.lit(90)).alias("r")).first().r
    assert abs(r.recall - 0.9) < 1e-9 and r.low < r.recall < r.high


def test_roots_are_reduced_by_all_their_primes():
    import random
    import time

    from sieveline.functions import answers

    read = answers.read_value
    assert read("sqrt(300420147)") == read("10007*sqrt(3)") is not None
    assert read("sqrt(1000003)*sqrt(1000003)") == read("1000003")
    assert read(f"sqrt({1000003**2 * 1000033 * 5})") == read(f"1000003*sqrt({1000033 * 5})") is not None
    assert read(f"sqrt({2**200})") == read(f"{2**100}") is not None
    assert read(f"sqrt({(10**30 + 57) ** 2})") == read(f"{10**30 + 57}") is not None
    for n in range(1, 3000):
        root, c = answers._root(n)
        assert c * c * root == n and all(root % (d * d) for d in range(2, 60))
    rng = random.Random(1)
    start = time.time()
    for _ in range(30):
        p, q = (rng.choice([1009, 10007, 999983, 1000003, 16777259, 1048583]) for _ in range(2))
        root, c = answers._root(p * p * q)
        assert (root, c) == ((q, p) if p != q else (p, p))
    assert time.time() - start < 10
    assert read(f"sqrt({(2**61 - 1) * (2**89 - 1)})") is None  # beyond what is factored: no value rather than a wrong one


def test_equal_texts_are_read_once():
    import pandas as pd

    seen = []
    got = answers._once(pd.Series(["1", None, "2", "1", "2"], index=[4, 3, 2, 1, 0]), lambda x: seen.append(x) or (None if x == "2" else x + "!"))
    assert got.tolist() == ["1!", None, None, "1!", None] and got.index.tolist() == [4, 3, 2, 1, 0] and seen == ["1", "2"]
    assert answers._once(pd.Series([], dtype=object), str).tolist() == []


def test_equal_outputs_are_judged_once(spark):
    """Outputs are counted by text before they are judged."""
    from conftest import SF

    from sieveline.plans.answers import degeneration_labels

    plan = degeneration_labels(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 5  # by text and by label, in both sides of the shares, and their total


def test_gram_hashes_tell_grams_apart_as_texts_do(spark):
    texts = ["a b c d e f g", "a b c d e", "b c d e f", "a b", "ab", "a", "b a", "", None, "a a a a a a a a", "A-b c, d e", "a b c d"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    w = text.words(F.col("text"))
    rows = df.select(F.explode(F.arrays_zip(text.word_grams(w, 5).alias("g"), text.gram_hashes(w, 5).alias("h"))).alias("x")).select("x.g", "x.h").collect()
    sizes = df.select(F.size(text.word_grams(w, 5)).alias("g"), F.size(text.gram_hashes(w, 5)).alias("h")).collect()
    assert all(r.g == r.h for r in sizes) and len(rows) == sum(r.g for r in sizes)
    assert len({r.g for r in rows}) == len({r.h for r in rows}) == len({(r.g, r.h) for r in rows})


def test_families_work_edges_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6)], "a long, b long").repartition(2).mapInArrow(count, "a long, b long")
    got = {(r.node, r.family) for r in curation.families(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)} and seen.value == 4
