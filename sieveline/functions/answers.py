"""Reading final answers: extraction, exact values, equality, verdicts and action contracts.

Numbers are exact: a value is a reduced fraction, written `n` or `n/d`; sums of rational multiples of pi and square
roots, and tuples of values, have a canonical text too, so that equality of values is equality of texts. A value that
cannot be read is null and equals nothing.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from fractions import Fraction
from functools import lru_cache
from math import gcd, isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels after which a line holds the answer.
LABELS = "Dap so|Đáp số|Ket qua|Kết quả|Answer"
LABEL = rf"(?i)(?:{LABELS})[ \t]*[:=][ \t]*([^\n]+)"
NUMBER = r"-?\d+(?:[.,]\d+)?"


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def boxed(text: Column) -> Column:
    """The content of the last \\boxed{}, braces nested to any depth, or null; an unbalanced last one is null. One scan
    of the characters after the last box, in the JVM."""
    tail = F.when(text.contains("\\boxed{"), F.regexp_extract(text, r"(?s)^.*\\boxed\{(.*)$", 1))
    step = lambda s, c: F.struct(
        (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
        (s["at"] + 1).alias("at"),
        F.when((s["end"] < 0) & (s["depth"] == 1) & (c == "}"), s["at"]).otherwise(s["end"]).alias("end"),
    )
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    found = F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])
    return F.get(F.transform(F.array(found), lambda end: F.when(end >= 0, F.trim(F.substring(tail, F.lit(1), end)))), 0)


def extract_answer(text: Column, mode: str = "lenient") -> Column:
    """lenient: boxed, else the last labelled line, else the last number. strict: without the number. rescued: the
    first number of the last labelled line, else as lenient."""
    label = F.trim(_last(text, LABEL))
    if mode == "strict":
        return F.coalesce(boxed(text), label)
    if mode == "rescued":
        first = F.regexp_extract(label, NUMBER, 0)
        return F.coalesce(boxed(text), F.when(first != "", first), label, _last(text, NUMBER, 0))
    return F.coalesce(boxed(text), label, _last(text, NUMBER, 0))


def plain_latex(text: Column) -> Column:
    """Fractions, roots, text and spacing commands rewritten, up to five deep; other commands are left as they are."""
    out = F.regexp_replace(text, r"\\left|\\right|\\!|\\,|\;", "")
    out = F.regexp_replace(out, r"\\text\{[^{}]*\}", "")
    for _ in range(5):
        out = F.regexp_replace(out, r"\\d?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "(($1)/($2))")
        out = F.regexp_replace(out, r"\\sqrt\{([^{}]*)\}", "sqrt($1)")
    for command, plain in ((r"\\cdot", "*"), (r"\\times", "*"), (r"\\div", "/"), (r"\\pi", "pi")):
        out = F.regexp_replace(out, command, plain)
    return F.when(text.rlike(r"[\\;]"), F.trim(out)).otherwise(F.trim(text))  # without either no pattern fits


def decimal_text(answer: Column) -> Column:
    """A bare number as plain decimal text, without currency, thousands commas or unit; null for anything else.

    A comma before groups of three digits separates thousands, any other is a decimal comma. JVM-only: for exact
    values of all forms use exact_value.
    """
    t = F.regexp_replace(F.trim(answer), r"\.$", "")
    t = F.trim(F.regexp_replace(t, r"^[$€£¥]\s*", ""))
    number = F.regexp_extract(t, r"^([-+]?\d[\d,]*(?:\.\d+)?)(?:\s*[^\d\s.,+*/^()-].*)?$", 1)
    thousands = number.rlike(r"^[-+]?\d{1,3}(,\d{3})+(\.\d+)?$")
    return F.when(number == "", F.lit(None)).otherwise(F.when(thousands, F.regexp_replace(number, ",", "")).otherwise(F.regexp_replace(number, ",", ".")))


def constant_text(answer: Column) -> Column:
    """As decimal_text, but a letter right after the digits is a free symbol, not a unit, and gives null."""
    return F.when(~F.trim(answer).rlike(r"\d[A-Za-z]$"), decimal_text(answer))


# values: a sum {(radicand, power of pi): coefficient}


def _mul(x: dict, y: dict) -> dict:
    out: dict = {}
    for (r, p), a in x.items():
        for (s, q), b in y.items():
            root, c = _root(r * s)
            key = (root, p + q)
            out[key] = out.get(key, 0) + a * b * c
    return {k: v for k, v in out.items() if v}


#: Bases that tell all primes below 3.3 * 10^24 (Sorenson and Webster).
PRIME_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
#: Numbers under roots beyond so many bits, once small factors are gone, have no value here (the answer is read as null).
ROOT_BITS = 80


def _is_prime(n: int) -> bool:
    if n < 43:
        return n in PRIME_BASES
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in PRIME_BASES:
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def _factor(n: int) -> int:
    """A proper factor of an odd composite number that is no square: Pollard's rho, products of 64 steps at a time."""
    for c in range(1, 1000):
        x = y = start = 2
        g = 1
        while g == 1:
            product, start = 1, (x, y)
            for _ in range(64):
                x = (x * x + c) % n
                y = (y * y + c) % n
                y = (y * y + c) % n
                product = product * (x - y) % n
            g = gcd(product, n)
        if g == n:  # the factors met within these steps: one by one
            x, y = start
            g = 1
            while g == 1:
                x = (x * x + c) % n
                y = (y * y + c) % n
                y = (y * y + c) % n
                g = gcd(x - y, n)
        if g != n:
            return g
    raise ValueError("no factor found")


def _primes(n: int) -> list[int]:
    """Prime factors of an odd number, with repeats."""
    if n == 1:
        return []
    s = isqrt(n)
    if s * s == n:
        return 2 * _primes(s)
    if _is_prime(n):
        return [n]
    f = _factor(n)
    return _primes(f) + _primes(n // f)


def _root(n: int) -> tuple[int, int]:
    """sqrt(n) = c * sqrt(root), root free of squares: small factors first, the rest by its primes."""
    c, root = 1, 1
    for d in range(2, 1000):
        if d * d > n:
            break
        k = 0
        while n % d == 0:
            n, k = n // d, k + 1
        c, root = c * d ** (k // 2), root * d ** (k % 2)
    s = isqrt(n)
    if s * s == n:
        return root, c * s
    if n.bit_length() > ROOT_BITS:
        raise ValueError("root of a number too large to factor")
    for prime, k in Counter(_primes(n)).items():
        c, root = c * prime ** (k // 2), root * prime ** (k % 2)
    return root, c


def _value(node: ast.AST):
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Tuple):
        return tuple(_value(e) for e in node.elts)
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return {(1, 0): Fraction(node.value)} if Fraction(node.value) else {}
    if isinstance(node, ast.Name) and node.id == "pi":
        return {(1, 1): Fraction(1)}
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        v = _value(node.operand)
        return {k: -c for k, c in v.items()} if isinstance(node.op, ast.USub) else v
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "sqrt" and len(node.args) == 1:
        v = _value(node.args[0])
        q = v.get((1, 0), Fraction(0))
        if set(v) - {(1, 0)} or q < 0:
            raise ValueError("root of no rational number")
        root, c = _root(q.numerator * q.denominator)
        return {(root, 0): Fraction(c, q.denominator)} if q else {}
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left), _value(node.right)
        if isinstance(a, tuple) or isinstance(b, tuple):
            raise ValueError("arithmetic on tuples")
        if isinstance(node.op, (ast.Add, ast.Sub)):
            sign = 1 if isinstance(node.op, ast.Add) else -1
            return {k: v for k in {*a, *b} if (v := a.get(k, 0) + sign * b.get(k, 0))}
        if isinstance(node.op, ast.Mult):
            return _mul(a, b)
        if isinstance(node.op, ast.Div) and len(b) == 1:
            ((r, p), c), = b.items()
            return {(k[0], k[1] - p): v for k, v in _mul(a, {(r, 0): 1 / (c * r)}).items()}
        if isinstance(node.op, ast.Pow) and set(b) <= {(1, 0)}:
            n = b.get((1, 0), Fraction(0))
            if n.denominator == 1 and abs(n) <= 64:
                out = {(1, 0): Fraction(1)}
                for _ in range(abs(int(n))):
                    out = _mul(out, a)
                return out if n >= 0 else _value(ast.parse("'1'", mode="eval")) and _inverse(out)
    raise ValueError("unsupported form")


def _inverse(v: dict) -> dict:
    if len(v) != 1:
        raise ValueError("inverse of a sum")
    ((r, p), c), = v.items()
    return {(r, -p): 1 / (c * r)}


def _text(v) -> str:
    if isinstance(v, tuple):
        return "(" + ",".join(map(_text, v)) + ")"
    parts = []
    for (r, p), c in sorted(v.items()):
        parts.append("*".join([str(c), *([f"sqrt{r}"] if r != 1 else []), *([f"pi^{p}"] if p else [])]))
    return "+".join(parts) or "0"


def parse_expression(text: str):
    """The value of a sum, product, power, root or tuple; numbers stay exact, a product sign may be left out."""
    t = text.replace("^", "**").replace("√", "sqrt")
    t = re.sub(r"(?<=[\d)])\s*(?=pi|sqrt|\()", "*", t)
    t = re.sub(r"(?<=pi|..\))\s*(?=\d)", "*", t) if re.search(r"(pi|\))\s*\d", t) else t
    t = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?|\.\d+)(?![\w.])", r"'\1'", re.sub(r"(\d)(?=[a-z])", r"\1*", t))
    return _value(ast.parse(t.strip(), mode="eval"))


def read_value(answer: str | None) -> str | None:
    """Canonical text of an extracted answer (LaTeX already plain), or null."""
    if answer is None:
        return None
    t = answer.strip().rstrip(".")
    if "\\" in t:
        return None
    t = re.sub(r"^[$€£¥]\s*", "", t).strip()
    if re.fullmatch(r"[-+]?\d[\d.,]*", t):
        t = t.replace(",", "") if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d+)?", t) else t.replace(",", ".")
    unit = re.match(r"^([-+]?\d[\d,]*(?:\.\d+)?)\s+[^\W\d_]{2,}.*$", t)
    if unit:
        t = unit[1].replace(",", "") if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d+)?", unit[1]) else unit[1].replace(",", ".")
    try:
        return _text(parse_expression(t))
    except (ValueError, SyntaxError, ZeroDivisionError, TypeError, RecursionError, AttributeError, MemoryError):
        lead = re.match(r"[-+]?\d+(?:\.\d+)?", t)
        return _text({(1, 0): Fraction(lead[0])} if lead and Fraction(lead[0]) else {}) if lead else None


#: Distinct texts whose values a task keeps at hand.
KEPT = 1 << 14


def _once(texts: pd.Series, value) -> pd.Series:
    """value of each text, worked out once for equal ones of a batch; null stays null."""
    codes, distinct = pd.factorize(texts)
    found = pd.array([value(t) for t in distinct] + [None], dtype=object)  # -1, of null, is the last
    return pd.Series(found[codes], index=texts.index, dtype=object)


@lru_cache(KEPT)
def _read(answer: str) -> str | None:
    return read_value(answer)


@F.pandas_udf(T.StringType())
def _exact(answer: pd.Series) -> pd.Series:
    return _once(answer, _read)


def exact_value(answer: Column) -> Column:
    """Canonical exact value of an answer; equal values have equal texts. Rewriting LaTeX runs before, in the JVM."""
    return _exact(plain_latex(answer))


def same_answer(a: Column, b: Column) -> Column:
    """Of two canonical values: false, not null, where either is null; never null-safe equality."""
    return F.coalesce(a == b, F.lit(False))


def gsm8k(answer: Column) -> Column:
    """struct(final, steps): the text after `####` without commas, and the (expr, value) pairs of `<<expr=value>>`."""
    final = F.regexp_replace(F.regexp_extract(answer, r"####\s*([^\n]+)", 1), ",", "")
    pair = r"<<([^<>=]*)=([^<>]*)>>"
    steps = F.zip_with(F.regexp_extract_all(answer, F.lit(pair), F.lit(1)), F.regexp_extract_all(answer, F.lit(pair), F.lit(2)), lambda e, v: F.struct(e.alias("expr"), v.alias("value")))
    return F.struct(F.when(final != "", F.trim(final)).alias("final"), steps.alias("steps"))


@lru_cache(KEPT)
def _worked_out(e: str) -> str | None:
    try:
        v = parse_expression(e) if re.fullmatch(r"[\d\s.+*/()-]+", e) else None
    except (ValueError, SyntaxError, ZeroDivisionError, TypeError, RecursionError, AttributeError):
        return None
    return None if v is None or isinstance(v, tuple) else _text(v)


@F.pandas_udf(T.StringType())
def arithmetic(expression: pd.Series) -> pd.Series:
    """Exact value of + - * / over rational numbers as `n` or `n/d`; null for any other form. Parsed, never run."""
    return _once(expression, _worked_out)


def numbers(text: Column) -> Column:
    """Distinct numbers of a text as written, decimal commas as points, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", ".")))


def first_missing_step(steps: Column, text: Column) -> Column:
    """The first reference step whose value is not among the numbers of the attempt; null if all are."""
    have = F.transform(numbers(text), lambda x: x.try_cast("double"))
    return F.get(F.filter(steps, lambda s: ~F.array_contains(have, s["value"].try_cast("double"))), 0)


def perturbed(answer: Column) -> Column:
    """A numeric answer plus one, decimals rounded to two places; null for others."""
    whole = F.trim(answer).rlike(r"^-?\d+$")
    number = F.trim(answer).try_cast("double")
    return F.when(whole, (F.trim(answer).try_cast("decimal(38,0)") + 1).cast("string")).when(number.isNotNull(), F.format_string("%.2f", number + 1))


def verdict_pick(text: Column, answer_a: Column, answer_b: Column) -> Column:
    """A or B by the last `Verdict: Solution X`, else by the value of the judge's own answer (A before B), else
    `invented`; answer_a and answer_b are canonical values."""
    said = F.upper(_last(text, r"(?i)verdict\s*[:\-]?\s*solution\s*([AB])\b"))
    own = exact_value(extract_answer(text))
    return F.coalesce(said, F.when(same_answer(own, answer_a), "A").when(same_answer(own, answer_b), "B"), F.lit("invented"))


def swapped_labels(text: Column) -> Column:
    """`Solution A` and `Solution B` exchanged at once."""
    hold = F.regexp_replace(text, r"\bSolution A\b", "Solution \u0001")
    return F.regexp_replace(F.regexp_replace(hold, r"\bSolution B\b", "Solution A"), "Solution \u0001", "Solution B")


def action(text: Column, strict: bool = True) -> Column:
    """KEEP, REVISE or INVALID. strict: the whole text is one command; lenient: the last command in it."""
    if strict:
        t = F.trim(text)
        return F.when(t.rlike(r"^KEEP$"), "KEEP").when(t.rlike(r"(?s)^REVISE\s*\n.*\S.*$"), "REVISE").otherwise("INVALID")
    return F.coalesce(_last(text, r"\b(KEEP|REVISE)\b"), F.lit("INVALID"))


def reward(initial_ok: Column, final_ok: Column, act: Column) -> Column:
    """Reward of a transition: keeping right or repairing wrong 1, harming -1, else 0; an invalid action -0.5."""
    return (
        F.when(act == "INVALID", -0.5)
        .when(initial_ok & final_ok & (act == "KEEP"), 1.0)
        .when(~initial_ok & final_ok, 1.0)
        .when(initial_ok & ~final_ok, -1.0)
        .otherwise(0.0)
    )


def code_block(text: Column) -> Column:
    """The first fenced block, else the whole text."""
    block = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```", 1)
    return F.when(block != "", block).otherwise(text)


def entry_point(code: Column) -> Column:
    name = F.regexp_extract(code, r"(?m)^\s*def\s+([A-Za-z_]\w*)\s*\(", 1)
    return F.when(name != "", name)


@F.pandas_udf(T.StringType())
def code_form(code: pd.Series) -> pd.Series:
    """top_level, Solution_method or null: where the first function is defined. Parsed, never run."""

    def one(c: str | None):
        try:
            body = ast.parse(c).body if c is not None else []
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        if any(isinstance(n, ast.FunctionDef) for n in body):
            return "top_level"
        inside = any(isinstance(n, ast.ClassDef) and n.name == "Solution" and any(isinstance(m, ast.FunctionDef) for m in n.body) for n in body)
        return "Solution_method" if inside else None

    return code.map(one)


def verify(reference: Column, text: Column) -> Column:
    """struct(passed, detail): the extracted answer of a text against a reference answer, by exact value."""
    want, got = exact_value(reference), exact_value(extract_answer(text))
    detail = F.when(got.isNull(), "no readable answer").when(want.isNull(), "unreadable reference").when(got == want, "equal").otherwise(F.concat(F.lit("got "), got, F.lit(" want "), want))
    return F.struct(same_answer(got, want).alias("passed"), detail.alias("detail"))


#: Reasons of the gate that send a lesson back.
HARD = ("forbidden_number", "protected_ngram", "empty", "committed_side_remains", "no_rule", "no_template")


def edit_gate(text: Column, forbidden: Column | None = None, protected: list[str] | None = None) -> Column:
    """struct(text, action, reasons) of a self-written lesson: list markers become dashes, a last line that commits to
    one side goes if the body names no other side; then accept (nothing done), normalize, or retry where one of the
    forbidden numbers (an array) or eight words in a row of a protected text occur, no rule or no template of eight
    words is left, or a committed side remains."""
    from sieveline.functions.text import word_grams, words

    def values(found: Column) -> Column:
        return F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("decimal(38,10)"))

    verdict = r"(?i)verdict:\s*solution\s*([AB])\b"
    clean = F.regexp_replace(F.trim(text), r"(?im)^([ \t]*)(?:step[ \t]+)?\d{1,2}[.):][ \t]+", "$1- ")
    lines = F.split(clean, "\n")
    last, body = F.element_at(lines, -1), F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n")
    side = F.upper(F.regexp_extract(last, verdict, 1))
    other = F.when(side == "A", body.rlike(r"(?i)solution\s*B\b")).when(side == "B", body.rlike(r"(?i)solution\s*A\b")).otherwise(True)
    commits = (F.regexp_count(last, F.lit(verdict)) == 1) & ~other
    chosen = F.trim(F.when(commits, body).otherwise(clean))
    sides = F.array_distinct(F.transform(F.regexp_extract_all(chosen, F.lit(verdict), F.lit(1)), F.upper))
    n_words = lambda t: F.regexp_count(t, F.lit(r"(?U)\w+"))
    halves = F.split(chosen, "(?i)ideal response template|\n[ \t]*\n", 2)
    leaked = F.lit(False) if forbidden is None else F.coalesce(F.arrays_overlap(values(F.regexp_extract_all(chosen, F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))), values(forbidden)), F.lit(False))
    grams = [word_grams(words(F.lit(p), r"(?U)\w+"), 8, "empty") for p in protected or []]
    overlaps = F.arrays_overlap(word_grams(words(chosen, r"(?U)\w+"), 8, "empty"), F.flatten(F.array(*grams))) if grams else F.lit(False)
    reasons = F.array_compact(
        F.array(
            F.when(clean != F.trim(text), F.lit("list_markers")),
            F.when(commits, F.lit("committed_side")),
            F.when(leaked, F.lit("forbidden_number")),
            F.when(overlaps, F.lit("protected_ngram")),
            F.when(chosen == "", F.lit("empty")),
            F.when(F.size(sides) == 1, F.lit("committed_side_remains")),
            F.when(n_words(F.get(halves, 0)) < 8, F.lit("no_rule")),
            F.when(F.coalesce(n_words(F.get(halves, 1)), F.lit(0)) < 8, F.lit("no_template")),
        )
    )
    bad = F.arrays_overlap(reasons, F.array(*map(F.lit, HARD)))
    act = F.when(bad, "retry").when(F.size(reasons) > 0, "normalize").otherwise("accept")
    return F.struct(chosen.alias("text"), act.alias("action"), reasons.alias("reasons"))


def output_flags(text: Column, hit_cap: Column) -> Column:
    """Detectors of a program-like answer: S-format (no labelled or boxed answer), S-loop (cut off while repeating a
    line), S-integer (a decimal where the answer is a whole number of things)."""
    answer = extract_answer(text, "strict")
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    loop = hit_cap & (F.size(lines) - F.size(F.array_distinct(lines)) >= 3)
    return F.array_compact(F.array(F.when(answer.isNull(), F.lit("S-format")), F.when(loop, F.lit("S-loop")), F.when(F.coalesce(answer, F.lit("")).rlike(r"^-?\d+\.\d*[1-9]\d*$"), F.lit("S-integer"))))
