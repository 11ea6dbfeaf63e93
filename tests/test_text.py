"""Unicode parity of the regex helpers and the answer / reward expressions."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import rewards as W
from tessera.functions import text as T

UNIT_PY = re.compile(r"\b(m/s|m/s\^2|kg|N|J|Pa|K|eV|Hz|W|C|V|T|mol|rad)\b")

UNIT_PROBES = ["m/s²", "m/s，", "10N的", "10 N 的", "v = 3 m/s", "5kg", "5 kg", "E = 2 eV.", "Hz", "(J)",
               "KJ", "rad/s", "速度为 3 m/s。"]


def _one(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_unit_pattern_matches_python(spark):
    got = _one(spark, lambda c: c.rlike(W.UNIT), UNIT_PROBES)
    assert got == [bool(UNIT_PY.search(p)) for p in UNIT_PROBES]
    assert got[:4] == [False, True, False, True]


def test_strip_is_python_strip(spark):
    vals = ["  a b \n", "　答案　", "\t\x0b\x1cx\x1f\x85", "", " y "]
    assert _one(spark, T.strip, vals) == [v.strip() for v in vals]


def test_whitespace_tokens_is_str_split(spark):
    vals = ["a  b\tc\n", "　x　y ", "", "one"]
    assert _one(spark, T.whitespace_tokens, vals) == [v.split() for v in vals]


# reply -> (answer, solution)
PARSE_CASES = {
    "答案：42\n\n解答：因为 6×7": ("42", "因为 6×7"),
    "答案:42\n解答: x": ("42", "x"),
    "答案：42": ("42", ""),
    "解答：only solution": ("", "only solution"),
    "答案：1\n\n解答：a\n解答：b": ("1", "a\n解答：b"),
    "no markers at all\n": ("no markers at all", ""),
    "": ("", ""),
    "答案：\n\n正文": ("正文", ""),
    "前言\n答案：　3\n\n后文": ("3", ""),
    "答案： 5 \n解答：\n  step  ": ("5", "step"),
}


def test_answer_parse_matches_rules(spark):
    got = _one(spark, W.answer_and_solution, list(PARSE_CASES))
    assert {c: (g["answer"], g["solution"]) for c, g in zip(PARSE_CASES, got)} == PARSE_CASES


STRUCTURAL_CASES = {"<think>a</think> v = 3 m/s": 1.0, "x =　５": 0.5, "10N的": 0.3, "nothing": 0.0, "T = 300 K": 0.7}


@pytest.mark.parametrize("r", STRUCTURAL_CASES)
def test_structural_reward(spark, r):
    assert _one(spark, W.structural_reward, [r])[0] == pytest.approx(STRUCTURAL_CASES[r])


def test_expression_match_and_credit(spark):
    df = spark.createDataFrame([("解: ∫ 2x dx = x^2 + C", "= x^2 + C"), ("= \\sin(x)", "= \\cos(x)"),
                                ("no equation", "= 1")], "a string, b string")
    ok = [r[0] for r in df.select(W.expression_match(F.col("a"), F.col("b"))).collect()]
    assert ok == [True, False, False]   # sin and cos stay different (Q10 fixed)
    cred = [r[0] for r in df.select(W.partial_credit_reward(F.col("a"), F.lit(False))).collect()]
    # '解', '=', '+ C', 'C' and the integral sign: -0.5 + 4 * 0.15 + 0.1
    assert cred[0] == pytest.approx(0.2)
    assert cred[2] == pytest.approx(-0.5)


def test_unit_java_form_equals_portable_form(spark):
    probes = UNIT_PROBES + ["kg", "xkg", "kgx", "m/s^2", "am/s", "_N", "N_", "２N", "Nº", "\nK\n", "mol/L", "prad"]
    a = _one(spark, lambda c: c.rlike(W.UNIT), probes)
    b = _one(spark, lambda c: c.rlike(W.UNIT_JAVA), probes)
    assert a == b == [bool(UNIT_PY.search(p)) for p in probes]


def test_strip_all_python_whitespace(spark):
    v = T.WS_CHARS + "x" + T.WS_CHARS[::-1] + "y" + T.WS_CHARS
    assert _one(spark, T.strip, [v])[0] == v.strip()
