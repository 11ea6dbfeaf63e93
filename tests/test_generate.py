"""Generators (G1-G7): determinism, exact sizes, fixed quirks."""

import json

from pyspark.sql import functions as F

from tessera.operators import generate as G
from tessera.operators import lint as L


def idx(spark, n, start=0):
    return spark.range(start, start + n).withColumnRenamed("id", "i")


def test_sft_records_lint_clean_and_deterministic(spark):
    a = G.gen_sft(idx(spark, 40), "train", 0, seed=5)
    assert L.lint(a).count() == 0
    b = G.gen_sft(idx(spark, 40), "train", 0, seed=5)
    assert sorted(r.raw for r in a.collect()) == sorted(r.raw for r in b.collect())
    cats = {json.loads(r.raw)["category"] for r in a.collect()}
    assert cats == {p[0] for p in G.PROBLEMS}


def test_test_split_offset(spark):
    t = G.gen_sft(idx(spark, 5), "test", 100, seed=1)
    assert sorted(r.idx for r in t.collect()) == [100, 101, 102, 103, 104]


def test_pairs_rejected_is_after_last_equals(spark):
    p = G.gen_pairs(idx(spark, 8)).collect()
    for r in p:
        assert r.rejected_text.startswith("The answer is ") and "<think>" in r.chosen_text


def test_calculus_coefficient_reduced_once(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "i long")
    out = G.gen_calculus(df, seed=2).where(F.col("type") == "integral").collect()
    for r in out:
        a, n = r.i // 5 + 1, r.i % 5 + 1
        coef = str(a // (n + 1)) if a % (n + 1) == 0 else f"{a}/{n + 1}"
        assert r.output == f"∫ {a}x^{n} dx = {coef}x^{n + 1} + C"


def test_integral_mixture_exact_size_and_share(spark):
    g = G.gen_integrals(idx(spark, 2000), seed=3)
    assert g.count() == 2000
    share = g.where(F.col("type") == "polynomial").count() / 2000
    assert 0.66 < share < 0.74


def test_corruption_kinds(spark):
    df = spark.createDataFrame([(i, "= 3 sin(x) + C") for i in range(60)], "i long, a string")
    out = df.select(G.corrupt(F.col("a"), F.col("i"), seed=1).alias("c")).collect()
    assert {r.c.kind: r.c.text for r in out} == {"marked": "= 3 sin(x) + C (错误)", "refusal": "无法计算此积分", "zero": "0 + C"}
    more = df.select(G.corrupt(F.col("a"), F.col("i"), seed=1, kinds=G.OPT_IN_CORRUPTIONS).alias("c")).collect()
    by = {}
    for r in more:
        by.setdefault(r.c.kind, set()).add(r.c.text)
    assert by == {"sign": {"= 3 sin(x) - C"}, "coefficient": {f"= {k} sin(x) + C" for k in (4, 5, 6)}}
    none = spark.createDataFrame([(i, "= e^x") for i in range(20)], "i long, a string")
    assert {r.c.text for r in none.select(G.corrupt(F.col("a"), F.col("i"), seed=1, kinds=G.OPT_IN_CORRUPTIONS).alias("c")).collect()} == {"= e^x (错误)"}


def test_definite_integrals_have_their_value(spark):
    import re
    rows = G.gen_integrals(idx(spark, 3000), seed=3).where("type = 'definite'").collect()
    assert len(rows) > 20
    for r in rows:
        b, a, n = map(int, re.fullmatch(r"∫ from 0 to (\d+) of (\d+)x\^(\d+) dx", r.prompt).groups())
        assert a * b ** (n + 1) == (n + 1) * int(r.correct_answer[2:])
    assert {r.type for r in G.gen_integrals(idx(spark, 3000), seed=3).select("type").distinct().collect()} >= {"polynomial", "rational", "composite", "trig"}


def test_rejected_answers_are_wrong_and_not_empty(spark):
    g = G.gen_integrals(idx(spark, 1000), seed=11)
    out = g.select("correct_answer", G.corrupt(F.col("correct_answer"), F.col("i"), seed=13)["text"].alias("r")).collect()
    assert all(r.r.strip(" =") and r.r != r.correct_answer for r in out)


def test_texts_grow_with_the_index(spark):
    few = {(r.chosen[1].content, r.chosen_text) for r in G.gen_pairs(idx(spark, 300)).collect()}
    many = {(r.chosen[1].content, r.chosen_text) for r in G.gen_pairs(idx(spark, 1200)).collect()}
    assert len(few) == 300 and len(many) == 1200


def test_arithmetic_corpus_uses_the_whole_index(spark):
    out = G.gen_arithmetic(idx(spark, 114)).collect()
    assert len(out) == 114 and sum(r.split == "train" for r in out) == 90
    assert all(eval(r.instruction[8:-1]) == int(r.output) for r in out)


def test_calculus_reference_mode_keeps_double_division(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "i long")
    fixed = {r.i: r.output for r in G.gen_calculus(df, seed=2).collect()}
    ref = {r.i: r.output for r in G.gen_calculus(df, seed=2, mode="reference").collect()}
    # a = i // 5 + 1 and n = i % 5 + 1: the modes differ where n + 1 divides a
    diff = [i for i in fixed if fixed[i] != ref[i]]
    assert diff and all(ref[i].endswith(f"/{i % 5 + 2} + C") for i in diff)
    assert all((i // 5 + 1) % (i % 5 + 2) == 0 for i in diff)
