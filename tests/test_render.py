"""Rendering and normalisation."""

import base64
import math

from pyspark.sql import functions as F

from tessera.operators import render as R


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_user_content_prefix_rules(spark):
    rows = [("Q", ""), ("Q", "extra")]
    sch = "instruction string, input string"
    assert one(spark, rows, sch, R.user_content(F.col("instruction"), F.col("input"))) == ["Q", "Q\nextra"]
    twice = "A {instruction} B {instruction}"
    assert one(spark, rows, sch, R.user_content(F.col("instruction"), F.col("input"), twice))[0] == "A Q B Q"
    # without placeholder the prefix replaces the instruction (kept as in the reference)
    assert one(spark, rows, sch, R.user_content(F.col("instruction"), F.col("input"), "Only"))[1] == "Only\nextra"
    b64 = base64.b64encode("前缀：{instruction}".encode()).decode()
    got = one(spark, rows, sch, R.user_content(F.col("instruction"), F.col("input"), R.prefix_from_base64(b64)))
    assert got[0] == "前缀：Q"


MSGS = [[("system", "S"), ("user", "U1"), ("assistant", "A1"), ("user", "U2")]]
MSG_SCHEMA = "m array<struct<role:string,content:string>>"


def _msgs(spark):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in m],) for m in MSGS], MSG_SCHEMA)


def test_fallback_and_chatml(spark):
    df = _msgs(spark)
    assert df.select(R.fallback_chat_text(F.col("m"))).first()[0] == \
        "User: U1\n\nAssistant: A1\n\nUser: U2\n\nAssistant: "
    assert df.select(R.chatml_messages(F.col("m"), True)).first()[0] == (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU1<|im_end|>\n<|im_start|>assistant\nA1<|im_end|>\n"
        "<|im_start|>user\nU2<|im_end|>\n<|im_start|>assistant\n")


def test_rl_prompt_keeps_system_and_user(spark):
    df = _msgs(spark).withColumn("instruction", F.lit(None).cast("string"))
    p = R.rl_prompts(df, "m", "instruction").first().prompt
    assert [x.role for x in p] == ["system", "user", "user"]


def test_alpaca_templates(spark):
    rows = [("I", "", "O"), ("I", "X", "O")]
    sch = "instruction string, input string, output string"
    c = F.col
    assert one(spark, rows, sch, R.chatml_alpaca(c("instruction"), c("input"), c("output")))[1] == \
        "<|im_start|>user\nI\nX<|im_end|>\n<|im_start|>assistant\nO<|im_end|>"
    assert one(spark, rows, sch, R.heading_template(c("instruction"), c("output")))[0] == "### 问题:\nI\n\n### 回答:\nO"


def test_pairs_need_both_sides(spark):
    df = spark.createDataFrame([("p", "c", "r"), ("p", None, "r")], "prompt string, chosen string, rejected string")
    out = R.preference_pairs_alpaca(df).collect()
    assert len(out) == 1 and out[0].chosen_messages[1].content == "p"


def test_reply_extraction_keeps_text_without_marker(spark):
    rows = [("<|im_start|>assistant\n  hi there \n",), ("no marker at all",)]
    got = one(spark, rows, "t string", R.reply_after_assistant(F.col("t")))
    assert got == ["hi there", "no marker at all"]
    assert one(spark, rows, "t string", R.reply_after_last(F.col("t"), "<|im_start|>assistant"))[1] == \
        "no marker at all"


def test_non_finite_sentinel_and_names(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    e = df.select(R.encode_non_finite(F.col("v")).alias("e")).collect()
    assert [x.e.value for x in e] == [-999999.0, -999999.0, 1.0]
    assert e[0].e.labels == {"nan": "true"} and e[2].e.labels == {}
    names = one(spark, [("/models/qwen-7b/",), ("ckpt",)], "p string", R.short_model_name(F.col("p")))
    assert names == ["qwen-7b", "ckpt"]
    assert not math.isnan(1.0)


def test_empty_outputs(spark):
    df = spark.createDataFrame([(0, "a" * 100, " \n"), (1, "b", "ok"), (2, "c", None), (3, "d", "")],
                               "idx long, instruction string, output string")
    cnt, first = R.empty_outputs(df)
    assert cnt.first().n_empty == 3
    assert [r.idx for r in first.collect()] == [0, 2, 3] and len(first.first().instruction80) == 80


def test_pairs_of_either_form(spark):
    raw = ['{"instruction":"q","chosen":"a","rejected":"b"}', '{"prompt":"p","chosen":"a","rejected":"b"}', '{"chosen":"a","rejected":null}', '{"chosen":"a"}',
           '{"chosen":[{"role":"user","content":"u"},{"role":"assistant","content":"x"}],"rejected":[{"role":"assistant","content":null}]}']
    v = spark.createDataFrame([(x,) for x in raw], "raw string").select(F.parse_json("raw").alias("v"))
    get = lambda n, t: F.try_variant_get("v", f"$.{n}", t).alias(n)
    rows = v.select(get("instruction", "string"), get("prompt", "string"), get("chosen", "variant"), get("rejected", "variant"))
    got = [([tuple(m) for m in r.chosen_messages], [tuple(m) for m in r.rejected_messages]) for r in R.preference_pairs(rows).collect()]
    lead = lambda q: [("system", R.DEFAULT_SYSTEM), ("user", q)]
    assert got == [(lead("q") + [("assistant", "a")], lead("q") + [("assistant", "b")]), (lead("p") + [("assistant", "a")], lead("p") + [("assistant", "b")]),
                   ([("user", "u"), ("assistant", "x")], [("assistant", None)])]
    lists = spark.createDataFrame([([("user", "u")], [("user", "w")]), ([("user", "u")], None)], "chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")
    assert R.preference_pairs(lists).count() == 1


def test_a_turn_without_content_stays(spark):
    df = spark.createDataFrame([([("user", None), ("assistant", "a")],)], "m array<struct<role:string,content:string>>")
    r = df.select(R.fallback_chat_text(F.col("m")).alias("f"), R.chatml_messages(F.col("m")).alias("c")).first()
    assert r.f == "User: \n\nAssistant: a\n\n" and r.c == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
