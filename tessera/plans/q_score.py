"""Scoring jobs (R1-R5, A14, J3, J4) over replies derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewards as W
from ..functions import text as T
from ..sources import tables
from .catalog import register
from .common import r6

WS = T.WS
STRIP_SQL = "'^" + WS + "+|" + WS + r"+\z'"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {STRIP_SQL}, '', 'g')"


def _parse_sql(t: str) -> tuple[str, str]:
    """SQL text of (answer, solution) for a non-null text expression t (same patterns as Spark)."""
    sol_split, sol_present = f"'{W.SOLUTION_SPLIT}'", f"'{W.SOLUTION_PRESENT}'"
    ans_present, to_end, to_break = f"'{W.ANSWER_PRESENT}'", f"'{W.ANSWER_TO_END}'", f"'{W.ANSWER_TO_BREAK}'"
    head = f"regexp_extract({t}, {sol_split}, 1)"
    tail = f"regexp_extract({t}, {sol_split}, 2)"
    split_ans = (f"CASE WHEN regexp_matches({head}, {ans_present}) "
                 f"THEN {_strip_sql(f'regexp_extract({head}, {to_end}, 1)')} ELSE {_strip_sql(head)} END")
    fb = (f"CASE WHEN regexp_matches({t}, {ans_present}) "
          f"THEN {_strip_sql(f'regexp_extract({t}, {to_break}, 1)')} ELSE '' END")
    answer = (f"CASE WHEN {t} = '' THEN '' WHEN regexp_matches({t}, {sol_present}) THEN {split_ans} "
              f"WHEN {fb} <> '' THEN {fb} ELSE {_strip_sql(t)} END")
    solution = f"CASE WHEN {t} <> '' AND regexp_matches({t}, {sol_present}) THEN {_strip_sql(tail)} ELSE '' END"
    return answer, solution


def eval_inputs(spark, sf_dir):
    """Ground truth and model replies with answer / solution markers, built from doc_id."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    i = F.col("doc_id").cast("string")
    fl = F.col("text")  # whole texts
    gt = d.select("doc_id", "lang", F.concat(F.lit("答案："), i, F.lit("\n\n解答："), fl).alias("gt_full"))
    k = F.col("doc_id") % 7
    reply = (F.when(F.col("doc_id") % 10 == 9, F.lit(None).cast("string"))
             .when(k == 0, F.concat(F.lit("答案："), i, F.lit("\n\n解答："), fl))
             .when(k == 1, F.concat(F.lit("答案:"), i, F.lit("\n解答: "), fl))
             .when(k == 2, F.concat(F.lit("答案："), (F.col("doc_id") + 1).cast("string")))
             .when(k == 3, F.concat(F.lit("解答："), fl))
             .when(k == 4, F.concat(F.lit("答案："), i, F.lit("\n\n解答："), fl, F.lit("\n解答：extra")))
             .when(k == 5, fl)
             .otherwise(F.lit("")))
    replies = d.select(F.col("doc_id").alias("id"), reply.alias("model_full"))
    return gt, replies


EVAL_INPUT_SQL = r"""
gt AS (SELECT doc_id, lang, '答案：' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || '解答：'
              || text AS gt_full, text AS fl FROM documents),
rep AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 9 THEN NULL
   WHEN doc_id % 7 = 0 THEN '答案：' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || '解答：' || fl
   WHEN doc_id % 7 = 1 THEN '答案:' || CAST(doc_id AS VARCHAR) || chr(10) || '解答: ' || fl
   WHEN doc_id % 7 = 2 THEN '答案：' || CAST(doc_id + 1 AS VARCHAR)
   WHEN doc_id % 7 = 3 THEN '解答：' || fl
   WHEN doc_id % 7 = 4 THEN '答案：' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || '解答：' || fl || chr(10) || '解答：extra'
   WHEN doc_id % 7 = 5 THEN fl ELSE '' END AS model_full FROM gt),
j AS (SELECT gt.doc_id, gt.lang, gt.gt_full, coalesce(rep.model_full, '') AS model_full
      FROM gt LEFT JOIN rep ON gt.doc_id = rep.id)"""

_GA, _GS = _parse_sql("gt_full")
_MA, _MS = _parse_sql("model_full")
EVAL_TABLE_SQL = "WITH " + EVAL_INPUT_SQL + f""",
e AS (SELECT doc_id, lang, {_GA} AS gt_answer, {_GS} AS gt_solution, {_MA} AS model_answer, {_MS} AS model_solution
      FROM j)"""


def eval_table_df(spark, sf_dir):
    gt, replies = eval_inputs(spark, sf_dir)
    j = gt.join(replies, gt["doc_id"] == replies["id"], "left")  # J4: every ground truth row is kept
    g = W.answer_and_solution(F.col("gt_full"))
    m = W.answer_and_solution(F.col("model_full"))
    return j.select("doc_id", "lang", g["answer"].alias("gt_answer"), g["solution"].alias("gt_solution"),
                    m["answer"].alias("model_answer"), m["solution"].alias("model_solution"))


@register("eval_table", EVAL_TABLE_SQL + """
SELECT *, gt_answer = model_answer AS answer_match FROM e""")
def eval_table(spark, sf_dir):
    """R1 + J4: parsed answer and solution of ground truth and reply, joined by id."""
    e = eval_table_df(spark, sf_dir)
    return e.withColumn("answer_match", F.col("gt_answer") == F.col("model_answer"))


@register("eval_accuracy", EVAL_TABLE_SQL + """
SELECT lang, count(*) AS n, round(avg(CASE WHEN gt_answer = model_answer THEN 1.0 ELSE 0.0 END), 6) AS answer_accuracy,
       round(avg(CASE WHEN gt_solution = model_solution THEN 1.0 ELSE 0.0 END), 6) AS solution_accuracy
FROM e GROUP BY lang""")
def eval_accuracy(spark, sf_dir):
    """Exact-match rate of answers and solutions per language."""
    e = eval_table_df(spark, sf_dir)
    return e.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg((F.col("gt_answer") == F.col("model_answer")).cast("double"))).alias("answer_accuracy"),
        r6(F.avg((F.col("gt_solution") == F.col("model_solution")).cast("double"))).alias("solution_accuracy"))


# suffixes appended to real text (which rarely has units or '=') to exercise each rule
STRUCT_SUFFIXES = [" <think>reasoning</think> v = 3.5 m/s", " F = 10 N 的", " a = 9.8 m/s²", " 速度 m/s，",
                   " 10N的", " <think>x</think>", " E = -13.6 eV", ""]


def _suffix_col(values, k):
    return F.element_at(F.array(*[F.lit(s) for s in values]), (k + 1).cast("int"))


def _suffix_sql(values, k):
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in values) + f"][{k} + 1]"


@register("structural_reward", f"""
SELECT doc_id, CAST(round(
   (CASE WHEN contains(r, '<think>') AND contains(r, '</think>') THEN 0.3 ELSE 0.0 END)
 + (CASE WHEN regexp_matches(r, '{W.EQUATION}') THEN 0.2 ELSE 0.0 END)
 + (CASE WHEN regexp_matches(r, '{W.UNIT}') THEN 0.2 ELSE 0.0 END)
 + (CASE WHEN regexp_matches(r, '{T.DIGIT}') THEN 0.3 ELSE 0.0 END), 6) AS DOUBLE) AS reward
FROM (SELECT doc_id, text || {_suffix_sql(STRUCT_SUFFIXES, 'doc_id % 8')} AS r FROM documents)""")
def structural_reward(spark, sf_dir):
    """R2: structural reward of whole reply texts."""
    d = tables.load(spark, sf_dir, "documents")
    r = F.concat(F.col("text"), _suffix_col(STRUCT_SUFFIXES, F.col("doc_id") % 8))
    return d.select("doc_id", r6(W.structural_reward(r)).alias("reward"))


REPLY_SUFFIXES = [" 解: ∫ 2x dx = x^2 + C", " 积分 = \\frac{1}{2}x^2 + C", " 步骤 = \\sin(x)<|im_end|>",
                  " = π/2", " no equation here", " = x^{2}"]
CORRECT_ANSWERS = ["∫ 2x dx = x^2 + C", "= \\frac{1}{2} x^2 + C", "y = sin(x)"]


def _expr_sql(t: str) -> str:
    out = "NULL"
    for p in reversed(W.EXPR_PATTERNS):
        out = f"CASE WHEN regexp_matches({t}, '{p}') THEN {_strip_sql(f'regexp_extract({t}, {chr(39)}{p}{chr(39)}, 1)')} ELSE {out} END"
    return out


def _norm_sql(e: str) -> str:
    s = f"replace(replace({e}, '∫', ''), 'dx', '')"
    s = f"replace(replace({s}, 'π', 'pi'), '∞', 'oo')"
    s = f"replace({s}, '\\frac', '/')"
    s = f"regexp_replace({s}, '\\\\([a-zA-Z]+)', '\\1', 'g')"
    s = f"replace(replace({s}, '{{', '('), '}}', ')')"
    return f"regexp_replace({s}, '{WS}', '', 'g')"


def _kw_sql(t: str, kws) -> str:
    return " + ".join(f"(CASE WHEN contains({t}, '{k}') THEN 1 ELSE 0 END)" for k in kws)


@register("symbolic_reward", f"""
WITH x AS (
  SELECT d.doc_id, d.text || {_suffix_sql(REPLY_SUFFIXES, 'd.doc_id % 6')} AS reply,
         {_suffix_sql(CORRECT_ANSWERS, 'c.c_custkey % 3')} AS correct_answer,
         CAST(l.quality AS DOUBLE) - 0.5 AS learned
  FROM documents d JOIN customer c ON c.c_custkey = d.doc_id % 120 LEFT JOIN labels l ON d.doc_id = l.doc_id),
y AS (SELECT *, {_expr_sql('reply')} AS a, {_expr_sql('correct_answer')} AS b FROM x),
z AS (SELECT *, coalesce(a IS NOT NULL AND a <> '' AND b IS NOT NULL AND b <> '' AND {_norm_sql('a')} = {_norm_sql('b')},
                         false) AS correct FROM y),
s AS (SELECT *, CASE WHEN correct THEN 1.0 ELSE greatest(least(-0.5 + ({_kw_sql('reply', W.PPO_KEYWORDS)}) * 0.15
        + CASE WHEN contains(reply, '∫') THEN 0.1 ELSE 0.0 END, 1.0), -1.0) END AS policy_reward,
        CASE WHEN correct THEN 1.0 ELSE greatest(-0.5 + ({_kw_sql('reply', W.RM_KEYWORDS)}) * 0.1, -1.0) END AS rm_reward
      FROM z)
SELECT doc_id, a AS model_expr, correct, CAST(round(policy_reward, 6) AS DOUBLE) AS policy_reward,
       CAST(round(rm_reward, 6) AS DOUBLE) AS rm_reward,
       CAST(round(CASE WHEN learned IS NULL THEN policy_reward ELSE 0.3 * learned + 0.7 * policy_reward END, 6) AS DOUBLE)
         AS combined_reward
FROM s""")
def symbolic_reward(spark, sf_dir):
    """R3 + R4 + R5 + J3: responses joined with the answers of their prompts, expression match, partial
    credit (both flavours), combined with a learned score.

    Prompts are customers, each with an answer; a document is a response to prompt doc_id mod 120.
    """
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    lab = tables.load(spark, sf_dir, "labels").select("doc_id", "quality")
    prompts = tables.load(spark, sf_dir, "customer").select("c_custkey")
    answers = prompts.select(F.col("c_custkey").alias("prompt_id"), _suffix_col(CORRECT_ANSWERS, F.col("c_custkey") % 3).alias("correct_answer"))
    responses = d.join(lab, "doc_id", "left").select(
        "doc_id", (F.col("doc_id") % 120).alias("prompt_id"),
        F.concat(F.col("text"), _suffix_col(REPLY_SUFFIXES, F.col("doc_id") % 6)).alias("reply"),
        (F.col("quality").cast("double") - 0.5).alias("learned"))
    x = W.with_answers(responses, answers)
    correct = W.expression_match(F.col("reply"), F.col("correct_answer"))
    pol = W.partial_credit_reward(F.col("reply"), correct)
    return x.select("doc_id", W.extract_expression(F.col("reply")).alias("model_expr"), correct.alias("correct"),
                    r6(pol).alias("policy_reward"),
                    r6(W.reward_model_credit(F.col("reply"), correct)).alias("rm_reward"),
                    r6(W.combined_reward(F.col("learned"), pol)).alias("combined_reward"))


KEYWORDS = ["the", "und", "les", "los"]


@register("keyword_accuracy", f"""
SELECT lang, count(*) AS n, round(avg(CASE WHEN {' OR '.join(f"contains(lower(text), '{k}')" for k in KEYWORDS)}
       THEN 100.0 ELSE 0.0 END), 6) AS accuracy_pct
FROM documents GROUP BY lang""")
def keyword_accuracy(spark, sf_dir):
    """Share of answers containing any expected keyword (case-insensitive), per language."""
    d = tables.load(spark, sf_dir, "documents")
    hit = W.keyword_hit(F.col("text"), F.array(*[F.lit(k) for k in KEYWORDS]))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                                 r6(F.avg(F.when(hit, 100.0).otherwise(0.0))).alias("accuracy_pct"))
