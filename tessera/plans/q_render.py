"""Rendering and normalisation jobs."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import render as R
from ..sources import tables
from . import derive
from ..streaming.metrics import new_run_dirs
from .catalog import register

ALPACA_SQL = r"""
alp0 AS (
  SELECT doc_id AS idx, split_part(text, chr(10), 1) AS instruction,
         CASE WHEN doc_id % 3 = 0 THEN 'lang: ' || lang ELSE '' END AS input,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS output,
         source AS category, lang
  FROM documents),
alp AS (SELECT * FROM alp0 UNION ALL
  SELECT -idx - 1 AS idx, instruction, input, '' AS output, category, lang FROM alp0 WHERE idx % 11 = 0)"""

PREFIX = "请解答下面的问题：{instruction}"
PREFIX_NO_PLACEHOLDER = "Answer the question."


@register("alpaca_user_content", "WITH " + ALPACA_SQL + r"""
SELECT idx,
  replace('请解答下面的问题：{instruction}', '{instruction}', instruction)
    || CASE WHEN extra <> '' THEN chr(10) || extra ELSE '' END AS user_content,
  'Answer the question.' || CASE WHEN extra <> '' THEN chr(10) || extra ELSE '' END AS user_content_replaced,
  instruction || CASE WHEN extra <> '' THEN chr(10) || extra ELSE '' END AS user_content_plain
FROM (SELECT *, input || CASE WHEN input <> '' AND output <> '' THEN chr(10) ELSE '' END || output AS extra FROM alp)""")
def alpaca_user_content(spark, sf_dir):
    """P1 + P2: user turn from Alpaca rows; prefix passed as base64, with and without placeholder.

    The rest of a document is part of the extra input, so whole texts are used.
    """
    a = derive.alpaca_records(spark, sf_dir)
    extra = F.concat("input", F.when((F.col("input") != "") & (F.col("output") != ""), F.lit("\n")).otherwise(F.lit("")), "output")
    b64 = base64.b64encode(PREFIX.encode("utf-8")).decode("ascii")
    return a.select("idx",
                    R.user_content(F.col("instruction"), extra, R.prefix_from_base64(b64)).alias("user_content"),
                    R.user_content(F.col("instruction"), extra, PREFIX_NO_PLACEHOLDER)
                    .alias("user_content_replaced"),
                    R.user_content(F.col("instruction"), extra).alias("user_content_plain"))


@register("chat_fallback_text", r"""
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' || text || chr(10) || chr(10) || 'Assistant: '
                                WHEN role = 'assistant' THEN text || chr(10) || chr(10) ELSE '' END, '' ORDER BY turn)
       AS chat_text
FROM conversations GROUP BY conv_id""")
def chat_fallback_text(spark, sf_dir):
    """Fallback chat template text per conversation (system turns drop out), rendered per turn."""
    t = tables.load(spark, sf_dir, "conversations")
    return R.join_turns(t, "conv_id", "turn", R.fallback_piece(F.col("role"), F.col("text")), out="chat_text")


@register("chatml_conversations", r"""
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
       AS chatml
FROM conversations GROUP BY conv_id""")
def chatml_conversations(spark, sf_dir):
    """ChatML of each conversation, system turns included, rendered per turn."""
    t = tables.load(spark, sf_dir, "conversations")
    return R.join_turns(t, "conv_id", "turn", R.chatml_piece(F.col("role"), F.col("text")), out="chatml")


@register("chatml_alpaca_system", "WITH " + ALPACA_SQL + r"""
SELECT idx, p AS prompt, p || output || '<|im_end|>' AS text FROM (
  SELECT idx, output, '<|im_start|>system' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>user'
     || chr(10) || input || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS p FROM alp)""")
def chatml_alpaca_system(spark, sf_dir):
    """P4 (Alpaca form): instruction as system turn; prompt and full text."""
    a = derive.alpaca_records(spark, sf_dir)
    r = R.chatml_alpaca_with_system(F.col("instruction"), F.col("input"), F.col("output"))
    return a.select("idx", r["prompt"].alias("prompt"), r["text"].alias("text"))


@register("chatml_alpaca", "WITH " + ALPACA_SQL + r"""
SELECT idx, '<|im_start|>user' || chr(10) || instruction || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || output || '<|im_end|>' AS text FROM alp""")
def chatml_alpaca(spark, sf_dir):
    """P5: ChatML without system turn."""
    a = derive.alpaca_records(spark, sf_dir)
    return a.select("idx", R.chatml_alpaca(F.col("instruction"), F.col("input"), F.col("output")).alias("text"))


@register("heading_template", "WITH " + ALPACA_SQL + r"""
SELECT idx, '### 问题:' || chr(10) || instruction || chr(10) || chr(10) || '### 回答:' || chr(10) || output AS text
FROM alp""")
def heading_template(spark, sf_dir):
    """Heading template."""
    a = derive.alpaca_records(spark, sf_dir)
    return a.select("idx", R.heading_template(F.col("instruction"), F.col("output")).alias("text"))


@register("rl_prompts", r"""
SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS prompt_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
         || '<|im_start|>assistant' || chr(10) AS prompt
FROM conversations WHERE role IN ('system', 'user') GROUP BY conv_id
UNION ALL
SELECT 'doc-' || CAST(doc_id AS VARCHAR), 2,
       '<|im_start|>system' || chr(10) || '你是物理推理助手，请展示详细的推导过程。<|im_end|>' || chr(10)
       || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
       || '<|im_start|>assistant' || chr(10)
FROM documents""")
def rl_prompts(spark, sf_dir):
    """RL prompts from chat records (system + user turns) and from instruction rows."""
    msgs = derive.conversation_messages(spark, sf_dir).select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("prompt_id"),
        F.col("messages"), F.lit(None).cast("string").alias("instruction"))
    alp = tables.load(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("prompt_id"),
        F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"),
        F.col("text").alias("instruction"))
    p = R.rl_prompts(msgs.unionByName(alp), "messages", "instruction")
    p = p.where(F.size("prompt") > 0)
    return p.select("prompt_id", F.size("prompt").cast("bigint").alias("n_turns"),
                    R.chatml_messages(F.col("prompt"), add_generation_prompt=True).alias("prompt"))


PAIRS_SQL = r"""
dl AS (SELECT d.doc_id, d.lang, d.text, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
ch AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM dl WHERE quality = 1),
rj AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM dl WHERE quality = 0),
cnt AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS nc, count(*) FILTER (WHERE quality = 0) AS nr FROM dl GROUP BY lang),
p AS (SELECT lang, nc, nr, unnest(range(1, greatest(nc, nr) + 1)) AS k FROM cnt WHERE nc > 0 AND nr > 0),
pairs AS (SELECT p.lang, p.k, ch.doc_id AS chosen_id, rj.doc_id AS rejected_id,
                 'Write a passage in ' || p.lang || '.' AS prompt, ch.text AS chosen, rj.text AS rejected
          FROM p JOIN ch ON ch.lang = p.lang AND ch.k = (p.k - 1) % nc + 1 JOIN rj ON rj.lang = p.lang AND rj.k = (p.k - 1) % nr + 1)"""


def preference_source(spark, sf_dir):
    """J2 / P8 input: per language, quality-1 documents are chosen and quality-0 ones rejected, in doc_id order.

    The shorter side is used again from its start, so every labelled document
    of a language with both sides is in a pair.
    """
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lab = tables.load(spark, sf_dir, "labels").select("doc_id", "quality")
    ids = d.select("doc_id", "lang").join(lab, "doc_id").where(F.col("quality").isin(0, 1))
    ranked = O.rank_within(ids, ["quality", "lang"], ["doc_id"], "k")
    n = ids.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("nc"), F.count_if(F.col("quality") == 0).alias("nr"))
    side = lambda q, name, size, other: (  # noqa: E731  a document of the shorter side once per round
        ranked.where(F.col("quality") == q).join(n, "lang").where((F.col("nc") > 0) & (F.col("nr") > 0))
        .select("lang", F.col("doc_id").alias(name), F.explode(F.sequence(F.col("k").cast("long"), F.greatest(F.col(size), F.col(other)), F.col(size))).alias("k")))
    pairs = side(1, "chosen_id", "nc", "nr").join(side(0, "rejected_id", "nr", "nc"), ["lang", "k"])
    text = lambda key, name: d.select(F.col("doc_id").alias(key), F.col("text").alias(name))
    return (pairs.join(text("chosen_id", "chosen"), "chosen_id").join(text("rejected_id", "rejected"), "rejected_id")
            .withColumn("prompt", F.concat(F.lit("Write a passage in "), F.col("lang"), F.lit("."))))


CHATML_PAIR = r"""'<|im_start|>system' || chr(10) || '你是物理推理助手，请展示详细的推导过程。' || '<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"""


@register("preference_pairs", "WITH " + PAIRS_SQL + r"""
SELECT lang, k, chosen_id, rejected_id,
  """ + CHATML_PAIR + r""" || chosen || '<|im_end|>' || chr(10) AS chosen_chatml,
  """ + CHATML_PAIR + r""" || rejected || '<|im_end|>' || chr(10) AS rejected_chatml
FROM pairs""")
def preference_pairs(spark, sf_dir):
    """P8 + F2 + J2: Alpaca-form pairs gain the default system and user turns; rendered as ChatML."""
    p = R.preference_pairs_alpaca(preference_source(spark, sf_dir), prompt="prompt")
    return p.select("lang", "k", "chosen_id", "rejected_id",
                    R.chatml_messages(F.col("chosen_messages")).alias("chosen_chatml"),
                    R.chatml_messages(F.col("rejected_messages")).alias("rejected_chatml"))


MIXED_PAIR = r"""CASE WHEN k % 3 = 0 THEN '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) ELSE """ + CHATML_PAIR + " END"


@register("preference_pairs_mixed", "WITH " + PAIRS_SQL + r"""
SELECT lang, k, """ + MIXED_PAIR + r""" || chosen || '<|im_end|>' || chr(10) AS chosen_chatml,
  """ + MIXED_PAIR + r""" || rejected || '<|im_end|>' || chr(10) AS rejected_chatml
FROM pairs""")
def preference_pairs_mixed(spark, sf_dir):
    """P8 both forms + F2: a corpus file that mixes message lists (k divisible by 3) with Alpaca rows, read back.

    Rows that lack the rejected side (absent or null) are added for k divisible by 7; they drop out again.
    """
    p = preference_source(spark, sf_dir).select("lang", "k", "prompt", "chosen", "rejected")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    said = lambda c: F.array(turn("user", F.col("prompt")), turn("assistant", F.col(c)))
    lists = F.to_json(F.struct("lang", "k", said("chosen").alias("chosen"), said("rejected").alias("rejected")))
    texts = F.to_json(F.struct("lang", "k", "prompt", "chosen", "rejected"))
    null_side = F.concat(F.lit('{"rejected":null,'), F.substr(F.to_json(F.struct("lang", "k", "prompt", "chosen")), F.lit(2)))
    raw = p.select(F.when(F.col("k") % 3 == 0, lists).otherwise(texts).alias("value"))
    raw = raw.unionByName(p.where(F.col("k") % 7 == 0).select(
        F.when(F.col("k") % 2 == 0, null_side).otherwise(F.to_json(F.struct("lang", "k", said("chosen").alias("chosen")))).alias("value")))
    d = new_run_dirs(spark, "pairs")
    raw.write.text(d["out"])
    v = spark.read.text(d["out"]).select(F.parse_json("value").alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    rows = v.select(get("lang", "string"), get("k", "long"), get("prompt", "string"), get("chosen", "variant"), get("rejected", "variant"))
    out = R.preference_pairs(rows)
    return out.select("lang", "k", R.chatml_messages(F.col("chosen_messages")).alias("chosen_chatml"),
                      R.chatml_messages(F.col("rejected_messages")).alias("rejected_chatml"))


@register("pair_scored_texts", "WITH " + PAIRS_SQL + r"""
SELECT lang, k, prompt || chosen || '<|im_end|>' AS chosen_text, prompt || rejected || '<|im_end|>' AS rejected_text
FROM pairs""")
def pair_scored_texts(spark, sf_dir):
    """Prompt + chosen + end and prompt + rejected + end."""
    p = preference_source(spark, sf_dir)
    t = R.scored_texts(F.col("prompt"), F.col("chosen"), F.col("rejected"))
    return p.select("lang", "k", t["chosen_text"].alias("chosen_text"), t["rejected_text"].alias("rejected_text"))


WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIP = "'^" + WS + "+|" + WS + r"+\z'"


@register("reply_extraction", "WITH " + ALPACA_SQL + r""",
ft AS (SELECT idx, '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant'
   || chr(10) || output || '<|im_end|>' AS t FROM alp)
SELECT idx,
  regexp_replace(CASE WHEN strpos(t, 'assistant' || chr(10)) > 0
       THEN substr(t, strpos(t, 'assistant' || chr(10)) + 10) ELSE t END, """ + STRIP + r""", '', 'g') AS reply_first,
  regexp_replace(regexp_replace(string_split(t, '<|im_start|>assistant')[-1], '<\|im_end\|>', '', 'g'),
                 """ + STRIP + r""", '', 'g') AS reply_last
FROM ft""")
def reply_extraction(spark, sf_dir):
    """Reply after the first ``assistant\\n`` and after the last assistant marker."""
    a = derive.alpaca_records(spark, sf_dir)
    full = R.chatml_alpaca(F.col("instruction"), F.lit(""), F.col("output"))
    last = R.reply_after_last(full, "<|im_start|>assistant")
    return a.select("idx", R.reply_after_assistant(full).alias("reply_first"),
                    R.T.strip(F.replace(last, F.lit("<|im_end|>"), F.lit(""))).alias("reply_last"))


@register("empty_output_count", "WITH " + ALPACA_SQL + r"""
SELECT count(*) AS n_empty FROM alp WHERE output IS NULL OR regexp_replace(output, """ + STRIP + r""", '', 'g') = ''""")
def empty_output_count(spark, sf_dir):
    """number of rows whose output is empty or blank."""
    cnt, _ = R.empty_outputs(derive.alpaca_records(spark, sf_dir))
    return cnt


@register("empty_output_first", "WITH " + ALPACA_SQL + r"""
SELECT idx, left(instruction, 80) AS instruction80 FROM alp
WHERE output IS NULL OR regexp_replace(output, """ + STRIP + r""", '', 'g') = '' ORDER BY idx LIMIT 3""")
def empty_output_first(spark, sf_dir):
    """First three offenders with an 80-character instruction."""
    _, first = R.empty_outputs(derive.alpaca_records(spark, sf_dir))
    return first


@register("model_names", r"""
SELECT page_id,
  string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS short_name,
  string_split(regexp_replace(url, '/+$', ''), '/')[-1] || '-' || strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id),
     '%Y%m%d-%H%M%S') AS versioned
FROM pages""")
def model_names(spark, sf_dir):
    """Last path component and a time-stamped version name (URLs of ``pages`` as paths)."""
    p = tables.load(spark, sf_dir, "pages").select("page_id", "url")
    name = R.short_model_name(F.col("url"))
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("page_id"))
    return p.select("page_id", name.alias("short_name"), R.versioned_name(name, ts).alias("versioned"))
