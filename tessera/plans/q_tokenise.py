"""Tokenisation jobs (P10-P12, J5) on the Alpaca rows derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import ordering as O
from ..operators import render as R
from ..operators import tokenise as TK
from ..session import cut_lineage
from ..sources import tables
from . import derive
from .catalog import register
from .common import r6
from .q_render import ALPACA_SQL, PAIRS_SQL

MAX_LEN = 1024  # the reference default of max_length
BATCH = 8

TOK = f"list_filter(regexp_split_to_array(%s, '{WS}+'), lambda x: x <> '')"

TOK_SQL = "WITH " + ALPACA_SQL + f""",
s AS (SELECT idx, 'User: ' || instruction || chr(10) || chr(10) || 'Assistant: ' AS prompt,
             'User: ' || instruction || chr(10) || chr(10) || 'Assistant: ' || output || chr(10) || chr(10) AS full_text
      FROM alp),
w AS (SELECT unnest({TOK % 'text'}) AS token FROM documents),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id
      FROM (SELECT token, count(*) AS n FROM w GROUP BY token)),
t AS (SELECT idx, len({TOK % 'prompt'}) AS n_prompt, {TOK % 'full_text'} AS toks FROM s),
u AS (SELECT idx, n_prompt, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM t),
ids AS (SELECT u.idx, any_value(n_prompt) AS n_prompt, count(*) AS n_tokens, list(coalesce(v.id, 1) ORDER BY pos) AS ids
        FROM u LEFT JOIN v ON u.token = v.token GROUP BY u.idx),
r AS (SELECT idx, n_prompt, n_tokens, ids[1:{MAX_LEN}] AS input_ids,
             list_transform(range(least(len(ids), {MAX_LEN})), lambda p: CASE WHEN p < n_prompt THEN -100 ELSE ids[p + 1] END)
               AS labels FROM ids)"""


def _prompt_full(a):
    prompt = F.concat(F.lit("User: "), F.col("instruction"), F.lit("\n\nAssistant: "))
    full = R.fallback_chat_text(F.array(
        F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content"))))
    return prompt, full


def _tokenised(spark, sf_dir):
    a = derive.alpaca_records(spark, sf_dir)
    vocab = TK.build_vocab(tables.load(spark, sf_dir, "documents"), "text")
    prompt, full = _prompt_full(a)
    return TK.tokenise_masked(a, "idx", prompt, full, vocab, MAX_LEN)


@register("tokenise_masked", TOK_SQL + """
SELECT idx, n_prompt, n_tokens, input_ids, labels, len(list_filter(labels, lambda x: x <> -100)) AS trainable_tokens
FROM r""")
def tokenise_masked(spark, sf_dir):
    """P10 + J5: word ids from the whole vocabulary, prompt masked with -100, truncated to MAX_LEN."""
    t = _tokenised(spark, sf_dir)
    return t.select("idx", F.col("n_prompt").cast("bigint").alias("n_prompt"),
                    F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.col("input_ids").cast("array<bigint>").alias("input_ids"),
                    F.col("labels").cast("array<bigint>").alias("labels"),
                    F.col("trainable_tokens").cast("bigint").alias("trainable_tokens"))


@register("fully_masked_samples", TOK_SQL + """
SELECT count(*) AS n_fully_masked FROM r WHERE len(list_filter(labels, lambda x: x <> -100)) = 0""")
def fully_masked_samples(spark, sf_dir):
    """Samples with no trainable token (empty output, or prompt longer than the limit)."""
    t = _tokenised(spark, sf_dir)
    return t.agg(F.count_if("fully_masked").alias("n_fully_masked"))


@register("padding_report", "WITH " + ALPACA_SQL + f""",
l AS (SELECT idx, len({TOK % "'User: ' || instruction || chr(10) || chr(10) || 'Assistant: ' || output || chr(10) || chr(10)"})
             AS n_tok, row_number() OVER (ORDER BY idx) - 1 AS k FROM alp),
b AS (SELECT k // {BATCH} AS batch, count(*) AS n, sum(n_tok) AS real_t, max(n_tok) AS max_t FROM l GROUP BY 1)
SELECT count(*) AS n_batches, CAST(sum(real_t) AS BIGINT) AS real_tokens, CAST(sum(n * max_t) AS BIGINT) AS padded_tokens,
       round(1 - sum(real_t) / sum(n * max_t), 6) AS waste_ratio FROM b""")
def padding_report(spark, sf_dir):
    """Padding waste of batches of 8 in index order (lengths in word tokens)."""
    a = derive.alpaca_records(spark, sf_dir)
    _, full = _prompt_full(a)
    lens = cut_lineage(TK.token_counts(a, ["idx"], full))  # split once; what follows ranks two narrow columns
    r = TK.padding_report(O.global_index(lens, ["idx"], "k"), F.floor(F.col("k") / BATCH), "n_tokens")
    return r.select("n_batches", F.col("real_tokens").cast("bigint"), F.col("padded_tokens").cast("bigint"),
                    r6(F.col("waste_ratio")).alias("waste_ratio"))


@register("pair_padding_report", "WITH " + PAIRS_SQL + f""",
l AS (SELECT 'chosen' AS side, lang, k, len({TOK % 'chosen'}) AS n_tok FROM pairs
      UNION ALL SELECT 'rejected', lang, k, len({TOK % 'rejected'}) FROM pairs),
o AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY lang, k) - 1 AS i FROM l),
b AS (SELECT side, i // {BATCH} AS batch, count(*) AS n, sum(n_tok) AS real_t, max(n_tok) AS max_t FROM o GROUP BY 1, 2)
SELECT side, count(*) AS n_batches, CAST(sum(real_t) AS BIGINT) AS real_tokens,
       CAST(sum(n * max_t) AS BIGINT) AS padded_tokens, round(1 - sum(real_t) / sum(n * max_t), 6) AS waste_ratio
FROM b GROUP BY side""")
def pair_padding_report(spark, sf_dir):
    """P12 for preference pairs: chosen and rejected sides padded separately, batches of 8 in pair order."""
    from .q_render import preference_source
    p = preference_source(spark, sf_dir)
    sides = p.select("lang", "k", F.explode(F.create_map(F.lit("chosen"), "chosen", F.lit("rejected"), "rejected")).alias("side", "text"))
    sides = cut_lineage(TK.token_counts(sides, ["side", "lang", "k"], F.col("text")))
    ranked = O.rank_within(sides, ["side"], ["lang", "k"], "_r")
    r = TK.padding_report(ranked, F.floor((F.col("_r") - 1) / BATCH), "n_tokens", ["side"])
    return r.select("side", "n_batches", F.col("real_tokens").cast("bigint"), F.col("padded_tokens").cast("bigint"),
                    r6(F.col("waste_ratio")).alias("waste_ratio"))
