"""Generation, shuffle and split jobs (G1-G7, J6, T2-T5, A3) driven by the ids of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate as G
from ..operators import lint as L
from ..operators import ordering as O
from ..sources import tables
from .catalog import register


def doc_index(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))


@register("corpus_composition", """
SELECT source AS type, count(*) AS n FROM documents GROUP BY source""")
def corpus_composition(spark, sf_dir):
    """A3: corpus composition by kind (type = source)."""
    d = tables.load(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@register("generated_sft_summary", """
WITH g AS (SELECT doc_id AS i, 'train' AS split FROM documents
           UNION ALL SELECT doc_id + (SELECT count(*) FROM documents), 'test' FROM documents)
SELECT split, ['mechanics','thermo','em','optics','statistical','mechanics'][i % 6 + 1]
         AS category,
       ['high_school','undergraduate','high_school','undergraduate','graduate','undergraduate'][i % 6 + 1] AS difficulty, count(*) AS n_records
FROM g GROUP BY ALL""")
def generated_sft_summary(spark, sf_dir):
    """G1 + J6 + T4 + T5: train and test SFT corpora (test ids start after train), counted per kind."""
    idx = doc_index(spark, sf_dir)
    n = idx.count()
    train = G.gen_sft(idx, "train", 0, seed=1)
    test = G.gen_sft(idx, "test", n, seed=1)
    both = train.unionByName(test)
    v = F.try_parse_json("raw")
    return both.select(F.try_variant_get(v, "$.split", "string").alias("split"),
                       F.try_variant_get(v, "$.category", "string").alias("category"),
                       F.try_variant_get(v, "$.difficulty", "string").alias("difficulty")) \
        .groupBy("split", "category", "difficulty").agg(F.count(F.lit(1)).alias("n_records"))


@register("generated_sft_lint", """
SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS error_count, CAST(0 AS BIGINT) AS warning_count,
       true AS passed FROM documents""")
def generated_sft_lint(spark, sf_dir):
    """G1 -> F5 round trip: the lint report of the generated corpus (every record clean)."""
    recs = G.gen_sft(doc_index(spark, sf_dir), "train", 0, seed=3)
    return L.report(spark, L.lint_once(recs)[1])


# The problem table once more, as a person would write it in SQL.
PAIRS_SQL = r"""
n AS (SELECT doc_id AS i, doc_id % 6 AS kind FROM documents),
q AS (SELECT i, kind,
   CASE kind WHEN 0 THEN 3 * i + 7 WHEN 1 THEN 100 + 10 * i WHEN 2 THEN 2 * i + 5 WHEN 3 THEN i + 4 WHEN 4 THEN i + 1 ELSE 50 + 5 * i END AS a,
   CASE kind WHEN 0 THEN i // 5 + 2 WHEN 1 THEN i // 3 + 1 WHEN 2 THEN i // 4 + 3 WHEN 3 THEN i // 6 + 10 WHEN 4 THEN i // 8 + 1 ELSE i // 9 + 2 END AS b
  FROM n),
d AS (SELECT *, CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y FROM q),
r AS (SELECT *, CASE kind
   WHEN 0 THEN printf('%.4f', round(x / y * 1e4) / 1e4) WHEN 1 THEN printf('%.5f', round(60 * x / (4186 * y) * 1e5) / 1e5)
   WHEN 2 THEN printf('%.6f', round(24 / (x + y) * 1e6) / 1e6) WHEN 3 THEN printf('%.4f', round(y * (x + y) / x * 1e4) / 1e4)
   WHEN 4 THEN printf('%.5f', round((x * ln(2) + y * ln(3)) * 1e5) / 1e5) ELSE printf('%.5f', round(x * y * y / 20000 * 1e5) / 1e5) END AS v FROM d),
t AS (SELECT i, kind, CASE kind
   WHEN 0 THEN 'A cart covers ' || a || ' m in ' || b || ' s at constant speed. How fast is it?'
   WHEN 1 THEN 'A ' || a || ' W heater warms ' || b || ' kg of water for one minute (c = 4186 J/(kg K)). By how much does its temperature rise?'
   WHEN 2 THEN 'Resistors of ' || a || ' ohm and ' || b || ' ohm in series are connected to 24 V. Which current flows?'
   WHEN 3 THEN 'An object stands ' || a || ' cm beyond the focus of a lens of ' || b || ' cm focal length. How far from the lens is its image?'
   WHEN 4 THEN 'A system has ' || a || ' independent spins and ' || b || ' independent three-level atoms, all states equally likely. What is its entropy in units of k?'
   ELSE 'A spring of ' || a || ' N/m is pressed together by ' || b || ' cm. How much energy does it hold?' END AS question,
  CASE kind WHEN 0 THEN 'speed is distance over time: ' || v || ' m/s' WHEN 1 THEN 'all heat goes into the water: rise of ' || v || ' K'
   WHEN 2 THEN 'resistances in series add up: current of ' || v || ' A' WHEN 3 THEN 'the lens equation gives ' || v || ' cm'
   WHEN 4 THEN 'entropies of independent parts add up: ' || v ELSE 'half the constant times the square of the way in metres: ' || v || ' J' END AS think,
  CASE kind WHEN 0 THEN 'v = ' || v || ' m/s' WHEN 1 THEN 'rise = ' || v || ' K' WHEN 2 THEN 'I = ' || v || ' A' WHEN 3 THEN 'b = ' || v || ' cm'
   WHEN 4 THEN 'S/k = ' || v ELSE 'E = ' || v || ' J' END AS answer FROM r),
p AS (SELECT i, ['mechanics', 'thermo', 'em', 'optics', 'statistical', 'mechanics'][kind + 1] AS category, question,
   '<think>' || chr(10) || think || chr(10) || '</think>' || chr(10) || chr(10) || answer AS chosen,
   'The answer is ' || trim(string_split(answer, '=')[-1]) AS rejected, sha256('6:' || i) AS h FROM t),
pairs AS (SELECT i, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
   category, 'sha256:' || substr(sha256('[{"content": "You are a physics reasoning assistant. Show the full derivation and give the final numeric result.", "role": "system"}, {"content": '
     || to_json(question) || ', "role": "user"}, {"content": ' || to_json(chosen) || ', "role": "assistant"}]'), 1, 16) AS content_hash, question, chosen, rejected FROM p)"""


@register("generated_pairs", "WITH " + PAIRS_SQL + " SELECT i, id, category, content_hash, question, chosen, rejected FROM pairs")
def generated_pairs(spark, sf_dir):
    """Physics preference pairs."""
    p = G.gen_pairs(doc_index(spark, sf_dir), seed=5)
    return p.select("i", "id", "category", "content_hash", F.col("chosen")[1]["content"].alias("question"), F.col("chosen_text").alias("chosen"),
                    F.col("rejected_text").alias("rejected"))


def _choice_sql(i: str, seed: int, n: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {i}), 1, 8) AS BIGINT) % {n}"


CALCULUS_SQL = f"""
c AS (SELECT doc_id AS i, doc_id // 5 + 1 AS a, doc_id % 5 + 1 AS n, doc_id % 7 + 2 AS b FROM documents),
k AS (SELECT *, {_choice_sql('i', 7, 3)} AS kind,
   CASE WHEN a % (n + 1) = 0 THEN CAST(a // (n + 1) AS VARCHAR) ELSE a || '/' || (n + 1) END AS coef FROM c)"""

INTEGRALS_SQL = CALCULUS_SQL + f""",
f(fact, family, integrand, antiderivative, method) AS (VALUES
  (0, 'trig', 'sin(x)', '-cos(x)', 'table'), (1, 'trig', 'cos(x)', 'sin(x)', 'table'), (2, 'trig', 'sec(x)^2', 'tan(x)', 'table'),
  (3, 'exp', 'e^x', 'e^x', 'table'), (4, 'exp', 'x e^x', '(x - 1) e^x', 'parts'), (5, 'log', '1/x', 'ln|x|', 'table'),
  (6, 'log', 'ln(x)', 'x ln(x) - x', 'parts'), (7, 'inverse', '1/(1 + x^2)', 'arctan(x)', 'table'), (8, 'inverse', '1/sqrt(1 - x^2)', 'arcsin(x)', 'table'),
  (9, 'rational', '1/(x^2 - 1)', '(1/2) ln|(x - 1)/(x + 1)|', 'partial fractions'), (10, 'substitution', '2x cos(x^2)', 'sin(x^2)', 'substitution'),
  (11, 'substitution', 'x/(x^2 + 1)', '(1/2) ln(x^2 + 1)', 'substitution')),
w AS (SELECT *, {_choice_sql('i', 11, 1_000_000)} < 700000 AS poly, {_choice_sql('i', 28, 15)} AS pick, CAST(a * b ** (n + 1) AS BIGINT) AS v FROM k),
g AS (SELECT i,
  CASE WHEN poly THEN 'polynomial' WHEN pick = 12 THEN 'definite' WHEN pick = 13 THEN 'rational' WHEN pick = 14 THEN 'composite' ELSE family END AS type,
  CASE WHEN poly THEN '∫ ' || a || 'x^' || n || ' dx' WHEN pick = 12 THEN '∫ from 0 to ' || b || ' of ' || a * (n + 1) || 'x^' || n || ' dx'
    WHEN pick = 13 THEN '∫ ' || a || '/(x + ' || b || ') dx' WHEN pick = 14 THEN '∫ ' || a * b || ' cos(' || b || 'x) dx' ELSE '∫ ' || integrand || ' dx' END AS prompt,
  CASE WHEN poly THEN '= ' || coef || 'x^' || (n + 1) || ' + C' WHEN pick = 12 THEN '= ' || v WHEN pick = 13 THEN '= ' || a || ' ln|x + ' || b || '| + C'
    WHEN pick = 14 THEN '= ' || a || ' sin(' || b || 'x) + C' ELSE '= ' || antiderivative || ' + C' END AS correct_answer,
  CASE WHEN poly THEN 'power rule' WHEN pick = 12 THEN 'limits' WHEN pick = 13 THEN 'logarithm' WHEN pick = 14 THEN 'substitution' ELSE method END AS method,
  CASE WHEN poly THEN 'Raise the exponent from ' || n || ' to ' || (n + 1) || '. Divide ' || a || ' by ' || (n + 1) || '. Add the constant.'
    WHEN pick = 12 THEN 'An antiderivative is ' || a || 'x^' || (n + 1) || '. At ' || b || ' it is ' || v || ', at 0 it is 0.'
    WHEN pick = 13 THEN 'The derivative of x + ' || b || ' is 1. Its logarithm takes the factor ' || a || '.'
    WHEN pick = 14 THEN 'Put u = ' || b || 'x, so that dx is du/' || b || '. Then ' || a * b || '/' || b || ' is ' || a || '.'
    ELSE 'The derivative of ' || antiderivative || ' is ' || integrand || '.' END AS steps
  FROM w LEFT JOIN f ON w.pick = f.fact),
wrong AS (SELECT *, {_choice_sql('i', 13, 3)} AS c FROM g)"""

WRONG_SQL = "CASE c WHEN 0 THEN correct_answer || ' (错误)' WHEN 1 THEN '无法计算此积分' ELSE '0 + C' END"


@register("generated_calculus", "WITH " + CALCULUS_SQL + """
SELECT i,
  CASE kind WHEN 0 THEN 'Find the derivative of ' || a || 'x^' || n || '.' WHEN 1 THEN 'Compute the integral ∫ ' || a || 'x^' || n || ' dx.'
    ELSE 'Find the derivative of sin(' || a || 'x^' || n || ').' END AS instruction,
  CASE kind WHEN 0 THEN CASE WHEN n = 1 THEN 'd/dx = ' || a ELSE 'd/dx = ' || a * n || 'x^' || (n - 1) END
    WHEN 1 THEN '∫ ' || a || 'x^' || n || ' dx = ' || coef || 'x^' || (n + 1) || ' + C'
    ELSE 'd/dx = ' || a * n || 'x^' || (n - 1) || ' cos(' || a || 'x^' || n || ')' END AS output,
  ['derivative', 'integral', 'chain_rule'][kind + 1] AS type FROM k""")
def generated_calculus(spark, sf_dir):
    """Derivative / integral / chain-rule problems."""
    return G.gen_calculus(doc_index(spark, sf_dir), seed=7)


@register("generated_integrals", "WITH " + INTEGRALS_SQL + f"""
SELECT i, type, prompt, correct_answer, method, steps, ['marked', 'refusal', 'zero'][c + 1] AS corruption, {WRONG_SQL} AS rejected_answer FROM wrong""")
def generated_integrals(spark, sf_dir):
    """G4 + G5 + G6: integral questions by family, 70/30 mixture, and a corrupted rejected reply."""
    g = G.gen_integrals(doc_index(spark, sf_dir), seed=11)
    c = G.corrupt(F.col("correct_answer"), F.col("i"), seed=13)
    return g.select("i", "type", "prompt", "correct_answer", "method", "steps", c["kind"].alias("corruption"),
                    c["text"].alias("rejected_answer"))


@register("generated_preference_prompts", "WITH " + INTEGRALS_SQL + f"""
SELECT i, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
       '解: ' || correct_answer AS chosen, '解: ' || {WRONG_SQL} AS rejected, type FROM wrong""")
def generated_preference_prompts(spark, sf_dir):
    """Integral preference pairs with a raw ChatML prompt."""
    return G.gen_integral_pairs(doc_index(spark, sf_dir), seed=11)


@register("generated_arithmetic", """
SELECT doc_id AS i, 'What is ' || CAST(doc_id + 1 AS VARCHAR) || ' + ' || CAST(doc_id * 7 + 3 AS VARCHAR) || '?' AS instruction, '' AS input,
       CAST(doc_id * 8 + 4 AS VARCHAR) AS output, CASE WHEN doc_id % 38 < 30 THEN 'train' ELSE 'test' END AS split FROM documents""")
def generated_arithmetic(spark, sf_dir):
    """Arithmetic records, 30 training rows to 8 test rows."""
    return G.gen_arithmetic(doc_index(spark, sf_dir))


SHUFFLE_SQL = "CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 15) AS BIGINT)"


@register("seeded_shuffle", f"""
SELECT doc_id, row_number() OVER (ORDER BY {SHUFFLE_SQL.format(seed=43)}, doc_id) - 1 AS position FROM documents""")
def seeded_shuffle(spark, sf_dir):
    """Documents in a seeded order, per-epoch reseed (seed + epoch); position from the stable index."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id")
    k = d.withColumn("k", O.seeded_key(F.col("doc_id"), 42 + 1))
    return O.global_index(k, ["k", "doc_id"], "position").select("doc_id", "position")


def _shards_sql(seed: int, world: int, epochs: list[int]) -> str:
    """The keyed permutation in SQL: rounds on (p, q), walked on while a place is beyond n."""
    h = f"CAST('0x' || substr(md5('{seed}:' || epoch || ':%d:' || %s), 1, 15) AS BIGINT)"
    rounds = []
    for r in range(O.ROUNDS):
        p, q = (f"(p + {h % (r, 'q')}) % a", "q") if r % 2 == 0 else ("p", f"(q + {h % (r, 'p')}) % b")
        rounds.append(f"(SELECT doc_id, epoch, n, a, b, step, {p} AS p, {q} AS q FROM @)")
    nested = "(SELECT doc_id, epoch, n, a, b, step, x // b AS p, x % b AS q FROM {src})"
    for part in rounds:
        nested = part.replace("@", nested)
    values = ", ".join(f"({e})" for e in epochs)
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
g AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM s),
z AS (SELECT doc_id, epoch, x, n, a, (n + a - 1) // a AS b, 0 AS step FROM g, (VALUES {values}) e(epoch)),
w AS (SELECT * FROM z
      UNION ALL SELECT doc_id, epoch, p * b + q AS x, n, a, b, step + 1 AS step FROM {nested.format(src='(SELECT * FROM w WHERE step = 0 OR x >= n)')}),
d AS (SELECT doc_id, epoch, x, n FROM w WHERE step > 0 AND x < n),
t AS (SELECT doc_id, epoch, unnest(range(x, (n + {world} - 1) // {world} * {world}, n)) AS p FROM d)
SELECT doc_id, epoch, CAST(p % {world} AS INTEGER) AS rank, p // {world} AS slot FROM t"""


@register("epoch_shards", _shards_sql(42, 6, [0, 1]))
def epoch_shards(spark, sf_dir):
    """Two shuffled epochs of the documents over six ranks, padded by wrapping; one index, no sort per epoch."""
    d = O.global_index(tables.load(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "idx")
    n = tables.load(spark, sf_dir, "documents").count()
    return O.epoch_shards(d, "idx", n, 6, 42, [0, 1]).select("doc_id", "epoch", "rank", "slot")


@register("split_exact_members", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {SHUFFLE_SQL.format(seed=42)}, doc_id) <= CAST(floor(0.9 * count(*) OVER ()) AS BIGINT)
       THEN 'train' ELSE 'test' END AS split FROM documents""")
def split_exact_members(spark, sf_dir):
    """Which documents are in which side of the exact 90/10 split."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id")
    return O.split_exact(d, "doc_id", 0.9, seed=42).select("doc_id", "split")


@register("split_exact_counts", """
SELECT 'train' AS split, CAST(floor(0.9 * count(*)) AS BIGINT) AS n FROM documents
UNION ALL SELECT 'test', count(*) - CAST(floor(0.9 * count(*)) AS BIGINT) FROM documents""")
def split_exact_counts(spark, sf_dir):
    """Exact 90/10 split by seeded order; the counts are exact (randomSplit's are not)."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id")
    return O.split_exact(d, "doc_id", 0.9, seed=42).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


CHAT_SCHEMA = ("id string, version string, split string, difficulty string, category string, source string, "
               "content_hash string, messages array<struct<role:string,content:string>>")


@register("corpus_file_roundtrip", """
SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS error_count, CAST(0 AS BIGINT) AS warning_count,
       true AS passed, count(*) AS n_indexed FROM documents""")
def corpus_file_roundtrip(spark, sf_dir):
    """F8 + S10 + S1 + S8: gated write of a clean generated corpus, read back from files, indexed, linted."""
    from ..sources import io
    from ..streaming.metrics import new_run_dirs
    d = new_run_dirs(spark, "corpus")
    recs = G.gen_sft(doc_index(spark, sf_dir), "train", 0, seed=9)
    if not L.gated_write(recs, False, d["out"] + "/train"):
        raise RuntimeError("generated corpus did not lint clean")
    back = io.require_rows(io.read_records(spark, d["out"]), "written corpus")
    typed = io.read_corpus(spark, d["out"] + "/train", CHAT_SCHEMA).where(F.col("id").isNotNull())
    rep = L.report(spark, L.lint_once(back)[1])
    return rep.withColumn("n_indexed", F.lit(typed.count()).cast("bigint"))


@register("generated_pairs_lint", """
SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS error_count, count(*) AS warning_count, true AS passed
FROM documents""")
def generated_pairs_lint(spark, sf_dir):
    """G2 -> F5 round trip for pair files: no error; each rejected answer lacks <think> (one warning per pair)."""
    p = G.gen_pairs(doc_index(spark, sf_dir), seed=5)
    recs = p.select(F.col("i").alias("idx"), F.to_json(F.struct(
        "id", "version", "split", "difficulty", "category", "source", "content_hash", "chosen", "rejected")).alias("raw"))
    return L.report(spark, L.lint_once(recs, messages_keys=["chosen", "rejected"])[1])
