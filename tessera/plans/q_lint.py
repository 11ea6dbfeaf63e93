"""Lint family over chat records derived from ``conversations``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fingerprint as FP
from ..operators import lint as L
from ..sources import io, tables
from . import derive
from .catalog import register

# The same planted faults as derive.chat_records, restated in SQL.
CHAT_SQL = r"""
t AS (
  SELECT conv_id AS c, turn,
         CASE WHEN conv_id % 19 = 0 AND turn = 0 THEN 'bot' ELSE role END AS role,
         CASE WHEN conv_id % 37 = 0 AND turn = 1 THEN NULL
              WHEN conv_id % 23 = 0 AND turn = 1 THEN '  ' || chr(10) || ' '
              WHEN conv_id % 31 = 0 AND turn = 0 THEN text || ' <tool_call>'
              ELSE text END AS content
  FROM conversations),
m AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn) - 1 AS pos FROM t),
agg AS (SELECT c, count(*) AS n, bool_or(role = 'user') AS has_user, bool_or(role = 'assistant') AS has_asst,
               bool_or(coalesce(content, '') LIKE '%tool_call%') AS has_tool FROM m GROUP BY c),
u AS (SELECT c, substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4)
                || '-' || substr(h,21,12) AS uu
      FROM (SELECT c, md5(CAST(c AS VARCHAR)) AS h FROM (SELECT DISTINCT conv_id AS c FROM conversations
            UNION ALL SELECT DISTINCT conv_id + 1099511627776 FROM conversations WHERE conv_id % 41 = 0))),
r AS (SELECT u.c,
   CASE WHEN u.c % 7 = 0 THEN NULL WHEN u.c % 13 = 0 THEN 'not-a-uuid-' || CAST(u.c AS VARCHAR)
        WHEN u.c % 29 = 0 THEN upper(uu) ELSE uu END AS id,
   CASE WHEN u.c % 11 = 0 THEN '' WHEN u.c % 9 = 0 THEN 'v1.0' ELSE 'v1.' || CAST(u.c % 4 AS VARCHAR) || '.0' END AS version,
   CASE WHEN u.c % 5 = 0 THEN 'dev' ELSE ['train','val','test'][u.c % 3 + 1] END AS split,
   CASE WHEN u.c % 8 = 0 THEN NULL ELSE ['high_school','undergraduate','graduate'][u.c % 3 + 1] END AS difficulty,
   CASE WHEN u.c % 10 = 3 THEN 'biology' ELSE ['mechanics','em','thermo','quantum','optics','relativity',
        'nuclear','statistical'][u.c % 8 + 1] END AS category,
   CASE WHEN u.c % 17 = 0 THEN '' ELSE 'conversations' END AS source,
   u.c % 4 <> 0 AS has_hash_key,
   u.c < 1099511627776 AS has_messages,
   CASE WHEN u.c % 6 = 0 THEN 'too_long' WHEN u.c % 6 = 1 THEN 'wrong_answer' END AS rejection_reason,
   agg.n, agg.has_user, agg.has_asst, agg.has_tool
  FROM u LEFT JOIN agg ON u.c = agg.c)
"""

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

ISSUES_SQL = "WITH " + CHAT_SQL + r""",
issues AS (
SELECT c AS idx, 'error' AS level, 'id' AS field, 'L1' AS rule, 'id: missing' AS msg FROM r WHERE coalesce(id, '') = ''
UNION ALL SELECT c, 'error', 'id', 'L2', 'id: not a UUID: ' || id FROM r
  WHERE id <> '' AND NOT regexp_matches(id, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\n?\z')
UNION ALL SELECT c, 'error', 'version', 'L3', 'version: missing' FROM r WHERE coalesce(version, '') = ''
UNION ALL SELECT c, 'error', 'version', 'L4', 'version: expected vX.Y.Z, got ' || version FROM r
  WHERE version <> '' AND NOT regexp_matches(version, '^v\p{Nd}+\.\p{Nd}+\.\p{Nd}+\n?\z')
UNION ALL SELECT c, 'error', 'split', 'L5', 'split: missing' FROM r WHERE coalesce(split, '') = ''
UNION ALL SELECT c, 'error', 'split', 'L6', 'split: invalid value ''' || split || ''', allowed [''test'', ''train'', ''val'']'
  FROM r WHERE split <> '' AND split NOT IN ('train', 'val', 'test')
UNION ALL SELECT c, 'error', 'difficulty', 'L7', 'difficulty: missing' FROM r WHERE coalesce(difficulty, '') = ''
UNION ALL SELECT c, 'error', 'difficulty', 'L8', 'difficulty: invalid value ''' || difficulty
  || ''', allowed [''graduate'', ''high_school'', ''undergraduate'']'
  FROM r WHERE difficulty <> '' AND difficulty NOT IN ('high_school', 'undergraduate', 'graduate')
UNION ALL SELECT c, 'error', 'category', 'L9', 'category: missing' FROM r WHERE coalesce(category, '') = ''
UNION ALL SELECT c, 'error', 'category', 'L10', 'category: invalid value ''' || category
  || ''', allowed [''em'', ''mechanics'', ''nuclear'', ''optics'', ''quantum'', ''relativity'', ''statistical'', ''thermo'']'
  FROM r WHERE category <> '' AND category NOT IN ('mechanics','em','thermo','quantum','optics','relativity','nuclear','statistical')
UNION ALL SELECT c, 'error', 'source', 'L11', 'source: missing or empty' FROM r WHERE coalesce(source, '') = ''
UNION ALL SELECT c, 'error', 'messages', 'L12', 'messages: missing' FROM r WHERE NOT has_messages
UNION ALL SELECT c, 'error', 'messages', 'L14', 'messages: at least 2 messages needed, got ' || CAST(n AS VARCHAR)
  FROM r WHERE has_messages AND n < 2
UNION ALL SELECT c, 'error', 'messages', 'L15', 'messages: no message with role=user' FROM r
  WHERE has_messages AND n >= 2 AND NOT has_user
UNION ALL SELECT c, 'error', 'messages', 'L16', 'messages: no message with role=assistant' FROM r
  WHERE has_messages AND n >= 2 AND NOT has_asst
UNION ALL SELECT c, 'warning', 'content_hash', 'L22', 'content_hash: missing' FROM r WHERE NOT has_hash_key
UNION ALL SELECT c, 'error', 'tool_calls', 'L23', 'tool_calls: content has a tool call but tool_calls is absent'
  FROM r WHERE has_messages AND has_tool
UNION ALL SELECT c, 'error', 'rejection_reason', 'L24', 'rejection_reason: invalid value ''' || rejection_reason
  || ''', allowed [''format_error'', ''skip_step'', ''wrong_answer'']'
  FROM r WHERE rejection_reason IS NOT NULL AND rejection_reason NOT IN ('skip_step', 'wrong_answer', 'format_error')
UNION ALL SELECT m.c, 'error', 'messages[' || pos || ']', 'L17', 'messages[' || pos || ']: role missing'
  FROM m JOIN agg ON m.c = agg.c WHERE agg.n >= 2 AND coalesce(role, '') = ''
UNION ALL SELECT m.c, 'error', 'messages[' || pos || ']', 'L18', 'messages[' || pos || ']: invalid role ''' || role || ''''
  FROM m JOIN agg ON m.c = agg.c WHERE agg.n >= 2 AND role <> '' AND role NOT IN ('system', 'user', 'assistant')
UNION ALL SELECT m.c, 'error', 'messages[' || pos || ']', 'L19', 'messages[' || pos || ']: content missing'
  FROM m JOIN agg ON m.c = agg.c WHERE agg.n >= 2 AND content IS NULL
UNION ALL SELECT m.c, 'error', 'messages[' || pos || ']', 'L20', 'messages[' || pos || ']: content empty'
  FROM m JOIN agg ON m.c = agg.c
  WHERE agg.n >= 2 AND regexp_replace(content, '^""" + WS + "+|" + WS + r"""+\z', '', 'g') = ''
UNION ALL SELECT m.c, 'warning', 'messages[' || pos || ']', 'L21', 'messages[' || pos || ']: assistant turn without <think>'
  FROM m JOIN agg ON m.c = agg.c WHERE agg.n >= 2 AND role = 'assistant' AND coalesce(content, 'None') NOT LIKE '%<think>%'
)"""


def _issues(spark, sf_dir):
    return L.lint(derive.chat_records(spark, sf_dir))


@register("lint_issues", ISSUES_SQL + " SELECT * FROM issues")
def lint_issues(spark, sf_dir):
    """every issue of every record."""
    return _issues(spark, sf_dir)


@register("lint_rule_counts", ISSUES_SQL + """
SELECT level, rule, field, count(*) AS n_issues, count(DISTINCT idx) AS n_records
FROM issues GROUP BY level, rule, field""")
def lint_rule_counts(spark, sf_dir):
    """A2: issues per rule and field."""
    return L.rule_counts(_issues(spark, sf_dir))


@register("lint_report", ISSUES_SQL + """
SELECT (SELECT count(*) FROM r) AS total_records,
       count(*) FILTER (WHERE level = 'error') AS error_count,
       count(*) FILTER (WHERE level <> 'error') AS warning_count,
       count(*) FILTER (WHERE level = 'error') = 0 AS passed
FROM issues""")
def lint_report(spark, sf_dir):
    """A1: totals and pass flag."""
    _, totals = L.lint_once(derive.chat_records(spark, sf_dir))
    return L.report(spark, totals)


@register("lint_pass_report", ISSUES_SQL + """
SELECT 'rule ' || rule AS item, count(*) AS n FROM issues GROUP BY rule
UNION ALL SELECT 'level ' || level, count(*) FROM issues GROUP BY level
UNION ALL SELECT 'records', count(*) FROM r""")
def lint_pass_report(spark, sf_dir):
    """A1 + A2: totals and issues per rule from one pass over the records (linted, counted and written once)."""
    table, totals = L.lint_once(derive.chat_records(spark, sf_dir))
    rules = L.exploded(table).groupBy(F.concat(F.lit("rule "), "rule").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    named = {"level error": "error_count", "level warning": "warning_count", "records": "total_records"}
    heads = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for k, c in named.items() for x in (k, totals[c])])).alias("item", "n"))
    return rules.unionByName(heads.where("n > 0 or item = 'records'").select("item", F.col("n").cast("long")))


@register("lint_files", ISSUES_SQL + """,
s AS (SELECT (SELECT count(*) FROM r) AS n, count(*) FILTER (WHERE level = 'error') AS e, count(*) FILTER (WHERE level <> 'error') AS w FROM issues)
SELECT folder, fatal, CASE WHEN fatal IS NULL THEN n ELSE 0 END AS total_records, CASE WHEN fatal IS NULL THEN e ELSE 0 END AS error_count,
       CASE WHEN fatal IS NULL THEN w ELSE 0 END AS warning_count
FROM s, (VALUES ('lines', NULL), ('arrays', NULL), ('torn', 'not parsed'), ('nowhere', 'missing')) f(folder, fatal)""")
def lint_files(spark, sf_dir):
    """A1 over files: JSON Lines, arrays, torn files and a missing path, each file sniffed; summed per folder."""
    from ..session import scratch_path
    base = scratch_path(spark, f"lint-{uuid.uuid4().hex}")
    records = derive.chat_records(spark, sf_dir)
    records.select("raw").write.text(f"{base}/in/lines")
    torn = F.substring("raw", 1, F.length("raw") - 1)
    records.select(torn.alias("value")).write.text(f"{base}/in/torn")
    io.write_raw_array(records.select("raw"), f"{base}/in/arrays")
    rows = L.lint_files(spark, f"{base}/in", pattern="*.txt").unionByName(L.lint_files(spark, f"{base}/nowhere"))
    folder = F.regexp_extract("file_path", "(lines|arrays|torn|nowhere)(/[^/]*)?$", 1)
    return rows.groupBy(folder.alias("folder"), "fatal").agg(*[F.sum(c).alias(c) for c in ("total_records", "error_count", "warning_count")])


@register("lint_first_errors", ISSUES_SQL + """
SELECT * FROM issues WHERE level = 'error' ORDER BY idx, rule, field, msg LIMIT 30""")
def lint_first_errors(spark, sf_dir):
    """The first 30 errors in record order (a top-k report)."""
    return L.first_issues(_issues(spark, sf_dir), "error", 30)


@register("lint_first_warnings", ISSUES_SQL + """
SELECT * FROM issues WHERE level <> 'error' ORDER BY idx, rule, field, msg LIMIT 10""")
def lint_first_warnings(spark, sf_dir):
    """The first 10 warnings."""
    return L.first_issues(_issues(spark, sf_dir), "warning", 10)


@register("lint_strict_rule_counts", ISSUES_SQL + """
SELECT 'error' AS level, rule, count(*) AS n_issues FROM issues GROUP BY rule""")
def lint_strict_rule_counts(spark, sf_dir):
    """F5 with strict=True: warnings are promoted to errors."""
    return (L.lint(derive.chat_records(spark, sf_dir), strict=True)
            .groupBy("level", "rule").agg(F.count(F.lit(1)).alias("n_issues")))


CANON_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, role, text FROM conversations)
SELECT c AS conv_id,
       'sha256:' || substr(sha256('[' || string_agg('{"content": ' || to_json(text) || ', "role": ' || to_json(role) || '}',
                                                ', ' ORDER BY turn) || ']'), 1, 16) AS content_hash
FROM t GROUP BY c"""


@register("content_hash", CANON_SQL)
def content_hash(spark, sf_dir):
    """fingerprint of each conversation's message list (message JSON built per turn row)."""
    from ..operators.render import join_turns
    conv = tables.load(spark, sf_dir, "conversations")
    piece = F.concat(F.lit('{"content": '), FP.json_string(F.col("text")), F.lit(', "role": '),
                     FP.json_string(F.col("role")), F.lit("}"))
    joined = join_turns(conv, "conv_id", "turn", piece, sep=", ", out="_body")
    return joined.select("conv_id", FP.digest(F.concat(F.lit("["), F.col("_body"), F.lit("]"))).alias("content_hash"))


@register("repair_then_lint", ISSUES_SQL + """
SELECT rule, count(*) AS n_issues FROM issues
WHERE rule NOT IN ('L1', 'L3') AND NOT (rule = 'L22' AND idx < 1099511627776) GROUP BY rule""")
def repair_then_lint(spark, sf_dir):
    """F6 + F5: after repair, id / version / hash issues are gone, others stay."""
    fixed = L.repair(derive.chat_records(spark, sf_dir), seed=7)
    return L.lint(fixed).groupBy("rule").agg(F.count(F.lit(1)).alias("n_issues"))


def _turn_issues(spark, sf_dir, strict=False):
    records, turns = derive.chat_tables(spark, sf_dir)
    return L.lint_turns(records, turns, strict)


@register("lint_turns_issues", ISSUES_SQL + " SELECT * FROM issues")
def lint_turns_issues(spark, sf_dir):
    """F5 on the corpus as (records, turns) tables: same issues, no per-record gather."""
    return _turn_issues(spark, sf_dir)


@register("lint_turns_rule_counts", ISSUES_SQL + """
SELECT level, rule, field, count(*) AS n_issues, count(DISTINCT idx) AS n_records
FROM issues GROUP BY level, rule, field""")
def lint_turns_rule_counts(spark, sf_dir):
    """A2 over the long-form lint (the flagship job)."""
    return L.rule_counts(_turn_issues(spark, sf_dir))
