"""Record lint, repair, content fingerprint and the gated write.

Input is one JSON text per record (column ``raw``) plus a stable index
(column ``idx``).  Records are parsed to VARIANT so that an *absent* key, a
JSON ``null`` and a value of the wrong type stay distinguishable, which a
fixed schema would collapse.  Every rule is a column expression; one record
yields an array of issue structs that is exploded, so lint is a single
narrow pass (no shuffle) whatever the corpus size.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.fingerprint import content_hash_of_variant_messages, digest, plain_messages, python_canonical

# ---- fixed values of the record schema (must equal the reference's) ----
VALID_SPLIT = ["train", "val", "test"]
VALID_DIFFICULTY = ["high_school", "undergraduate", "graduate"]
VALID_CATEGORY = ["mechanics", "em", "thermo", "quantum",
                  "optics", "relativity", "nuclear", "statistical"]
VALID_ROLE = ["system", "user", "assistant"]
VALID_REJECTION = ["skip_step", "wrong_answer", "format_error"]
UUID_BODY = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
VERSION_BODY = r"v\p{Nd}+\.\p{Nd}+\.\p{Nd}+"
DEFAULT_VERSION = "v1.0.0"
# -------------------------------------------------------------------------

ISSUE_FIELDS = ["idx", "level", "field", "rule", "msg"]


def _sorted_list(vals):
    return "[" + ", ".join(f"'{v}'" for v in sorted(vals)) + "]"


def _vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(x: Column) -> Column:
    """Kind of a VARIANT value: NULL (absent), VOID (json null), STRING, ..."""
    return F.schema_of_variant(x)


def _truthy(x: Column) -> Column:
    """Python truthiness of a JSON value (absent/null/''/0/false/[]/{} are falsy)."""
    k = _kind(x)
    s = F.try_variant_get(x, "$", "string")
    return (F.when(x.isNull() | F.is_variant_null(x), F.lit(False))
            .when(k == "STRING", s != "")
            .when(k == "BOOLEAN", s == "true")
            .when(k.startswith("ARRAY"), F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
            .when(k.startswith("OBJECT"), k != "OBJECT<>")
            .otherwise(F.try_variant_get(x, "$", "double") != 0))


def _issue(cond: Column, level: Column | str, field: str | Column, rule: str, msg: Column | str) -> Column:
    lvl = F.lit(level) if isinstance(level, str) else level
    fld = F.lit(field) if isinstance(field, str) else field
    m = F.lit(msg) if isinstance(msg, str) else msg
    return F.when(cond, F.struct(lvl.alias("level"), fld.alias("field"),
                                 F.lit(rule).alias("rule"), m.alias("msg")))


def _enum_rules(v: Column, key: str, valid: list[str], miss_rule: str, bad_rule: str) -> list[Column]:
    x = _vget(v, f"$.{key}")
    s = F.try_variant_get(x, "$", "string")
    present = _truthy(x)
    return [
        _issue(~present, "error", key, miss_rule, f"{key}: missing"),
        _issue(present & ~s.isin(*valid), "error", key, bad_rule,
               F.concat(F.lit(f"{key}: invalid value '"), s, F.lit(f"', allowed {_sorted_list(valid)}"))),
    ]


def lint(records: DataFrame, strict: bool = False, messages_key: str = "messages") -> DataFrame:
    """records(idx, raw) -> issues(idx, level, field, rule, msg).

    ``messages_key`` names the message list the message rules look at.
    """
    return exploded(issue_lists(records, strict, [messages_key]))


def exploded(lists: DataFrame) -> DataFrame:
    """One row per issue of ``issue_lists``."""
    # a plain explode adds an inferred filter on the list, which would take every rule a second time
    return lists.select("idx", F.explode_outer("issues").alias("i")).where(F.col("i").isNotNull()).select("idx", "i.level", "i.field", "i.rule", "i.msg")


def issue_lists(records: DataFrame, strict: bool = False, messages_keys: list[str] | None = None, keep_raw: bool = False) -> DataFrame:
    """(idx, issues) of every record, with ``raw`` if wanted; a record with several message lists is parsed once for all."""
    message_keys = messages_keys or ["messages"]
    warn = "error" if strict else "warning"
    # Parse once: the record text, its VARIANT and its key list are projected
    # first, so the rules below read columns instead of re-parsing the text.
    parsed = records.select("idx", *(["raw"] if keep_raw else []), F.try_parse_json(F.col("raw")).alias("_v"), F.json_object_keys(F.col("raw")).alias("_keys"))
    for k, mk in enumerate(message_keys):
        parsed = (parsed.withColumn(f"_msgs_x{k}", F.try_variant_get(F.col("_v"), f"$.{mk}", "variant"))
                  .withColumn(f"_msgs{k}", F.try_variant_get(F.col(f"_msgs_x{k}"), "$", "array<variant>"))
                  .withColumn(f"_m{k}", F.transform(f"_msgs{k}", lambda m: F.struct(
                      F.try_variant_get(m, "$.role", "variant").alias("rx"),
                      F.try_variant_get(m, "$.role", "string").alias("r"),
                      F.try_variant_get(m, "$.content", "string").alias("c"),
                      _kind(m).startswith("OBJECT").alias("obj")))))
    v, keys = F.col("_v"), F.col("_keys")
    is_obj = _kind(v).startswith("OBJECT")

    id_x = _vget(v, "$.id")
    id_s = F.try_variant_get(id_x, "$", "string")
    ver_x = _vget(v, "$.version")
    ver_s = F.try_variant_get(ver_x, "$", "string")
    src_x = _vget(v, "$.source")
    says_tool = F.lit(False)  # of any list: a record field is named once
    for k in range(len(message_keys)):
        says_tool = says_tool | F.exists(F.coalesce(F.col(f"_m{k}"), F.array()), lambda m: F.coalesce(m["c"], F.lit("")).contains("tool_call") & m["obj"])

    record_rules = [
        _issue(~_truthy(id_x), "error", "id", "L1", "id: missing"),
        _issue(_truthy(id_x) & ~T.re_fullmatch_unicode(id_s, UUID_BODY, ignore_case=True),
               "error", "id", "L2", F.concat(F.lit("id: not a UUID: "), id_s)),
        _issue(~_truthy(ver_x), "error", "version", "L3", "version: missing"),
        _issue(_truthy(ver_x) & ~T.re_fullmatch_unicode(ver_s, VERSION_BODY),
               "error", "version", "L4", F.concat(F.lit("version: expected vX.Y.Z, got "), ver_s)),
        *_enum_rules(v, "split", VALID_SPLIT, "L5", "L6"),
        *_enum_rules(v, "difficulty", VALID_DIFFICULTY, "L7", "L8"),
        *_enum_rules(v, "category", VALID_CATEGORY, "L9", "L10"),
        _issue(~_truthy(src_x), "error", "source", "L11", "source: missing or empty"),
        _issue(~F.array_contains(keys, "content_hash"), warn, "content_hash", "L22", "content_hash: missing"),
        _issue(says_tool & ~F.array_contains(keys, "tool_calls"),
               "error", "tool_calls", "L23", "tool_calls: content has a tool call but tool_calls is absent"),
    ]
    rr_x = _vget(v, "$.rejection_reason")
    rr_s = F.try_variant_get(rr_x, "$", "string")
    record_rules.append(
        _issue(rr_x.isNotNull() & ~F.is_variant_null(rr_x)
               & (~(_kind(rr_x) == "STRING") | ~rr_s.isin(*VALID_REJECTION)),
               "error", "rejection_reason", "L24",
               F.concat(F.lit("rejection_reason: invalid value '"), rr_s,
                        F.lit(f"', allowed {_sorted_list(VALID_REJECTION)}"))))

    def per_message(mk: str, m: Column, i: Column) -> Column:
        field = F.concat(F.lit(f"{mk}["), i.cast("string"), F.lit("]"))
        r_x, r, c = m["rx"], m["r"], m["c"]
        pre = F.concat(field, F.lit(": "))
        return F.array(
            _issue(~_truthy(r_x), "error", field, "L17", F.concat(pre, F.lit("role missing"))),
            _issue(_truthy(r_x) & ~r.isin(*VALID_ROLE), "error", field, "L18",
                   F.concat(pre, F.lit("invalid role '"), r, F.lit("'"))),
            _issue(c.isNull(), "error", field, "L19", F.concat(pre, F.lit("content missing"))),
            _issue(c.isNotNull() & T.is_blank(c), "error", field, "L20", F.concat(pre, F.lit("content empty"))),
            _issue((F.coalesce(r, F.lit("")) == "assistant") & ~F.coalesce(c, F.lit("None")).contains("<think>"),
                   warn, field, "L21", F.concat(pre, F.lit("assistant turn without <think>"))),
        )

    def list_rules(k: int, mk: str) -> Column:
        msgs_x, mcols = F.col(f"_msgs_x{k}"), F.col(f"_m{k}")
        is_list = _kind(msgs_x).startswith("ARRAY")
        n_msgs = F.size(F.col(f"_msgs{k}"))
        roles = F.transform(mcols, lambda m: m["r"])
        list_ok = is_list & (n_msgs >= 2)
        whole = F.array(
            _issue(msgs_x.isNull() | F.is_variant_null(msgs_x), "error", mk, "L12", f"{mk}: missing"),
            _issue(msgs_x.isNotNull() & ~F.is_variant_null(msgs_x) & ~is_list,
                   "error", mk, "L13", f"{mk}: must be an array"),
            _issue(is_list & (n_msgs < 2), "error", mk, "L14",
                   F.concat(F.lit(f"{mk}: at least 2 messages needed, got "), n_msgs.cast("string"))),
            _issue(list_ok & ~F.array_contains(roles, "user"), "error", mk, "L15",
                   f"{mk}: no message with role=user"),
            _issue(list_ok & ~F.array_contains(roles, "assistant"), "error", mk, "L16",
                   f"{mk}: no message with role=assistant")
        )
        each = F.when(list_ok, F.flatten(F.transform(mcols, lambda m, i: per_message(mk, m, i)))).otherwise(F.array())
        return F.concat(whole, each)

    parse_rule = _issue(F.lit(True), "error", "record", "L0", "record: not a JSON object")
    all_issues = F.when(~is_obj | v.isNull(), F.array(parse_rule)).otherwise(
        F.concat(F.array(*record_rules), *[list_rules(k, mk) for k, mk in enumerate(message_keys)]))
    return parsed.select("idx", *(["raw"] if keep_raw else []), F.array_compact(all_issues).alias("issues"))


def lint_pairs(records: DataFrame, strict: bool = False) -> DataFrame:
    """F5 for preference-pair records: record rules once, message rules on both ``chosen`` and ``rejected``."""
    return exploded(issue_lists(records, strict, ["chosen", "rejected"]))


def lint_once(records: DataFrame, strict: bool = False, messages_keys: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """((idx, raw, issues) as written once, totals): one pass lints, counts and writes.

    The totals (total_records, error_count, warning_count) are observed while the table is written, so report, rule
    counts and a gated write read what is there and nothing is linted again.
    """
    from pyspark.sql import Observation

    from ..session import cut_lineage
    o = Observation()
    is_error = lambda x: x["level"] == "error"
    errors = F.size(F.filter("issues", is_error))
    lists = issue_lists(records, strict, messages_keys, keep_raw=True).observe(
        o, F.count(F.lit(1)).alias("total_records"), F.coalesce(F.sum(errors), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum(F.size("issues") - errors), F.lit(0)).alias("warning_count"))
    return cut_lineage(lists), o.get


def rule_counts(issues: DataFrame) -> DataFrame:
    """A2: issues per (level, rule, field); partial aggregation absorbs skew."""
    return (issues.groupBy("level", "rule", "field")
            .agg(F.count(F.lit(1)).alias("n_issues"),
                 F.count_distinct("idx").alias("n_records")))


def report(spark: SparkSession, totals: dict[str, int]) -> DataFrame:
    """A1 headline (one row): total_records, error_count, warning_count and the pass flag, from ``lint_once``."""
    cols = ["total_records", "error_count", "warning_count"]
    return spark.range(1).select(*[F.lit(totals[c]).cast("bigint").alias(c) for c in cols], F.lit(totals["error_count"] == 0).alias("passed"))


def first_issues(issues: DataFrame, level: str, n: int) -> DataFrame:
    """A1 detail / T1: first n issues of a level in record order (TakeOrdered)."""
    return (issues.where(F.col("level") == level)
            .orderBy("idx", "rule", "field", "msg").limit(n))


def repair(records: DataFrame, seed: int = 0) -> DataFrame:
    """fill a missing id (deterministic UUID from seed and idx), a missing
    version and an absent content hash; every other key is kept as it is.

    The reference draws a random UUID and ignores its seed (Q13); ours is the
    sha-256 of (seed, idx) laid out as a version-4 UUID, so reruns agree.
    Returns (idx, raw).
    """
    v = F.try_parse_json(F.col("raw"))
    keys = F.json_object_keys(F.col("raw"))
    obj = F.try_variant_get(v, "$", "map<string,variant>")
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("idx").cast("string")), 256)
    new_id = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                         F.concat(F.lit("4"), F.substring(h, 14, 3)),
                         F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    id_x = _vget(v, "$.id")
    ver_x = _vget(v, "$.version")
    msgs = F.try_variant_get(v, "$.messages", "array<variant>")
    wanted = ~F.array_contains(keys, "content_hash") & F.array_contains(keys, "messages")
    by_python = python_canonical(F.when(wanted & ~plain_messages(msgs), F.col("raw")))
    new_hash = F.when(wanted, F.coalesce(digest(by_python), content_hash_of_variant_messages(msgs)))
    patch = F.map_concat(
        F.map_filter(obj, lambda k, _: ~k.isin("id", "version", "content_hash")),
        F.create_map(F.lit("id"), F.when(_truthy(id_x), id_x).otherwise(new_id.cast("variant")),
                     F.lit("version"), F.when(_truthy(ver_x), ver_x)
                     .otherwise(F.lit(DEFAULT_VERSION).cast("variant"))),
        F.when(F.array_contains(keys, "content_hash") | new_hash.isNotNull(),
               F.create_map(F.lit("content_hash"), F.coalesce(new_hash.cast("variant"), F.element_at(obj, F.lit("content_hash")))))
        .otherwise(F.create_map().cast("map<string,variant>")),
    )
    fixed = F.when(obj.isNull(), F.col("raw")).otherwise(F.to_json(patch))
    return records.select("idx", fixed.alias("raw"))


def gated_write(repaired: DataFrame, strict: bool, path: str) -> bool:
    """F8: write the repaired records only if linting them finds no error; repaired, linted and counted in one pass."""
    table, totals = lint_once(repaired, strict)
    if totals["error_count"]:
        return False
    table.select("raw").write.mode("overwrite").text(path)
    return True


def lint_turns(records: DataFrame, turns: DataFrame, strict: bool = False) -> DataFrame:
    """F5 for a chat corpus kept as tables: the same issues as ``lint`` without gathering a record.

    records: (idx, id, version, split, difficulty, category, source, has_hash_key, has_messages,
              has_tool_calls_key, rejection_reason) -- typed columns, null = absent.
    turns:   (idx, pos, role, content) -- one row per message, pos = 0-based position.

    Message rules run on turn rows; the record rules that look at all messages
    (count, has user / assistant, tool call) are algebraic aggregates per
    record, so a conversation holding a third of all turns is pre-aggregated
    map-side and its turn rows stay spread over many tasks.
    """
    warn = "error" if strict else "warning"
    stats = turns.groupBy("idx").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max((F.col("role") == "user").cast("int")).alias("_has_user"),
        F.max((F.col("role") == "assistant").cast("int")).alias("_has_asst"),
        F.max(F.coalesce(F.col("content"), F.lit("")).contains("tool_call").cast("int")).alias("_has_tool"))
    r = records.join(stats, "idx", "left")
    t = T.truthy_string
    n = F.coalesce(F.col("_n"), F.lit(0))
    has_msgs = F.col("has_messages")
    list_ok = has_msgs & (n >= 2)

    def enum(key, valid, miss, bad):
        c = F.col(key)
        return [_issue(~t(c), "error", key, miss, f"{key}: missing"),
                _issue(t(c) & ~c.isin(*valid), "error", key, bad,
                       F.concat(F.lit(f"{key}: invalid value '"), c, F.lit(f"', allowed {_sorted_list(valid)}")))]

    rr = F.col("rejection_reason")
    rec_rules = [
        _issue(~t(F.col("id")), "error", "id", "L1", "id: missing"),
        _issue(t(F.col("id")) & ~T.re_fullmatch_unicode(F.col("id"), UUID_BODY, ignore_case=True),
               "error", "id", "L2", F.concat(F.lit("id: not a UUID: "), F.col("id"))),
        _issue(~t(F.col("version")), "error", "version", "L3", "version: missing"),
        _issue(t(F.col("version")) & ~T.re_fullmatch_unicode(F.col("version"), VERSION_BODY),
               "error", "version", "L4", F.concat(F.lit("version: expected vX.Y.Z, got "), F.col("version"))),
        *enum("split", VALID_SPLIT, "L5", "L6"),
        *enum("difficulty", VALID_DIFFICULTY, "L7", "L8"),
        *enum("category", VALID_CATEGORY, "L9", "L10"),
        _issue(~t(F.col("source")), "error", "source", "L11", "source: missing or empty"),
        _issue(~has_msgs, "error", "messages", "L12", "messages: missing"),
        _issue(has_msgs & (n < 2), "error", "messages", "L14",
               F.concat(F.lit("messages: at least 2 messages needed, got "), n.cast("string"))),
        _issue(list_ok & (F.col("_has_user") == 0), "error", "messages", "L15", "messages: no message with role=user"),
        _issue(list_ok & (F.col("_has_asst") == 0), "error", "messages", "L16",
               "messages: no message with role=assistant"),
        _issue(~F.col("has_hash_key"), warn, "content_hash", "L22", "content_hash: missing"),
        _issue(has_msgs & (F.coalesce(F.col("_has_tool"), F.lit(0)) == 1) & ~F.col("has_tool_calls_key"),
               "error", "tool_calls", "L23", "tool_calls: content has a tool call but tool_calls is absent"),
        _issue(rr.isNotNull() & ~rr.isin(*VALID_REJECTION), "error", "rejection_reason", "L24",
               F.concat(F.lit("rejection_reason: invalid value '"), rr,
                        F.lit(f"', allowed {_sorted_list(VALID_REJECTION)}"))),
    ]
    rec_issues = r.select("idx", F.explode(F.array_compact(F.array(*rec_rules))).alias("i"))

    ok_records = r.where(list_ok).select("idx")
    tt = turns.join(ok_records, "idx", "left_semi")
    field = F.concat(F.lit("messages["), F.col("pos").cast("string"), F.lit("]"))
    pre = F.concat(field, F.lit(": "))
    role, content = F.col("role"), F.col("content")
    msg_rules = [
        _issue(~t(role), "error", field, "L17", F.concat(pre, F.lit("role missing"))),
        _issue(t(role) & ~role.isin(*VALID_ROLE), "error", field, "L18",
               F.concat(pre, F.lit("invalid role '"), role, F.lit("'"))),
        _issue(content.isNull(), "error", field, "L19", F.concat(pre, F.lit("content missing"))),
        _issue(content.isNotNull() & T.is_blank(content), "error", field, "L20", F.concat(pre, F.lit("content empty"))),
        _issue((F.coalesce(role, F.lit("")) == "assistant") & ~F.coalesce(content, F.lit("None")).contains("<think>"),
               warn, field, "L21", F.concat(pre, F.lit("assistant turn without <think>"))),
    ]
    msg_issues = tt.select("idx", F.explode(F.array_compact(F.array(*msg_rules))).alias("i"))
    return (rec_issues.unionByName(msg_issues)
            .select("idx", "i.level", "i.field", "i.rule", "i.msg"))


def records_from_table(df: DataFrame, idx: str | None = None) -> DataFrame:
    """(idx, raw) from a typed table (e.g. a Parquet corpus) for ``lint``.

    Typed list columns stay JSON arrays (a Parquet list is a list, Q2) and a
    null cell is written as a JSON null: in a table the key exists, so L22
    does not fire for a null content_hash; a missing *column* is an absent key.
    Without ``idx`` the stable file-order index of ``sources.io`` is used.
    """
    cols = [c for c in df.columns if c != idx]
    raw = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    if idx is not None:
        return df.select(F.col(idx).alias("idx"), raw.alias("raw"))
    from ..sources.io import with_row_index
    return with_row_index(df.select(raw.alias("raw")), "idx")


FATAL = ["missing", "empty", "not parsed"]


def _readable_parquet(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The rows of those files that can be read; none if no file has a schema."""
    if not paths:
        return None
    try:
        return spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(*paths)
    except AnalysisException:
        return None


def lint_files(spark: SparkSession, root: str, strict: bool = False, pattern: str = "*.{json,jsonl,parquet}") -> DataFrame:
    """A1 for files: one row per .jsonl, .json or .parquet file under ``root``, sniffed; a file that cannot be linted is a row too.

    (file_path, fatal, total_records, error_count, warning_count, passed); fatal is ``missing`` (no such path),
    ``empty`` (no record, or a Parquet file without readable rows), ``not parsed`` (a record that is no JSON), or null.
    """
    from ..sources import io
    kind = "file_path string, fatal string, total_records long, error_count long, warning_count long, passed boolean"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(conf).exists(path):
        return spark.range(1).select(F.lit(root).alias("file_path"), F.lit(FATAL[0]).alias("fatal"), *[F.lit(0).cast("long").alias(c) for c in
                                     ("total_records", "error_count", "warning_count")], F.lit(False).alias("passed")).to(StructType.fromDDL(kind))
    names = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).inputFiles()  # listed, not read; empty files too
    files = spark.createDataFrame([(x,) for x in names], "file_path string")
    formats = {"lines": [], "array": [], "parquet": []}
    for r in io.sniff_formats(spark, root, pattern.replace(",parquet", "")).collect():  # a row per file
        formats[r["format"]].append(r["file_path"])
    formats["parquet"] = [x for x in names if x.endswith(".parquet")]
    raws = []
    if formats["lines"]:
        raws.append(spark.read.text(formats["lines"]).where(~T.is_blank(F.col("value"))).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw")))
    if formats["array"]:
        raws.append(io.array_records(spark, formats["array"]).select("file_path", "raw"))
    t = _readable_parquet(spark, formats["parquet"])
    if t is not None:
        raws.append(t.select(F.col("_metadata.file_path").alias("file_path"), F.to_json(F.struct(*t.columns), {"ignoreNullFields": "false"}).alias("raw")))
    found = None
    for r in raws:
        found = r if found is None else found.unionByName(r)
    if found is None:
        per_file = files.where("false").select("file_path", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("total_records", "long"), ("broken", "boolean"), ("error_count", "long"), ("warning_count", "long"))])
    else:
        lists = issue_lists(found.withColumnRenamed("file_path", "idx"), strict, keep_raw=True)
        errors = F.size(F.filter("issues", lambda x: x["level"] == "error"))
        per_file = lists.groupBy(F.col("idx").alias("file_path")).agg(
            F.count(F.lit(1)).alias("total_records"), F.bool_or(F.try_parse_json("raw").isNull()).alias("broken"),
            F.sum(errors).alias("error_count"), F.sum(F.size("issues") - errors).alias("warning_count"))
    key = lambda c: F.regexp_replace(c, r"^(\w+):/+", r"$1:/")  # noqa: E731  one path is written file:/ and file:///
    out = files.join(per_file.withColumn("_key", key("file_path")).drop("file_path"), key("file_path") == F.col("_key"), "left")
    fatal = F.when(F.col("total_records").isNull(), FATAL[1]).when(F.col("broken"), FATAL[2])
    n = lambda c: F.when(fatal.isNull(), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    return out.select("file_path", fatal.alias("fatal"), n("total_records"), n("error_count"), n("warning_count"),
                      (fatal.isNull() & (F.coalesce("error_count", F.lit(0)) == 0)).alias("passed"))
