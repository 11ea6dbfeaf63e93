"""Input tables of the jobs, derived by Spark from the driver's tables.

The reference works on chat corpora, preference pairs, rollouts, training
logs and metric points; the driver supplies TPC-H-like tables plus
``conversations``, ``documents``, ``events`` and friends.  Each function here
maps a driver table onto one input schema of the jobs (the mapping is listed
in FIXTURES.md section 3) so that the work grows with the tables.  Every
rule is a column expression and can be restated in plain SQL, which is what
the DuckDB oracles do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint as L
from ..sources import tables


def md5_uuid(c: Column) -> Column:
    h = F.md5(c.cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def conversation_turns(conv: DataFrame) -> DataFrame:
    """Turn rows with planted message faults: (c, turn, role, content)."""
    c, turn = F.col("conv_id"), F.col("turn")
    role = F.when((c % 19 == 0) & (turn == 0), F.lit("bot")).otherwise(F.col("role"))
    content = (F.when((c % 37 == 0) & (turn == 1), F.lit(None).cast("string"))
               .when((c % 23 == 0) & (turn == 1), F.lit("  \n "))
               .when((c % 31 == 0) & (turn == 0), F.concat(F.col("text"), F.lit(" <tool_call>")))
               .otherwise(F.col("text")))
    return conv.select(c.alias("c"), turn, role.alias("role"), content.alias("content"))


def chat_messages(conv: DataFrame) -> DataFrame:
    """(c, messages array<struct<role,content>>) in turn order.

    One conversation is one record of the corpus, so its turns are gathered
    into one row; a record is bounded by the chat format, not by the data size.
    """
    t = conversation_turns(conv)
    return (t.groupBy("c")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
            .select("c", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                             x["content"].alias("content"))).alias("messages")))


#: Records without a ``messages`` key are added, one for every conversation whose id is divisible by 41; their ids are shifted.
ADDED = 1 << 40


def added_ids(ids: DataFrame) -> DataFrame:
    """(c): ids of the added records, from distinct conversation ids (c)."""
    return ids.where(F.col("c") % 41 == 0).select((F.col("c") + ADDED).alias("c"))


def chat_record_columns(msgs: DataFrame) -> DataFrame:
    """Typed chat records with planted field faults (null = key absent)."""
    c = F.col("c")
    u = md5_uuid(c)
    return msgs.select(
        c,
        F.when(c % 7 == 0, F.lit(None)).when(c % 13 == 0, F.concat(F.lit("not-a-uuid-"), c.cast("string")))
        .when(c % 29 == 0, F.upper(u)).otherwise(u).alias("id"),
        F.when(c % 11 == 0, F.lit("")).when(c % 9 == 0, F.lit("v1.0"))
        .otherwise(F.concat(F.lit("v1."), (c % 4).cast("string"), F.lit(".0"))).alias("version"),
        F.when(c % 5 == 0, F.lit("dev")).otherwise(pick(L.VALID_SPLIT, c % 3)).alias("split"),
        F.when(c % 8 == 0, F.lit(None).cast("string")).otherwise(pick(L.VALID_DIFFICULTY, c % 3)).alias("difficulty"),
        F.when(c % 10 == 3, F.lit("biology")).otherwise(pick(L.VALID_CATEGORY, c % 8)).alias("category"),
        F.when(c % 17 == 0, F.lit("")).otherwise(F.lit("conversations")).alias("source"),
        F.when(c % 4 >= 2, F.concat(F.lit("sha256:"), F.substring(F.md5(c.cast("string")), 1, 16))).alias("content_hash"),
        "messages",
        F.when(c % 6 == 0, F.lit("too_long")).when(c % 6 == 1, F.lit("wrong_answer")).alias("rejection_reason"),
    )


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, raw): one JSON text per conversation, as a corpus file would hold.

    Absent keys are omitted; records with c % 4 == 1 carry ``content_hash: null``
    (present but null), which only the text form can express.
    """
    conv = tables.load(spark, sf_dir, "conversations")
    ids = conv.select(F.col("conv_id").alias("c")).distinct()
    rec = chat_record_columns(chat_messages(conv).unionByName(added_ids(ids), allowMissingColumns=True))
    j = F.to_json(F.struct(*[F.col(n) for n in rec.columns if n != "c"]))
    raw = F.when(F.col("c") % 4 == 1, F.concat(F.lit('{"content_hash":null,'), j.substr(F.lit(2), F.length(j))))\
        .otherwise(j)
    return rec.select(F.col("c").alias("idx"), raw.alias("raw"))


def alpaca_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpaca SFT rows from ``documents``: instruction = first line, output = the rest.

    input is ``lang: xx`` for doc_id % 3 == 0; for doc_id % 11 == 0 a row with an
    empty output is added under idx = -doc_id - 1.
    """
    from ..functions import text as T
    d = tables.load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select(
        i.alias("idx"),
        T.first_line(F.col("text")).alias("instruction"),
        F.when(i % 3 == 0, F.concat(F.lit("lang: "), F.col("lang"))).otherwise(F.lit("")).alias("input"),
        T.after_first_line(F.col("text")).alias("output"),
        F.col("source").alias("category"),
        F.col("lang"),
    )
    blank = rows.where(F.col("idx") % 11 == 0).withColumn("idx", -F.col("idx") - 1).withColumn("output", F.lit(""))
    return rows.unionByName(blank)


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) of the unmodified conversations, in turn order."""
    conv = tables.load(spark, sf_dir, "conversations")
    return (conv.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
            .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                   x["text"].alias("content"))).alias("messages")))


def chat_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The chat corpus of ``chat_records`` kept as two tables, (records, turns), nothing gathered.

    records carry presence flags where the JSON form would omit a key; turns
    get their 0-based message position from the skew-safe rank.
    """
    from ..operators.ordering import rank_within
    conv = tables.load(spark, sf_dir, "conversations")
    t = conversation_turns(conv)
    ids = conv.select(F.col("conv_id").alias("c")).distinct()
    rec = chat_record_columns(ids.unionByName(added_ids(ids)).withColumn("messages", F.lit(None)))
    c = F.col("c")
    records = rec.select(c.alias("idx"), "id", "version", "split", "difficulty", "category", "source",
                         (c % 4 != 0).alias("has_hash_key"), (c < ADDED).alias("has_messages"),
                         F.lit(False).alias("has_tool_calls_key"), "rejection_reason")
    turns = rank_within(t, ["c"], ["turn"], "_r").select(
        F.col("c").alias("idx"), (F.col("_r") - 1).alias("pos"), "role", "content")
    return records, turns
