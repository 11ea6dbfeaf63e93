"""Corpus-file jobs (S1-S3, S5-S7, S9-S11): files written from the driver's tables and read back by each source.

The oracles are the tables themselves, so a job is right only if every record and every text survives the files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io, tables
from ..streaming.metrics import new_run_dirs
from .catalog import ORACLES, QUERIES, register

DOC_SCHEMA = "doc_id long, text string, lang string, source string"
DOC_SQL = "SELECT doc_id, text, lang, source FROM documents"


def _documents(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@register("corpus_json_lines", DOC_SQL)
def corpus_json_lines(spark, sf_dir):
    """S1 + S10: JSON Lines sink and strict JSON Lines source; nulls and non-ASCII text are kept."""
    d = new_run_dirs(spark, "lines")
    io.write_jsonl(_documents(spark, sf_dir), d["out"])
    return io.read_corpus(spark, d["out"], DOC_SCHEMA)


@register("corpus_json_arrays", DOC_SQL)
def corpus_json_arrays(spark, sf_dir):
    """Files that hold one JSON array each, read in byte ranges."""
    d = new_run_dirs(spark, "arrays")
    io.write_json_array(_documents(spark, sf_dir), d["out"])
    return io.read_arrays(spark, d["out"], DOC_SCHEMA).drop("file_path")


@register("corpus_mixed_directory", """
SELECT doc_id, text, lang, source, CASE WHEN doc_id % 2 = 0 THEN 'deep/arrays' ELSE 'lines' END AS folder FROM documents""")
def corpus_mixed_directory(spark, sf_dir):
    """S3 + S5: a directory tree with array files and JSON Lines files, sniffed file by file, with provenance."""
    d = new_run_dirs(spark, "mixed")
    docs = _documents(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    io.write_json_array(docs.where(even), d["out"] + "/deep/arrays")
    io.write_jsonl(docs.where(~even), d["out"] + "/lines")
    back = io.read_any(spark, d["out"], DOC_SCHEMA, pattern="*.{json,jsonl,txt}")
    folder = F.regexp_extract("file_path", "/(deep/arrays|lines)/[^/]*$", 1)
    return back.select("doc_id", "text", "lang", "source", folder.alias("folder"))


@register("corpus_several_paths", DOC_SQL)
def corpus_several_paths(spark, sf_dir):
    """Several paths read as one corpus."""
    d = new_run_dirs(spark, "paths")
    docs = _documents(spark, sf_dir)
    paths = []
    for k in range(3):
        paths.append(f"{d['out']}/part{k}")
        io.write_jsonl(docs.where(F.col("doc_id") % 3 == k), paths[-1])
    return io.read_corpus(spark, paths, DOC_SCHEMA)


@register("corpus_empty_refused", """
SELECT k AS part, (SELECT count(*) FROM documents WHERE doc_id % 2 = k) = 0 AS refused FROM range(3) t(k)""")
def corpus_empty_refused(spark, sf_dir):
    """An input without records is refused, others pass (the third part of two is empty)."""
    docs = _documents(spark, sf_dir)
    out = []
    for k in range(3):
        try:
            io.require_rows(docs.where(F.col("doc_id") % 2 == k), f"part {k}")
            out.append((k, False))
        except io.EmptyInput:
            out.append((k, True))
    return spark.createDataFrame(out, "part long, refused boolean")


@register("features_csv", """
SELECT CAST(label AS BIGINT) AS label,
       array_to_string(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)), ',') AS features
FROM embeddings""")
def features_csv(spark, sf_dir):
    """Vectors written as CSV with a header and the label in the last column, read as feature arrays."""
    d = new_run_dirs(spark, "features")
    e = tables.load(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    e.select(*[F.get("embedding", F.lit(k)).alias(f"f{k}") for k in range(width)], "label") \
        .write.option("header", True).csv(d["out"])
    back = io.read_features_csv(spark, d["out"], width)
    q = F.transform("features", lambda x: F.floor(x.cast("double") * F.lit(1024.0)).cast("string"))
    return back.select(F.col("label").cast("long").alias("label"), F.array_join(q, ",").alias("features"))


def _eval_results(spark, sf_dir):
    """The evaluation table written as result files and read back."""
    d = new_run_dirs(spark, "results")
    table = QUERIES["eval_table"](spark, sf_dir)
    io.write_jsonl(table, d["out"])
    return io.read_corpus(spark, d["out"], table.schema)


def register_results() -> None:
    """After the scoring jobs: the result files hold what ``eval_table`` gives, so they share its oracle."""
    register("eval_result_files", ORACLES["eval_table"])(_eval_results)
