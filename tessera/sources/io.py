"""Corpus sources and sinks.

JSON Lines and JSON arrays are read by Spark's JSON source with an explicit
schema (no inference pass over the data).  A file that holds one huge array is
read by many tasks (``read_arrays``).  Format sniffing looks at the
first non-blank line of every file with a distributed text scan, not by
opening files on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import is_blank

CORPUS_GLOB = "*.{json,jsonl}"


class EmptyInput(ValueError):
    """A corpus with no record is an error."""


def read_corpus(spark: SparkSession, paths: str | list[str], schema: StructType | str,
                strict: bool = True, multiline: bool = False) -> DataFrame:
    """JSON Lines (blank lines skipped) or JSON arrays, several paths at once.

    strict=True fails the job on a broken line (the reference's behaviour);
    strict=False keeps it in ``_corrupt_record``.
    """
    r = spark.read.schema(schema).option("multiLine", multiline)
    r = r.option("mode", "FAILFAST") if strict else r.option("mode", "PERMISSIVE")
    return r.json(paths)


_TOKEN = re.compile(r'\\.|"', re.DOTALL)


def _quotes_and_depths(text: str) -> tuple[int, int, int]:
    """(unescaped quotes, depth gained if the text begins outside a string, the same if it begins inside one)."""
    cuts, at = [], 0
    for m in _TOKEN.finditer(text):
        if m.group() == '"':
            cuts.append(text[at:m.start()])
            at = m.end()
    cuts.append(text[at:])
    gain = [sum(x.count(c) for c in "{[") - sum(x.count(c) for c in "}]") for x in cuts]
    return len(cuts) - 1, sum(gain[::2]), sum(gain[1::2])


def array_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, record, raw) of files that each hold one JSON array of objects; byte ranges of a file are read in parallel.

    The text source splits files by bytes and cuts at every ``}``, which may end an object or stand in a string.  Each
    piece is scanned once for both cases: how many unescaped quotes it has, and how deep it goes if it begins outside
    or inside a string.  Running sums over the pieces of a file (``scan.prefix_sums``) then say which case holds and
    where the depth returns to that of the array: there a record ends, and its pieces are put together again.
    What follows the last record and is not the end of the array comes as a last record that does not parse.
    """
    from ..operators.scan import prefix_sums
    from ..session import cut_lineage

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_quotes_and_depths(t) for t in b.column(2).to_pylist()]
            q, outside, inside = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int32()) for x in (q, outside, inside))], [*b.schema.names, "q", "d0", "d1"])
    pieces = with_row_index(spark.read.option("recursiveFileLookup", True).option("lineSep", "}").text(paths)
                            .withColumn("file_path", F.col("_metadata.file_path")), "no").select("file_path", "no", "value")
    pieces = cut_lineage(pieces.mapInArrow(scan, "file_path string, no long, value string, q int, d0 int, d1 int"))
    span = pieces.groupBy("file_path").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    rows = pieces.drop("value").join(span, "file_path").select("file_path", (F.col("no") - F.col("first")).alias("i"), "no", "q", "d0", "d1",
                                                               (F.col("no") == F.col("last")).alias("end"))
    rows = prefix_sums(rows, ["file_path"], "i", {"quotes": F.col("q")})
    inside = F.pmod(F.col("quotes") - F.col("q"), F.lit(2)) == 1
    closes = (F.pmod("quotes", F.lit(2)) == 0) & ~F.col("end")  # the } that cut the piece stands outside of strings
    rows = rows.withColumn("closes", closes).withColumn("gain", F.when(inside, F.col("d1")).otherwise(F.col("d0")) - F.col("closes").cast("int"))
    rows = prefix_sums(rows.drop("quotes"), ["file_path"], "i", {"depth": F.col("gain")})
    ends = (F.col("closes") & (F.col("depth") == 1)).cast("int")
    rows = prefix_sums(rows.withColumn("ends", ends).drop("depth"), ["file_path"], "i", {"upto": F.col("ends")})
    whole = pieces.join(rows.select("no", "ends", (F.col("upto") - F.col("ends")).alias("record")), "no").groupBy("file_path", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "value"))), lambda x: x["value"]), "}").alias("t"), F.max("ends").alias("whole"))
    tail = F.regexp_replace("t", r"^\s*(\[\s*)?\]?\s*\z", "")  # the end of the array, of an empty one too, and of a file that ends with }
    body = F.regexp_replace("t", r"^\s*[\[,]?\s*", "")  # the bracket that opens the array, or the comma before the record
    raw = F.when(F.col("whole") == 1, F.concat(body, F.lit("}"))).otherwise(tail)
    return whole.select("file_path", "record", raw.alias("raw")).where("raw != ''")


def read_arrays(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """Records, with ``file_path``, of files that each hold one JSON array of objects (``array_records``)."""
    record = F.from_json("raw", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return array_records(spark, paths).select("file_path", record.alias("r")).select("r.*", "file_path")


def read_corpus_dir(spark: SparkSession, root: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Every ``*.json`` / ``*.jsonl`` under ``root`` (recursive), with provenance ``file_path``."""
    r = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", CORPUS_GLOB)
         .option("mode", "FAILFAST" if strict else "PERMISSIVE"))
    return r.json(root).withColumn("file_path", F.col("_metadata.file_path"))


def sniff_formats(spark: SparkSession, root: str, pattern: str = CORPUS_GLOB) -> DataFrame:
    """S3: (file_path, format) -- 'array' when the first non-blank character is '[', else 'lines'.

    The first line of a file is the non-blank line with the smallest
    (split offset, position in split); splits of one file can land in any
    partition, so the offset orders them.
    """
    t = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
         .select(F.col("_metadata.file_path").alias("file_path"), F.input_file_block_start().alias("_off"),
                 F.monotonically_increasing_id().alias("_pos"), F.ltrim("value").alias("v"))
         .where(F.col("v") != ""))
    first = t.groupBy("file_path").agg(F.min_by("v", F.struct("_off", "_pos")).alias("first_line"))
    return first.select("file_path", F.when(F.col("first_line").startswith("["), F.lit("array"))
                        .otherwise(F.lit("lines")).alias("format"))


def read_any(spark: SparkSession, root: str, schema: StructType | str, pattern: str = CORPUS_GLOB) -> DataFrame:
    """S3 + S5: sniff each file, read JSON Lines and pretty arrays with the right reader, union them."""
    fmt = sniff_formats(spark, root, pattern).collect()  # one row per file: file metadata, not data
    lines = [r.file_path for r in fmt if r.format == "lines"]
    arrays = [r.file_path for r in fmt if r.format == "array"]
    parts = []
    if lines:
        parts.append(read_corpus(spark, lines, schema).withColumn("file_path", F.col("_metadata.file_path")))
    if arrays:
        parts.append(read_arrays(spark, arrays, schema))
    if not parts:
        raise EmptyInput(f"no corpus file under {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_rows(df: DataFrame, what: str = "dataset") -> DataFrame:
    """Raise when the input has no row (one cheap action)."""
    if df.isEmpty():
        raise EmptyInput(f"{what} is empty")
    return df


def with_row_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Stable 0-based record index in file order (path, split offset, position).

    Rows of a split are read in order by one task, so the count of every split is enough: one pass counts, and
    the records themselves are not sorted.  The table of counts has a row per split.
    """
    split = ["_src_fp", "_src_off"]
    keyed = (df.withColumn("_src_fp", F.col("_metadata.file_path"))
             .withColumn("_src_off", F.input_file_block_start())
             .withColumn("_src_pos", F.monotonically_increasing_id()))
    counts = keyed.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_src_pos").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*split, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return keyed.join(starts, split).withColumn(name, F.col("_src_pos") + F.col("_shift")).drop(*split, "_src_pos", "_shift")


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S1 + S8: (idx, raw) of the records of JSON Lines files in file order; blank lines are no records."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    return with_row_index(lines.where(~is_blank("value")).withColumnRenamed("value", "raw")).select("idx", "raw")


def read_features_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """CSV with a header; the last column is the label, the others a float feature array."""
    cols = [f"f{k}" for k in range(n_features)] + ["label"]
    schema = ", ".join(f"{c} float" for c in cols)
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(F.array(*[F.col(c) for c in cols[:-1]]).alias("features"), F.col("label"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines directory; nulls are written, non-ASCII text is kept as is."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """A directory of text files, each one JSON array with a record per line; nulls are kept.

    A task streams its rows through and holds one batch; an array file cannot be split by a reader, so
    the number of rows in a partition decides the size of a reading task.
    """
    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    _array_lines(records).write.text(path)


def write_raw_array(records: DataFrame, path: str) -> None:
    """As ``write_json_array``, of records (raw) that are JSON texts already."""
    _array_lines(records.select(F.col("raw").alias("value"))).write.text(path)


def _array_lines(records: DataFrame) -> DataFrame:
    def lines(batches):
        lead = "["
        for b in batches:
            out = [("," if n else lead) + x for n, x in enumerate(b["value"].tolist())]
            if out:
                lead = ","
                yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})
    return records.mapInPandas(lines, "value string")
