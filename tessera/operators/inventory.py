"""Artefact inventory (S15, A16, A17): file listings summarised by Spark.

``binaryFile`` lists files with their length; selecting only path and length
prunes the content column, so no file body is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 4
MAX_CHILDREN = 50


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, modification_time) of every file under root."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", "length", F.col("modificationTime").alias("modification_time"))


def directory_summary(files: DataFrame, root: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Per directory (to ``depth`` levels below root): files, bytes, direct sub-directories."""
    rel = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + root.rstrip("/") + "/?", "")
    parts = F.split(rel, "/")
    f = files.select(F.col("length"), parts.alias("parts"))
    # every ancestor directory of a file, up to depth levels: prefixes of its folder components
    anc = f.select("length", "parts", F.explode(F.sequence(F.lit(0),
                   F.least(F.size("parts") - 1, F.lit(depth)))).alias("lvl"))
    anc = anc.select("length", F.array_join(F.slice("parts", 1, F.col("lvl")), "/").alias("dir"),
                     F.when(F.col("lvl") + 1 < F.size("parts"), F.element_at("parts", F.col("lvl") + 1))
                     .alias("child_dir"))
    return anc.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"),
                                  F.count_distinct("child_dir").alias("n_subdirs"))


def largest_children(files: DataFrame, n: int = MAX_CHILDREN) -> DataFrame:
    """A16 detail: the n largest files (a top-k listing)."""
    return files.orderBy(F.col("length").desc(), "path").limit(n).select("path", "length")


def weight_inventory(files: DataFrame, pattern: str) -> DataFrame:
    """Count and total size of weight files matching ``pattern``."""
    w = files.where(F.col("path").rlike(pattern))
    return w.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
