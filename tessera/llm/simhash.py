"""Operator 4: SimHash near-duplicates, found by deletion-variant signatures.

Fingerprint: a bit is set if it is set in over half of the 64-bit hashes of
a text's word shingles.  Two fingerprints are linked if they differ in at
most ``max_bits`` = 3 bits.

Candidate search.  Cut into 3 + 1 segments, one would have to be equal; cut
into only two, one differs by at most one bit.  So each 32-bit half is
indexed under its 32 one-wildcard variants (the bit at the wildcard is
cleared): two halves that differ by at most one bit share a variant.
Fingerprints are joined on equal variants and verified by the population
count of their difference.  A pair is reported by one variant only: in the
high half if that differs by at most one bit, else in the low half; at the
differing bit, or at bit 0 where the halves are equal.

Only distinct fingerprints are indexed, so exact copies (and all other
documents with one fingerprint) are one row however many they are.  The join
is a plain sort-merge equi-join of 64 narrow rows per distinct fingerprint,
never a broadcast of them, which adaptive execution splits where a variant is
common; its output is links only.

Components: alternating large-star and small-star steps over the links, each
written to the shared folder, until a step changes nothing; every node ends
linked to the smallest of its component.

Edge cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; fewer words than a shingle has
are one shingle; rows with a null doc_id get a fingerprint but take no part
in components (component_id null); repeated doc_ids are linked through every
fingerprint they have; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free, stored
from .worker import tidy

SHINGLE, MAX_BITS, SEED = 3, 3, 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    n = len(raw)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded temporaries for very long texts
        ones += np.unpackbits(raw[k:k + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "").cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the one-wildcard variants of both halves; key = half, wildcard bit, half without that bit."""
    bit = (F.col("j") % 32).cast("int")
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    half = F.when(F.col("j") < 32, F.shiftrightunsigned("fp", 32)).otherwise(low)
    wild = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    key = F.call_function("shiftleft", F.col("j").cast("long"), F.lit(32)).bitwiseOR(half.bitwiseAND(F.bitwise_not(wild)))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select(key.alias("key"), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: each pair of distinct fingerprints within ``max_bits`` once."""
    if max_bits > 3:
        raise ValueError("two one-wildcard halves find pairs of at most three differing bits")
    v = variants(fps)
    a, b = v.select("key", F.col("fp").alias("a")), v.select("key", F.col("fp").alias("b"))
    x: Column = F.col("a").bitwiseXOR(F.col("b"))
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))
    j = F.shiftrightunsigned(F.col("key"), 32)
    by_high = (j < 32) & ((high != 0) | (j == 0))
    by_low = (j >= 32) & (F.bit_count(high) >= 2) & ((low != 0) | (j == 32))
    # the size of an exploded table is reckoned without its 64 rows for one, so it may look small enough to broadcast: one plan at every size
    pair = a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits) & (by_high | by_low))
    return pair.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge (u, v)."""
    e = edges.toDF("u", "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = stored(e, "edges")
    known = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # large-star may leave a node without its own edge to the minimum; small-star gives it one
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(m.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        e = stored(small, "edges")
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == known:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        known = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    table = stored(fingerprints(docs, shingle), "fingerprints")
    some = table.where("doc_id is not null")
    first = stored(some.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct-fingerprints")
    pairs = links(first.select("fp"), max_bits)
    # a doc_id with several fingerprints links them
    repeated = some.distinct().groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = some.distinct().join(repeated.select("doc_id", "a"), "doc_id").where("fp != a").select("a", F.col("fp").alias("b"))
    roots = components(pairs.unionByName(again))
    root = F.coalesce(F.col("root"), F.col("fp"))
    of_fp = first.join(roots, first["fp"] == roots["node"], "left").select("fp", root.alias("root"), "first")
    least = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of_fp.join(least, "root").select("fp", "component_id")
    out = table.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document for each component: the smallest doc_id.

    Of rows that repeat both its doc_id and its text, one stays; other texts under that doc_id stay.
    Rows with a null doc_id belong to no component and stay.
    """
    names = near_duplicates(docs.select("doc_id", "text"), shingle, max_bits)
    k, t = free(docs.columns, "kept_id", "kept_text")
    kept = names.where("doc_id = component_id").select(F.col("doc_id").alias(k)).distinct()
    own = docs.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id").cast("long") == F.col(k), "left_semi")
    own = own.withColumn(t, F.xxhash64("text")).dropDuplicates(["doc_id", t]).drop(t)
    return own.unionByName(docs.where(F.col("doc_id").isNull()))
