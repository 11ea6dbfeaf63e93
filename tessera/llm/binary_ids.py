"""Operator 1: token ids as frequency-ranked, byte-aligned variable-length codes with separate control bytes.

File format (Parquet rows, so that any store Spark writes to will do):

* ``ranks``: one row per token id that occurs: (id, rank); rank 0 is the most
  frequent id of the corpus, ties to the smaller id.
* ``blocks``: one row per block of whole documents, in ascending doc_id order
  within a part and from part to part: (part, block, start, n_tokens,
  doc_ids, lengths, control, data).  ``control`` holds two bits per id (its
  number of bytes less one), four ids a byte, the first id in the lowest
  bits; ``data`` holds the little-endian bytes of the ranks back to back.

Frequent ids have small ranks, so most ids take one or two bytes and two
bits.  Decoding looks every control byte up in a 256-row numpy table of four
lengths, turns lengths into offsets by a running sum and reads four unaligned
bytes per id, masked by its length; a second table lookup maps ranks to ids.

Every text is tokenised once: a first job range-partitions the texts by
doc_id and writes their plain ids as blocks to the shared folder, a second
counts these ids (one row per id and task is shuffled), a third writes each
block again as ranks, in any order.  The rank table has at most one row per
vocabulary entry, which bounds what the driver sends out.

Edge cases: a null text is empty and yields only the end id; an empty table
writes and returns no rows; rows with a null doc_id come first; rows that
repeat a doc_id follow each other in text order; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import partitions, stored, table_path
from .tokens import END_ID, batch_ids, default_path
from .worker import tidy

BLOCK_IDS = 1 << 16
_WIDTH = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit integers."""
    v = np.ascontiguousarray(values, dtype="<u4")
    width = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[:len(v)] = width - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers behind (control, data)."""
    width = _WIDTH[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(width, dtype=np.int64) - width
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    four = np.ndarray((max(len(raw) - 3, 0),), dtype="<u4", buffer=raw, strides=(1,))
    return four[at] & _MASK[width]


def plain_blocks(docs: DataFrame, path: str, end_id: int, block_ids: int) -> DataFrame:
    """Blocks of whole documents with their ids as they are, little-endian, two bytes an id where that is enough."""
    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[object, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held, size
            ids = np.concatenate([x for _, x in held])
            row = {"part": part, "block": block, "start": before, "n_tokens": len(ids), "doc_ids": [d for d, _ in held],
                   "lengths": [len(x) for _, x in held], "ids": ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()}
            block, before, held, size = block + 1, before + len(ids), [], 0
            return pa.RecordBatch.from_pylist([row], schema=_PLAIN_SCHEMA)

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for i, j, ids, off in batch_ids(b.column(1), path, end_id):
                for r in range(i, j):
                    x = ids[off[r - i]:off[r - i + 1]]
                    held.append((doc_ids[r], x))
                    size += len(x)
                    if size >= block_ids:
                        yield flush()
        if held:
            yield flush()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                  # one id's texts spread by their beginnings
                  .repartitionByRange(partitions(docs.sparkSession), "doc_id", F.substring("text", 1, 40)).sortWithinPartitions("doc_id", "text")
                  .mapInArrow(pack, PLAIN_TYPE), "token-id-blocks")


def _block_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(blocks: DataFrame) -> DataFrame:
    """(id, n) over all plain blocks; a task sends one row per id it met."""
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            for size, raw in zip(b.column(0).to_pylist(), b.column(1)):
                m = np.bincount(_block_ids(raw.as_buffer(), size), minlength=len(n))
                m[:len(n)] += n
                n = m
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["id", "n"])
    return blocks.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode (doc_id, text) into the folder ``out``."""
    spark = docs.sparkSession
    blocks = plain_blocks(docs, path or default_path(), end_id, block_ids)
    counts = id_counts(blocks).collect()  # one row per vocabulary entry at most
    order = sorted(counts, key=lambda r: (-r["n"], r["id"]))
    rank = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.uint32)
    for k, r in enumerate(order):
        rank[r["id"]] = k
    spark.createDataFrame([(r["id"], k) for k, r in enumerate(order)], "id long, rank long").coalesce(1) \
        .write.parquet(f"{out}/ranks")

    @tidy
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a block a row
                r = b.slice(i, 1)
                control, data = encode(rank[_block_ids(r.column(6)[0].as_buffer(), r.column(3)[0].as_py())])
                yield pa.RecordBatch.from_arrays([*(r.column(k).cast(_SCHEMA.field(k).type) for k in range(6)),
                                                  pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema=_SCHEMA)

    blocks.mapInArrow(ranked, BLOCK_TYPE).write.option("compression", "none").parquet(f"{out}/blocks")


_PLACE = [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
          ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
_PLAIN_SCHEMA = pa.schema([*_PLACE, ("ids", pa.binary())])
_SCHEMA = pa.schema([*_PLACE, ("control", pa.binary()), ("data", pa.binary())])
_PLACE_TYPE = "part int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<long>"
PLAIN_TYPE = f"{_PLACE_TYPE}, ids binary"
BLOCK_TYPE = f"{_PLACE_TYPE}, control binary, data binary"


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the folder, in no fixed row order; ids is binary, little-endian uint32."""
    return _decoded(spark, out, "doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.astype("<u4").tobytes())


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the folder."""
    return _decoded(spark, out, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _decoded(spark: SparkSession, out: str, schema: str, last) -> DataFrame:
    blocks = spark.read.schema(BLOCK_TYPE).parquet(f"{out}/blocks")
    # one row per part, that is per write task
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(sizes):
        first[p], total = total, total + sizes[p]
    ids_of = np.zeros(1 << 16, np.uint32)
    for r in spark.read.parquet(f"{out}/ranks").collect():  # bounded by the vocabulary
        if r["rank"] >= len(ids_of):
            ids_of = np.concatenate([ids_of, np.zeros_like(ids_of)])
        ids_of[r["rank"]] = r["id"]
    kind = pa.binary() if schema.endswith("binary") else pa.int64()
    names = [x.split()[0] for x in schema.split(", ")]

    @tidy
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a block a row
                r = b.slice(i, 1).to_pylist()[0]
                ids = ids_of[decode(r["control"], r["data"], r["n_tokens"])]
                upto = np.cumsum([0, *r["lengths"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(upto[:-1] + first[r["part"]] + r["start"], pa.int64()),
                     pa.array(r["lengths"], pa.int64()), pa.array([last(ids[x:y]) for x, y in zip(upto[:-1], upto[1:])], kind)], names)
    return blocks.mapInArrow(unpack, schema)


def token_id_files(docs: DataFrame, out: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` in the format above (by default to the shared folder) and return the digests read back."""
    spark = docs.sparkSession
    out = out or table_path(spark, "token-ids")
    write(docs, out, path)
    return read_digests(spark, out)
