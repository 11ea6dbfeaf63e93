"""Operator 7: exact substring deduplication with fixed-block anchors.

A word is removed if a window of ``window`` = 50 words around it also starts
in a document with a smaller doc_id.  Any such window holds a whole block of
``(window + 1) // 2`` = 25 words that begins at a multiple of 25 in the other
document.  So only these non-overlapping blocks are indexed, and every
rolling 25-word window probes the index.  Hits are extended to maximal exact
repeats: the 50-word windows around a hit are compared by their own hashes,
and a word is removed if one of them has an equal in a smaller document.

Shape of the jobs (``b`` = bucket of a hash; their number follows from the size of the texts):

1. Each task hashes the words of its documents (64 bit) and, by running sums,
   all their 25-word windows.  A *chunk* of documents (a bounded number of
   words) sends each distinct window once: a probe of four hash bytes and a
   place, packed per bucket; blocks likewise.  Windows that occur twice in a
   chunk are candidates at once and need no partner, which thins out hot
   passages and groups of copies before the shuffle.
2. A bucket holds its blocks and streams its probes past them; a probe hits
   if another chunk has a block with its hash, and flags these blocks too.
   Hits go back to their chunk and become spans of window starts per
   document.
3. Documents are joined with their spans.  Those without any are done.  The
   others send the 50-word windows in their spans, as 96-bit hashes with the
   doc_id, again packed per bucket and once per chunk; a bucket finds the
   smallest doc_id of each window and returns the windows of larger ones.

Nothing is cut off: a false hit of step 2 only costs a comparison in step 3.
No task holds more than a chunk or a bucket.

Edge cases: null and empty texts have no words; rows with a null doc_id are
counted but neither lose words nor make others lose them; rows that repeat a
doc_id do not shorten each other, as neither id is smaller; repeats within a
document stay; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import partitions, stored
from .words import hash_words, mix, text_slices, word_bounds
from .worker import tidy

WINDOW = 50
CHUNK_WORDS = 2 << 20
BUCKETS_PER_PARTITION, BUCKET_WORDS = 2, 4 << 20  # at least; a bucket gets so many words' probes at most
_Q1, _Q2 = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
BLOCK, PROBE, HEADER, PLACES = 0, 1, 2, 3
_ROW = "bucket int, kind int, chunk long, data binary"


def rolling(h: np.ndarray, n: int, q: int) -> np.ndarray:
    """Hash of the n words from every place on (places less than n words from the end are left out)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power = np.full(len(h) + 1, q, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    back = np.full(len(h) - n + 1, pow(q, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((sums[n:] - sums[:len(h) - n + 1]) * back)


def planes(x: np.ndarray, width: int) -> bytes:
    """Differences of rising numbers, byte plane by byte plane: high planes are zeros, which compress to nothing."""
    d = np.diff(x, prepend=x.dtype.type(0)).astype(f"<u{width}")
    return d.view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(raw: bytes, width: int, kind: type) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").reshape(-1)
    return np.cumsum(d.astype(kind), dtype=kind)


def _row(bucket: int, kind: int, chunk: int, data: bytes) -> tuple:
    return bucket, kind, chunk, data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                       pa.array(cols[3], pa.binary())], ["bucket", "kind", "chunk", "data"])


class _Chunks:
    """Gathers documents of a task into chunks: word hashes, word counts and keys of whole documents."""

    def __init__(self, flush, chunk_words: int):
        from pyspark import TaskContext
        self.most = chunk_words
        self.flush, self.no = flush, TaskContext.get().partitionId() << 24
        self._new()

    def _new(self) -> None:
        self.h: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.more: list = []
        self.words = 0

    def add(self, h: np.ndarray, n: np.ndarray, keys: np.ndarray, more=None) -> Iterator[pa.RecordBatch]:
        self.h.append(h)
        self.n.append(n)
        self.keys.append(keys)
        self.more.append(more)
        self.words += len(h)
        if self.words >= self.most:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            rows = self.flush(self.no, np.concatenate(self.h), np.concatenate(self.n), np.concatenate(self.keys), self.more)
            self.no += 1
            self._new()
            for k in range(0, len(rows), 64):
                yield _batch(rows[k:k + 64])


def _header(bucket: int, chunk: int, keys: np.ndarray, n: np.ndarray) -> tuple:
    """Keys (doc_id, text key) and word counts of a chunk's documents."""
    return _row(bucket, HEADER, chunk, len(n).to_bytes(8, "little") + keys.astype("<i8").tobytes() + n.astype("<i8").tobytes())


def _places(bucket: int, chunk: int, at: np.ndarray) -> tuple:
    return _row(bucket, PLACES, chunk, planes(np.sort(at).astype(np.int64), 4))


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k]:ends[k + 1]]


def _inside(n: np.ndarray, size: int, total: int) -> np.ndarray:
    """Places from which ``size`` words lie within one document."""
    ends = np.cumsum(n)
    end_of = np.repeat(ends, n)
    at = np.arange(total)
    return np.flatnonzero(at + size <= end_of)


def anchor_rows(docs: DataFrame, block: int, buckets: int, chunk_words: int) -> DataFrame:
    """Step 1: probes, blocks, local candidates and headers of all chunks."""
    def flush(chunk: int, h: np.ndarray, n: np.ndarray, keys: np.ndarray, _) -> list[tuple]:
        rows = [_header(chunk % buckets, chunk, keys, n)]
        at = _inside(n, block, len(h))
        if not at.size:
            return rows
        r = rolling(h, block, _Q1)[at]
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        again = np.zeros(len(r), bool)
        again[order[~first]] = True  # not the first with its hash
        twice = np.zeros(len(r), bool)
        twice[order[np.concatenate([~first[1:], [False]]) | ~first]] = True
        if twice.any():
            rows.append(_places(chunk % buckets, chunk, at[twice]))
        starts = np.repeat(np.cumsum(n) - n, n)
        aligned = (at - starts[at]) % block == 0
        # of the aligned places with one hash, the first
        block_order = order[aligned[order]]
        b = r[block_order]
        blocks = np.sort(block_order[np.concatenate([[True], b[1:] != b[:-1]])]) if len(b) else block_order
        for kind, pick in ((BLOCK, blocks), (PROBE, np.flatnonzero(~again))):
            for k, x in _by_bucket(((r[pick] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), buckets):
                x = pick[x]
                rows.append(_row(k, kind, chunk, len(x).to_bytes(8, "little") + r[x].astype("<u4").tobytes() + planes(at[x].astype(np.int64), 4)))
        return rows

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(flush, chunk_words)
        for b in batches:
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            for i, j, buf, off in text_slices(b.column(2)):
                starts, ends, ptr = word_bounds(buf, off)
                yield from chunks.add(hash_words(buf, starts, ends), np.diff(ptr), ids[i:j])
        yield from chunks.end()
    return docs.mapInArrow(run, _ROW)


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, "<u4", n, 8), unplanes(data[8 + 4 * n:], 4, np.int64)


def match_anchors(rows: DataFrame) -> DataFrame:
    """Step 2: stream the probes of each bucket past its blocks."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, index, flags = None, [], None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if index is not None and flags is not None:
                on = np.cumsum(flags[:-1]) > 0
                keys, chunk, at, _ = index
                out = []
                for k in np.unique(chunk[on]).tolist():
                    out.append(_places(bucket, k, at[on & (chunk == k)]))
                if out:
                    yield _batch(out)

        def build() -> tuple:
            keys = np.concatenate([x for _, x, _ in blocks]) if blocks else np.zeros(0, np.uint32)
            chunk = np.concatenate([np.full(len(x), c) for c, x, _ in blocks]) if blocks else np.zeros(0, np.int64)
            at = np.concatenate([x for _, _, x in blocks]) if blocks else np.zeros(0, np.int64)
            order = np.argsort(keys, kind="stable")
            return keys[order], chunk[order], at[order], {c: np.sort(x) for c, x, _ in blocks}

        for b in batches:
            for k, kind, chunk, data in zip(*(b.column(n).to_pylist() for n in range(3)), b.column(3)):
                if k != bucket:
                    yield from finish()
                    bucket, blocks, index, flags = k, [], None, None
                if kind in (HEADER, PLACES):
                    yield _batch([_row(k, kind, chunk, data.as_py())])
                    continue
                keys, at = _read(data.as_py())
                if kind == BLOCK:
                    blocks.append((chunk, keys, at))
                    continue
                if index is None:
                    index = build()
                    flags = np.zeros(len(index[0]) + 1, np.int64)
                lo, hi = np.searchsorted(index[0], keys, "left"), np.searchsorted(index[0], keys, "right")
                own = index[3].get(chunk)
                mine = np.zeros(len(keys), np.int64)
                if own is not None and len(own):
                    mine = np.searchsorted(own, keys, "right") - np.searchsorted(own, keys, "left")
                hit = hi - lo > mine  # a block of another chunk
                if hit.any():
                    np.add.at(flags, lo[hit], 1)
                    np.add.at(flags, hi[hit], -1)
                    yield _batch([_places(k, chunk, at[hit])])
        yield from finish()
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(run, _ROW)


def _spans(starts: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers as half-open ranges, pair after pair."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + 1], axis=1).reshape(-1)


def spans_by_document(found: DataFrame, before: int, size: int) -> DataFrame:
    """(doc_id, text_key, spans): starts of ``size``-word windows, from ``before`` words before each place on, within its document.

    With ``before`` 0 the places themselves are meant.
    """
    def regroup(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.loc[pdf["kind"] == HEADER, "data"].iat[0]
        m = int.from_bytes(head[:8], "little")
        keys = np.frombuffer(head, "<i8", 2 * m, 8).reshape(m, 2)
        n = np.frombuffer(head, "<i8", m, 8 + 16 * m)
        ends = np.cumsum(n)
        places = [unplanes(x, 4, np.int64) for x in pdf.loc[pdf["kind"] == PLACES, "data"]]
        out = []
        if places:
            at = np.unique(np.concatenate(places))
            doc = np.searchsorted(ends, at, side="right")
            for d, lo, hi in zip(*_runs(doc)):
                start = ends[d] - n[d]
                p = at[lo:hi] - start
                last = n[d] - size  # of a window's starts
                if last < 0:
                    continue
                marks = np.zeros(n[d] + 2, np.int64)
                np.add.at(marks, np.maximum(p - before, 0), 1)
                np.add.at(marks, np.minimum(p, last) + 1, -1)
                s = np.flatnonzero(np.cumsum(marks[:last + 1]) > 0)
                if len(s):
                    out.append((int(keys[d, 0]), int(keys[d, 1]), _spans(s).astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "text_key", "spans"])
    rows = found.select("chunk", "kind", "data").groupBy("chunk").applyInPandas(regroup, "doc_id long, text_key long, spans binary")
    # a repeated row has its spans once
    return rows.groupBy("doc_id", "text_key").agg(F.max("spans").alias("spans"))


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    cut = np.flatnonzero(np.diff(x)) + 1
    lo = np.concatenate([[0], cut])
    return x[lo].tolist(), lo.tolist(), np.concatenate([cut, [len(x)]]).tolist()


def _starts(raw: bytes) -> np.ndarray:
    pairs = np.frombuffer(raw, "<i4").reshape(-1, 2).astype(np.int64)
    return np.concatenate([np.arange(a, b) for a, b in pairs]) if len(pairs) else np.zeros(0, np.int64)


def window_rows(some: DataFrame, window: int, buckets: int, chunk_words: int) -> DataFrame:
    """Step 3: the windows in the spans of (doc_id, text_key, text, spans), once per chunk."""
    def flush(chunk: int, h: np.ndarray, n: np.ndarray, keys: np.ndarray, more: list) -> list[tuple]:
        rows = [_header(chunk % buckets, chunk, keys, n)]
        first = np.cumsum(n) - n
        spans = [x for part in more for x in part]
        at = np.concatenate([_starts(s) + f for s, f in zip(spans, first.tolist())])
        if not at.size:
            return rows
        w = rolling(h, window, _Q1)[at]
        check = rolling(h ^ (h >> np.uint64(7)), window, _Q2)[at].astype(np.uint32)
        doc = np.repeat(keys[:, 0], [len(_starts(s)) for s in spans])
        order = np.lexsort((doc, check, w))
        a, c, d = w[order], check[order], doc[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        least = d[new][np.cumsum(new) - 1]
        if (d > least).any():  # a smaller document of this chunk has the window
            rows.append(_places(chunk % buckets, chunk, at[order[d > least]]))
        ask = np.sort(order[d == least])
        for k, x in _by_bucket(((w[ask] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), buckets):
            x = ask[x]
            rows.append(_row(k, PROBE, chunk, len(x).to_bytes(8, "little") + w[x].astype("<u8").tobytes() + check[x].astype("<u4").tobytes()
                             + planes(doc[x].astype(np.int64), 8) + planes(at[x].astype(np.int64), 4)))
        return rows

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(flush, chunk_words)
        for b in batches:
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            spans = b.column(3).to_pylist()
            for i, j, buf, off in text_slices(b.column(2)):
                starts, ends, ptr = word_bounds(buf, off)
                yield from chunks.add(hash_words(buf, starts, ends), np.diff(ptr), ids[i:j], spans[i:j])
        yield from chunks.end()
    return some.mapInArrow(run, _ROW)


def match_windows(rows: DataFrame) -> DataFrame:
    """Step 3: places of windows that a smaller document of another chunk has."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            size = [len(x[1]) for x in held]
            w, check, doc = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            order = np.lexsort((doc, check, w))
            a, c, d = w[order], check[order], doc[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            larger = np.zeros(len(w), bool)
            larger[order[d > d[new][np.cumsum(new) - 1]]] = True
            out = []
            for (chunk, *_, at), hit in zip(held, np.split(larger, np.cumsum(size)[:-1])):
                if hit.any():
                    out.append(_places(bucket, chunk, at[hit]))
            if out:
                yield _batch(out)

        for b in batches:
            for k, kind, chunk, data in zip(*(b.column(n).to_pylist() for n in range(3)), b.column(3)):
                if k != bucket:
                    yield from finish()
                    bucket, held = k, []
                raw = data.as_py()
                if kind in (HEADER, PLACES):
                    yield _batch([_row(k, kind, chunk, raw)])
                    continue
                n = int.from_bytes(raw[:8], "little")
                held.append((chunk, np.frombuffer(raw, "<u8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n),
                             unplanes(raw[8 + 12 * n:8 + 20 * n], 8, np.int64), unplanes(raw[8 + 20 * n:], 4, np.int64)))
        yield from finish()
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(run, _ROW)


def repeated_spans(docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, removals).

    documents: (doc_id, text_key, n_words, kept_sha256, text, spans): digests
    of documents without any candidate; the others have their text and
    candidate spans instead.  removals: (doc_id, text_key, spans) with the
    starts of windows whose words go, as int32 ranges.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(BUCKETS_PER_PARTITION * partitions(spark), -(-size // (6 * BUCKET_WORDS)))  # a word and its space: six bytes or so
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    hits = match_anchors(anchor_rows(table.where("doc_id is not null"), block, buckets, chunk_words))
    spans = spans_by_document(hits, window - block, window)
    joined = table.join(spans, ["doc_id", "text_key"], "left")

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, kept = [], [], []
            has = b.column(3).is_valid().to_pylist()
            for t, some in zip(b.column(2), has):
                text = t.as_py() or ""
                words = text.encode().split()
                n.append(len(words))
                sha.append(None if some else hashlib.sha256(b" ".join(words)).hexdigest())
                kept.append(text if some else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()),
                                              b.column(3)], ["doc_id", "text_key", "n_words", "kept_sha256", "text", "spans"])
    done = stored(joined.select("doc_id", "text_key", "text", "spans")
                  .mapInArrow(digest, "doc_id long, text_key long, n_words long, kept_sha256 string, text string, spans binary"), "anchored")
    some = done.where("spans is not null").select("doc_id", "text_key", "text", "spans")
    removed = match_windows(window_rows(some, window, buckets, chunk_words))
    return done, spans_by_document(removed, 0, window)


def removed_words(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words the windows from ``starts`` on cover."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + window, n), -1)
    return np.cumsum(marks[:n]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text of documents that lose words, kept_sha256) of every row."""
    done, removals = repeated_spans(docs, window, chunk_words)
    joined = done.where("spans is not null").drop("spans").join(removals, ["doc_id", "text_key"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words = text.as_py().encode().split()
                gone = removed_words(_starts(spans.as_py()), len(words), window) if spans.is_valid else np.zeros(len(words), bool)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((doc_id, len(words), int(gone.sum()), kept.decode() if gone.any() else None, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
    changed = joined.select("doc_id", "text", "spans").mapInArrow(cut, schema)
    same = done.where("spans is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), "kept_sha256")
    return changed.unionByName(same)
