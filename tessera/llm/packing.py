"""Operator 3: best-fit packing of documents into sequences, improved by swap-based local search.

A document (its ids and the end id) of at most ``seq_len`` ids is one piece;
a longer one is cut into full pieces and a shorter last one.  Only piece
lengths matter for packing, so the ids go through one task each and what is
shuffled is one small row per piece.

Pieces are dealt into cells by a hash, a bounded number per cell.  A cell is
packed best-fit-decreasing; then local search works on its underfull bins:
the emptiest bin gives a piece to a bin with room, or exchanges one of its
pieces, or two of them, for a smaller one of another bin.  Every step raises
the sum of squared fills; a bin whose pieces are all gone is dropped.  Bins
that are full up to ``slack`` ids are closed; pieces of the others go, dealt
anew into fewer cells, to the next round, until one cell is left, the open
bins are as few as their pieces allow (by their sum, or because that many
pieces are longer than half a sequence).  A round that saves no bin is taken
back; then the fuller half of the open bins is closed as it was, and the
emptier half, where cells were dealt unevenly, goes on.  So no task holds more
than a cell whatever the corpus, and the waste of the many cells is packed
again.

Edge cases: a null text is empty (one piece, the end id); an empty table
yields no rows; repeated doc_ids and null doc_ids are rows like others; extra
columns are not read.  Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .tokens import END_ID, batch_ids, default_path
from .worker import tidy

SEQ_LEN = 4096
CELL_PIECES = 40_000
SLACK = 4


def pieces(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row per piece of every document."""
    path = path or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids = b.column(0).to_numpy(zero_copy_only=False) if not b.column(0).null_count else np.array(b.column(0).to_pylist(), object)
            for i, j, ids, off in batch_ids(b.column(1), path, end_id):
                size = np.diff(off)
                many = -(-size // seq_len)
                row = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * seq_len
                length = np.minimum(size[row] - start, seq_len)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = off[row] + start
                crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i:j][row], pa.int64()), pa.array(piece, pa.int32()),
                                                  pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, seq_len: int) -> list[list[int]]:
    """Bins of indices, best-fit-decreasing; ``room`` has bit r set if a bin with r ids of room exists."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    room = 0
    for k in np.argsort(-length, kind="stable").tolist():
        n = int(length[k])
        fits = room >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            at = by_room[r].pop()
            if not by_room[r]:
                room &= ~(1 << r)
        else:
            r, at = seq_len, len(bins)
            bins.append([])
        bins[at].append(k)
        r -= n
        if r:
            by_room.setdefault(r, []).append(at)
            room |= 1 << r
    return bins


def _offers(own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """(rising sums, pieces) of what a bin can give in exchange: any one or any two of its pieces, one way for each sum.

    Pieces of one length are alike, and a bin holds fewer than 2 * sqrt(its fill) lengths, so all pairs are few.
    """
    lengths, first, many = np.unique(size[own], return_index=True, return_counts=True)
    found: dict[int, tuple[int, ...]] = {}
    for i, a in enumerate(lengths.tolist()):
        found.setdefault(a, (int(own[first[i]]),))
    for i, a in enumerate(lengths.tolist()):
        if many[i] > 1:
            p, q = own[size[own] == a][:2].tolist()
            found.setdefault(2 * a, (p, q))
        for j in range(i + 1, len(lengths)):
            found.setdefault(a + int(lengths[j]), (int(own[first[i]]), int(own[first[j]])))
    sums = sorted(found)
    return np.array(sums, np.int64), [found[s] for s in sums]


def local_search(bins: list[list[int]], length: np.ndarray, seq_len: int) -> list[list[int]]:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges; each raises the sum of squared fills."""
    fill = np.array([int(length[b].sum()) for b in bins], dtype=np.int64)
    under = [k for k in np.argsort(fill, kind="stable").tolist() if fill[k] < seq_len]
    if len(under) < 2:
        return bins
    least = -(-int(fill.sum()) // seq_len)
    where = np.repeat(under, [len(bins[k]) for k in under])  # bin of every item of an underfull bin
    item = np.concatenate([np.array(bins[k]) for k in under])
    size = length[item].astype(np.int64)
    alive = len(bins)
    for d in under:
        if alive <= least or seq_len * (len(under) - 1) - fill[under].sum() + fill[d] < fill[d]:
            break
        while True:
            own = np.flatnonzero(where == d)
            if not own.size:
                alive -= 1
                break
            other = np.flatnonzero((where != d) & (fill[where] >= fill[d]))  # exchanges only towards fuller bins
            if not other.size:
                break
            room = seq_len - fill
            mine = size[own]
            y = int(own[np.argmax(mine)])
            open_bins = np.unique(where[other])
            fits = open_bins[room[open_bins] >= size[own].min()]
            if fits.size:  # a move: the largest piece that fits, to the bin it leaves the least room in
                r = room[fits]
                y = int(max((k for k in own.tolist() if size[k] <= r.max()), key=lambda k: size[k]))
                ok = fits[r >= size[y]]
                to = int(ok[np.argmin(room[ok])])
                where[y] = to
                fill[to] += size[y]
                fill[d] -= size[y]
                continue
            x, r = size[other], room[where[other]]
            sums, gives = _offers(own, size)
            at = np.searchsorted(sums, x + r, "right") - 1  # the most that fits where piece x leaves
            gain = np.where(at >= 0, sums[at] - x, 0)
            k = int(np.argmax(gain))
            best, step = int(gain[k]), None
            if best > 0:
                step = gives[int(at[k])], int(other[k])
            if step is None:
                break
            give, take = step
            to = int(where[take])
            for k in give:
                where[k] = to
            where[take] = d
            fill[to] += best
            fill[d] -= best
    out = {k: [] for k in under}
    for k, b in zip(item.tolist(), where.tolist()):
        out[b].append(k)
    return [out.get(k, b) for k, b in enumerate(bins) if out.get(k, b)]


def pack_lengths(length: np.ndarray, seq_len: int = SEQ_LEN) -> list[list[int]]:
    return local_search(best_fit(length, seq_len), length, seq_len)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, cell long, sequence_id long, offset long, closed boolean"


def _cell_packer(turn: int, final: bool, seq_len: int, slack: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, ignore_index=True)
        length = pdf["length"].to_numpy()
        bins = pack_lengths(length, seq_len)
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        closed = np.ones(len(pdf), bool)
        base = (turn << 56) + (int(pdf["cell"].iat[0]) << 24)
        for k, b in enumerate(bins):
            ends = np.cumsum(length[b])
            seq[b], off[b] = base + k, ends - length[b]
            closed[b] = final or ends[-1] >= seq_len - slack
        return pdf.assign(sequence_id=seq, offset=off, closed=closed)
    return one


def _halves(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of the bins that are at least as full as the median, and of the others."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    middle = fill.agg(F.percentile_approx("fill", 0.5)).first()[0]
    both = stored(packed.join(fill, "sequence_id").select(*packed.columns, (F.col("fill") >= middle).alias("full")), "halves")
    return both.where("full").drop("full"), both.where("not full").drop("full")


def pack(table: DataFrame, seq_len: int = SEQ_LEN, cell_pieces: int = CELL_PIECES, slack: int = SLACK) -> DataFrame:
    """Pieces with (sequence_id, offset)."""
    spark = table.sparkSession
    rest, done, n, turn = table, [], table.count(), 0
    before = None  # open pieces as they stand, and in how many bins
    while n:
        cells = -(-n // cell_pieces)
        final = cells == 1
        cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn)), F.lit(cells))  # equal rows spread too
        packed = stored(rest.withColumn("cell", cell).groupBy("cell").applyInPandas(_cell_packer(turn, final, seq_len, slack), _PACKED), "packed")
        bins = packed.select("sequence_id").distinct().count()
        if before is not None and bins >= before[1] and not final:
            full, left = _halves(before[0])
            done.append(full)
            r = left.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
            before, rest, n, turn = (left, r["bins"]), left.select(*table.columns), r["n"], turn + 1
            continue
        if before is not None and bins >= before[1]:
            done.append(before[0])
            break
        done.append(packed.where("closed"))
        left = packed.where(~F.col("closed"))
        r = left.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("ids"), F.count_if(F.col("length") * 2 > seq_len).alias("long"),
                     F.count_distinct("sequence_id").alias("bins")).first()
        if r["n"] and r["bins"] <= max(-(-r["ids"] // seq_len), r["long"]):  # as few as can be
            done.append(left)
            break
        before, rest, n, turn = (left, r["bins"]), left.select(*table.columns), r["n"], turn + 1
    if not done:
        return spark.createDataFrame([], _PACKED)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    table = stored(pieces(docs, path, seq_len), "pieces")
    return pack(table, seq_len).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
