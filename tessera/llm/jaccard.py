"""Operator 11: n-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct word shingles (as 64-bit hashes, sorted).
Two documents are linked if 100 * |x & y| >= percent * |x | y|.

1. Possible sets.  Linked sets share at least a fifth of the smaller one
   within the 40 % or so of their elements with the smallest hashes (prefix
   lemma: with overlap of at least o, the first |x| - o + l elements of both
   share l).  So tasks send only these, as four hash bytes, packed per
   bucket, each once per *chunk* of documents; a bucket answers which of them
   another chunk has too.  A document with too few shared elements has no
   link and is done.
2. Equal sets are one *class*; the class's smallest doc_id stands for it.
   The texts of possible classes are read again as sorted arrays and bitmaps.
3. Elements are ordered by falling rarity; linked sets share one of the first
   |x| - ceil(percent * |x|) + 1.  Elements that one set alone has are in no
   prefix entry, so boilerplate, which is frequent, is only met by sets that
   consist of it.  Entries with one element and size band form a *tile*
   (band b with the sets of band b + 1; a band is a size ratio of 1 / percent,
   so links never reach further).
4. Groups of near copies are joined first, in linear work: the most central
   set of a tile, whose elements are the most shared, is compared with one set
   of every other component in it (of all sets at first), for two tiles of
   each set at most, in a few rounds.  Then tiles that still hold several
   components compare all pairs of different components: bits of x that y has
   not are elements that y has not, which bounds the overlap from above.
   Pairs that the bound lets through are intersected exactly.  A large tile is
   cut into blocks and all pairs of blocks, so a hot element is spread over
   tasks; pairs inside one component are never made.

Bitmaps have four times as many bits as the largest set of the band has
elements, rounded up to a power of two; the next band's are folded to that
width.

Edge cases: a null text or one without words has no shingles and is linked
with nothing; fewer words than a shingle has are one shingle; rows with a
null doc_id get their size but no component (null) and take no part; rows
that repeat a doc_id are linked with each other through it, unless empty; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simhash import components
from .store import partitions, stored
from .words import hash_words, mix, text_slices, word_bounds
from .worker import tidy

SHINGLE, PERCENT = 5, 80
CHUNK_WORDS = 2 << 20
BUCKET_ENTRIES = 2 << 20
TILE = 1024  # sets of a block
ROUNDS = 2  # of comparisons with central sets, before all that is left is compared
BITS = 4  # of a bitmap, for each element of the band's largest set
PAIRS = 1 << 20  # pairs compared at once, times bitmap words
HEADER, ASK, TELL, HITS = 0, 1, 2, 3
_ROW = "bucket int, kind int, chunk long, data binary"
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_TWO = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n, percent: int):
    """Elements that a set of n elements shares at least with a linked one."""
    return -(-n * percent // 100)


def shared_prefix(n):
    """Prefix elements that two linked sets share at least, the smaller of which has n elements."""
    return np.maximum(1, n // 5)


def bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Size band: linked sets lie in one band or in neighbouring ones."""
    edges = [1]
    top = int(n.max(initial=1))
    while edges[-1] <= top:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.searchsorted(np.array(edges), n, side="right") - 1


def band_bits(band: int, percent: int) -> int:
    """Bits of the bitmaps of a band."""
    edge = 1
    for _ in range(band + 1):
        edge = edge * 100 // percent + 1
    return max(64, 1 << (BITS * (edge - 1) - 1).bit_length())


def shingle_sets(col: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes of all rows, sizes)."""
    for i, j, buf, off in text_slices(col):
        low = _LOWER[buf]
        starts, ends, ptr = word_bounds(low, off)
        h = hash_words(low, starts, ends)
        words = np.diff(ptr)
        width = np.minimum(words, shingle)  # short texts are one shingle
        many = np.where(words > 0, words - width + 1, 0)
        row = np.repeat(np.arange(j - i), many)
        first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + ptr[:-1][row]
        s = mix(width[row].astype(np.uint64) + _TWO)
        for k in range(shingle):
            on = slice(None) if not (width[row] <= k).any() else np.flatnonzero(width[row] > k)
            s[on] = mix(s[on] * _TWO + h[first[on] + k])
        ends_at = np.cumsum(many)
        for a, b in zip((ends_at - many).tolist(), ends_at.tolist()):
            s[a:b].sort()
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        yield i, j, s[new], np.bincount(row[new], minlength=j - i)


def set_keys(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of every set: sums of mixed elements."""
    out = np.zeros((len(n), 2), np.int64)
    some = np.flatnonzero(n)
    if some.size:
        at = (np.cumsum(n) - n)[some]
        for k in range(2):
            out[some, k] = np.add.reduceat(mix(s * np.uint64(2 * k + 1) + _TWO), at).view(np.int64)
    return out


def _deltas(x: np.ndarray) -> bytes:
    """Rising small numbers by byte planes of their differences, which compress to next to nothing."""
    return np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1), dtype=np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                      ["bucket", "kind", "chunk", "data"])


def _chunk_rows(chunk: int, s: np.ndarray, n: np.ndarray, ids: np.ndarray, buckets: int, percent: int) -> list[tuple]:
    """Header and packed prefix elements of one chunk of documents."""
    keys = set_keys(s, n)
    known = np.zeros(len(n), np.int64)  # prefix elements that another set of the chunk has
    _, first = np.unique(np.column_stack([n, keys]), axis=0, return_index=True)
    active = np.zeros(len(n), bool)
    active[first] = True  # of equal sets, one
    active &= n > 0
    take = np.where(active, n - least_overlap(n, percent) + shared_prefix(n), 0)
    row = np.repeat(np.arange(len(n)), take)
    at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + (np.cumsum(n) - n)[row]
    e = s[at]
    order = np.argsort(e, kind="stable")
    same = e[order][1:] == e[order][:-1]
    again = np.concatenate([[False], same])
    shared = again | np.concatenate([same, [False]])
    np.add.at(known, row[order[shared]], 1)
    out = []
    for kind, pick in ((ASK, np.sort(order[~shared])), (TELL, np.sort(order[shared & ~again]))):
        to = ((e[pick] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[by], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            x = pick[by[cut[k]:cut[k + 1]]]
            out.append((k, kind, chunk, len(x).to_bytes(8, "little") + e[x].astype("<u4").tobytes() + (_deltas(row[x]) if kind == ASK else b"")))
    head = b"".join([len(n).to_bytes(8, "little"), ids.astype("<i8").tobytes(), n.astype("<i8").tobytes(), keys.astype("<i8").tobytes(),
                     known.astype("<i8").tobytes()])
    return [(chunk % buckets, HEADER, chunk, head), *out]


def prefix_rows(docs: DataFrame, buckets: int, shingle: int, percent: int, chunk_words: int) -> DataFrame:
    """Packed prefix elements of all (doc_id, text)."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = _chunk_rows(chunk, *(np.concatenate(x) for x in zip(*held)), buckets, percent)
            for k in range(0, len(rows), 64):
                yield _batch(rows[k:k + 64])
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, s, n in shingle_sets(b.column(1), shingle):
                held.append((s, n, ids[i:j]))
                size += len(s) + j - i
                if size >= chunk_words:
                    yield from flush()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from flush()
    return docs.mapInArrow(run, _ROW)


def shared_elements(rows: DataFrame) -> DataFrame:
    """Headers, and for each chunk the documents of its elements that another chunk has (once per element)."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            keys = np.concatenate([x for _, _, x, _ in held])
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            hit = np.zeros(len(keys), bool)
            hit[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] = True
            at = 0
            for chunk, kind, x, docs in held:
                mine = hit[at:at + len(x)]
                at += len(x)
                if kind == ASK and mine.any():
                    yield _batch([(bucket, HITS, chunk, _deltas(_undeltas(docs)[mine]))])

        for b in batches:
            for k, kind, chunk, data in zip(*(b.column(n).to_pylist() for n in range(4))):
                if k != bucket:
                    yield from finish()
                    bucket, held = k, []
                if kind == HEADER:
                    yield _batch([(k, kind, chunk, data)])
                else:
                    m = int.from_bytes(data[:8], "little")
                    held.append((chunk, kind, np.frombuffer(data, "<u4", m, 8), data[8 + 4 * m:]))
        yield from finish()
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROW)


def sized_documents(found: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, possible) of every document: size and keys of its set, and whether it may have links."""
    def regroup(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.loc[pdf["kind"] == HEADER, "data"].iat[0]
        m = int.from_bytes(head[:8], "little")
        ids, n = np.frombuffer(head, "<i8", m, 8), np.frombuffer(head, "<i8", m, 8 + 8 * m)
        keys, hits = np.frombuffer(head, "<i8", 2 * m, 8 + 16 * m).reshape(m, 2), np.frombuffer(head, "<i8", m, 8 + 32 * m).copy()
        for data in pdf.loc[pdf["kind"] == HITS, "data"]:
            hits += np.bincount(_undeltas(data), minlength=m)
        enough = (n > 0) & (hits >= shared_prefix(least_overlap(n, percent)))
        return pd.DataFrame({"doc_id": ids, "n": n, "k1": keys[:, 0], "k2": keys[:, 1], "possible": enough})
    return found.select("chunk", "kind", "data").groupBy("chunk").applyInPandas(regroup, "doc_id long, n long, k1 long, k2 long, possible boolean")


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the elements' hashes, as unsigned 64-bit words."""
    on = np.zeros(bits, bool)
    on[(mix(s + _TWO) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view("<u8")


def class_sets(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(rep, k1, k2, n, band, s, bits, bits_below) of every possible class, read again from its representative's text."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            for i, j, s, n in shingle_sets(b.column(1), shingle):
                keys, ends, band = set_keys(s, n), np.cumsum(n), bands(n, percent)
                mine = np.flatnonzero((keys[:, 0] == k1[i:j]) & (keys[:, 1] == k2[i:j]) & (n > 0))  # a doc_id may have other texts
                if not mine.size:
                    continue
                part = [s[ends[r] - n[r]:ends[r]] for r in mine.tolist()]
                own = [bitmap(x, band_bits(k, percent)).tobytes() for x, k in zip(part, band[mine].tolist())]
                below = [bitmap(x, band_bits(max(k - 1, 0), percent)).tobytes() for x, k in zip(part, band[mine].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][mine]), pa.array(keys[mine, 0]), pa.array(keys[mine, 1]), pa.array(n[mine]), pa.array(band[mine], pa.int32()),
                     pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64())), pa.array(own, pa.binary()), pa.array(below, pa.binary())],
                    ["rep", "k1", "k2", "n", "band", "s", "bits", "bits_below"])
    some = docs.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), "doc_id").select("doc_id", "text", "k1", "k2")
    return some.mapInArrow(run, "rep long, k1 long, k2 long, n long, band int, s array<long>, bits binary, bits_below binary")


def prefix_entries(sets: DataFrame, percent: int) -> DataFrame:
    """(s, band, rep, k1, k2, n, central): rarest elements of every set, without those that no other set has."""
    every = sets.select("rep", "k1", "k2", "n", "band", F.explode("s").alias("s"))
    held = every.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = Window.partitionBy("rep", "k1", "k2")  # at most the elements of one text
    ranked = every.join(held, "s").withColumn("place", F.dense_rank().over(mine.orderBy("df", "s")))
    ranked = ranked.withColumn("shared", F.max("place").over(mine)).withColumn("central", F.sum("df").over(mine) / F.col("n"))
    # n - shared elements that it alone has come first
    least = F.ceil(F.col("n") * percent / 100)
    return ranked.where(F.col("place") <= F.col("shared") - least + 1).select("s", "band", "rep", "k1", "k2", "n", "central")


def tile_rows(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Entries with their component, in their own tile (side 0) and in that of the band below (side 1)."""
    if comps is None:
        named = entries.withColumn("comp", F.col("rep"))
    else:
        named = entries.join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    both = F.explode(F.sequence(F.lit(0), F.when(F.col("band") > 0, 1).otherwise(0)))
    return named.withColumn("side", both).withColumn("band", F.col("band") - F.col("side"))


def central_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): the most central set of a tile with the most central one of every other component, two for each b at most."""
    rank = F.struct("central", "rep")
    top = rows.groupBy("s", "band").agg(F.max(F.struct("central", "rep", "comp")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .where("lo != hi").select("s", "band", F.col("c.rep").alias("a"), F.col("c.comp").alias("own"), F.col("c.central").alias("weight"))
    other = rows.join(top, ["s", "band"]).where("comp != own").groupBy("s", "band", "comp").agg(F.max(rank).alias("m"), F.first("a").alias("a"), F.first("weight").alias("weight"))
    each = other.groupBy(F.col("m.rep").alias("b")).agg(F.array_distinct(F.array(F.max_by("a", F.struct("weight", "a")), F.min("a"))).alias("a"))
    return each.select(F.explode("a").alias("a"), "b").where("a != b")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those pairs of representatives that have linked sets; bit counts first, then sorted arrays."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x, y = (b.column(c).to_numpy() for c in (2, 3))
                need = least_of_pair(x, y, percent)
                keep = []
                for r, o in enumerate(need.tolist()):
                    u, v = (b.column(c)[r].values.to_numpy().view(np.uint64) for c in (4, 5))
                    if min(len(u), len(v)) >= o and common(u, v) >= o:
                        keep.append(r)
                yield b.select([0, 1]).take(pa.array(keep, pa.int64()))
    one = lambda p: sets.select(F.col("rep").alias(p), F.col("n").alias(f"n_{p}"), F.col("s").alias(f"s_{p}"))
    near = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(near).select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def least_of_pair(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap o of sizes x and y with 100 * o >= percent * (x + y - o)."""
    return -(-percent * (x + y) // (100 + percent))


def common(u: np.ndarray, v: np.ndarray) -> int:
    """Elements that two sorted arrays of distinct numbers share."""
    if len(u) > len(v):
        u, v = v, u
    at = np.searchsorted(v, u)
    return int((v[np.minimum(at, len(v) - 1)] == u).sum()) if len(v) else 0


def tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of different components whose sizes and bitmaps allow a link; rows come sorted by tile."""
    def compare(t: np.ndarray, side: np.ndarray, block: np.ndarray, n: np.ndarray, rep: np.ndarray, comp: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        end = np.searchsorted(t, t, side="right")  # of each row's tile
        step = max(1, PAIRS // max(1, words.shape[1]))
        lag, live = 1, np.arange(len(t))
        while (live := live[live + lag < end[live]]).size:
            for k in range(0, len(live), step):
                i = live[k:k + step]
                j = i + lag
                ok = ((side[i] == 0) | (side[j] == 0)) & (comp[i] != comp[j]) & ((block[i] != block[j]) | (block[i] < 0)) \
                    & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
                i, j = i[ok], j[ok]
                if not i.size:
                    continue
                x, y = words[i], words[j]
                most = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                ok = most >= least_of_pair(n[i], n[j], percent)
                a, b = rep[i[ok]], rep[j[ok]]
                if a.size:
                    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])
            lag += 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rest.append(b)
            if sum(x.num_rows for x in rest) < 4 * TILE:
                continue
            whole = pa.Table.from_batches(rest).combine_chunks()
            t = whole.column("tile").to_numpy()
            last = int(np.flatnonzero(np.diff(t))[-1]) + 1 if (t != t[-1]).any() else 0  # the last tile may go on
            if last:
                yield from parts(whole.slice(0, last))
                rest = whole.slice(last).to_batches()
        if rest:
            yield from parts(pa.Table.from_batches(rest).combine_chunks())

    def parts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        band = rows.column("band").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)]
        for lo, hi in zip(cut, cut[1:]):  # bitmaps of one band have one width
            part = rows.slice(lo, hi - lo)
            raw = b"".join(part.column("bits").to_pylist())
            words = np.frombuffer(raw, "<u8").reshape(hi - lo, -1)
            yield from compare(*(part.column(c).to_numpy() for c in ("tile", "side", "block", "n", "rep", "comp")), words)
    return tiles.mapInArrow(run, "a long, b long").distinct()


def open_tiles(rows: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """Rows of all tiles that still hold several components, sorted by tile: a large tile as all pairs of its blocks."""
    size = rows.groupBy("s", "band").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("side").alias("least")) \
        .where("lo != hi and least = 0").select("s", "band", F.ceil(F.col("m") / tile).cast("int").alias("g"))
    q = F.pmod(F.xxhash64("rep", "k1", "k2"), F.col("g")).cast("int")
    cut = rows.join(size, ["s", "band"]).withColumn("q", q).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cut = cut.select("s", "band", F.least("q", "o").alias("i"), F.greatest("q", "o").alias("j"), F.when(F.col("q") == F.col("o"), -1).otherwise(F.col("q")).alias("block"),
                     "side", "n", "rep", "k1", "k2", "comp")
    bits = sets.select("rep", "k1", "k2", "bits", "bits_below")
    full = cut.join(bits, ["rep", "k1", "k2"]).withColumn("bits", F.when(F.col("side") == 0, F.col("bits")).otherwise(F.col("bits_below")))
    full = full.withColumn("tile", F.xxhash64("s", "band", "i", "j"))
    n = partitions(rows.sparkSession)
    return full.select("tile", "band", "side", "block", "n", "rep", "comp", "bits").repartition(n, "band", "tile").sortWithinPartitions("band", "tile", "n", "rep")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, chunk_words: int = CHUNK_WORDS, tile: int = TILE,
                       bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = table.where("doc_id is not null")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), math.ceil(size / 6 * 0.4 / bucket_entries))  # a word and its space: six bytes or so
    rows = prefix_rows(some, buckets, shingle, percent, chunk_words)
    sized = stored(sized_documents(shared_elements(rows), percent), "sized-documents")
    classes = stored(sized.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("possible").alias("possible")), "classes")
    sets = stored(class_sets(some, classes.where("possible"), shingle, percent), "class-sets")
    entries = stored(prefix_entries(sets, percent), "prefix-entries")
    links = comps = None
    for _ in range(ROUNDS):
        found = linked_pairs(central_pairs(tile_rows(entries, comps)), sets, percent)
        links = stored(found if links is None else links.unionByName(found), "links")
        comps = components(links)
    more = tile_pairs(open_tiles(stored(tile_rows(entries, comps), "tile-rows"), sets, tile), percent)
    links = links.unionByName(linked_pairs(more, sets, percent))
    # rows that repeat a doc_id link their classes
    named = sized.where("n > 0").join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"]).select("doc_id", "rep").distinct()
    again = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("doc_id", "a")
    links = links.unionByName(named.join(again, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")))
    roots = components(links)
    own = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("n", "k1", "k2", F.coalesce("root", "rep").alias("component_id"))
    out = sized.join(own, ["n", "k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(sizes_only(table.where("doc_id is null"), shingle))


def sizes_only(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, null) of rows that take no part."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, n in shingle_sets(b.column(1), shingle):
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), none], ["doc_id", "n_shingles", "component_id"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, component_id long")
