"""Operator 9: benchmark decontamination by pigeonhole edit matching.

Text and items are lower-cased and runs of white space become one space.  An
item of n characters may be matched with up to k = floor(error_rate * n)
edits (one at least).  It is split into k + 1 pieces; k edits leave one piece
untouched, so every match contains an exact piece hit.  One Aho-Corasick pass
over a text finds all piece hits of all items; around each hit the text that
could hold the item is verified with Myers' bit-parallel algorithm
(semi-global: the item anywhere in the window), whose bit vectors are
Python integers as long as the item.

Items are the stated query set: they are taken in blocks of bounded size, one
scan of the documents per block (a benchmark of a few thousand items is one
block); a block is what a task holds.  Documents are scanned where they lie;
nothing is shuffled.

Items shorter than ``min_item`` characters after normalisation would match
ordinary prose within a word or with an edit: they get floor(error_rate * n)
edits (none under 13 characters) and a match must begin and end at the edge
of a word.  In scripts written without spaces every letter is such an edge.

Edge cases: null or blank items and texts match nothing; repeated item rows give one result each per item_id, the
least distance; repeated documents give a row each; rows with null ids are
compared like others; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import broadcast, free
from .worker import held, tidy

ERROR_RATE, MIN_ITEM, BLOCK_CHARS = 0.08, 24, 8 << 20
#: Thai to Myanmar, Khmer, kana, Han: no spaces between words
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
            (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def joins(c: str) -> bool:
    """Is ``c`` a letter, digit or mark of a script that parts words?"""
    if not (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"):
        return False
    return not any(a <= ord(c) <= b for a, b in UNSPACED)


def at_edge(text: str, i: int) -> bool:
    return not 0 < i < len(text) or not (joins(text[i - 1]) and joins(text[i]))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_distance(text: str, at: int, item: str, k: int) -> int | None:
    """Least distance up to k between the item and a stretch of whole words that begins at most k before or after ``at``."""
    best = None
    for a in range(max(0, at - k), at + k + 1):
        if at_edge(text, a):
            for b in range(max(a, a + len(item) - k), min(len(text), a + len(item) + k) + 1):
                if at_edge(text, b):
                    d = 0 if text[a:b] == item else edit_distance(item, text[a:b]) if k else k + 1
                    if d <= k and (best is None or d < best):
                        best = d
    return best


def edit_budget(n: int, rate: float = ERROR_RATE) -> int:
    return max(1, int(n * rate))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers(peq: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between the item behind ``peq`` (m characters) and any substring of ``text``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = ph << 1 & full
        pv = (mh << 1 & full) | (~(xv | ph) & full)
        mv = ph & xv
    return best


class Matcher:
    """All items of a block, ready to search texts."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, min_item: int):
        import ahocorasick
        self.min_item = min_item
        self.items: list[tuple[object, str, int, dict[str, int]]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            item = normalised(raw)
            if not item:
                continue
            k = edit_budget(len(item), error_rate) if len(item) >= min_item else int(len(item) * error_rate)
            for off, piece in pieces(item, k):
                at.setdefault(piece, []).append((len(self.items), off))
            self.items.append((item_id, item, k, masks(item)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int]]:
        """(item_id, distance) of every item within its budget."""
        if not self.items or not text:
            return []
        norm = normalised(text)
        best: dict[object, int] = {}
        windows: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.automaton.iter(norm):
            for i, off in where:
                item_id, item, k, peq = self.items[i]
                a = end + 1 - n - off - k  # text that the whole item can take, with k insertions
                b = a + len(item) + 2 * k
                if len(item) < self.min_item:  # whole words only, beside each hit
                    if best.get(item_id) != 0 and (not k or myers(peq, len(item), norm[max(0, a):b]) <= k):
                        d = word_distance(norm, a + k, item, k)
                        if d is not None:
                            best[item_id] = min(d, best.get(item_id, d))
                    continue
                spans = windows.setdefault(i, [])
                if spans and a <= spans[-1][1] and a >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        for i, spans in windows.items():
            item_id, item, k, peq = self.items[i]
            low = k + 1
            for a, b in spans:
                low = min(low, myers(peq, len(item), norm[max(0, a):b]))
                if not low:
                    break
            if low <= k:
                best[item_id] = min(low, best.get(item_id, low))
        return list(best.items())


def _blocks(benchmark: DataFrame, id_col: str, block_chars: int) -> list[DataFrame]:
    """Items dealt by hash into parts of about ``block_chars`` characters."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    many = max(1, -(-total // block_chars))
    if many == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64(F.col(id_col), F.col("text")), F.lit(many)) == k) for k in range(many)]


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_item: int = MIN_ITEM,
                       block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance): one row per document row and item that it holds within the edit budget."""
    out = None
    for block in _blocks(benchmark, "item_id", block_chars):
        items = [(r["item_id"], r["text"]) for r in block.select("item_id", "text").collect()]  # about block_chars characters
        sent, token = broadcast(docs.sparkSession, items), uuid.uuid4().hex

        @tidy
        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            matcher = held(("matcher", token), lambda: Matcher(sent.value, error_rate, min_item))
            for b in batches:
                rows = [(d, i, n) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for i, n in matcher.find(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.int32())], ["doc_id", "item_id", "distance"])
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
            .mapInArrow(run, "doc_id long, item_id long, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_item: int = MIN_ITEM,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns, no shuffle."""
    out = docs
    for block in _blocks(benchmark, "item_id", block_chars):
        items = [(r["item_id"], r["text"]) for r in block.select("item_id", "text").collect()]
        sent, token = broadcast(docs.sparkSession, items), uuid.uuid4().hex
        (name,) = free(out.columns, "scanned_text")

        @tidy
        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            matcher = held(("matcher", token), lambda: Matcher(sent.value, error_rate, min_item))
            for b in batches:
                keep = pa.array([not matcher.find(t.as_py()) for t in b.column(b.num_columns - 1)], pa.bool_())
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(keep)
        out = out.withColumn(name, F.col("text").cast("string")).mapInArrow(run, out.schema)
    return out
