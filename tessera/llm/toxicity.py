"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary text:
n-grams of up to five bytes within `` word `` (a space before and after).  The
highest order has its own counts per class with absolute discounting; what
it discounts goes to lower orders that both classes share, estimated from
continuation counts (in how many contexts an n-gram occurs), so a rare
expression is smoothed alike on both sides and only evidence tells them
apart.  Unlike word counts, letter n-grams know the inflected forms of a stem
they have seen.

The log-likelihood ratio of every word, divided by its length, is compared
over the document: the mean over all its letters, the largest word value and
the (log) number of words with a clear ratio.  A logistic function of these
three is the score.  It is fitted on labelled documents chosen by hash, half
of ``fit_rows`` of each class or all there are, in folds: a fold's documents
are valued by the counts of all labelled rows less those of the fold.

Counts come from all labelled training rows, distributed: tasks count
distinct words, then their n-grams, and send one row per n-gram, which an
aggregation sums.  The model is these sums and the continuation counts they
give, as sorted tables keyed by the n-gram itself (its bytes through a
bijection), so no two n-grams share an entry and the tables grow with the
distinct n-grams of the labelled rows; driver and tasks hold them.

Edge cases: null and empty texts have no words and get the score of an
all-zero document; without training rows of both classes every score is 0;
null or other labels than 0 and 1 are not learned; a doc_id with several
label rows counts once per row; the only document of a class is not taken out
of the counts that value it; repeated rows are rows of their own; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import LOWER, WordTable
from .store import broadcast, free, stored
from .words import NON_WORD, Memo, grown, hash_words, mix, text_slices, word_bounds
from .worker import held, tidy

ORDER = 5
DISCOUNT = 0.75
SLOT_BITS = 64  # fewer would let n-grams share entries
FIT_ROWS, FIT_FOLDS = 20_000, 4
CLEAR = 1.0  # log-likelihood ratio per letter
MEMO_ROWS = 1 << 20
THRESHOLD = 0.7
_WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"

_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - bits)).view(np.int64)


def _grams(table: WordTable) -> Iterator[tuple[int, int, np.ndarray]]:
    """(n-gram length, words, keys): for each place after the first space, the n-gram that ends there.

    Words of a ``WordTable`` begin with a space; one more is taken to end each.
    """
    spaced = table.flat
    for i in range(1, table.longest + 1):
        n = table.longer(i)  # words with a byte, or their closing space, at place i
        size = min(i + 1, ORDER)
        at = table.at[:n] + i - size + 1
        v = np.ndarray((len(spaced) - 7,), "<u8", buffer=spaced, strides=(1,))[at] & _LOW[size]
        closing = np.flatnonzero(table.size[:n] == i)
        v[closing] = (v[closing] & _LOW[size - 1]) | np.uint64(0x20) << np.uint64(8 * (size - 1))
        yield size, n, v


def _slices(col: pa.Array):
    for i, j, buf, off in text_slices(col):
        low = LOWER[buf]
        starts, ends, ptr = word_bounds(low, off, NON_WORD)
        yield i, j, low, starts, ends, ptr, hash_words(low, starts, ends)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(key, size, n0, n1): counts of every n-gram in the ordinary and toxic texts of (text, label)."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def summed() -> tuple[np.ndarray, ...]:
            key, size, n0, n1 = (np.concatenate(x) for x in zip(*found))
            u, first, back = np.unique(key, return_index=True, return_inverse=True)
            return u, size[first], np.bincount(back, weights=n0, minlength=len(u)), np.bincount(back, weights=n1, minlength=len(u))
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, low, starts, ends, ptr, h in _slices(b.column(0)):
                if not len(h):
                    continue
                _, first, back = np.unique(h, return_index=True, return_inverse=True)
                toxic = np.repeat(label[i:j], np.diff(ptr)).astype(np.float64)
                n1 = np.bincount(back, weights=toxic, minlength=len(first))
                n0 = np.bincount(back, minlength=len(first)) - n1
                table = WordTable(low, starts[first], ends[first])
                n0, n1 = n0[table.order], n1[table.order]
                for size, n, keys in _grams(table):
                    u, back = np.unique(keys, return_inverse=True)
                    found.append((u, np.full(len(u), size), np.bincount(back, weights=n0[:n], minlength=len(u)), np.bincount(back, weights=n1[:n], minlength=len(u))))
                    held += len(u)
                if held > 2_000_000:
                    found = [summed()]
                    held = len(found[0][0])
        if found:
            u, size, n0, n1 = summed()
            for k in range(0, len(u), 50_000):
                s = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(u[s].view(np.int64)), pa.array(size[s].astype(np.int32)),
                                                  pa.array(n0[s].astype(np.int64)), pa.array(n1[s].astype(np.int64))], ["key", "size", "n0", "n1"])
    return rows.select("text", "label").mapInArrow(run, "key long, size int, n0 long, n1 long") \
        .groupBy("key", "size").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Table:
    """Sums of some columns by slot: sorted slots and, behind the last, a row of zeros."""

    def __init__(self, slots: np.ndarray, *columns: np.ndarray):
        self.slots, back = np.unique(slots, return_inverse=True)
        self.columns = np.zeros((len(columns), len(self.slots) + 1), np.float32)
        for k, c in enumerate(columns):
            self.columns[k, :-1] = np.bincount(back, weights=c, minlength=len(self.slots))

    def find(self, slots: np.ndarray) -> np.ndarray:
        """Row of each slot; the row of zeros where it has none."""
        n = len(self.slots)
        if not n:
            return np.zeros(np.shape(slots), np.int64)
        at = np.minimum(np.searchsorted(self.slots, slots), n - 1)
        return np.where(self.slots[at] == slots, at, n)

    def __getstate__(self) -> tuple:
        """For sending, compressed."""
        return (self.columns.shape, zlib.compress(np.diff(self.slots, prepend=0).tobytes(), 1), zlib.compress(self.columns.tobytes(), 1))

    def __setstate__(self, state: tuple) -> None:
        self.slots = np.cumsum(np.frombuffer(zlib.decompress(state[1]), np.int64))
        self.columns = np.frombuffer(zlib.decompress(state[2]), np.float32).reshape(state[0])


class _Values:
    """One column of a table by slot."""

    def __init__(self, table: Table, column: int):
        self.table, self.column = table, column

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        return self.table.columns[self.column][self.table.find(slots)]


class Model:
    """Tables of the two models and the fitted weights, from the counts of all distinct n-grams by class."""

    def __init__(self, bits: int, key: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        self.bits = bits
        seen = n0 + n1 > 0
        key, n0, n1 = key[seen], n0[seen], n1[seen]
        self.grams = Table(_slot(key, bits), n0, n1)  # highest order, by class
        self.contexts = Table(_slot(key & _LOW[_sizes(key) - 1], bits), n0, n1, n0 > 0, n1 > 0)  # totals and types
        self.lower: dict[int, Table] = {}  # shared continuation counts
        self.lower_contexts: dict[int, Table] = {}
        for o in range(ORDER - 1, 0, -1):
            # every distinct longer n-gram is one context of its suffix; n-grams cut short by a word's start give their own suffixes
            key, c = np.unique(key[_sizes(key) > 1] >> np.uint64(8), return_counts=True)
            mine = _sizes(key) == o
            self.lower[o] = Table(_slot(key[mine], bits), c[mine])
            self.lower_contexts[o] = Table(_slot(key[mine] & _LOW[o - 1], bits), c[mine], np.ones(int(mine.sum())))
        self.weights = np.zeros(4)
        self.mean, self.std = np.zeros(3), np.ones(3)
        self.ready = bool(n0.any() and n1.any())
        self.key = ""

    @property
    def count(self) -> list[_Values]:
        return [_Values(self.grams, k) for k in (0, 1)]

    @property
    def total(self) -> list[_Values]:
        return [_Values(self.contexts, k) for k in (0, 1)]

    @property
    def types(self) -> list[_Values]:
        return [_Values(self.contexts, k) for k in (2, 3)]

    @property
    def cont(self) -> dict[int, _Values]:
        return {o: _Values(t, 0) for o, t in self.lower.items()}

    @property
    def cont_total(self) -> dict[int, _Values]:
        return {o: _Values(t, 0) for o, t in self.lower_contexts.items()}

    @property
    def cont_types(self) -> dict[int, _Values]:
        return {o: _Values(t, 1) for o, t in self.lower_contexts.items()}


def _sizes(key: np.ndarray) -> np.ndarray:
    """Bytes of every n-gram; none holds a zero byte."""
    return sum((key > _LOW[k]).astype(np.int64) for k in range(ORDER))


def collected(grams: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, n0, n1) of ``gram_counts``, by key."""
    pdf = grams.select("key", "n0", "n1").toPandas()
    key = pdf["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], pdf["n0"].to_numpy(np.int64)[order], pdf["n1"].to_numpy(np.int64)[order]


def train_counts(rows: DataFrame, bits: int = SLOT_BITS) -> Model:
    """Both models from (text, label)."""
    return Model(bits, *collected(gram_counts(rows)))


def word_ratios(m: Model, table: WordTable) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of every word, in table order."""
    out = np.zeros(len(table.size))
    for size, n, keys in _grams(table):
        keys, back = np.unique(keys, return_inverse=True)
        p = np.full(len(keys), 1.0 / 256)
        for o in range(1, size):
            key = keys >> np.uint64(8 * (size - o))  # the last o bytes
            s, c = m.lower[o].find(_slot(key, m.bits)), m.lower_contexts[o].find(_slot(key & _LOW[o - 1], m.bits))
            total, types = m.lower_contexts[o].columns[:, c]
            seen = total > 0
            p = np.where(seen, (np.maximum(m.lower[o].columns[0, s] - DISCOUNT, 0) + DISCOUNT * types * p) / np.where(seen, total, 1), p)
        s, c = m.grams.find(_slot(keys, m.bits)), m.contexts.find(_slot(keys & _LOW[size - 1], m.bits))
        both = []
        for k in (0, 1):
            total = m.contexts.columns[k, c]
            seen = total > 0
            both.append(np.where(seen, (np.maximum(m.grams.columns[k, s] - DISCOUNT, 0) + DISCOUNT * m.contexts.columns[k + 2, c] * p) / np.where(seen, total, 1), p))
        out[:n] += (np.log(both[1]) - np.log(both[0]))[back]
    return out


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, Memo(21)
        self.ratio = np.zeros(1 << 16, np.float32)

    def features(self, col: pa.Array) -> np.ndarray:
        """rows x (mean ratio per letter, largest ratio per letter of a word, log(1 + words with a clear ratio))."""
        out = []
        for i, j, low, starts, ends, ptr, h in _slices(col):
            f = np.zeros((j - i, 3))
            if len(h):
                if self.memo.rows > MEMO_ROWS:
                    self.memo.clear()
                row = self.memo.find(h)
                new = np.flatnonzero(row < 0)
                if new.size:
                    keys, first, back = np.unique(h[new], return_index=True, return_inverse=True)
                    at = new[first]
                    rows = self.memo.add(keys)
                    self.ratio = grown(self.ratio, self.memo.rows)
                    for k in range(0, len(at), 1 << 15):
                        part = at[k:k + (1 << 15)]
                        table = WordTable(low, starts[part], ends[part])
                        self.ratio[rows[k:k + (1 << 15)][table.order]] = word_ratios(self.model, table)
                    row[new] = rows[back]
                ratio = self.ratio[row].astype(np.float64)
                size = (ends - starts + 1).astype(np.float64)
                some = np.flatnonzero(np.diff(ptr))
                at = ptr[:-1][some]
                each = ratio / size
                f[some, 0] = np.add.reduceat(ratio, at) / np.add.reduceat(size, at)
                f[some, 1] = np.maximum.reduceat(each, at)
                f[some, 2] = np.log1p(np.add.reduceat((each > CLEAR).astype(np.float64), at))
            out.append(f)
        return np.concatenate(out) if out else np.zeros((0, 3))


def features(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """``docs`` with the three features under ``names``."""
    from pyspark.sql import types as T
    (text,) = free(docs.columns, "toxicity_text")
    sent = broadcast(docs.sparkSession, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", sent.value.key), lambda: Scorer(sent.value))
        for b in batches:
            f = scorer.features(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(f[:, k]) for k in range(3))], names=[*b.schema.names[:-1], *names])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.DoubleType()) for x in names)])
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (last: intercept) by Newton's method; both classes weigh alike."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        reg = ridge * np.array([1.0] * x.shape[1] + [0.0])
        g = a.T @ (weight * (p - y)) + reg * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(reg + 1e-9)
        w = w - np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, labels: DataFrame, use: Column, bits: int = SLOT_BITS, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from documents (doc_id, text) for which ``use`` holds, marked by labels (doc_id, toxic)."""
    import uuid
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    rows = docs.where(use).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("text is not null").join(known.hint("merge"), "doc_id")  # one plan at every size
    rows = rows.where(F.col("text").rlike(_WORD)).select("text", "label", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    rows = stored(rows, "labelled")
    key, n0, n1 = collected(gram_counts(rows))
    model = Model(bits, key, n0, n1)
    if model.ready:
        names = ["f0", "f1", "f2"]
        fold, alone = _fit_folds(rows, fit_rows)
        chosen = stored(rows.select("text", "label", fold.alias("fold")).where("fold is not null"), "chosen")  # about fit_rows rows
        parts = []
        for f in range(FIT_FOLDS):
            mine = chosen.where(F.col("fold") == f)
            k, a, b = collected(gram_counts(mine.where(~F.col("label").isin(alone))))
            at = np.searchsorted(key, k)
            less0, less1 = n0.copy(), n1.copy()
            less0[at] -= a
            less1[at] -= b
            without = Model(bits, key, less0, less1)
            without.key = uuid.uuid4().hex
            each = features(mine.select("text", "label"), without, names).select("label", *names)
            for label in (0, 1):  # a doc_id with very many rows: no more than fit_rows in all
                parts.append(each.where(F.col("label") == label).limit(fit_rows // 2).toPandas())
        pdf = pd.concat(parts, ignore_index=True)
        x = pdf[names].to_numpy()
        model.mean, model.std = x.mean(0), np.maximum(x.std(0), 1e-9)
        model.weights = fit_logistic((x - model.mean) / model.std, pdf["label"].to_numpy())
    model.key = uuid.uuid4().hex
    return model


def _fit_folds(rows: DataFrame, fit_rows: int) -> tuple[Column, list[int]]:
    """The fold of (label, h), null where it is not chosen, and the labels that only one document has.

    The documents of a class with the smallest hashes are chosen, and dealt in equal numbers to the folds.
    """
    ids = rows.select("label", "h").distinct()
    fold, alone = F.lit(None).cast("int"), []
    for label in (0, 1):
        h = [r["h"] for r in ids.where(F.col("label") == label).orderBy("h").limit(fit_rows // 2).collect()]
        if len(h) == 1:
            alone.append(label)
        for f in reversed(range(FIT_FOLDS)):
            cut = len(h) * (f + 1) // FIT_FOLDS
            if cut:
                fold = F.when((F.col("label") == label) & (F.col("h") <= h[cut - 1]), f).otherwise(fold)
    return fold, alone


def score(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for toxic texts."""
    if not model.ready:
        return docs.withColumn(score_col, F.lit(0.0))
    names = free(docs.columns, "toxicity_mean", "toxicity_top", "toxicity_words")
    out = features(docs, model, names)
    z = sum((F.col(n) - float(m)) / float(s) * float(w) for n, m, s, w in zip(names, model.mean, model.std, model.weights)) + float(model.weights[3])
    return out.withColumn(score_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop(*names)
