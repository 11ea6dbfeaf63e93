"""Operator 2: language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public: all lower-case pieces of a sentencepiece
file, and every single byte, so that any word has a segmentation.  For each language, piece probabilities are the add-alpha
shares of the pieces' occurrences in that language's training texts (all
segmentations alike).  The probability of a word is the sum over all its
segmentations of the product of its pieces' probabilities, by the forward
algorithm; a text's log-likelihood is the sum over its words.  The language
with the highest one is predicted; the score is its share among all
languages (softmax).

Words are runs of letters in lower case (ASCII rules) with a leading space,
so digits, marks and white space say nothing.  Each task works on its
distinct words: training counts a word's pieces once, times its frequency;
scoring keeps the log-probabilities of words it has met in a bounded memo.
The forward algorithm runs over many words at once in numpy, with a ring of
one state more than the longest piece has bytes, whatever the length of a
word.  Pieces are found by 64-bit keys: their bytes, or a hash of them beyond
eight (no two pieces share a key).

Shuffled: one row per (language, piece) and task.  Sent to the tasks: the
table of probabilities, languages x pieces (about 30,000), independent of
the corpus.

Edge cases: a null text or one without any letter gets ``und`` and score 0;
without training rows every text is ``und``; ties go to the language name
that sorts first; null languages are not learned; an empty table gives no
rows; repeated rows and null doc_ids are rows like others; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import broadcast, free
from .words import Memo, grown, hash_words, mix, text_slices, word_bounds
from .worker import held, tidy

ALPHA = 0.5
MEMO_ROWS = 1 << 20
MIN_SCORE = 0.5
UND = "und"

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
NON_LETTER = np.array([not (chr(b).isascii() and chr(b).isalpha() or b >= 0x80) for b in range(256)])
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def long_keys(first: np.ndarray, n: int, later) -> np.ndarray:
    """Keys of n > 8 bytes: ``first`` are the first eight, ``later(k)`` the eight from byte k on."""
    h = mix(first + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))
    for k in range(8, n, 8):
        h = mix(h ^ (later(k) & _LOW[min(8, n - k)]))
    return h


def piece_key(raw: bytes) -> int:
    if len(raw) <= 8:
        return int.from_bytes(raw, "little")
    eight = lambda k: np.array([int.from_bytes(raw[k:k + 8], "little")], np.uint64)
    return int(long_keys(eight(0), len(raw), eight)[0])


class Pieces:
    """The vocabulary as a hash table from keys to piece numbers."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(1, 256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                raw = sp.id_to_piece(i).replace("▁", " ").encode()
                if raw and raw == raw.lower():
                    found.add(raw)
        self.pieces = sorted(found)
        self.n = len(self.pieces)
        self.lengths = sorted({len(x) for x in self.pieces})
        self.bits = 18
        self.key = np.zeros((1 << self.bits) + 64, np.uint64)
        self.number = np.full(len(self.key), self.n, np.int32)  # n: no piece
        self.probes = 1
        keys = np.array([piece_key(p) for p in self.pieces], np.uint64)
        if len(np.unique(keys)) < self.n:
            raise ValueError("two pieces share a key")
        for k, (key, slot) in enumerate(zip(keys.tolist(), (mix(keys) >> np.uint64(64 - self.bits)).tolist())):
            at = slot
            while self.key[at]:
                at += 1
            self.key[at], self.number[at] = key, k
            self.probes = max(self.probes, at - slot + 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = mix(keys) >> np.uint64(64 - self.bits)
        here = self.key[slot]
        out = np.where(here == keys, self.number[slot], np.int32(self.n))
        left = np.flatnonzero((here != keys) & (here != 0))
        for k in range(1, self.probes):
            if not left.size:
                break
            s, want = slot[left] + np.uint64(k), keys[left]
            here = self.key[s]
            hit = here == want
            out[left[hit]] = self.number[s[hit]]
            left = left[~hit & (here != 0)]
        return out


class WordTable:
    """Distinct words by falling length, each with a leading space, ready for eight-byte reads at any place."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.order = np.argsort(starts - ends, kind="stable")
        size = (ends - starts)[self.order] + 1
        self.size = size
        self.at = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()) + 16, np.uint8)
        total = int(size.sum())
        src = np.repeat(starts[self.order] - 1 - self.at, size) + np.arange(total)
        flat[:total] = buf[np.maximum(src, 0)]
        flat[self.at] = 0x20
        self.eight = np.ndarray((len(flat) - 7,), "<u8", buffer=flat, strides=(1,))
        self.flat = flat
        self.longest = int(size[0]) if len(size) else 0

    def longer(self, n: int) -> int:
        """Words of at least ``n`` bytes: they come first."""
        return int(np.searchsorted(-self.size, -n, side="right"))

    def steps(self, lengths: list[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(place, piece length, words, keys) of all substrings of these lengths; the length 1 is one of them."""
        for i in range(self.longest):
            at = self.at[:self.longer(i + 1)] + i
            v = self.eight[at]
            for k in lengths:
                n = self.longer(i + k)
                if not n:
                    break
                yield i, k, n, v[:n] & _LOW[k] if k <= 8 else long_keys(v[:n], k, lambda b: self.eight[at[:n] + b])


def forward(pieces: Pieces, p: np.ndarray, words: WordTable) -> np.ndarray:
    """log P(word | language) of every word, in the order of ``WordTable.order``; p is (pieces + 1) x languages."""
    n, langs = len(words.size), p.shape[1]
    width = min(pieces.lengths[-1], max(words.longest, 1)) + 1
    ring = np.zeros((width, n, langs))
    ring[0] = 1.0
    scale = np.zeros((n, 1))
    out = np.empty((n, langs))

    def leave(i: int) -> None:
        """All pieces from place i on are done."""
        ring[i % width] = 0.0  # free for place i + width
        a, b = words.longer(i + 2), words.longer(i + 1)
        if b > a:  # words that end at place i + 1
            out[a:b] = np.log(ring[(i + 1) % width, a:b]) + scale[a:b]
    place = 0
    for i, k, m, keys in words.steps(pieces.lengths):
        if i != place:
            leave(place)
            place = i
            if i % 16 == 0:  # long words: keep the numbers in range
                live = ring[:, :m]
                top = live.max(axis=(0, 2))[:, None]
                live /= top
                scale[:m] += np.log(top)
        ring[(i + k) % width, :m] += ring[i % width, :m] * p[pieces.find(keys)]
    if n:
        leave(place)
    return out


def _words(buf: np.ndarray, off: np.ndarray):
    low = LOWER[buf]
    starts, ends, ptr = word_bounds(low, off, NON_LETTER)
    return low, starts, ends, ptr, hash_words(low, starts, ends)


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(lang, piece, n): occurrences of every piece in the texts of every language."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held(("pieces", path), lambda: Pieces(path))
        names: dict[str, int] = {}
        total: list[np.ndarray] = []
        memo = Memo(20)
        count = np.zeros((1 << 16, 8), np.int64)
        kept: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def count_pieces() -> None:
            nonlocal memo, count, kept, sizes
            while len(total) < len(names):
                total.append(np.zeros(vocab.n + 1))
            if memo.rows:
                flat, size = np.concatenate(kept), np.concatenate(sizes)
                ends = np.cumsum(size)
                table = WordTable(flat, ends - size, ends)
                weight = count[:memo.rows][table.order]
                for _, _, m, keys in table.steps(vocab.lengths):
                    number = vocab.find(keys)
                    for c in range(len(names)):
                        total[c] += np.bincount(number, weights=weight[:m, c], minlength=vocab.n + 1)
            memo, kept, sizes = Memo(20), [], []
            count[:] = 0

        for b in batches:
            lang = b.column(1).to_pylist()
            for i, j, buf, off in text_slices(b.column(0)):
                for x in lang[i:j]:
                    names.setdefault(x, len(names))
                if len(names) > count.shape[1]:
                    count = np.concatenate([count, np.zeros_like(count)], axis=1)
                of_row = np.array([names[x] for x in lang[i:j]])
                low, starts, ends, ptr, h = _words(buf, off)
                if not len(h):
                    continue
                keys, first, back = np.unique(h, return_index=True, return_inverse=True)
                per = np.bincount(back * len(names) + np.repeat(of_row, np.diff(ptr)), minlength=len(keys) * len(names)).reshape(len(keys), -1)
                row = memo.find(keys)
                new = np.flatnonzero(row < 0)
                if new.size:
                    s, e = starts[first[new]], ends[first[new]]
                    row[new] = memo.add(keys[new])
                    size = e - s
                    upto = np.cumsum(size)
                    kept.append(low[np.repeat(s - (upto - size), size) + np.arange(int(upto[-1]))])
                    sizes.append(size)
                    while memo.rows > len(count):
                        count = np.concatenate([count, np.zeros_like(count)])
                count[row, :per.shape[1]] += per
                if memo.rows > 400_000:
                    count_pieces()
        count_pieces()
        for x, c in names.items():
            at = np.flatnonzero(total[c][:vocab.n])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(total[c][at].astype(np.int64))], ["lang", "piece", "n"])
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Languages and piece probabilities; small enough to travel with the tasks."""

    def __init__(self, langs: list[str], p: np.ndarray, path: str):
        self.langs, self.p, self.path = langs, p, path
        self.key = hash((path, tuple(langs), p.tobytes()))


def train(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> Model:
    """Learn from (text, lang); rows without a language are left out."""
    path = path or default_vocabulary()
    n_pieces = Pieces(path).n
    rows = piece_counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), path).toPandas()  # languages x pieces
    langs = sorted(rows["lang"].unique().tolist())
    p = np.zeros((n_pieces + 1, len(langs)))
    for c, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        n = np.full(n_pieces, alpha)
        n[mine["piece"].to_numpy()] += mine["n"].to_numpy()
        p[:n_pieces, c] = n / n.sum()
    return Model(langs, p, path)


class Scorer:
    """Word log-probabilities of one model, memoised in a worker."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.path)
        self.memo = Memo(21)
        self.logp = np.zeros((1 << 16, len(model.langs)), np.float32)

    def predict(self, col: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i, j, buf, off in text_slices(col):
            low, starts, ends, ptr, h = _words(buf, off)
            total = np.zeros((j - i, len(self.model.langs)))
            if len(h):
                if self.memo.rows > MEMO_ROWS:
                    self.memo.clear()
                row = self.memo.find(h)
                new = np.flatnonzero(row < 0)
                if new.size:
                    keys, first, back = np.unique(h[new], return_index=True, return_inverse=True)
                    at = new[first]
                    rows = self.memo.add(keys)
                    self.logp = grown(self.logp, self.memo.rows)
                    for k in range(0, len(at), 1 << 14):
                        part = at[k:k + (1 << 14)]
                        table = WordTable(low, starts[part], ends[part])
                        self.logp[rows[k:k + (1 << 14)][table.order]] = forward(self.pieces, self.model.p, table)
                    row[new] = rows[back]
                some = np.flatnonzero(np.diff(ptr))
                total[some] = np.add.reduceat(self.logp[row].astype(np.float64), ptr[:-1][some], axis=0)
            letters = np.zeros(j - i, bool)
            has = np.concatenate([[0], np.cumsum((low[:int(off[-1])] >= 97) & (low[:int(off[-1])] <= 122))])
            letters = has[off[1:]] > has[off[:-1]]
            for r in np.flatnonzero(~letters).tolist():
                letters[r] = any(c.isalpha() for c in buf[off[r]:off[r + 1]].tobytes().decode())
            best = total.argmax(axis=1)
            share = 1.0 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
            for r in range(j - i):
                names.append(self.model.langs[best[r]] if letters[r] else UND)
                scores.append(float(share[r]) if letters[r] else 0.0)
        return names, scores


def predict(docs: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with a predicted language and its score, from the text alone."""
    if not model.langs:
        return docs.withColumn(lang_col, F.lit(UND)).withColumn(score_col, F.lit(0.0))
    (name,) = free(docs.columns, "langid_text")
    sent = broadcast(docs.sparkSession, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("language", sent.value.key), lambda: Scorer(sent.value))
        for b in batches:
            lang, score = scorer.predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*b.schema.names[:-1], lang_col, score_col])
    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Is crc32(doc_id as text) mod ``folds`` equal to ``fold``?  A null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def accepted(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows whose language is identified: not ``und``, with a score of at least ``min_score``; the columns of ``docs``."""
    lang, score = free(docs.columns, "langid_lang", "langid_score")
    return predict(docs, model, lang, score).where((F.col(lang) != UND) & (F.col(score) >= min_score)).drop(lang, score)
