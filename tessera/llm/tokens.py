"""Token ids of whole texts with a public tokenizer file, memoised per distinct word inside each Python worker.

The vocabulary file drops white space and never joins characters across it,
so the ids of a text are the ids of its ASCII-white-space-separated words in
a row (``tests/llm`` checks this against ``Tokenizer.encode`` on whole
texts).  A worker therefore asks the tokenizers library once per distinct
word it meets and looks the rest up.  The memo is bounded; when it is full
it starts again.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from .words import Memo, grown, hash_words, text_slices, word_bounds
from .worker import held

END_ID = 1
MEMO_WORDS, POOL_IDS = 1 << 20, 4 << 20  # words and ids kept by the memo: some 40 MB
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BYTE_CHARS: list[str] = []


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """Characters by which the byte-level pre-tokenizer writes the 256 bytes: printable ones as they are, others from U+0100 on."""
    if not _BYTE_CHARS:
        keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(0x100, 0x200))
        _BYTE_CHARS.extend(chr(b) if b in keep else chr(next(others)) for b in range(256))
    return _BYTE_CHARS


class WordIds:
    """ids of words; one object per worker and tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.memo = Memo(21)
        self.marks: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        self.memo.clear()
        self.pool = np.empty(1 << 20, self.dtype)
        self.used = 0
        self.at = np.empty(1 << 18, np.int64)
        self.n = np.empty(1 << 18, np.int32)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word without ASCII white space.

        A run of Latin letters is one pre-token, in lower case, and so is a
        run of closing marks; such words need no pattern matching.  All others
        go through the whole tokenizer.
        """
        text = word.decode()
        body = text.rstrip(_MARKS)
        if body.isalpha() and (body.isascii() or max(body) < "\u0250" and unicodedata.is_normalized("NFC", body)):
            low = body.lower()
            if not low.isascii():
                if not low.isalpha():  # a letter whose lower case has a combining mark
                    return self.tok.encode(text, add_special_tokens=False).ids
                chars = _byte_chars()
                low = "".join([chars[b] for b in low.encode()])
            ids = [t.id for t in self.model.tokenize(low)]
            if len(body) < len(text):
                mark = text[len(body):]
                if mark not in self.marks:
                    if len(self.marks) > 1 << 16:
                        self.marks.clear()
                    self.marks[mark] = [t.id for t in self.model.tokenize(mark)]
                ids += self.marks[mark]
            return ids
        return self.tok.encode(text, add_special_tokens=False).ids

    def _store(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Rows of new words in the pool."""
        found = [self.encode_word(w) for w in words]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), self.dtype, int(size.sum()))
        row = self.memo.add(keys)
        self.pool = grown(self.pool, self.used + len(flat))
        self.at, self.n = grown(self.at, self.memo.rows), grown(self.n, self.memo.rows)
        self.pool[self.used:self.used + len(flat)] = flat
        self.at[row] = self.used + np.cumsum(size) - size
        self.n[row] = size
        self.used += len(flat)
        return row

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        if self.used > POOL_IDS or self.memo.rows > MEMO_WORDS:
            self._reset()
        h = hash_words(buf, starts, ends)
        row = self.memo.find(h)
        new = np.flatnonzero(row < 0)
        if new.size:
            keys, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            raw = buf.tobytes()
            rows = self._store(keys, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            row[new] = rows[back]
        n = self.n[row].astype(np.int64)
        ends_at = np.cumsum(n)
        total = int(ends_at[-1]) if n.size else 0
        where = np.repeat(self.at[row] - (ends_at - n), n) + np.arange(total)
        return self.pool[where], n


def worker_ids(path: str) -> WordIds:
    return held(("ids", path), lambda: WordIds(path))


def batch_ids(col: pa.Array, path: str, end_id: int = END_ID):
    """Yield (first row, end row, ids uint32, row offsets): the end id closes every row's ids."""
    coder = worker_ids(path)
    for i, j, buf, off in text_slices(col):
        starts, ends, ptr = word_bounds(buf, off)
        ids, n = coder.ids(buf, starts, ends)
        upto = np.concatenate([[0], np.cumsum(n)])[ptr]  # ids before each row
        rows = j - i
        out = np.empty(len(ids) + rows, np.uint32)
        last = upto[1:] + np.arange(rows)  # places of the end ids
        keep = np.ones(len(out), bool)
        keep[last] = False
        out[keep] = ids
        out[last] = end_id
        yield i, j, out, upto + np.arange(rows + 1)
