"""Operator 11 against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard, jobs
from .helpers import AWKWARD, WORDS, documents

SF = "/root/testdata/sf0.001"


def plain_set(text, shingle=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return {" ".join(w[k:k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {" ".join(w)} if w else set()


def plain_join(rows, percent=80):
    """rows: (doc_id, text) -> sorted (doc_id, size, component)."""
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, s in sets if i is not None and s}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    some = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, x) in enumerate(some):
        for j, y in some[:n]:
            if 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), i if i is not None and not s else find(i) if i is not None else None) for i, s in sets), key=repr)


def joined(spark, rows, **kw):
    return sorted((tuple(r) for r in jaccard.jaccard_components(documents(spark, rows), **kw).collect()), key=repr)


def test_jaccard_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in jobs.op11_jaccard_join(spark, SF).collect()), key=repr) == plain_join(rows)


def near_copies(seed):
    """Chains of edits around the threshold, copies, templates with a unique rest, boilerplate, and texts of a few words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    rows, plate = [], [word() for _ in range(60)]
    for _ in range(12):
        text = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.randint(2, 7)):
            rows.append(" ".join(text))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.4:
                text = text + [word() for _ in range(rng.randint(1, 8))]
    family = [word() for _ in range(200)]
    for _ in range(25):
        t = list(family)
        t[rng.randrange(200)] = word()
        rows.append(" ".join(t))
    for _ in range(15):
        rows.append(" ".join(plate + [word() for _ in range(30)]))
    rows += ["a b c d e", "A B C D E", "a b c d e f", "a b c d", "a b c d", "a  b\tc\nd", "one", "One", "two"] + ["x " * k for k in (3, 5, 6, 9, 40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("kw", [{}, {"tile": 3, "chunk_words": 300, "bucket_entries": 500}])
def test_near_copies(spark, kw):
    rows = near_copies(7)
    got = joined(spark, rows, **kw)
    assert got == plain_join(rows)
    assert len({c for *_, c in got}) < len(rows) - 40


def test_awkward_rows(spark):
    rows = [*AWKWARD, (5, "b c d e f g h"), (40, "b c d e f g h"), (41, "no id at all here")]
    assert joined(spark, rows) == plain_join(rows)
    assert joined(spark, []) == []
    assert joined(spark, [(None, "x y")]) == [(None, 1, None)]


def test_bands_keep_linked_sizes_together():
    n = np.arange(1, 5000)
    b = jaccard.bands(n, 80)
    for x in (1, 3, 4, 7, 50, 333, 3999):
        assert (np.abs(b[(100 * n >= 80 * x) & (100 * x >= 80 * n)] - b[x - 1]) <= 1).all()
    assert all(jaccard.band_bits(int(k), 80) >= n[b == k].max() for k in np.unique(b))


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n in (1, 5, 70, 400):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 2 + 1).astype(np.uint64)]))
        band = int(jaccard.bands(np.array([max(len(x), len(y))]), 80)[0])
        u, v = jaccard.bitmap(x, jaccard.band_bits(band, 80)), jaccard.bitmap(y, jaccard.band_bits(band, 80))
        bound = min(len(x) - np.bitwise_count(u & ~v).sum(), len(y) - np.bitwise_count(v & ~u).sum())
        assert bound >= len(np.intersect1d(x, y)) == jaccard.common(x, y)


def test_sizes_count_distinct_shingles():
    texts = ["a b a b a b a b a b", "", None, "x", "a b c d e f"]
    (part,) = jaccard.shingle_sets(pa.array(texts, pa.string()), 5)
    assert part[3].tolist() == [len(plain_set(t)) for t in texts]
