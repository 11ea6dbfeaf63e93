"""Operators 4, 5, 7 and 9 against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontam, jobs, simhash, substring, topk
from .helpers import AWKWARD, WORDS, documents, sha

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    grams = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_components(fps):
    """fps: list of (id, fingerprint) -> id -> smallest id reachable."""
    root = {i: i for i, _ in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for n, (i, x) in enumerate(fps):
        for j, y in fps[:n]:
            if bin(x ^ y).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in jobs.op4_simhash(spark, SF).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in fps}


def test_links_find_every_pair_once(spark):
    rng = random.Random(3)
    fps = set()
    while len(fps) < 400:
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def near_rows(n=60):
    """Documents in pairs that differ in one late word of many, and the plain fingerprints."""
    rng = random.Random(11)
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(10_000)}" for _ in range(400)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1] + ["other"]))]
    return rows, [(i, plain_fingerprint(t)) for i, t in rows]


def watch_link_plans(monkeypatch):
    """The plans of the links that ``components`` is given from now on."""
    plans, real = [], simhash.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return real(edges)
    monkeypatch.setattr(simhash, "components", seen)
    return plans


def test_links_are_never_broadcast(spark):
    signed = [x - (1 << 64) if x >> 63 else x for _, x in near_rows()[1]]
    fps = simhash.stored(spark.createDataFrame([(x,) for x in set(signed)], "fp long"), "few-fingerprints")
    found = simhash.links(fps)  # a small file, of which every row explodes into 64
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_stage_broadcasts_no_variants(spark, monkeypatch):
    import corpus_pipeline
    rows, fps = near_rows()
    plans = watch_link_plans(monkeypatch)
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(fps).values()))
    assert len(plans) == 1 and "SortMergeJoin [key#" in plans[0] and "BroadcastHashJoin [key#" not in plans[0]


def test_simhash_query_broadcasts_no_variants(spark, tmp_dir, monkeypatch):
    rows, fps = near_rows(20)
    rows += [(None, "no id"), (500, None), (0, rows[0][1])]
    fps += [(500, 0)]
    documents(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    plans = watch_link_plans(monkeypatch)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in jobs.op4_simhash(spark, tmp_dir).collect()}
    want = plain_components(fps)
    assert got == {(i, f"{x:016x}", want[i]) for i, x in fps} | {(None, f"{plain_fingerprint('no id'):016x}", None)}
    assert len(plans) == 1 and "SortMergeJoin [key#" in plans[0] and "BroadcastHashJoin [key#" not in plans[0]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, k) for k in range(1001, 1400)]
    random.Random(5).shuffle(chain)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 301)) and all(got[k] == 1000 for k in range(1001, 1400))


def test_simhash_edges(spark):
    docs = documents(spark, AWKWARD)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[0] == by[1] == by[2] == {(0, 0)}
    assert {c for _, c in by[4]} == {c for _, c in by[5]} == {4} and {c for _, c in by[8]} == {7}
    assert {c for _, c in by[None]} == {None}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [0, 3, 4, 6, 7, 9]
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def plain_top(rows, k=10):
    out = []
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in ok:
        if i % 100 == 0:
            best = sorted(((-int(q @ x), j) for j, x in ok if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("row_block,query_block", [(4096, 4096), (37, 2)])
def test_top_k_in_blocks(spark, row_block, query_block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(i, rows[i - 400][1]) for i in range(400, 480)]  # ties
    rows += [(500, None), (600, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (None, [0.0] * 8), (701, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("query_id", F.lit(2))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.exact_top_k(df, F.col("vec_id") % 100 == 0, row_block=row_block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == plain_top(as_float)


def test_top_k_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.exact_top_k(few, F.col("vec_id") % 100 == 0).collect())) == [(0, 1, 1, 2097152), (0, 2, 2, 2097152)]


def plain_removal(docs, window=50):
    """docs: (doc_id, text) with distinct ids -> doc_id -> (n_words, n_removed, sha)."""
    words = {i: WORDS.findall(t or "") for i, t in docs}
    first, out = {}, {}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in jobs.op7_substring_dedup(spark, SF).collect()}
    assert got == plain_removal(docs)


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_substring_passages_at_any_place(spark, chunk):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 130)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 5)
            w += p[a:len(p) - rng.randrange(0, 5)] + [word() for _ in range(rng.randrange(0, 40))]
        docs.append((i * 7 % 61, " ".join(w)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(documents(spark, docs), chunk_words=chunk).collect()}
    assert got == plain_removal(docs)


def test_substring_edges(spark):
    got = substring.without_repeats(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[7] == [(30_000, 0)] and by[8] == [(30_000, 30_000)] and by[5] == [(1, 0)] * 2 and by[0] == by[1] == by[2] == [(0, 0)]
    same = [(5, " ".join(f"a{k}" for k in range(60)))] * 2 + [(9, " ".join(f"a{k}" for k in range(60)))] + [(None, " ".join(f"a{k}" for k in range(60)))]
    got = sorted(((r.doc_id or -1, r.n_removed) for r in substring.without_repeats(documents(spark, same)).collect()))
    assert got == [(-1, 0), (5, 0), (5, 0), (9, 60)]
    assert substring.without_repeats(documents(spark, [])).count() == 0


def plain_distance(item, text):
    """Least edit distance of item and any substring of text."""
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(prev[j - 1] + (a != b), prev[j] + 1, row[-1] + 1))
        prev = row
    return min(prev)


def test_myers_equals_the_table():
    rng = random.Random(4)
    for _ in range(200):
        item = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        assert decontam.myers(decontam.masks(item), len(item), text) == plain_distance(item, text)


def test_decontamination_finds_all_within_the_budget(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "x"
    items = [(k, text(rng.randrange(40, 120))) for k in range(8)] + [(90, None), (91, ""), (92, "short"), (3, "a second row with the item id three")]
    docs = [(k, t) for k, (_, t) in enumerate([(0, "plain words only")] * 3)]
    for k in range(60):
        item = list(items[k % 8][1])
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(item))
            item[at:at + rng.randrange(0, 2)] = rng.choice(["", "z", "Q"])
        docs.append((100 + k, text(50) + " " + "".join(item) + "\n" + text(30)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    want = set()
    for i, t in docs:
        for j, b in items:
            n = decontam.normalised(b)
            if len(n) >= decontam.MIN_ITEM:
                d = plain_distance(n, decontam.normalised(t))
                if d <= decontam.edit_budget(len(n)):
                    want.add((i, j, d))
    for block in (decontam.BLOCK_CHARS, 100):  # one block and many
        got = decontam.contaminated_pairs(documents(spark, docs), bench, block_chars=block)
        assert {tuple(r) for r in got.collect()} == want and want
    kept = decontam.clean_documents(documents(spark, docs), bench, block_chars=100)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _, _ in want}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "word0 word1 word2 word3 word4 word5")], "item_id long, text string")
    docs = documents(spark, AWKWARD)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontam.contaminated_pairs(docs, bench).collect()) == [(7, 1, 0), (8, 1, 0)]
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 2
    assert decontam.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert decontam.contaminated_pairs(documents(spark, []), bench).count() == 0


def test_short_items_match_whole_words(spark):
    items = [(1, "Who wrote Emma?"), (2, "首都はどこですか"), (3, "Pi"), (4, "What is DNA"), (5, "  ")]
    docs = [(1, "Quiz: who  wrote emma? Austen"), (2, "問題：日本の首都はどこですか。"), (3, "a pi, a pie and spices"), (4, "spices only"),
            (5, "somewhat is dna"), (6, "what is dna?"), (7, "who wrota emma? nobody"), (8, "what is dnas"), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated_pairs(documents(spark, docs), bench).collect()
    assert {tuple(r) for r in got} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (6, 4, 0), (7, 1, 1)}
    assert {r.doc_id for r in decontam.clean_documents(documents(spark, docs), bench).collect()} == {4, 5, 8, 9}


def test_the_most_frequent_length_is_searched(spark):
    rows = [(k, [float(k), 1.0, 2.0]) for k in range(30)] + [(100 + k, [float(k)]) for k in range(8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    first = table.select("vec_id", topk.quantised(F.col("embedding")).alias("v")).orderBy(F.xxhash64("v"), "vec_id").collect()
    odd = next(r.vec_id for r in first if len(r.v) == 1)
    keep = [r.vec_id for r in first if len(r.v) == 3][-20:]  # hashed behind an odd row
    assert [r.vec_id for r in first].index(odd) < [r.vec_id for r in first].index(keep[0])
    got = topk.exact_top_k(table.where(F.col("vec_id").isin([odd, *keep])), F.lit(True), k=2)
    assert {r.query_id for r in got.collect()} == set(keep)


def test_every_length_is_searched(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (100, [1.0]), (101, [2.0])], "vec_id long, embedding array<float>")
    got = topk.exact_top_k(table, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 3 * 1024 ** 2), (100, 1, 101, 2 * 1024 ** 2)]


def test_large_components_score_exactly(spark):
    rows = [(0, [1e6, 1e6, -3.0]), (1, [2e6, -2e6, 1.0]), (2, [2e6, 1.0, 0.0]), (3, [1e12, 1e12, 0.0]), (4, [-1e30, 0.0, 0.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    q = [int(np.floor(1024 * x)) for x in rows[0][1]]
    hold = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
    want = sorted(((hold(sum(a * hold(int(np.floor(1024 * x))) for a, x in zip(q, v))), -i) for i, v in rows[1:]), reverse=True)
    assert [(r.score, -r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == want


def test_pivots_spare_most_rows():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (30, 16))
    x = (centres[rng.integers(0, 30, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(np.int64)
    pivots = x[:32].astype(np.float64)
    ids = np.arange(4000)
    far = topk.distances(x, pivots)
    evaluated = 0
    for i, best, score, n in topk.search_block(ids[:40], x[:40], far[:40], ids, x, far, 10):
        s = x @ x[i]
        s[i] = -(1 << 60)
        want = np.lexsort((ids, -s))[:10]
        assert best.tolist() == want.tolist() and score.tolist() == s[want].tolist()
        evaluated += n
    assert evaluated < 0.35 * 40 * 4000
