"""Operators 12 and 13 against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import centroids, jobs, trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, d long, shard string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) -> the operator's rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role or '')}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p] for p in members}

    def under(p):
        return [p] + [x for q in kids[p] for x in under(q)]
    out = set()
    for p, cs in members.items():
        sub = under(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        ends = ",".join(str(c) for c in sorted(cs) if seqs[c] == p)
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in sub), saved, sha(ends)))
    return out


def trie_rows(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    return {tuple(r) for r in trie.prefix_trie(df, **kw).collect()}


def some_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 200, 205, 317, -3, -100, 10**15]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice("ab") * rng.randint(1, 2)))
    rows += [(7, None, None, None), (7, None, "user", ""), (7, 2, "user", "é日𝒳"), (8, 1, "user", "a"), (8, 1, "user", "a"), (None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in jobs.op12_prefix_trie(spark, SF).collect()} == plain_trie(rows)


@pytest.mark.parametrize("fan, queue", [(2, 1), (3, 2), (4096, 1 << 18)])
def test_trie_over_several_levels_and_spilling_queues(spark, fan, queue):
    rows = some_conversations(4)
    assert trie_rows(spark, rows, fan=fan, queue=queue) == plain_trie(rows)


def test_trie_of_a_comb_and_of_copies(spark):
    comb = [(100 * k + 50, t, "user", "s" if t < k else f"leaf{k}") for k in range(1, 9) for t in range(k + 1)]
    copies = [(5000 + k, t, "user", "same") for k in range(12) for t in range(4)]
    for rows in (comb, copies, comb + copies):
        assert trie_rows(spark, rows, fan=2, queue=1) == plain_trie(rows)


def test_trie_of_a_long_conversation(spark):
    rows = [(3, t, "user", f"w{t % 7}") for t in range(9000)] + [(4, t, "user", f"w{t % 7}") for t in range(5000)]
    got = {(r[0], r[1]): r for r in trie_rows(spark, rows)}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (3, 4)}
    seqs = {c: [f"w{t % 7}" for t in range(h[c], n)] for c, n in ((3, 9000), (4, 5000))}
    shared = next((k for k, (a, b) in enumerate(zip(seqs[3], seqs[4])) if a != b), min(map(len, seqs.values())))
    assert len(got) == 1 + len(seqs[3]) + len(seqs[4]) - shared
    assert got[(3, 0)][2:7] == (None, 2, 1 if shared else 2, 1 if shared == len(seqs[4]) else 2, 2 * shared)
    assert got[(3, 8000)][2:] == (3, 1, 1, 1, 0, sha(""))


def test_trie_without_rows(spark):
    assert trie_rows(spark, []) == set()
    assert trie_rows(spark, [(None, 1, "user", "x")]) == set()


def test_a_conversation_without_turns_belongs_to_the_root(spark):
    c = next(k for k in range(1, 99) if zlib.crc32(str(k).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "only turn")]
    assert trie_rows(spark, rows) == plain_trie(rows) == {(c, 0, None, 1, 0, 1, 0, sha(str(c)))}


def test_spilling_queue_is_sorted():
    rng = random.Random(1)
    q, want = trie.SpillingQueue(3), []
    for _ in range(200):
        m = (rng.randint(-9, 9), rng.randint(0, 3), 0, rng.randint(0, 9), 0)
        q.push(m)
        want.append(m)
        if rng.random() < 0.4:
            want.sort()
            assert q.peek() == want[0] and q.pop() == want.pop(0)
    assert [q.pop() for _ in want] == sorted(want) and q.peek() is None


def plain_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-2**26, min(2**26, x)) for x in v]) for i, v in kept]
    order = sorted([(sha(f"2:{i}"), v) for i, v in kept if i is not None])
    cents = [v for _, v in order[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    lab = [(i, *best(v)) for i, v in kept]
    per = {}
    for _, d, c in lab:
        per[c] = per.get(c, 0) + d
    return sorted(((i, c, d, per[c], sum(per.values()), sha(",".join(map(str, cents[c])))) for i, d, c in lab), key=repr)


def test_centroid_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in jobs.op13_centroid_clusters(spark, SF).collect()), key=repr) == plain_clusters(rows)


def test_awkward_vectors(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for k in range(120)]  # many ties
    rows += [(5, rows[5][1]), (5, [9.0] * 4), (None, [0.1] * 4), (200, None), (201, [1.0] * 3), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4),
             (204, [float("inf")] * 4), (205, [1e300, -1e300, 0.0, 0.0]), (206, []), (207, [-0.0] * 4)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")
    got = centroids.with_totals(*centroids.cluster(df, size=4, k=7)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_clusters(rows, k=7, size=4)
    few = centroids.with_totals(*centroids.cluster(df.where("vec_id < 3 and vec_id >= 0"), size=4, k=7)).collect()
    assert sorted((tuple(r) for r in few), key=repr) == plain_clusters(rows[:3], k=7, size=4)
    none = centroids.with_totals(*centroids.cluster(df.where("false"), size=4))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_orchard_search_is_exact_and_skips():
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (40, 64))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 64)))
    near = centroids.Neighbours(centres)
    c, d, evaluated = centroids.nearest(x, near)
    full = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (c == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert evaluated < 0.2 * len(x) * 40  # far from all distances
    same = np.concatenate([centres[:3], centres[:3]])  # equal centroids: the smaller number
    assert (centroids.nearest(x[:50], centroids.Neighbours(same))[0] < 3).all()
