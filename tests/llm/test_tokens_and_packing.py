"""Operators 1 and 3 against the tokenizers library on whole texts."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import binary_ids, jobs, packing, tokens
from .helpers import AWKWARD, crc, documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_path())


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def batch(texts):
    out = [None] * len(texts)
    for i, j, ids, off in tokens.batch_ids(pa.array(texts, pa.string()), tokens.default_path()):
        for r in range(i, j):
            out[r] = ids[off[r - i]:off[r - i + 1]].tolist()
    return out


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aAbzéÉßñÇΣςİKǄ'’stredvmll .,;!?\n\t\x1c\x85\xa0́ͅ<|>endoftext09½日本ﬁ\U0001f600"), max_size=30), max_size=6))
def test_word_memo_equals_whole_text_encoding(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_path())
    assert batch(texts) == [plain(t, x) for x in texts]


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(0, 2**32 - 1)))
def test_control_byte_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = binary_ids.encode(v)
    assert len(control) == -(-len(v) // 4)
    assert binary_ids.decode(control, data, len(v)).tolist() == values


def expect_files(rows, tokenizer):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(tokenizer, text)
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_files_of_awkward_documents(spark, tokenizer):
    got = [tuple(r) for r in binary_ids.token_id_files(documents(spark, AWKWARD)).collect()]
    assert sorted(got, key=lambda r: r[1]) == expect_files(AWKWARD, tokenizer)


def test_files_hold_the_ids_themselves(spark, tokenizer, tmp_dir):
    docs = documents(spark, AWKWARD)
    binary_ids.write(docs, tmp_dir + "/out", block_ids=100)
    got = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in binary_ids.read(spark, tmp_dir + "/out").collect()}
    flat = [x for k in sorted(got) for x in got[k]]
    want = [x for r in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")) for x in plain(tokenizer, r[1])]
    assert flat == want


def test_files_of_an_empty_table(spark):
    assert binary_ids.token_id_files(documents(spark, [])).count() == 0


def test_files_tokenise_a_text_once(spark, tmp_dir, monkeypatch):
    import os
    seen = f"{tmp_dir}/seen"
    os.mkdir(seen)
    real = tokens.batch_ids

    def noted(col, *args):
        import uuid
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(col)))
        return real(col, *args)
    monkeypatch.setattr(binary_ids, "batch_ids", noted)
    docs = documents(spark, AWKWARD)
    binary_ids.write(docs, tmp_dir + "/out", block_ids=100)
    assert sum(int(open(f"{seen}/{f}").read()) for f in os.listdir(seen)) == len(AWKWARD)  # before: twice that


def test_blocks_of_wide_ids(spark, tokenizer, tmp_dir):
    docs = documents(spark, AWKWARD)  # an end id that two bytes do not hold
    binary_ids.write(docs, tmp_dir + "/out", end_id=70_001, block_ids=100)
    flat = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in binary_ids.read(spark, tmp_dir + "/out").collect()}
    want = [x for r in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
            for x in [*plain(tokenizer, r[1])[:-1], 70_001]]
    assert [x for k in sorted(flat) for x in flat[k]] == want


def check_packing(rows, want, seq_len):
    """want: list of (doc_id, ids)."""
    sequences, per = collections.defaultdict(list), collections.Counter()
    expected = collections.Counter()
    for doc_id, ids in want:
        for k in range(0, len(ids), seq_len):
            expected[(doc_id, k // seq_len, k, len(ids[k:k + seq_len]), crc(ids[k:k + seq_len]))] += 1
    for r in rows:
        per[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert per == expected
    for places in sequences.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= seq_len
    return len(sequences)


def test_packing_of_awkward_documents(spark, tokenizer):
    got = packing.pack_documents(documents(spark, AWKWARD)).collect()
    check_packing(got, [(d, plain(tokenizer, t)) for d, t in AWKWARD], 4096)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_query_packs_all_documents_tightly(spark, tokenizer):
    docs = [(r.doc_id, plain(tokenizer, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bins = check_packing(jobs.op3_best_fit_packing(spark, SF).collect(), docs, 4096)
    assert bins <= -(-sum(len(i) for _, i in docs) // 4096) + 1


def test_query_files_match_brute_force(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in jobs.op1_token_id_files(spark, SF).collect()), key=lambda r: r[1]) == expect_files(docs, tokenizer)


def test_many_cells_pack_as_well_as_one(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), 0, 0, int(n), int(k)) for k, n in enumerate(rng.integers(1, 4097, 3000))]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    many = packing.pack(table, cell_pieces=300).select("sequence_id").distinct().count()
    one = len(packing.pack_lengths(np.array([r[3] for r in rows])))
    assert many <= one * 1.03 + 1  # cells of 300 pieces; production cells hold 40,000


def test_local_search_empties_a_bin():
    length = np.array([5, 4, 4, 3, 2, 2])
    # best fit leaves three bins of ten; two suffice
    assert len(packing.local_search([[0, 3], [1, 2], [4, 5]], length, 10)) == 2
    got = packing.local_search([[0], [1], [2], [3], [4], [5]], length, 10)
    assert sorted(k for b in got for k in b) == list(range(6)) and len(got) == 2


def plain_fewest(lengths, size):
    """Fewest bins by trying every way (few pieces)."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in sorted(set(rooms), reverse=True):
            if i >= lengths[k]:
                rest = list(rooms)
                rest[rest.index(i)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, rooms + [size - lengths[k]])
    place(0, [])
    return best[0]


def test_packing_reaches_small_optima():
    rng = np.random.default_rng(9)
    far = 0
    for _ in range(40):
        lengths = np.sort(rng.integers(1, 60, 10))[::-1].copy()
        bins = packing.pack_lengths(lengths, 60)
        assert sorted(k for b in bins for k in b) == list(range(10)) and all(lengths[b].sum() <= 60 for b in bins)
        far += len(bins) - plain_fewest(lengths.tolist(), 60)
    assert far <= 1


def test_exchanges_of_any_two_pieces():
    own = np.arange(50)
    size = np.concatenate([np.arange(1, 51), [7, 7]])
    sums, gives = packing._offers(np.concatenate([own, [50, 51]]), size)
    assert sums.tolist() == list(range(1, 100)) and all(size[list(g)].sum() == s and len(set(g)) == len(g) <= 2 for s, g in zip(sums, gives))


def test_rounds_end_when_no_bin_is_saved(spark):
    rows = [(k, 0, 0, 3000 if k % 2 else 700, k) for k in range(400)]  # long pieces that never share a sequence
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(table, 4096, cell_pieces=50).collect()
    assert len(out) == 400 and len({r.sequence_id for r in out}) == 200
