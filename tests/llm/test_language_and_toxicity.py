"""Operators 2 and 6: the models against plain forms, and held-out accuracy."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import jobs, langid, toxicity
from .helpers import AWKWARD, documents

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(langid.default_vocabulary())
    p = np.random.default_rng(0).random((pieces.n + 1, 3))
    p[-1] = 0
    number = {w: k for k, w in enumerate(pieces.pieces)}

    def plain(word):
        s = b" " + word
        total = [np.zeros(3) for _ in range(len(s) + 1)]
        total[0] += 1
        for end in range(1, len(s) + 1):
            for n in range(1, end + 1):
                k = number.get(s[end - n:end])
                if k is not None:
                    total[end] = total[end] + total[end - n] * p[k]
        return np.log(total[-1])
    words = [b"the", b"a", "été".encode(), b"nationalisation", b"q" * 60, b"application", b"x" * 20 + b"responsibility" * 3]
    assert any(len(x) > 16 for x in pieces.pieces)
    flat = np.frombuffer(b"".join(words) + b"\0" * 16, np.uint8)
    ends = np.cumsum([len(w) for w in words])
    table = langid.WordTable(flat, ends - np.array([len(w) for w in words]), ends)
    got = langid.forward(pieces, p, table)
    for row, k in zip(got, table.order):
        assert np.allclose(row, plain(words[k]))


def test_model_equals_piece_counts_of_whole_texts(spark):
    import re
    docs = [(1, "The cat's nationalisation, 12 the", "en"), (2, "le chat été\nLE", "fr"), (3, "the application the", "en"), (4, None, "fr"), (5, "x", None)]
    model = langid.train(documents(spark, [(i, t, g, None) for i, t, g in docs]))
    vocab = langid.Pieces(langid.default_vocabulary())
    number = {w: k for k, w in enumerate(vocab.pieces)}
    n = {g: np.full(vocab.n, langid.ALPHA) for g in ("en", "fr")}
    for _, text, g in docs:
        for word in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower()) if g else []:
            s = b" " + word
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    if s[a:b] in number:
                        n[g][number[s[a:b]]] += 1
    assert model.langs == ["en", "fr"]
    for c, g in enumerate(model.langs):
        assert np.allclose(model.p[:-1, c], n[g] / n[g].sum())


def test_language_edges(spark):
    train = documents(spark, [(k, t, g, None) for k, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)] * 3)])
    model = langid.train(train)
    assert model.langs == ["en", "fr"]
    docs = documents(spark, AWKWARD + [(20, "the dog"), (21, "le chien"), (22, "1234 — €"), (23, "ñ")])
    got = langid.predict(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(AWKWARD) + 4
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[0] == by[1] == by[2] == by[3] == by[22] == ("und", 0.0)
    assert by[20][0] == "en" and by[21][0] == "fr" and by[23][0] in ("en", "fr")
    assert all(0 <= s <= 1 for _, s in by.values())
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {0, 1, 2, 3, 22}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.predict(documents(spark, []).select("doc_id", "text"), model).count() == 0
    none = langid.train(documents(spark, []))
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = jobs.op2_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def plain_ratio(m, word):
    """log P(word | toxic) - log P(word | ordinary) by the model's tables, one letter at a time."""
    s = b" " + word + b" "
    slot = lambda raw: int(toxicity._slot(np.array([int.from_bytes(raw, "little")], np.uint64), m.bits)[0])
    total = 0.0
    for i in range(1, len(s)):
        gram = s[max(0, i - toxicity.ORDER + 1):i + 1]
        p = 1 / 256
        for o in range(1, len(gram)):
            low, n = gram[-o:], m.cont_total[o][slot(gram[-o:-1])]
            if n > 0:
                p = (max(m.cont[o][slot(low)] - .75, 0) + .75 * m.cont_types[o][slot(gram[-o:-1])] * p) / n
        q = []
        for k in (0, 1):
            n = m.total[k][slot(gram[:-1])]
            q.append((max(m.count[k][slot(gram)] - .75, 0) + .75 * m.types[k][slot(gram[:-1])] * p) / n if n > 0 else p)
        total += math.log(q[1]) - math.log(q[0])
    return total


def test_word_ratios_match_the_plain_form(spark):
    rows = spark.createDataFrame([("you are a vile toad", 1), ("a fine day for a walk", 0), ("the toad sat on a stone", 0)], "text string, label int")
    m = toxicity.train_counts(rows, bits=16)
    words = [b"toad", b"vile", b"walk", b"unseen", "été".encode()]
    flat = np.frombuffer(b" ".join(words) + b" " * 16, np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    table = langid.WordTable(flat, starts, starts + np.array([len(w) for w in words]))
    for r, k in zip(toxicity.word_ratios(m, table), table.order):
        assert abs(r - plain_ratio(m, words[k])) < 1e-4


def test_toxicity_edges(spark):
    bad = [(k, "such a vile toad and villain", None, None) for k in range(100, 140)]
    good = [(k, "a fine day for a long walk", None, None) for k in range(140, 180)]
    docs = documents(spark, AWKWARD + bad + good)
    labels = spark.createDataFrame([(d[0], 1) for d in bad] + [(d[0], 0) for d in good] + [(0, 1), (1, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, F.lit(True), bits=16)
    got = toxicity.score(docs.select("doc_id", "text"), m).collect()
    assert len(got) == len(AWKWARD) + 80 and all(0 <= r.score <= 1 for r in got)
    s = {r.doc_id: r.score for r in got}
    assert min(s[d[0]] for d in bad) > 0.7 > 0.5 > max(s[d[0]] for d in good)
    assert toxicity.score(documents(spark, []).select("doc_id", "text"), m).count() == 0
    untrained = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True), bits=16)
    assert {r.score for r in toxicity.score(docs.select("doc_id", "text"), untrained).collect()} == {0.0}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"  # some thirty toxic training rows; larger tables give more
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = jobs.op6_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) >= 10
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.7 and sum(r.predicted for r in clean) / len(clean) < 0.05


def test_no_two_grams_share_an_entry(spark):
    n = 40_000  # with the four letters before it, each word gives several distinct n-grams
    rows = spark.range(n).selectExpr("substr(md5(cast(id as string)), 1, 12) text", "cast(id % 2 as int) label")
    m = toxicity.train_counts(rows)
    want = {}
    for r in rows.collect():
        s = f" {r.text} ".encode()
        for i in range(1, len(s)):
            g = s[max(0, i - toxicity.ORDER + 1):i + 1]
            want.setdefault(g, [0, 0])[r.label] += 1
    keys = np.array([int.from_bytes(g, "little") for g in want], np.uint64)
    assert len(keys) > 250_000
    for k in (0, 1):
        assert (m.count[k][toxicity._slot(keys, m.bits)] == np.array([x[k] for x in want.values()])).all()


def test_every_labelled_row_is_counted_and_both_classes_are_fitted(spark):
    ids = spark.range(1, 600).select("id", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("fold")).collect()
    rare, other = [r.id for r in ids if r.fold][:8], [r.id for r in ids if not r.fold]
    rows = [(k, "zorgblat everywhere") for k in rare] + [(k, "a vile toad") for k in other[:8]] + [(k, f"a fine day for walk{k}") for k in other[8:]]
    labels = spark.createDataFrame([(k, int(n < 16)) for n, (k, _) in enumerate(rows)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    m = toxicity.train(docs, labels, F.lit(True), fit_rows=10)
    slot = toxicity._slot(np.array([int.from_bytes(b" zorg", "little")], np.uint64), m.bits)
    assert m.ready and m.count[1][slot][0] == 8 and m.count[0][slot][0] == 0
    s = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), m).collect()}
    assert min(s[k] for k, _ in rows[:16]) > 0.5 > max(s[k] for k, _ in rows[16:])
