"""Gradients, the distribution, counts against brute force, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tickloom.llm.gru_lm import FREQUENT, HIDDEN, INNER, TAIL, Model, _frequent, held_out, in_share, lanes_of, pieces_of, score_documents, tokens_of


def small_model(kind=np.float64):
    counts = np.random.default_rng(0).integers(0, 50, FREQUENT + TAIL)
    return Model({n: w.astype(kind) for n, w in Model.start(counts).w.items()})


def test_gradients():
    model, draw = small_model(), np.random.default_rng(2)
    given = np.concatenate([np.full((1, 5), -1), draw.integers(0, FREQUENT + TAIL, (9, 5))])
    given[4, 2] = -1
    target, live = draw.integers(0, FREQUENT + TAIL, (10, 5)), draw.random((10, 5)) < 0.8
    state = draw.normal(0, 0.5, (5, HIDDEN))

    def loss():
        states, _ = model.forward(given, state, False)
        return -(model.log_probabilities(states.reshape(-1, HIDDEN), target.ravel()) * live.ravel()).sum() / live.sum()

    gradients, _ = model.gradients(given, target, live, state)
    for name in Model.NAMES:
        w, g = model.w[name], gradients[name]
        for at in np.argwhere(np.abs(g) > 0.2 * np.abs(g).max())[:3]:
            i, kept = tuple(at), w[tuple(at)]
            w[i] = kept + 1e-4
            up = loss()
            w[i] = kept - 1e-4
            down = loss()
            w[i] = kept
            assert abs(g[i] - (up - down) / 2e-4) < 1e-6 + 1e-3 * abs(g[i])


def test_probabilities_sum_to_one():
    model, state = small_model(), np.random.default_rng(1).normal(0, 1, (1, HIDDEN))
    every = np.arange(FREQUENT + TAIL)
    assert abs(np.exp(model.log_probabilities(np.repeat(state, len(every), axis=0), every)).sum() - 1) < 1e-9
    assert FREQUENT % INNER == 0


def test_lanes_do_not_change_scores():
    draw = np.random.default_rng(3)
    text = np.repeat(np.arange(30), draw.integers(1, 90, 30))
    entry = draw.integers(0, FREQUENT + TAIL, len(text)).astype(np.int32)
    model = small_model()
    one = model.score(entry, text, 30, 1)
    assert np.allclose(one, model.score(entry, text, 30, 7)) and np.allclose(one, model.score(entry, text, 30, 500))
    given, target, owner, length = lanes_of(entry, text, 7)
    assert (owner >= 0).sum() == len(text) == length.sum() and (given[owner >= 0] < 0).sum() == 30
    assert np.bincount(pieces_of(np.zeros(5000, dtype=np.int64))).max() == 1024


def brute(rows):
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = Counter(x for d, own in tokens.items() if not held[d] for x in own)
    n, v = sum(count.values()), len(count)
    return {d: (held[d], len(own), sum(count[x] > 0 for x in own), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own)) for d, own in tokens.items()}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expect = brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = score_documents(docs, share=1).collect()
    assert len(rows) == len(expect)
    for r in rows:
        held, tokens, known, train, base = expect[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, train)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    gain = sum(r.score - r.base_score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    assert gain > 0.05  # log10 per held-out token


def test_tokens():
    hashes, text, tail = tokens_of(pa.array(["A a", None, "", "b"]))
    assert text.tolist() == [0, 0, 0, 1, 2, 3, 3] and hashes[0] == hashes[1] and hashes[2] == hashes[3] == hashes[4] == hashes[6] and tail[0] == tail[1]


def test_odd_rows(odd, none):
    rows = score_documents(odd, share=1, rounds=1).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    fives = {(r.n_tokens, r.n_known, r.base_score) for r in rows if r.doc_id == 5}
    assert len(fives) == 1
    assert score_documents(none).collect() == []


def test_every_training_document_trains(spark):
    ids = [i for i in range(400) if not held_out([i])[0] and not in_share([i], 8)[0]][:40]
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog ran " * 20) for i in ids], "doc_id long, text string")
    trained, fresh = ({r.doc_id: r.score for r in score_documents(docs, **how).collect()} for how in ({}, {"rounds": 0}))
    assert len(trained) == 40 and all(trained[i] > fresh[i] for i in ids)


def test_vocabulary_counts_every_word():
    words = " ".join(f"w{i}" for i in range(6000))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([2, 3], pa.int64()), "text": [words, words]})
    assert not held_out([2, 3]).any()
    assert sum(sum(b.column("n").to_pylist()) for b in _frequent(iter([batch]))) == 12_002


def test_short_last_window_trains():
    entry = np.array([1, 2, 3], dtype=np.int32)
    model = Model.start(np.ones(FREQUENT + TAIL))
    before = model.flat()
    model.train(*lanes_of(entry, np.zeros(3, dtype=np.int64), 128)[:3], {}, 0.01)
    assert not np.array_equal(before, model.flat())


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    from tickloom.llm import gru_lm

    monkeypatch.setattr(gru_lm, "LOT", 60_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: r.score for r in score_documents(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    assert all(abs(one[i] - many[i]) <= 1e-4 * max(1, abs(one[i])) for i in one)


def test_softmax_shifts_only_where_the_weights_are_large():
    """Small weights bound the logits, so no pass for the largest one is needed; large ones must not overflow."""
    random = np.random.default_rng(3)
    for scale in (0.1, 40.0):
        weights, bias = (random.normal(0, scale, (16, 8))).astype(np.float32), random.normal(0, scale, 8).astype(np.float32)
        logits = random.uniform(-1, 1, (50, 16)).astype(np.float32) @ weights + bias
        exact = logits.astype(np.float64)
        top = exact.max(axis=1, keepdims=True)
        log_sum = np.log(np.exp(exact - top).sum(axis=1, keepdims=True)) + top
        given = logits.copy()
        total, found = Model._softmax(given, weights, bias)
        np.testing.assert_allclose(found, log_sum, rtol=1e-5, atol=1e-5)
        np.testing.assert_allclose(given / total, np.exp(exact - log_sum), rtol=1e-3, atol=1e-6)
