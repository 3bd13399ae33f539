"""Removed bytes against brute force, also over the path for hot anchors."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tickloom.llm.suffix_dedup import LENGTH, anchors, longest_right, multikey_quicksort, repeated_spans


def brute(rows, length=LENGTH):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcdefghij kéü") for _ in range(n))
    long, edge, short = text(900), text(399), text(200)
    rows = [text(800) for _ in range(8)]
    rows += [text(draw.randrange(300)) + long[draw.randrange(200):700 + draw.randrange(200)] + text(draw.randrange(300)) for _ in range(12)]
    rows += [text(50) + edge + text(60) for _ in range(3)] + [edge + "x" + short, edge + "x" + short, edge + "y" + short]
    rows += [short + text(500) + short, "ab " * 700, "ab " * 700, "a" * 1000, "b" * 401, "b" * 400 + "c", "", None, long, long, "\0" * 500 + long[:300], "x" + "\0" * 450]
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [50_000, 3])
def test_passages(spark, hot):
    rows = passages()
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute(rows)


def test_documents(docs, texts):
    got = repeated_spans(docs).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute(list(texts.items()))


def test_kept_text(docs, texts):
    """What is left comes back as text: its bytes have the hash, but where a cut splits a character."""
    for r in repeated_spans(docs).collect():
        data, at, rest = (texts[r.doc_id] or "").encode(), 0, b""
        for a, b in r.spans:
            rest, at = rest + data[at:a], b
        assert r.text == (rest + data[at:]).decode("utf-8", "replace")


def test_odd_rows(odd, none):
    rows = repeated_spans(odd).collect()
    assert len(rows) == 9
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (5, 6)) and all(r.n_bytes == 0 for r in rows if r.doc_id in (1, 2))
    assert repeated_spans(none).collect() == []


def test_order_and_neighbours():
    draw = random.Random(1)
    suffixes = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(20, 48))) for _ in range(500)]
    packed = np.array([list(s.ljust(48, b"\0")) for s in suffixes], dtype=np.uint8)
    order = multikey_quicksort(packed.view(">u8"))
    assert [suffixes[i].ljust(48, b"\0") for i in order] == sorted(s.ljust(48, b"\0") for s in suffixes)
    best = longest_right(suffixes, 48)
    for i in range(0, 500, 25):
        own = max(next((k for k in range(48) if packed[i, k] != packed[j, k]), 48) for j in range(500) if j != i)
        assert best[i] == own


def test_every_string_has_one_anchor():
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    found = anchors(data)
    assert found["low"][0] == 0 and found["high"][-1] == 5000 - LENGTH and (found["low"][1:] == found["high"][:-1] + 1).all()
    assert ((found["place"] >= found["high"]) & (found["place"] <= found["low"] + LENGTH - 32)).all()
