"""Components against brute force; the tree's bound; odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm.ngram_join import BLOCK, COARSE, COUNT, FINE, CountTree, fold, jaccard_components, needed_overlap, representatives
from tickloom.llm.text import BLANK, NOT_LETTER, Words


def brute(rows, width, num, den):
    sets = {}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    parent, index = {d: d for d in sets}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = Counter(o for g in s for o in index.get(g, ()))
        for g in s:
            index.setdefault(g, []).append(d)
        for o, n in common.items():
            if den * n >= num * (len(s) + len(sets[o]) - n):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def families():
    """Copies with edits around both thresholds, at sizes on both sides of every scheme, and a passage all share."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(60)], []
    for size in (1, 2, 3, 5, 8, 9, 10, 12, 20, 30, 45, 60, 66, 68, 75, 90, 130, 300, 700):
        base = [word() for _ in range(size)] + (passage if size % 2 else [])
        for edits in (0, 1, 2, 3, 5, 8):
            for _ in range(2):
                own = list(base)
                for _ in range(edits * max(1, len(own) // 100)):
                    own[draw.randrange(len(own))] = word()
                if edits == 2 and len(own) > 4:
                    own = own[: -(len(own) // 12 + 1)]
                rows.append(" ".join(own))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_families(spark, width, num, den):
    rows = families()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, num=num, den=den).collect()}
    assert got == brute(rows, width, num, den)


def test_documents(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute(texts.items(), 4, 85, 100)


def test_odd_rows(odd, none):
    rows = jaccard_components(odd).collect()
    assert len(rows) == 9
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == 1 and by[2] == 2 and by[3] == 3 and by[5] == by[6] == 5 and by[None] is None
    assert jaccard_components(none).collect() == []


def test_tree_keeps_every_close_point():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 9, (40, FINE))
    points = np.concatenate([np.maximum(0, base + draw.integers(-1, 2, base.shape)) for _ in range(5)]).astype(np.uint16)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = CountTree(points, sizes)
    for p, n in zip(points[::7], sizes[::7]):
        expect = np.flatnonzero(np.minimum(points, p).sum(axis=1, dtype=np.int64) >= needed_overlap(n, sizes, 85, 100))
        assert sorted(tree.search(p, n, 85, 100)) == expect.tolist()
    assert BLOCK > CountTree.LEAF


def test_counts_beyond_sixteen_bits():
    """Groups of 80,000 shingles: a bound from wrapped counts would rule out equal sets."""
    point = np.full((1, FINE), 80_000 // (FINE // COARSE), dtype=COUNT)
    point[0, :3] = 80_000
    assert fold(point)[0].astype(np.int64).sum() == point.astype(np.int64).sum() and fold(point)[0, 0] > 65_535
    size = np.array([int(point.sum())])
    assert CountTree(point, size).search(point[0], size[0], 85, 100).tolist() == [0]


def test_one_row_of_each_group_stays(spark, odd):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (3, text), (None, text), (None, text), (2, text + " more"), (7, "one text of its own"), (7, text), (None, "alone without an id"), (8, None), (8, None), (9, " ")]
    df = spark.createDataFrame([(*r, k, "s") for k, r in enumerate(rows)], "doc_id long, text string, row int, component_id string")
    kept = representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(2, text + " more"), (7, "one text of its own"), (0, "alone without an id"), (8, ""), (8, ""), (9, " ")])
    none = df.where("doc_id IS NULL")
    assert sorted(r.text for r in representatives(none).collect()) == ["alone without an id", text]
    assert representatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("separators,pattern", [(BLANK, r"[^\x20\x09-\x0D]+"), (NOT_LETTER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(separators, pattern):
    texts = ["", None, "A b", "é\x0bü 12-x", "  lead", "trail ", "x", "Straße y"]
    words = Words(pa.array(texts), separators)
    found = [words.data[s:e].tobytes().decode() for s, e in zip(words.starts, words.ends)]
    expect = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert found == sum(expect, []) and np.diff(words.first).tolist() == [len(x) for x in expect]
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == len(set(found))
