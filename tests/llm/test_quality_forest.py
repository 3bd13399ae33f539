"""Base statistics against brute force; the forest tells junk from prose; odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tickloom.llm.quality_forest import FEATURES, Forest, best_threshold, judge, keep_good, statistics


def brute(text):
    text = text or ""
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count, cover = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2)), set()
    for i in range(len(words) - 2):
        if count[tuple(words[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_statistics(texts):
    own = list(texts.values()) + [None, "", "\n", "a\na\n\na", "x y z x y z x", "é ü #|<> a\n\n b\r\nb\r\n", "a b", "A a A a A a"]
    found = statistics(pa.array(own))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(found[c][i]) for c in names) for i in range(len(own))] == [brute(t) for t in own]
    assert all(np.isfinite(found[c]).all() for c in FEATURES)


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = [rows[d].kept for d, q in known.items() if q == 1 and not rows[d].base_failed]
    bad = [rows[d].kept for d, q in known.items() if q == 0 and not rows[d].base_failed]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.05
    assert {r.doc_id for r in keep_good(docs, labels).select("doc_id").collect()} == {d for d, r in rows.items() if r.kept}


def test_threshold():
    assert best_threshold([(10, 0, 5), (20, 5, 0)]) == 15
    assert best_threshold([]) == 0 and best_threshold([(5, 3, 0)]) == 0


def test_forest_finds_values_outside_the_sample():
    draw = np.random.default_rng(0)
    forest = Forest.grow(draw.normal(0, 1, (2000, 3)), trees=50, rows=256)
    near, far = forest.mean_path(draw.normal(0, 1, (200, 3))), forest.mean_path(draw.normal(12, 1, (200, 3)))
    assert np.quantile(near, 0.05) > far.max()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (None, 1), (9, None), (6, 0)], "doc_id long, quality int")
    rows = judge(odd, labels).collect()
    assert len(rows) == 9 and all(not r.kept for r in rows if r.n_words < 50)
    assert judge(none, labels).collect() == [] and judge(odd, labels.limit(0)).count() == 9
    assert keep_good(odd, labels).columns == odd.columns and keep_good(none, labels).collect() == []
