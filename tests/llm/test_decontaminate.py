"""Windows against brute force, in one block and in several; cutting; odd rows."""

import hashlib
import re

import pytest

from tickloom.llm.decontaminate import contamination, remove_contamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words_of(text)
        for i in range(max(1, len(own) - 9)) if own else ():
            windows.setdefault(tuple(own[i:i + 10]), set()).add(str(item))
    out = {}
    for d, text in docs:
        own, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                key = tuple(own[i:i + size])
                if key in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[key]
        out[d] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "short item here"), (3, ""), (4, None), (5, "Short, ITEM-here!"), (10, "one two three four five six seven eight nine ten")]
DOCS = [(1, "x The quick, brown fox jumps over the lazy dog again y"), (2, "a short item here short item here b"), (3, "short item"), (4, None), (5, "ONE two three four five six seven eight nine ten"), (6, "clean"), (7, "")]


@pytest.mark.parametrize("block", [1000, 2])
def test_small(spark, block):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, items, block=block).collect()}
    assert got == brute(DOCS, ITEMS)


def test_documents(spark, docs, texts):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, bench).collect()}
    assert got == brute(texts.items(), items)
    clean = remove_contamination(docs, bench)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert all(not x[4] for x in brute(left.items(), items).values())
    assert all(left[d] == texts[d] for d, x in got.items() if not x[4])
    whole = remove_contamination(docs, bench, whole_documents=True)
    assert {r.doc_id for r in whole.collect()} == {d for d, x in got.items() if not x[4]}


def test_cutting_leaves_no_new_window(spark):
    docs = spark.createDataFrame([(1, "one two three short item here four five six seven eight nine ten"), (2, "short item here")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = {r.doc_id: r.text for r in remove_contamination(docs, items).collect()}
    assert left == {} or all(not x[4] for x in brute(left.items(), ITEMS).values())


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = contamination(odd, items).collect()
    assert len(rows) == 9 and not any(r.contaminated for r in rows)
    assert contamination(none, items).collect() == []
    assert contamination(odd, items.limit(0)).count() == 9
    assert remove_contamination(odd, items).count() == 9


def test_blocks_do_not_change_results(spark, odd):
    rows = [(None, "a short item here b"), (None, "no hit in here b"), (1, DOCS[0][1]), (1, DOCS[0][1]), (2, "short item here x y"), (2, "x y one two three"),
            (3, "one two three short item here four five six seven eight nine ten z"), (4, "short item here"), (5, None)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    told = lambda df: sorted(map(str, df.collect()))
    one = told(contamination(docs, items))
    assert len(one) == len(rows) and told(contamination(docs, items, block=2)) == one
    assert told(contamination(odd, items, block=2)) == told(contamination(odd, items))
    assert told(remove_contamination(docs, items, block=2)) == told(remove_contamination(docs, items))
    for block in (1000, 2):
        whole = told(remove_contamination(docs, items, whole_documents=True, block=block))
        assert whole == sorted(str(r) for r in docs.collect() if (r.doc_id, r.text) in {(None, rows[1][1]), (2, rows[5][1]), (5, None)})
