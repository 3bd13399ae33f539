"""The pipeline end to end and stage by stage."""

import corpus_pipeline as pipeline
from test_decontaminate import brute as windows
from test_ngram_join import brute as groups
from test_pii import brute as identifiers
from tickloom.llm.store import store

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    now, held = docs, {}
    for name, stage in pipeline.STAGES:
        now = store(stage(spark, now, FOLDER), name)
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            held[name] = {r.doc_id: r for r in now.collect()}
            assert all(r.n_chars == len(r.text) for r in held[name].values())
    good, single, clean, safe = (held[n] for n, _ in pipeline.STAGES[:4])
    assert 0 < len(single) <= len(good) < docs.count()
    group = groups([(d, r.text) for d, r in good.items()], 5, 80, 100)
    assert set(single) == {d for d, (_, c) in group.items() if c == d}
    assert not any(x[4] for x in windows([(d, r.text) for d, r in clean.items()], items).values())
    assert not any(identifiers(r.text) for r in safe.values()) and set(safe) == set(clean)
    assert {r.doc_id for r in now.select("doc_id").collect()} == set(safe)


def test_run(spark, none, odd):
    rows = pipeline.run(spark, FOLDER).collect()
    assert rows and {"doc_id", "lot", "bin", "bin_offset", "capacity", "n_tokens"} <= set(rows[0].asDict())


def test_odd_rows(spark, odd, none):
    for start in (odd, none):
        now = start
        for name, stage in pipeline.STAGES:
            now = store(stage(spark, now, FOLDER), name)
        assert now.count() >= 0
