"""The histogram and what its sums answer, against encoding every text."""

from tickloom.llm.token_counts import VOCABULARY, at_limits, at_quantiles, encoder, length_histogram, suffix_sums


def test_documents(docs, texts):
    encode = encoder(VOCABULARY).encode_ordinary
    sizes = sorted(len(encode(t or "")) for t in texts.values())
    sums = suffix_sums(length_histogram(docs)).cache()
    rows = sums.collect()
    assert sum(r.n_docs for r in rows) == len(sizes) and sum(r.tokens for r in rows) == sum(sizes)
    for r in rows:
        assert r.docs_ge == sum(s >= r.length for s in sizes) and r.tokens_ge == sum(s for s in sizes if s >= r.length)
        assert r.truncated_total == sum(min(s, r.length) for s in sizes)
        assert abs(r["quantile"] - sum(s <= r.length for s in sizes) / len(sizes)) < 1e-12
    limits = [1, 37, 512, 100_000]
    assert {r.context_limit: (r.docs_over, r.truncated_total) for r in at_limits(sums, limits).collect()} == {x: (sum(s > x for s in sizes), sum(min(s, x) for s in sizes)) for x in limits}
    found = {r.share: r.length for r in at_quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert found == {q: next(s for i, s in enumerate(sizes) if (i + 1) / len(sizes) >= q and sum(x <= s for x in sizes) / len(sizes) >= q) for q in found}


def test_odd_rows(odd, none):
    rows = {r.length: r.n_docs for r in length_histogram(odd).collect()}
    assert rows[0] == 2 and sum(rows.values()) == 9
    assert suffix_sums(length_histogram(none)).collect() == []
