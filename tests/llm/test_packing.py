"""Every token in one place, no sequence over its capacity, few tokens of padding."""

import random
import re
from collections import defaultdict

from tickloom.llm.packing import SIZES, pack, pack_documents


def check(rows, sizes):
    used, most = defaultdict(int), {}
    for r in sorted(rows, key=lambda r: r.bin_offset):
        key = (r.lot, r.bin)
        assert r.bin_offset == used[key]
        used[key] += r.n_tokens
        most[key] = r.capacity
    for key, n in used.items():
        assert n <= most[key] and most[key] == min(s for s in sizes if s >= n)
    return sum(used.values()), sum(most.values())


def test_documents(docs, texts):
    rows = pack_documents(docs).collect()
    filled, room = check(rows, SIZES)
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append((r.first_token, r.n_tokens))
    for d, t in texts.items():
        at = 0
        for first, n in sorted(per[d]):
            assert first == at
            at += n
        assert at == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    assert filled / room > 0.95
    small = pack_documents(docs, lot=40, sizes=(64, 128)).collect()
    assert len({r.lot for r in small}) > 5 and check(small, (64, 128))[0] == filled


def test_best_fit():
    bins, offsets, capacity = pack([5, 3, 8, 2, 2], (8, 16))
    assert sum(capacity[list(bins).index(b)] for b in set(bins)) >= 20 and offsets.min() == 0
    draw = random.Random(2)
    lengths = [draw.randrange(1, 4097) for _ in range(3000)]
    bins, _, capacity = pack(lengths)
    room = {b: c for b, c in zip(bins.tolist(), capacity.tolist())}
    assert sum(lengths) / sum(room.values()) > 0.97
    assert [len(x) for x in pack([])] == [0, 0, 0]


def test_equal_lengths_share_larger_sequences():
    for n in (257, 300):
        bins, _, capacity = pack([n] * 1300)
        room = dict(zip(bins.tolist(), capacity.tolist()))
        assert 1300 * n / sum(room.values()) > 0.87, n
    # What is left over at the end takes no more room than it needs.
    bins, _, capacity = pack([300] * 14)
    assert sorted(dict(zip(bins.tolist(), capacity.tolist())).values())[0] == 512


def test_placement_does_not_depend_on_partitions(spark, docs):
    """A third of the rows are copies of one; any number of lots, any partitioning."""
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "a b c d")] * 100, "doc_id long, text string"))
    for lot in (40, 100_000):
        pick = lambda df: sorted(tuple(r) for r in pack_documents(df, lot=lot, sizes=(64, 512)).select("doc_id", "piece", "n_tokens", "lot", "bin", "bin_offset", "capacity").collect())
        one = pick(rows.repartition(3))
        assert one == pick(rows.repartition(7)) == pick(rows.coalesce(1))
        if lot == 40:
            copies = [r[3] for r in one if r[0] == -1]
            assert len(set(copies)) > 5  # copies part


def test_odd_rows(spark, odd, none):
    rows = pack_documents(odd).collect()
    assert sum(r.n_tokens for r in rows if r.doc_id in (1, 2, 3)) == 3 and sum(r.n_tokens for r in rows if r.doc_id == 5) == 60_002
    assert pack_documents(none).collect() == []
    given = spark.createDataFrame([(1, 10), (2, None), (3, 0), (4, 9000)], "doc_id long, size int")
    rows = pack_documents(given, length_column="size").collect()
    assert sorted({r.doc_id for r in rows}) == [1, 4] and check(rows, SIZES)[0] == 9010
