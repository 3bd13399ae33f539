"""Conversation repair against a search over all edits, written from the definition alone."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tickloom.llm import dialogue
from tickloom.llm.queries import op12_conversation_repair

FOLDER = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, audit, lines) of the cheapest edits: uniform-cost search, ties by audit."""
    heap, done, best = [(0, "", 0, "", ())], {}, None
    while heap:
        cost, audit, at, seq, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", seq) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        state = (at, seq[-1:], len(seq) > 1 or seq == "u")  # all that the rest depends on
        if state in done and done[state] < (cost, audit):
            continue
        done[state] = (cost, audit)

        def go(letter, price, step, initial="", line=None):
            if not initial or re.fullmatch("s?(ua)*u?", seq + initial):
                heapq.heappush(heap, (cost + price, audit + letter, at + step, seq + initial, lines + ((line,) if line is not None else ())))
        for role in ("user", "assistant"):
            go("I", 2, 0, role[0], f"{role}:")
        if at < len(rows):
            role, text, fault = rows[at]
            go("D", 3, 1)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1]:
                    go("K", more, 1, role[0], f"{role}:{text}")
                for other in ("user", "assistant"):
                    go("R", 2 + more, 1, other[0], f"{other}:{text}")
    return best


def by_definition(table):
    """Results per conversation of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            role = "user" if draw == 4 else role
            rows += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked = set(), []
        for _, role, text in rows:
            kept = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = cheapest(marked)
        turns = [t for t, _, _ in rows if t is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def apply(df):
    return dialogue.repair(dialogue.damage(df)).withColumnRenamed("conv", "conv_id")


SCHEMA = "conv_id long, turn long, role string, text string"


def test_machine_against_search():
    kinds = {(i, f): (k, t) for k, i in enumerate(["system", "user", "assistant", "tool"]) for f, t in ((None, 0), ("truncated", 4), ("blank", 8), ("duplicate", 16))}
    repairer, rng = dialogue.Repairer(), random.Random(5)
    for size in range(6):
        found = list(itertools.product(kinds, repeat=size)) if size < 3 else [rng.choices(list(kinds), k=size) for _ in range(150)]
        for rows in found:
            cost, audit, _ = cheapest([(role, "x", fault) for role, fault in rows])
            assert repairer.repair(bytes(sum(kinds[r]) for r in rows))[:2] == (cost, audit), rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(op12_conversation_repair(spark, FOLDER)) == by_definition(rows)


def test_random_conversations_cut_anywhere(spark, monkeypatch):
    """One conversation holds most rows, pieces are small, and partitions cut it."""
    monkeypatch.setattr(dialogue, "_FRAGMENT", 3)
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "assistant", "tool", "", None], ["a.", "b", "c!", "  ", "d? \n", None]
    rows = {}
    for _ in range(260):
        conv = rng.choice([1, 1, 1, 1, 2, None, rng.randint(3, 9)])
        turn = rng.choice([None, rng.randint(0, 150)])
        if turn is not None or (conv, turn) not in rows:
            rows[conv, turn] = (conv, turn, rng.choice(roles), rng.choice(texts))
    rows = list(rows.values())
    assert results(apply(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_definition(rows)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, a long text, all rows dropped, clashing and extra columns."""
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = [(None, None, None, None), (5, None, "user", "x."), (5, None, "user", "x."), (6, 1, "user", "w " * 300_000 + "."), (6, 2, "assistant", "ok."), (6, 2, "assistant", "ok."), (dropped, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "c", b"k", 7) for r in rows], SCHEMA + ", task int, conv string, key binary, copies long")
    found = results(apply(df))
    assert found == by_definition(rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert apply(df.limit(0)).count() == 0


def test_grammars():
    """Another grammar: any number of user turns; one without a bound on its stacks raises."""
    loose = dialogue.Repairer(dialogue.Automaton((("Dialogue", ""), ("Dialogue", "Dialogue Turn"), ("Turn", "u"), ("Turn", "u a"), ("Turn", "s"))))
    assert loose.repair(bytes([0, 1, 1, 2, 2]))[:2] == (2, "KKKKIK")
    with pytest.raises(ValueError):
        dialogue.Repairer(dialogue.Automaton((("Dialogue", "u Dialogue a"), ("Dialogue", "s"))))
