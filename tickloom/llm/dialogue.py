"""Conversation repair: generalised LR parsing over the role grammar with weighted edits.

The parser follows all stacks at once.  A stack is a node (LR state, node below); nodes are
interned, so stacks share their lower parts and equal tops are one node, which keeps the minimum
(cost, audit) of all ways that lead to it.  Every row can be kept, rerolled or deleted, and rows can
be inserted before it.  For this grammar the nodes are few, so what one kind of row does to a set of
stacks is worked out once and looked up from then on.

Spark reduces each row to one byte, finds duplicates by a grouped minimum, sorts by conversation and
turn over range partitions that may cut a conversation anywhere, and gathers the bytes alone.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import store

#: A dialogue is empty, or an optional system turn and then turns of user and assistant.
GRAMMAR = (("Dialogue", ""), ("Dialogue", "Body"), ("Body", "Opening"), ("Body", "Body Turn"), ("Opening", "Turn"), ("Opening", "s Turn"), ("Turn", "u a"))
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits; a truncated row that is not deleted costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Bits of a row's byte: place of its initial in `INITIALS` (3: another), then its fault.
INITIALS = "sua"
_TRUNCATED, _BLANK, _DUPLICATE = 4, 8, 16
_FRAGMENT = 1 << 16
_SPACES = "' \\t\\n\\x0B\\f\\r'"


class Automaton:
    """LR(0) states of a grammar and the stacks (nodes) that its terminals lead to."""

    def __init__(self, rules=GRAMMAR, most: int = 1000):
        self.rules = [(left, tuple(right.split())) for left, right in rules]
        self.lefts = {left for left, _ in self.rules}
        self.rules.append(("", (self.rules[0][0],)))
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.nodes: list[tuple[int, int]] = []
        self.index: dict[tuple[int, int], int] = {}
        self.most = most
        self.root = self._node(self._state({(len(self.rules) - 1, 0)}), -1)
        self.terminals = sorted({x for _, right in self.rules for x in right} - self.lefts)

    def _state(self, items: set) -> int:
        todo = list(items)
        for rule, dot in todo:
            right = self.rules[rule][1]
            if dot < len(right) and right[dot] in self.lefts:
                for k, (left, _) in enumerate(self.rules):
                    if left == right[dot] and (k, 0) not in items:
                        items.add((k, 0))
                        todo.append((k, 0))
        key = frozenset(items)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.index:
            if len(self.nodes) >= self.most:
                raise ValueError("this grammar has no bound on its stacks")
            self.index[key] = len(self.nodes)
            self.nodes.append(key)
        return self.index[key]

    def _go(self, node: int, symbol: str) -> int | None:
        items = {(k, dot + 1) for k, dot in self.states[self.nodes[node][0]] if dot < len(self.rules[k][1]) and self.rules[k][1][dot] == symbol}
        return self._node(self._state(items), node) if items else None

    def _reductions(self, node: int) -> tuple[list[int], bool]:
        """Nodes after one reduction, and whether the node's state can do anything else."""
        found, other = [], False
        for k, dot in self.states[self.nodes[node][0]]:
            left, right = self.rules[k]
            if dot == len(right) and left:
                under = node
                for _ in right:
                    under = self.nodes[under][1]
                nxt = self._go(under, left)
                if nxt is not None:
                    found.append(nxt)
            else:
                other = True
        return found, other

    def _settled(self, node: int) -> set[int]:
        """The node after the reductions that are forced."""
        found, other = self._reductions(node)
        return {node} if other or not found else set().union(*(self._settled(n) for n in found))

    def _reach(self, node: int) -> set[int]:
        """The node and all that reductions lead to."""
        seen, todo = {node}, [node]
        for n in todo:
            for nxt in self._reductions(n)[0]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    def shift(self, node: int, terminal: str) -> set[int]:
        found = {self._go(n, terminal) for n in self._reach(node)} - {None}
        return set().union(*(self._settled(n) for n in found)) if found else set()

    def accepts(self, node: int) -> bool:
        done = (len(self.rules) - 1, 1)
        return any(done in self.states[self.nodes[n][0]] for n in self._reach(node))


class Repairer:
    """Cheapest edits of a sequence of row kinds, as a machine over sets of stacks."""

    def __init__(self, automaton: Automaton | None = None):
        self.lr = automaton or Automaton()
        reached = [self.lr.root]
        self.moves: list[dict[str, list[int]]] = []
        for node in reached:
            self.moves.append({t: sorted(self.lr.shift(node, t)) for t in self.lr.terminals})
            reached += sorted({n for found in self.moves[-1].values() for n in found if n not in reached})
        place = {n: k for k, n in enumerate(reached)}
        self.moves = [{t: [place[n] for n in found] for t, found in m.items()} for m in self.moves]
        self.final = [self.lr.accepts(n) for n in reached]
        self.behind = self._behind()
        self.frontiers: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[int, int]] = []
        self.taken: list[tuple[int, int, dict]] = []
        self.start = self._frontier(((0, 0, 0),))

    def _behind(self) -> np.ndarray:
        """behind[x, y]: how much dearer the rest of a dialogue is from stack y than from x, at most.

        Whatever x does, y can follow by the same edit, by deleting the row, by another role or after
        inserting rows.  A stack that costs more than another plus this bound can never be part of a
        cheapest repair, ties included, and is dropped.
        """
        n = len(self.moves)
        ahead = []
        for y in range(n):
            cost, todo = {y: 0}, [y]
            for k in todo:
                for t in ROLES:
                    for m in self.moves[k][t]:
                        if m not in cost:
                            cost[m] = cost[k] + INSERT
                            todo.append(m)
            ahead.append(cost)
        bound = np.zeros((n, n))
        for _ in range(100):
            fresh = bound.copy()
            for x in range(n):
                for y in range(n):
                    worst = bound[x, y]
                    if self.final[x]:
                        worst = max(worst, min((c for k, c in ahead[y].items() if self.final[k]), default=np.inf))
                    for t, nexts in self.moves[x].items():
                        for m in nexts:
                            ways = [c + DELETE + bound[m, k] for k, c in ahead[y].items()]
                            ways += [c + bound[m, z] for k, c in ahead[y].items() for z in self.moves[k][t]]
                            ways += [c + REROLE + bound[m, z] for k, c in ahead[y].items() for o in ROLES for z in self.moves[k][o]]
                            worst = max(worst, min(ways))
                    fresh[x, y] = worst
            if (fresh == bound).all():
                return bound
            bound = fresh
        return np.full((n, n), np.inf)

    def _frontier(self, key: tuple) -> int:
        if key not in self.numbers:
            self.numbers[key] = len(self.frontiers)
            self.frontiers.append(key)
            self.steps.append({})
        return self.numbers[key]

    def _with_inserts(self, frontier: tuple) -> dict[int, tuple]:
        """Node -> (cost, rank of the audit so far, letters since, node before, symbols) after any inserts.

        Audits so far end in the letter of a row and have as many of these, so none begins with another
        and their order decides, whatever follows.
        """
        best = {node: (cost, rank, "", node, "") for node, cost, rank in frontier}
        todo = list(best)
        for node in todo:
            cost, rank, letters, origin, symbols = best[node]
            for t in ROLES:
                for m in self.moves[node][t]:
                    way = (cost + INSERT, rank, letters + "I", origin, symbols + t)
                    if m not in best or way < best[m]:
                        best[m] = way
                        todo.append(m)
        return best

    def _step(self, frontier: tuple, kind: int) -> tuple[int, int, dict]:
        """(next frontier, cost of its cheapest stack, node -> (node before, letters, symbols))."""
        best: dict[int, tuple] = {}

        def offer(node: int, cost: int, way: tuple, letter: str, symbol: str) -> None:
            new = (way[0] + cost, way[1], way[2] + letter, way[3], way[4] + symbol)
            if node not in best or new < best[node]:
                best[node] = new
        for node, way in self._with_inserts(frontier).items():
            offer(node, DELETE, way, "D", "-")
            if not kind & (_BLANK | _DUPLICATE):
                more = TRUNCATED if kind & _TRUNCATED else 0
                if kind & 3 < 3:
                    for m in self.moves[node].get(INITIALS[kind & 3], ()):
                        offer(m, more, way, "K", INITIALS[kind & 3])
                for t in ROLES:
                    for m in self.moves[node][t]:
                        offer(m, REROLE + more, way, "R", t)
        kept = {x: w for x, w in best.items() if not any(v[0] + self.behind[x, y] < w[0] for y, v in best.items() if y != x)}
        low = min(w[0] for w in kept.values())
        order = sorted({w[1:3] for w in kept.values()})
        key = tuple(sorted((x, w[0] - low, order.index(w[1:3])) for x, w in kept.items()))
        return self._frontier(key), low, {x: (w[3], w[2], w[4]) for x, w in kept.items()}

    def repair(self, kinds: bytes) -> tuple[int, str, str]:
        """(cost, audit, role initial of each audit letter, `-` for a deleted row)."""
        at, cost, path, steps, taken = self.start, 0, array("I"), self.steps, self.taken
        for kind in kinds:
            kind &= 31
            step = steps[at].get(kind)
            if step is None:
                taken.append(self._step(self.frontiers[at], kind))
                step = steps[at][kind] = len(taken) - 1
            path.append(step)
            at, low, _ = taken[step]
            cost += low
        ends = self._with_inserts(self.frontiers[at])
        _, last = min((way, node) for node, way in ends.items() if self.final[node])
        added, _, letters, node, symbols = ends[last]
        audit, roles = [letters], [symbols]
        for step in reversed(path):
            node, letters, symbols = taken[step][2][node]
            audit.append(letters)
            roles.append(symbols)
        return cost + added, "".join(reversed(audit)), "".join(reversed(roles))


def damage(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows with the faults that crc32 of `conv:turn` modulo 20 deals out.

    0 drops the row (`copies` 0: it only says that the conversation exists), 1 empties the text, 2 removes
    its sentence ends, 3 repeats the row, 4 makes it the user's.  Null roles and texts are one space, and
    so are null ids and turns inside the hash.
    """
    conv, turn = F.col(conv_column), F.col(turn_column)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_column, text_column))
    name = F.concat(*[F.coalesce(c.cast("string"), F.lit(" ")) if k != 1 else F.lit(":") for k, c in enumerate((conv, conv, turn))])
    draw = F.crc32(name.cast("binary")) % 20
    return conversations.select(
        conv.alias("conv"), turn.cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("int").alias("copies"))


def _kind() -> Column:
    """The byte of a row (role, text) but for the duplicate: place of the initial, truncated or blank."""
    first, kept = F.substring("role", 1, 1), F.expr(f"trim(TRAILING {_SPACES} FROM text)")
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(F.length(kept) == 0, _BLANK).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), _TRUNCATED).otherwise(0)
    return (initial + fault).cast("int")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, each: int = 1000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, each)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _typed(batches: Iterator[pa.RecordBatch], work, *fields: tuple[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """`work` on the batches, whose first result column has the type of their first column."""
    head = next(batches, None)
    if head is not None:
        yield from _batches(work(chain([head], batches)), pa.schema([("conv", head.schema.field(0).type), *fields]))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation in sorted rows: their bytes, and what their turns add up to.

    A run ends with its conversation, its partition, or at `_FRAGMENT` rows; (task, part) orders the runs.
    """
    def work(batches):
        task = TaskContext.get().partitionId()
        for conv, group in groupby(_rows(batches, "conv", "turn", "kind", "copies", "again"), key=lambda r: r[0]):
            kinds, first, last, turns, part = bytearray(), None, None, 0, 0
            for _, turn, kind, copies, again in group:
                if copies and turn is not None and turn != last:
                    first, last, turns = first if turns else turn, turn, turns + 1
                rest = kind if kind & _BLANK else (kind & 3) | _DUPLICATE
                kinds += bytes([rest if again else kind])[:copies]
                copies -= 1
                while copies > 0 or len(kinds) >= _FRAGMENT:  # equal rows after the first, in pieces of bounded size
                    more = max(0, min(copies, _FRAGMENT - len(kinds)))
                    kinds += bytes([rest]) * more
                    copies -= more
                    if len(kinds) >= _FRAGMENT:
                        yield conv, task, part, bytes(kinds), first, last, turns
                        kinds, first, turns, part = bytearray(), None, 0, part + 1
            yield conv, task, part, bytes(kinds), first, last, turns
    long = pa.int64()
    return _typed(batches, work, ("task", long), ("part", long), ("kinds", pa.binary()), ("first", long), ("last", long), ("turns", long))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = np.zeros((4, 4), dtype=bool)
for _pair in ("su", "ua", "au"):
    _LEGAL[INITIALS.index(_pair[0]), INITIALS.index(_pair[1])] = True


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost, audit and roles of each conversation from its bytes: one byte per row is gathered."""
    def work(batches):
        repairer = Repairer()
        for conv, group in groupby(_rows(batches, "conv", "kinds", "first", "last", "turns"), key=lambda r: r[0]):
            parts, low, high, turns = [], None, None, 0
            for _, kinds, first, last, more in group:
                parts.append(kinds)
                if more:
                    turns += more - (first == high)  # a turn cut by a border counts once
                    low, high = first if low is None else low, last
            kinds = b"".join(parts)
            x = np.frombuffer(kinds, dtype=np.uint8)
            initial = x & 3
            illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum())
            gaps = high - low + 1 - turns if turns else 0
            yield conv, gaps, *(int((x & bit > 0).sum()) for bit in (_BLANK, _DUPLICATE, _TRUNCATED)), illegal, *repairer.repair(kinds)
    return _typed(batches, work, *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("roles", pa.string()))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The decision of each conversation, then its rows in order: texts pass by one at a time."""
    def work(batches):
        names = ("conv", *_COUNTS, "audit", "roles", "role", "text", "copies")
        for conv, group in groupby(_rows(batches, *names), key=lambda r: r[0]):
            decision = next(group)
            audit, roles, sha, at, lines = decision[7], decision[8], hashlib.sha256(), 0, 0

            def put(role: str, text: str) -> None:
                nonlocal lines
                sha.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                lines += 1
            for row in group:
                for _ in range(row[11]):
                    while audit[at] == "I":
                        put(ROLES[roles[at]], "")
                        at += 1
                    if audit[at] != "D":
                        put(row[9] if audit[at] == "K" else ROLES[roles[at]], row[10])
                    at += 1
            for symbol in roles[at:]:
                put(ROLES[symbol], "")
            yield *decision[:8], sha.hexdigest()
    return _typed(batches, work, *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string()))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv, turn, role, text, copies): faults, cost, audit and hash of the repair.

    `copies` says how often a row stands there; 0 only names the conversation.  Rows go by turn, nulls
    first; rows of equal turn go by role and then by a hash of role and text, so that equal ones are
    neighbours.  The first of equal rows (role and text) is no duplicate.  A null conv is one
    conversation of its own.  A role that is empty or has another initial cannot be kept.  Other columns
    are ignored; an empty table gives no rows.

    Rows are combined before each shuffle.  A conversation of any length is sorted in pieces; one task then
    holds a byte and a step number per row of it, about what its audit takes, and one task reads its texts in
    order, row by row, since a hash of the whole cannot be made in pieces.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    small = rows.select("conv", "turn", "role", F.unhex(key).alias("key"), _kind().alias("kind"), "copies")
    small = small.groupBy("conv", "turn", "role", "key").agg(F.min("kind").alias("kind"), F.sum("copies").alias("copies"))
    moment = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    often = small.where("copies > 0").groupBy("conv", "key").agg(F.min(moment).alias("m"), F.count("*").alias("n")).where("n > 1")
    often = often.select(F.col("conv").alias("conv_"), F.col("key").alias("key_"), F.col("m.turn").alias("turn_"), F.lit(True).alias("twice"))
    small = small.join(often, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("key") == F.col("key_")), "left")
    again = F.coalesce(F.col("twice"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("turn_"))
    small = small.select("conv", "turn", "role", "key", "kind", "copies", again.alias("again"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    kind = rows.schema["conv"].dataType.simpleString()
    runs = small.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _fragments, f"conv {kind}, task long, part long, kinds binary, first long, last long, turns long")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    found = store(runs.repartition(parts, "conv").sortWithinPartitions("conv", "task", "part").mapInArrow(_decide, f"conv {kind}, {counts}, audit string, roles string"), "repairs")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("key", "binary"), ("text", "string"), ("copies", "int"))]
    heads = found.select("conv", F.lit(0).alias("tag"), *_COUNTS, "audit", "roles", *blank)
    none = [F.lit(None).cast(t).alias(c) for c, t in [*((c, "long") for c in _COUNTS), ("audit", "string"), ("roles", "string")]]
    texts = rows.where("copies > 0").select("conv", F.lit(1).alias("tag"), *none, "turn", "role", F.unhex(key).alias("key"), "text", F.col("copies").cast("int").alias("copies"))
    merged = heads.union(texts).repartition(parts, "conv").sortWithinPartitions("conv", "tag", F.col("turn").asc_nulls_first(), "role", "key")
    return merged.mapInArrow(_hash, f"conv {kind}, {counts}, audit string, repaired_sha256 string")
