"""A gated recurrent language model with a class-factored softmax, in NumPy inside Spark tasks.

**Tokens.**  Frequent words have entries of their own; every other word belongs to one of
`TAIL` classes by its first two bytes, with the words of a class told apart by their exact
corpus counts.  `P(token | h) = P(class | h) * P(token | class[, h])`: frequent words stand in
frequency bins with a learned softmax inside, tail words in their class with
`(count + 1) / (tokens of the class + words of the class + 1)`.

**Counts** cover all training documents.  Each slice of texts sends its tail words in blocks,
one per hash bucket; a bucket's task has all occurrences of its words, counts them, and sends
back one sum per document.  Nothing that grows with the vocabulary is broadcast.

**Training** is truncated backpropagation through time on all training documents.  They are dealt
into lots of about `LOT` tokens by a hash of id and text; each lot trains weights of its own, which are averaged
after each round.  Lots and the order in them do not depend on how the table is partitioned.  Sequences are
laid in lanes one after the other, the state is carried from window to window and cleared
where a document begins, in training and in scoring.  Texts are turned into entries once;
training and scoring read those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import store
from tickloom.llm.text import BLANK, U, Words, mix, slices

#: Frequent words (a multiple of INNER, the end token among them), words in a bin, tail classes.
FREQUENT, INNER, TAIL = 1024, 32, 32
HEADS = FREQUENT // INNER
HIDDEN, WINDOW, LANES, SCORE_LANES = 16, 24, 256, 768
#: Tokens that one task scores at a time, and tokens of a training sequence: longer texts train as several.
AT_ONCE, PIECE = 2_000_000, 1024
#: Tokens of a lot that trains its own weights, and of those laid in lanes at a time.
LOT, LAID = 2_000_000, 500_000
#: Training: one in SHARE training documents (all of them), rounds of averaging, step size.
SHARE, ROUNDS, RATE, SEED = 1, 2, 0.01, 5
#: Tail occurrences in a bucket of the count.
BUCKET = 1_500_000
END = U(0x1B873593CC9E2D51)


def held_out(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo 7, is 2.  A null id is the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], dtype=bool)


def in_share(ids: list, share: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) // 7 % share == 0 for i in ids], dtype=bool)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, tail class) of each token in order; every text ends with the end token."""
    words = Words(column, BLANK)
    count = np.diff(words.first)
    at = words.first[1:]
    second = np.where(words.ends - words.starts > 1, words.data[np.minimum(words.starts + 1, max(0, len(words.data) - 1))], 0) if len(words.starts) else np.zeros(0, np.uint8)
    first = words.data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    tail = (mix(first.astype(np.uint64) * U(256) + second.astype(np.uint64)) % U(TAIL)).astype(np.int16)
    text = np.repeat(np.arange(len(count)), count)
    return np.insert(words.hashes(), at, END), np.insert(text, at, np.arange(len(count))), np.insert(tail, at, 0)


@dataclass
class Vocabulary:
    """Hashes of the frequent words in the order of frequency."""

    ranked: np.ndarray
    order: np.ndarray = field(init=False)

    def __post_init__(self):
        self.order = np.argsort(self.ranked, kind="stable")

    def entries(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Entry of each token: its rank, or FREQUENT plus its tail class."""
        ordered = self.ranked[self.order]
        near = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
        return np.where(ordered[near] == hashes, self.order[near], FREQUENT + tail).astype(np.int32)


def lanes_of(entry: np.ndarray, text: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid in lanes: (input, target, text) as (steps, lanes), and steps per lane, longest lane first.

    The input of a text's first token is the end token's entry marked by -1, which also clears
    the state; places beyond a lane's end have text -1.
    """
    size = np.bincount(text, minlength=int(text[-1]) + 1) if len(text) else np.zeros(0, dtype=np.int64)
    lanes = max(1, min(lanes, len(size)))
    total = np.cumsum(size)
    lane = np.minimum((total - size) * lanes // max(1, int(total[-1]) if len(total) else 1), lanes - 1)
    length = np.bincount(lane, weights=size, minlength=lanes).astype(np.int64)
    rank = np.empty(lanes, dtype=np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(lanes)
    lane, length = rank[lane], np.sort(length)[::-1]
    begin = total - size
    base = np.full(lanes, np.iinfo(np.int64).max)
    np.minimum.at(base, lane, begin)
    column = lane[text]
    row = np.arange(len(text)) - base[column]
    steps = int(length[0]) if len(length) else 0
    given, target, owner = np.full((steps, lanes), -1, dtype=np.int32), np.zeros((steps, lanes), dtype=np.int32), np.full((steps, lanes), -1, dtype=np.int32)
    before = np.concatenate([[-1], entry[:-1]])
    before[np.concatenate([[True], text[1:] != text[:-1]])] = -1
    given[row, column], target[row, column], owner[row, column] = before, entry, text
    return given, target, owner, length


def pieces_of(text: np.ndarray) -> np.ndarray:
    """Texts renumbered so that none has more than PIECE tokens."""
    if not len(text):
        return text
    head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    place = np.arange(len(text)) - np.repeat(head, np.diff(np.append(head, len(text))))
    return np.cumsum(place % PIECE == 0) - 1


class Model:
    """Weights: input tables and recurrent matrices (update, reset, new), class softmax and the softmax inside each bin."""

    NAMES = ("inputs", "recur", "classes", "class_bias", "inner", "inner_bias")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, entry_counts: np.ndarray, seed: int = SEED) -> Model:
        """Small random weights; the biases give the unigram distribution."""
        random = np.random.default_rng(seed)
        small = lambda *shape: (random.normal(0, 1, shape) / np.sqrt(HIDDEN) * 0.5).astype(np.float32)
        counts = entry_counts.astype(np.float64) + 1
        heads = counts[:FREQUENT].reshape(HEADS, INNER)
        mass = np.concatenate([heads.sum(axis=1), counts[FREQUENT:]])
        return cls({
            "inputs": small(3, FREQUENT + TAIL + 1, HIDDEN), "recur": small(3, HIDDEN, HIDDEN), "classes": small(HIDDEN, HEADS + TAIL) * np.float32(0.1),
            "class_bias": np.log(mass / mass.sum()).astype(np.float32), "inner": small(HEADS, HIDDEN, INNER) * np.float32(0.1), "inner_bias": np.log(heads / heads.sum(axis=1, keepdims=True)).astype(np.float32)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    def with_flat(self, values: np.ndarray) -> Model:
        out, at = {}, 0
        for n in self.NAMES:
            out[n] = values[at: at + self.w[n].size].reshape(self.w[n].shape).astype(np.float32)
            at += self.w[n].size
        return Model(out)

    def forward(self, given: np.ndarray, state: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """States after each step of a window, and with `keep` what the way back needs: the states before, both gates, the held part and the new one."""
        turned = np.array([-1, -1, 1], dtype=self.w["recur"].dtype)[:, None, None]  # gates need exp(-x): signs are turned once
        recur, fresh = self.w["recur"] * turned, given < 0
        x = np.take(self.w["inputs"] * turned, np.where(fresh, FREQUENT + TAIL, given), axis=1)
        carried = (~fresh).astype(recur.dtype)[:, :, None]
        shape = (len(given) if keep else 1, *state.shape)
        states, gates_of = np.empty((len(given), *state.shape), dtype=recur.dtype), np.empty((2, *shape), dtype=recur.dtype)
        before, held, new_of = (np.empty(shape, dtype=recur.dtype) for _ in range(3))
        for t in range(len(given)):
            k = t if keep else 0
            state = np.multiply(state, carried[t], out=before[k])
            a = state @ recur
            gates = np.add(x[:2, t], a[:2], out=gates_of[:, k])
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            held[k] = a[2]
            new = np.multiply(gates[1], a[2], out=new_of[k])
            new += x[2, t]
            np.tanh(new, out=new)
            after = states[t]
            np.subtract(new, state, out=after)
            after *= gates[0]
            after += state
            state = after
        return states, (before, gates_of[0], gates_of[1], held, new_of)

    def _bins(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Class of each target, the rows in the order of their classes, and the part of them in each frequency bin (bins come first)."""
        kind = np.where(target < FREQUENT, target // INNER, target - FREQUENT + HEADS)
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(HEADS + 1))
        return kind, order, [(c, slice(edges[c], edges[c + 1])) for c in range(HEADS) if edges[c] < edges[c + 1]]

    def _inner(self, states: np.ndarray, bins: list[tuple[int, slice]]) -> np.ndarray:
        """Logits of the words of each row's bin; the rows are in the order of the bins."""
        out = np.empty((len(states), INNER), dtype=states.dtype)
        for c, part in bins:
            np.matmul(states[part], self.w["inner"][c], out=out[part])
            out[part] += self.w["inner_bias"][c]
        return out

    @staticmethod
    def _softmax(logits: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits, shifted, with the log of their sum in the unshifted scale; `weights` and `bias` made them from states."""
        # A state lies in [-1, 1], so the weights bound the logits; small ones need no shift.
        top = logits.dtype.type(0)
        if logits.size and (np.abs(weights).sum(axis=-2) + np.abs(bias)).max() > 30:
            top = logits.max(axis=1, keepdims=True)
            logits -= top
        np.exp(logits, out=logits)
        total = (logits @ np.ones(logits.shape[1], dtype=logits.dtype))[:, None]  # faster than a sum of short rows
        return total, np.log(total) + top

    def log_probabilities(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for frequent words, P(word | class), per row."""
        w, rows = self.w, np.arange(len(target))
        kind, order, bins = self._bins(target)
        own = order[: bins[-1][1].stop if bins else 0]
        logits = states @ w["classes"]
        logits += w["class_bias"]
        out = logits[rows, kind].astype(np.float64)
        out -= self._softmax(logits, w["classes"], w["class_bias"])[1][:, 0]
        inner = self._inner(states[own], bins)
        found = inner[np.arange(len(own)), target[own] % INNER].astype(np.float64)
        out[own] += found - self._softmax(inner, w["inner"], w["inner_bias"])[1][:, 0]
        return out

    def gradients(self, given: np.ndarray, target: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss over one window (the state before it counts as given), and the last state."""
        w, g = self.w, {}
        states, saved = self.forward(given, state, True)
        steps, lanes = given.shape
        h, y = states.reshape(-1, HIDDEN), target.ravel()
        mask = (live.ravel() / max(1, live.sum())).astype(h.dtype)
        # Rows go in the order of their classes, so each bin is one stretch of them.
        kind, order, bins = self._bins(y)
        seen, mask, rows, inside = h[order], mask[order], np.arange(len(y)), bins[-1][1].stop if bins else 0
        ones = np.ones(len(y), dtype=h.dtype)
        p = seen @ w["classes"]
        p += w["class_bias"]
        p *= mask[:, None] / self._softmax(p, w["classes"], w["class_bias"])[0]
        p[rows, kind[order]] -= mask
        g["classes"], g["class_bias"] = seen.T @ p, ones @ p
        down = p @ w["classes"].T
        g["inner"], g["inner_bias"] = np.zeros_like(w["inner"]), np.zeros_like(w["inner_bias"])
        q = self._inner(seen[:inside], bins)
        q *= mask[:inside, None] / self._softmax(q, w["inner"], w["inner_bias"])[0]
        q[rows[:inside], y[order[:inside]] % INNER] -= mask[:inside]
        for c, part in bins:
            g["inner"][c], g["inner_bias"][c] = seen[part].T @ q[part], ones[part] @ q[part]
            down[part] += q[part] @ w["inner"][c].T
        back = np.empty_like(h)
        back[order] = down
        back = back.reshape(steps, lanes, HIDDEN)
        carried = (given >= 0).astype(h.dtype)[:, :, None]
        before, update, reset, held, new = saved
        by_update, by_reset, by_new = (1 - update) * (new - before), held * reset * (1 - reset), 1 - new * new
        d = np.zeros_like(state)
        # Side by side per row: by the update gate, by the reset gate, by the held part, by the new one.
        into, turned = np.empty((steps, lanes, 4, HIDDEN), dtype=h.dtype), np.ascontiguousarray(w["recur"].transpose(0, 2, 1)).reshape(3 * HIDDEN, HIDDEN)
        for t in range(steps - 1, -1, -1):
            d += back[t]
            moved = d * update[t]
            at = into[t]
            fresh = moved * by_new[t]
            at[:, 3] = fresh
            np.multiply(moved, by_update[t], out=at[:, 0])
            np.multiply(fresh, by_reset[t], out=at[:, 1])
            np.multiply(fresh, reset[t], out=at[:, 2])
            d -= moved
            d += at.reshape(lanes, 4 * HIDDEN)[:, : 3 * HIDDEN] @ turned
            d *= carried[t]
        flat = into.reshape(-1, 4 * HIDDEN)
        g["recur"] = np.ascontiguousarray((before.reshape(-1, HIDDEN).T @ flat[:, : 3 * HIDDEN]).reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
        tokens = np.where(given < 0, FREQUENT + TAIL, given).ravel()
        g["inputs"] = np.empty_like(w["inputs"])
        for k, part in enumerate((0, 1, 3)):
            for j in range(HIDDEN):
                g["inputs"][k, :, j] = np.bincount(tokens, weights=flat[:, part * HIDDEN + j], minlength=FREQUENT + TAIL + 1)
        return g, states[-1]

    def train(self, given: np.ndarray, target: np.ndarray, owner: np.ndarray, moments: dict, rate: float) -> None:
        """One pass over the lanes, longest first, window after window (Adam)."""
        state = np.zeros((given.shape[1], HIDDEN), dtype=np.float32)
        for begin in range(0, len(given), WINDOW):
            end = begin + WINDOW
            # Lanes that have ended are the last ones and add nothing.
            wide = int((owner[begin] >= 0).sum())
            live = owner[begin:end, :wide] >= 0
            g, state = self.gradients(given[begin:end, :wide], target[begin:end, :wide], live, state[:wide])
            moments["t"] = t = moments.get("t", 0) + 1
            for n, v in g.items():
                m, s = moments.setdefault(n, (np.zeros_like(v), np.zeros_like(v)))
                m += np.float32(0.1) * (v - m)
                s += np.float32(0.01) * (v * v - s)
                self.w[n] -= np.float32(rate / (1 - 0.9 ** t)) * m / (np.sqrt(s / np.float32(1 - 0.99 ** t)) + np.float32(1e-6))

    def score(self, entry: np.ndarray, text: np.ndarray, texts: int, lanes: int = SCORE_LANES) -> np.ndarray:
        """Summed natural log probabilities per text (tail words: of their class).

        The state runs through whole texts; the blocks here only bound the work at a time.
        """
        total = np.zeros(texts)
        if not len(entry):
            return total
        given, target, owner, length = lanes_of(entry, text, lanes)
        state, begin = np.zeros((given.shape[1], HIDDEN), dtype=np.float32), 0
        while begin < len(given):
            wide = int(np.searchsorted(-length, -begin, side="left"))
            end = begin + min(512, max(8, 16_384 // wide))
            states, _ = self.forward(given[begin:end, :wide], state[:wide], False)
            state = states[-1]
            own = owner[begin:end, :wide].ravel()
            live = own >= 0
            found = self.log_probabilities(states.reshape(-1, HIDDEN)[live], target[begin:end, :wide].ravel()[live])
            total += np.bincount(own[live], weights=found, minlength=texts)
            begin = end
        return total


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all words of each slice in the training documents."""
    for batch in batches:
        chosen = batch.filter(pa.array(~held_out(batch.column("id").to_pylist())))
        for part in slices(chosen, "text"):
            hashes, count = np.unique(tokens_of(part.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(count, pa.int64())], names=["hash", "n"])


_BLOCK = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("hash", pa.binary()), ("doc", pa.binary()), ("n", pa.binary()), ("kind", pa.binary()), ("train", pa.binary()), ("k1", pa.binary()), ("k2", pa.binary())])


def _blocks(shared, buckets: int):
    """Tail words of a slice in blocks, one per bucket; bucket -1 has the slice's counts of entries in the training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                train = ~held_out(part.column("id").to_pylist())
                hashes, text, tail = tokens_of(part.column("text"))
                entry = vocabulary.entries(hashes, tail)
                counts = np.bincount(entry[train[text]], minlength=FREQUENT + TAIL).astype(np.int64)
                k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
                task = U(TaskContext.get().partitionId())
                name = int((mix(mix(k1.view(np.uint64) + np.arange(len(k1), dtype=np.uint64)) + task).sum() ^ mix(k2.view(np.uint64)).sum()).view(np.int64))
                rows = [(-1, name, counts.tobytes(), b"", b"", b"", b"", k1.tobytes(), k2.tobytes())]
                rare = entry >= FREQUENT
                key, owner, kind = hashes[rare], text[rare], (entry[rare] - FREQUENT).astype(np.uint8)
                order = np.lexsort((owner, key))
                key, owner, kind = key[order], owner[order], kind[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, bool)
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(key))).astype(np.uint32)
                key, owner, kind = key[heads], owner[heads].astype(np.uint32), kind[heads]
                # Sorted by hash, so buckets are ranges of it.
                cut = np.searchsorted(key, (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets).clip(0, (1 << 64) - 1).astype(np.uint64))
                cut[-1] = len(key)
                for b in range(buckets):
                    s = slice(cut[b], cut[b + 1])
                    if cut[b] < cut[b + 1]:
                        rows.append((b, name, key[s].tobytes(), owner[s].tobytes(), n[s].tobytes(), kind[s].tobytes(), train.tobytes(), b"", b""))
                for begin in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[begin: begin + 64]), _BLOCK)], schema=_BLOCK)
    return run


_KNOWN = "slice long, doc binary, k1 binary, k2 binary, logs binary, known binary, totals binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice's documents the sums of log10(count + 1) and the known tokens of this bucket's words; and the bucket's totals."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    words = [r for r in rows if r["bucket"] >= 0]
    entries, distinct = np.zeros(FREQUENT + TAIL, dtype=np.int64), np.zeros(TAIL, dtype=np.int64)
    out = []
    for r in rows:
        if r["bucket"] < 0:
            entries += np.frombuffer(r["hash"], dtype=np.int64)
            out.append((r["slice"], b"", r["k1"], r["k2"], b"", b"", b""))
    if words:
        key = np.concatenate([np.frombuffer(r["hash"], dtype=np.uint64) for r in words])
        n = np.concatenate([np.frombuffer(r["n"], dtype=np.uint32) for r in words]).astype(np.int64)
        kind = np.concatenate([np.frombuffer(r["kind"], dtype=np.uint8) for r in words])
        train = np.concatenate([np.frombuffer(r["train"], dtype=bool)[np.frombuffer(r["doc"], dtype=np.uint32)] for r in words])
        _, first, where = np.unique(key, return_index=True, return_inverse=True)
        count = np.bincount(where, weights=n * train, minlength=len(first)).astype(np.int64)
        distinct = np.bincount(kind[first], weights=count > 0, minlength=TAIL).astype(np.int64)
        logs, known = n * np.log10(count[where] + 1.0), n * (count[where] > 0)
        at = 0
        for r in words:
            doc = np.frombuffer(r["doc"], dtype=np.uint32)
            own, back = np.unique(doc, return_inverse=True)
            span = slice(at, at + len(doc))
            out.append((r["slice"], own.tobytes(), b"", b"", np.bincount(back, weights=logs[span]).tobytes(), np.bincount(back, weights=known[span]).astype(np.int64).tobytes(), b""))
            at += len(doc)
    out.append((None, b"", b"", b"", b"", b"", np.concatenate([entries, distinct]).tobytes()))
    for begin in range(0, len(out), 64):
        kinds = [pa.int64(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[begin: begin + 64]), kinds)], names=["slice", "doc", "k1", "k2", "logs", "known", "totals"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per document over the buckets; a partition has all rows of its slices."""
    slices_: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            slices_.setdefault(r["slice"], []).append(r)
    for rows in slices_.values():
        k1, k2 = next((np.frombuffer(r["k1"], dtype=np.int64), np.frombuffer(r["k2"], dtype=np.int64)) for r in rows if r["k1"])
        logs, known = np.zeros(len(k1)), np.zeros(len(k1), dtype=np.int64)
        for r in rows:
            if r["doc"]:
                doc = np.frombuffer(r["doc"], dtype=np.uint32)
                logs[doc] += np.frombuffer(r["logs"], dtype=np.float64)
                known[doc] += np.frombuffer(r["known"], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(logs), pa.array(known)], names=["k1", "k2", "tail_logs", "tail_known"])


_ENCODED = "k1 long, k2 long, held_out boolean, learns boolean, entries binary"


def _encoded(shared, share: int):
    """The entries of each text, two bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_pylist()
                hashes, text, tail = tokens_of(part.column("text"))
                entry = vocabulary.entries(hashes, tail).astype(np.int16)
                edges = np.zeros(part.num_rows + 1, dtype=np.int32)
                np.cumsum(2 * np.bincount(text, minlength=part.num_rows), out=edges[1:])
                entries = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(edges), pa.py_buffer(entry)])
                held = held_out(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("k1"), part.column("k2"), pa.array(held), pa.array(~held & in_share(ids, share)), entries],
                    names=["id", "k1", "k2", "held_out", "learns", "entries"])
    return run


def entries_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(entries, tokens of each text) of a column of encoded texts."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1] // 2
    return np.frombuffer(data, dtype=np.int16, count=int(edges[-1]))[edges[0]:], np.diff(edges)


def _train(shared, rate: float):
    """Trains each lot, which comes whole and in order; the sum of the weights, each by its tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, seen, total = shared.value, 0, 0
        lot, block, behind, held = None, 0, 0, []
        model, moments = start, {}

        def lay() -> None:
            if held:
                entry, size = (np.concatenate(x) for x in zip(*held))
                text = np.repeat(np.arange(len(size)), size)
                given, target, owner, _ = lanes_of(entry.astype(np.int32), pieces_of(text), LANES)
                model.train(given, target, owner, moments, rate)
                held.clear()

        def close() -> None:
            nonlocal seen, total
            lay()
            if behind:
                seen, total = seen + behind, total + model.flat().astype(np.float64) * behind

        for batch in batches:
            lots = batch.column("lot").to_numpy()
            entry, size = entries_of(batch.column("entries"))
            edges = np.concatenate([[0], np.cumsum(size)])
            for begin, end in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(lots)) + 1, [len(lots)]]))):
                if lots[begin] != lot:
                    close()
                    lot, block, behind = lots[begin], 0, 0
                    model, moments = Model({n: v.copy() for n, v in start.w.items()}), {}
                # Where the lanes are cut depends on the tokens of the lot so far, not on batches.
                own = (behind + edges[begin:end] - edges[begin]) // LAID
                heads = np.flatnonzero(np.concatenate([[True], np.diff(own) > 0]))
                for first, last in zip(heads, np.append(heads[1:], end - begin)):
                    if own[first] != block:
                        lay()
                        block = own[first]
                    held.append((entry[edges[begin + first]: edges[begin + last]], size[begin + first: begin + last]))
                behind += int(edges[end] - edges[begin])
        close()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["seen", "weights"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total = 0, None
    for batch in batches:
        for n, values in zip(batch.column("seen").to_pylist(), batch.column("weights").to_pylist()):
            seen, total = seen + n, np.frombuffer(values, dtype=np.float64) + (0 if total is None else total)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["seen", "weights"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, entry_counts, class_log = shared.value
        logs, known = np.log10(entry_counts[:FREQUENT] + 1.0), entry_counts[:FREQUENT] > 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            size = sum(part.num_rows for part, _, _ in held)
            begin = np.cumsum([0] + [part.num_rows for part, _, _ in held])
            entry = np.concatenate([e for _, e, _ in held])
            text = np.concatenate([t + b for (_, _, t), b in zip(held, begin)])
            common = entry < FREQUENT
            total = model.score(entry, text, size) / np.log(10)
            total -= np.bincount(text[~common], weights=class_log[entry[~common] - FREQUENT], minlength=size)
            column = lambda c: pa.concat_arrays([part.column(c) for part, _, _ in held])
            yield pa.RecordBatch.from_arrays(
                [column("id"), column("k1"), column("k2"), column("held_out"), pa.array(np.bincount(text, minlength=size).astype(np.int64)),
                 pa.array(np.bincount(text[common], weights=known[entry[common]], minlength=size).astype(np.int64)), pa.array(np.bincount(text[common], weights=logs[entry[common]], minlength=size)), pa.array(total)],
                names=["id", "k1", "k2", "held_out", "n_tokens", "known", "logs", "part"])
            held.clear()

        for batch in batches:
            entry, size = entries_of(batch.column("entries"))
            edges = np.concatenate([[0], np.cumsum(size)])
            begin = 0
            while begin < len(size):
                end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + AT_ONCE // 4, side="right")) - 1)
                part = batch.slice(begin, end - begin).select(["id", "k1", "k2", "held_out"])
                held.append((part, entry[edges[begin]: edges[end]].astype(np.int32), np.repeat(np.arange(end - begin, dtype=np.int32), size[begin:end])))
                begin = end
                if sum(len(e) for _, e, _ in held) >= AT_ONCE:
                    yield from flush()
        if held:
            yield from flush()
    return run


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: int = SHARE, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """One row per row of `docs`: `held_out`, token counts, the unigram `base_score` and the model's `score` (log10).

    A null or empty text is its end token alone.  Repeated rows are scored each and count each;
    rows with a null id train.  Without training documents every word is unknown and both
    scores stay defined.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(F.col(id_column), text).alias("k1"), F.xxhash64(F.col(id_column), F.lit(1)).alias("k2"))
    kind = base.schema["id"].dataType.simpleString()
    top = base.select("id", "text").mapInArrow(_frequent, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    end = int(np.array([END]).view(np.int64)[0])
    ranked = [end] + [r.hash for r in top.where(F.col("hash") != end).orderBy(F.desc("n"), "hash").limit(FREQUENT - 1).collect()]
    ranked = np.array(ranked, dtype=np.int64).view(np.uint64)
    if len(ranked) < FREQUENT:  # fewer words than entries: the rest can never occur
        spare = mix(np.arange(FREQUENT, dtype=np.uint64) + U(0x632BE59BD9B4E019))
        ranked = np.concatenate([ranked, spare[~np.isin(spare, ranked)][: FREQUENT - len(ranked)]])
    vocabulary = Vocabulary(ranked)

    known = context.broadcast(vocabulary)
    encoded = store(base.mapInArrow(_encoded(known, share), f"id {kind}, {_ENCODED}"), "entries")
    words = base.select(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // 12 // BUCKET))
    blocks = base.mapInArrow(_blocks(known, buckets), "bucket int, slice long, hash binary, doc binary, n binary, kind binary, train binary, k1 binary, k2 binary")
    # Blocks of one slice's entry counts are dealt by the slice; those of words by the bucket.
    dealt = blocks.repartition(buckets, F.when(F.col("bucket") < 0, F.col("slice")).otherwise(F.col("bucket").cast("long")))
    counted = store(dealt.mapInArrow(_counted, _KNOWN), "counts")
    # One row per bucket, of fixed size, added up in the tasks that read them.
    totals = np.zeros(FREQUENT + 2 * TAIL, dtype=np.int64)
    for row in counted.where("slice IS NULL").select("totals").repartition(min(64, buckets)).mapInArrow(_added_totals, "totals binary").collect():
        totals += np.frombuffer(row.totals, dtype=np.int64)
    entry_counts, distinct = totals[: FREQUENT + TAIL], totals[FREQUENT + TAIL:]
    train_tokens, vocabulary_size = int(entry_counts.sum()), int((entry_counts[:FREQUENT] > 0).sum() + distinct.sum())

    model = Model.start(entry_counts)
    lots = max(1, -(-train_tokens // LOT))
    lot = F.pmod(F.xxhash64("k1", "k2"), F.lit(lots)).cast("int").alias("lot")
    dealt = encoded.where("learns").select(lot, "k1", "k2", "entries").repartitionById(lots, F.col("lot")).sortWithinPartitions("lot", "k1", "k2").select("lot", "entries")
    for k in range(rounds):
        trained = dealt.mapInArrow(_train(context.broadcast(model), rate / (1 + k)), "seen long, weights binary")
        rows = trained.repartition(32).mapInArrow(_added, "seen long, weights binary").collect()
        seen = sum(r.seen for r in rows)
        if seen:
            model = model.with_flat(sum(np.frombuffer(r.weights, dtype=np.float64) for r in rows) / seen)

    class_log = np.log10(entry_counts[FREQUENT:] + distinct + 1.0)
    shared = context.broadcast((model, entry_counts, class_log))
    scored = encoded.mapInArrow(_score(shared), f"id {kind}, k1 long, k2 long, held_out boolean, n_tokens long, known long, logs double, part double")
    sums = counted.where("slice IS NOT NULL").repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "slice").mapInArrow(_summed, "k1 long, k2 long, tail_logs double, tail_known long")
    # Equal rows in different slices have sums of their own; each row needs one of them.
    sums = sums.dropDuplicates(["k1", "k2"])
    out = scored.join(sums, ["k1", "k2"], "left")
    logs, tail = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)), F.coalesce("tail_logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + vocabulary_size + 1)))).alias("base_score"), (F.col("part") + tail).alias("score"))


def _added_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FREQUENT + 2 * TAIL, dtype=np.int64)
    for batch in batches:
        for values in batch.column("totals").to_pylist():
            total += np.frombuffer(values, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["totals"])
