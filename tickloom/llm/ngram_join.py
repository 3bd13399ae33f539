"""N-gram Jaccard join with an R-tree over count vectors.

A document is its set of distinct word shingles.  Two documents link when
`den * |A & B| >= num * |A | B|`; components of links are the near-duplicate groups.

**Groups.**  A shingle's hash puts it in a group.  Two linked sets differ in at most
D = (|A| + |B|) (den - num) / (den + num) shingles, so of more than D groups at least one is the
same in both, and that group, if not empty, is a key under which the two meet in an equi-join.
The number of groups follows the size band of the set (a set is keyed for its own band and the
one below), so there are about six shingles in a group and unrelated texts share no key, even
if thousands of them hold the same passage.  Sets with more empty groups than the spare ones
are also keyed by their least shingles, and small sets by pairs of their least shingles (linked
sets share two).  All keys together lose no link.

**Points.**  The sets that meet under a key make a tile.  A set is a point: its counts of
shingles in many fine groups, and folded into few coarse ones.  No overlap can exceed the sum
of coordinate minima; a tree of boxes (greatest count in each coordinate, least and greatest
size) rules out whole subtrees by that bound, and single points after it.  What survives is
verified on the whole texts.

**Copies.**  Equal sets are one class, named by a 64-bit hash of the set, and only classes are
keyed, searched and linked.  In a tile all others are first held against the least
class.  After the components of those links are known, tiles that still hold several are taken
together by their least class, and the tree is searched between components only, from the points
outside the largest one.  So a group of thousands of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import components, fresh, partitions, store
from tickloom.llm.text import BLANK, U, Words, mix, signed, slices

#: Groups of a point: coarse ones for boxes and first tests, fine ones for points that pass.
COARSE, FINE = 64, 1024
#: Counts in a group; a text of 2**32 shingles would take more than a row can hold.
COUNT = np.uint32
SMALL = 64
#: Points that one search holds at once; larger families meet block by block.
BLOCK = 4000
_SALT = [int(x) for x in np.random.default_rng(20240229).integers(1, 1 << 62, 8)]


class Bands:
    """Size bands and the number of groups used for each."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [SMALL + 1]

    def least_overlap(self, n: int) -> int:
        """Any partner shares at least so many shingles with a set of n."""
        return -(-self.num * n // self.den)

    def edge(self, i: int) -> int:
        while len(self.low) <= i:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return self.low[i]

    def of(self, n: int) -> int:
        i = 0
        while self.edge(i + 1) <= n:
            i += 1
        return i

    def groups(self, i: int) -> tuple[int, int]:
        """(number of groups, how many of them may be empty) for pairs whose smaller set is in band i."""
        most = (self.edge(i + 1) + self.edge(i + 2) - 2) * (self.den - self.num) // (self.den + self.num)
        spare = 6 + most * 3 // 100
        return most + 1 + spare, spare


def _keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of one set, given as sorted distinct hashes."""
    n = len(found)
    least = bands.least_overlap(n)
    out = []
    if n * bands.num <= SMALL * bands.den and least >= 2:
        prefix = mix(found[: n - least + 2] + U(_SALT[0]))
        a, b = np.triu_indices(len(prefix), 1)
        out.append(mix(prefix[a] * U(3) + prefix[b]))
    if n > SMALL:
        band = bands.of(n)
        scrambled = mix(found + U(_SALT[1]))
        summed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(scrambled)])
        for i in range(max(0, band - 1), band + 1):
            k, spare = bands.groups(i)
            group = ((found >> U(32)) * U(k)) >> U(32)
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sums = summed[np.append(heads[1:], n)] - summed[heads]
            out.append(mix(sums + group[heads] * U(_SALT[2]) + U(_SALT[3] + i)))
            if k - len(heads) > spare:
                out.append(mix(found[: n - least + 1] + U(_SALT[4] + i)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, BLANK)
    text, _, found = words.windows(words.hashes(), width)
    edges = np.searchsorted(text, np.arange(len(column) + 1))
    for i in range(len(column)):
        yield np.unique(found[edges[i]: edges[i + 1]])


def set_name(found: np.ndarray) -> int:
    """The name of a class of equal sets, as Spark's LONG; 0 for the empty set."""
    return int(signed(mix(mix(found + U(_SALT[5])).sum(keepdims=True) + U(len(found))))[0]) if len(found) else 0


_FACTS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("counts", pa.binary()), ("fine", pa.binary())])


def fold(fine: np.ndarray) -> np.ndarray:
    """Counts in the coarse groups, each a sum of fine ones."""
    return fine.reshape(len(fine), FINE // COARSE, COARSE).sum(axis=1, dtype=COUNT)


def _facts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, names, counts, fine = [], [], [], []
                for found in shingle_sets(part.column("text"), width):
                    n.append(len(found))
                    names.append(set_name(found))
                    own = np.bincount((found & U(FINE - 1)).astype(np.int64), minlength=FINE).astype(COUNT)
                    counts.append(fold(own[None, :]).tobytes())
                    fine.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(counts, pa.binary()), pa.array(fine, pa.binary())], schema=_FACTS)
    return run


def _emit(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, owner = [], []
                for found in shingle_sets(part.column("text"), width):
                    name = set_name(found)
                    if not len(found) or name in seen:
                        continue  # a copy in the same task: its class is keyed already
                    seen.add(name)
                    own = _keys(found, bands)
                    keys.append(own)
                    owner.append(np.full(len(own), name, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(owner))], names=["key", "set"])
    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tiles of several classes: (two sums of hashes that tell it from others, its classes).

    A partition has all rows of its keys.  Many keys give the same tile; equal ones in a
    partition are one row.
    """
    keys, sets = [], []
    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        sets.append(batch.column("set").to_numpy())
    if not keys:
        return
    key, own = np.concatenate(keys), np.concatenate(sets)
    del keys, sets
    # Most keys have one row: keep the others before sorting by class as well.
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    same = key[1:] == key[:-1]
    keep = np.zeros(len(key), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    key, own = key[keep], own[keep]
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    if not len(key):
        return
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(heads, len(key)))
    bits = own.view(np.uint64)
    one, two = np.add.reduceat(mix(bits), heads), np.add.reduceat(mix(bits + U(_SALT[7])), heads)
    several = np.flatnonzero(size > 1)
    _, first = np.unique(np.stack([one[several], two[several]], axis=1), axis=0, return_index=True)
    chosen = several[first]
    for begin in range(0, len(chosen), 20_000):
        part = chosen[begin: begin + 20_000]
        lists = pa.array([own[heads[k]: heads[k] + size[k]] for k in part], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(signed(one[part])), pa.array(signed(two[part])), lists], names=["s1", "s2", "sets"])


def _named(width: int):
    """Rows (set, text) whose text has the set it is fetched for: ids may repeat with other texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                wanted = part.column("set").to_pylist()
                good = [set_name(found) == name for found, name in zip(shingle_sets(part.column("text"), width), wanted)]
                yield part.select(["set", "text"]).filter(pa.array(good, pa.bool_()))
    return run


def needed_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap at which sets of a and b shingles link."""
    return -(-num * (a + b) // (num + den))


class CountTree:
    """A packed R-tree over count vectors, with the sizes of the sets as one more coordinate.

    Leaves hold consecutive points in the order of size and then of the counts, so boxes are
    narrow in size; a box keeps the greatest count in each coarse coordinate.
    """

    LEAF = 16

    def __init__(self, fine: np.ndarray, sizes: np.ndarray):
        coarse = fold(fine)
        self.order = np.lexsort((coarse[:, 1], coarse[:, 0], sizes))
        self.fine, self.coarse, self.sizes = fine[self.order], coarse[self.order], sizes[self.order]
        self.levels = []
        top, low, high = self.coarse, self.sizes, self.sizes
        while len(top) > 1 or not self.levels:
            heads = np.arange(0, len(top), self.LEAF)
            top, low, high = np.maximum.reduceat(top, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            self.levels.append((top, low, high))

    def search(self, fine: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Points whose overlap with the given set could reach the threshold."""
        coarse = fold(fine[None, :])[0]
        live = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[live] for x in self.levels[depth])
            bound = np.minimum(top, coarse).sum(axis=1, dtype=np.int64)
            good = (bound >= needed_overlap(size, low, num, den)) & (high * den >= num * size) & (size * den >= num * low)
            live = (live[good][:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
            live = live[live < (len(self.levels[depth - 1][0]) if depth else len(self.coarse))]
        needed = needed_overlap(size, self.sizes[live], num, den)
        for points, own in ((self.coarse, coarse), (self.fine, fine)):
            good = np.minimum(points[live], own).sum(axis=1, dtype=np.int64) >= needed
            live, needed = live[good], needed[good]
        return self.order[live]


def _vectors(column, groups: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=COUNT).reshape(-1, groups)


def _search_families(num: int, den: int):
    """Pairs of different components that the tree cannot rule out; a partition has whole families or block pairs of one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).sort_by([("least", "ascending"), ("x", "ascending"), ("y", "ascending")])
        ids, comps, sizes, side = (table.column(c).to_numpy() for c in ("set", "component", "n", "side"))
        mark = np.stack([table.column(c).to_numpy() for c in ("least", "x", "y")])
        heads = np.flatnonzero(np.concatenate([[True], (mark[:, 1:] != mark[:, :-1]).any(axis=0)]))
        for begin, end in zip(heads, np.append(heads[1:], len(ids))):
            fine = _vectors(table.column("fine").slice(begin, end - begin).to_pylist(), FINE)
            own, comp, n = ids[begin:end], comps[begin:end], sizes[begin:end]
            left, right = np.flatnonzero(side[begin:end] == 0), np.flatnonzero(side[begin:end] == 1)
            if not len(right):  # one block with itself: each pair has an end outside the largest component
                names, count = np.unique(comp, return_counts=True)
                left, right = left[comp[left] != names[count.argmax()]], left
            tree = CountTree(fine[right], n[right])
            a, b = [], []
            for i in left.tolist():
                hit = right[tree.search(fine[i], n[i], num, den)]
                hit = hit[comp[hit] != comp[i]]
                a.append(np.full(len(hit), own[i]))
                b.append(own[hit])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return run


def _bounded(num: int, den: int):
    """Pairs whose summed coordinate minima reach the needed overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_vectors(batch.column(c).to_pylist(), COARSE) for c in ("counts_a", "counts_b"))
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            good = np.minimum(a, b).sum(axis=1, dtype=np.int64) >= needed_overlap(n, m, num, den)
            yield batch.select(["a", "b"]).filter(pa.array(good))
    return run


def _verify(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                good = []
                for x, y in zip(shingle_sets(part.column("text_a"), width), shingle_sets(part.column("text"), width)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def _linked(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that hold on the whole texts."""
    joined = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a").join(texts.withColumnRenamed("set", "b"), "b")
    return joined.select("a", "b", "text_a", "text").mapInArrow(_verify(width, num, den), "a long, b long").distinct()


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of `docs` of which one per group of linked texts stays: that with the least id.

    Rows are grouped, not ids: of repeated rows one stays, and so of copies that share an id or have
    none (a null id comes after all others); two texts under one id are judged each by itself.  Null,
    empty and blank texts link with nothing and all stay.  All columns come back, whatever their names.
    """
    key = fresh("row", docs)
    rows = store(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(key, F.col(text_column).alias("text")), key, "text", width, num, den).select(F.col(key).alias("k"), F.col("component_id").alias("c"))
    ids = rows.select(F.col(key).alias("k"), F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col(key).alias("row")).alias("rank"))
    best = found.join(ids, "k").groupBy("c").agg(F.min("rank").alias("best")).select(F.col("best.row").alias(key))
    return rows.join(best, key, "left_semi").select(*docs.columns)


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of `docs`: the id, `n_shingles` and `component_id`.

    Null, empty and blank texts have no shingles: they link with nothing and are their own
    component.  Rows with a null id cannot be named; they are returned with a null component.
    Rows that repeat an id get the least component of its texts.  Other columns are ignored,
    whatever their names.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    facts = store(base.mapInArrow(_facts(width), "id long, n long, set long, counts binary, fine binary"), "sets")
    known = facts.where("n > 0 AND id IS NOT NULL")
    # A set has about 2.4 (den - num) / (den + num) n keys twice over at most, see Bands.
    rows = (known.agg(F.sum("n")).first()[0] or 0) * 5 * (den - num) // (den + num)
    keyed = base.where("id IS NOT NULL").mapInArrow(_emit(width, num, den), "key long, set long")
    tiles = keyed.repartition(partitions(spark, rows, 1_500_000), "key").mapInArrow(_tiles, "s1 long, s2 long, sets array<bigint>")
    tiles = store(tiles.groupBy("s1", "s2").agg(F.first("sets").alias("sets")).select("s1", "s2", "sets", F.array_min("sets").alias("least")), "tiles")
    member = tiles.select("s1", "s2", "least", F.explode("sets").alias("set"))

    points = known.join(member.select("set").distinct(), "set").groupBy("set").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("fine").alias("fine"))
    points = store(points, "points")
    texts = base.join(points.select("id", "set"), "id").select("set", "text").mapInArrow(_named(width), "set long, text string")
    texts = store(texts, "texts")
    pairs = member.where("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b")).distinct()
    side = lambda c: points.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "counts_a", "counts_b")
    links = store(_linked(pairs.mapInArrow(_bounded(num, den), "a long, b long"), texts, width, num, den), "links")
    found = components(links)

    at = member.join(found.withColumnRenamed("id", "set"), "set", "left").select("s1", "s2", "least", "set", F.coalesce("component", "set").alias("component"))
    several = at.groupBy("s1", "s2").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("s1", "s2")
    family = store(at.join(several, ["s1", "s2"]).select("least", "set", "component").distinct(), "families")
    size = family.groupBy("least").agg(F.count("*").alias("size"))
    blocks = family.join(size, "least").withColumn("count", F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("set", F.lit(3)), F.col("count")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("count") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    blocks = blocks.withColumn("meet", F.explode(meets)).select("least", "meet.x", "meet.y", "set", "component", F.when(F.col("block") == F.col("meet.x"), 0).otherwise(1).alias("side"))
    blocks = blocks.join(points.select("set", "n", "fine"), "set")
    rest = blocks.repartition(partitions(spark, family.count(), BLOCK), "least", "x", "y").mapInArrow(_search_families(num, den), "a long, b long").distinct()
    more = store(_linked(rest, texts, width, num, den), "links")
    if more.limit(1).count():
        found = components(links.union(more))

    # Classes that no link reaches are their own component; a component is named by its least document.
    placed = known.select("id", "set").join(found.withColumnRenamed("id", "set"), "set", "left").select("id", F.coalesce("component", "set").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(least, "component").groupBy("id").agg(F.min("component_id").alias("component_id"))
    return facts.select("id", "n").join(named, "id", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
