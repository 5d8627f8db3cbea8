"""N-gram Jaccard join: links between documents whose sets of word shingles are similar, as connected components.

Jaccard distance is a metric, but documents without a shared shingle all lie at distance 1 of each other: pivots alone can't
separate them.  So the space is first cut into cells in which similar sets must meet, and the metric does its work there.

*Cells.*  Let a set and a similar one, no smaller than the threshold times its size, differ in K elements at most.  If
hashing deals both sets' elements into K + 1 + z parts, at least z + 1 parts are the same in both.  Each part is a cell: a
key of the size class and the part's elements.  Empty parts are left out, unless a set has more than z of them.  A set takes part
for its own size class and for the class below.  Sets that meet in a cell are candidates if at least z + 1 bytes agree in their
signatures, a byte per part: a necessary condition again.  Of cells that hold the same sets one is looked at.  Components
of candidates are regions, and no similar pair lies across two of them.

*Crowded cells.*  A common passage gives a cell to every set that holds it.  A pair that meets in crowded cells only meets in as many of
them as either set must share with a similar one: z + 1, less its own empty parts.  With all of its cells ordered by their number of sets, a set
hence passes over as many of the most crowded as are one fewer than that; what is left of a cell still holds the rarest that a pair shares.  If
it holds more than ``CROWDED`` sets then, all are candidates.

*Regions.*  In a region pivots are chosen and all distances to them computed.  Sets within the threshold of a pivot are linked to it.
Each set goes to its nearest pivot's Voronoi cell, and to any other one whose pivot is at most twice the threshold
farther: by the triangle inequality a similar pair meets in a cell.  Cells are joined recursively until all their
sets are pivots.  Where windows don't separate (a crowd of near copies), the sets outside the largest
component found so far are compared with all sets, for within a component nothing is left to find.  A region too large for a
task is treated alike, its sets dealt in blocks.

Sets are named by 64-bit digests, shingles by 64-bit hashes.  Similarity itself is counted in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .common import Scratch, cut, fresh_path, small_side, table
from .flat_hash import Rolling, groups, mixed
from .graph import components

#: Pivots of a cell; sets of a region that one task takes.
PIVOTS, REGION = 8, 3000
SEEN, CROWDED = 200_000, 512
_U = np.uint64
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  Words are runs of other bytes than space and 9 to 13, A-Z in lower case."""
    n = len(data)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first = first[:n]
    start = np.flatnonzero(inside & (first | ~np.append(False, inside[:-1])))
    end = np.flatnonzero(inside & (np.append(first[1:], True) | ~np.append(inside[1:], False))) + 1
    w = Rolling(low).of(start, end)
    text = np.searchsorted(at, start, "right") - 1
    count = np.bincount(text, minlength=len(at) - 1)
    base = np.cumsum(count) - count
    place = np.arange(len(w)) - base[text]
    heads = np.flatnonzero(place <= np.maximum(0, count[text] - words))
    size = np.minimum(words, count[text[heads]])
    h = size.astype(np.uint64)
    w = np.append(w, np.zeros(words, np.uint64))
    for j in range(words):
        h += np.where(j < size, w[heads + j] * _PLACES[j], _U(0))
    h = mixed(h)
    cuts = np.searchsorted(text[heads], np.arange(len(at)))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def size_classes(num: int, den: int, most: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(largest size, K, parts) of each class of set sizes: similar sets lie in the same class or in neighbouring ones.

    A class is as wide as two steps of the threshold, so that about half of its sets can be similar to some of the class below.
    """
    out, lo = [], 1
    while lo <= most:
        hi = lo * den // num * den // num
        k = hi * (den - num) // num
        # As many more parts as a set of the least size leaves empty, and some: that many must agree besides.
        z = 1
        while z < 2 * k + 8 and (e := (k + 1 + z) * math.exp(-lo / (k + 1 + z))) + 2 * math.sqrt(e) > z:
            z += max(1, k // 50)
        out.append((hi, k, k + 1 + z))
        lo = hi + 1
    return out


@cache
def part_edges(parts: int) -> np.ndarray:
    return (np.array([-(-j * (1 << 32) // parts) for j in range(1, parts)], np.uint64)) << _U(32)


def cell_keys(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, bytes]:
    """Keys of the cells of a sorted set, the size class in their last ten bits, and a byte for each part of its own class and of the class below, if it can be similar to sets there."""
    return cells(s, num, den)[:2]


def cells(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, bytes, list[int]]:
    """``cell_keys``, and the set's class with the least number of cells that it shares with a similar set, in its own class and in the class below."""
    classes = size_classes(num, den)
    own = int(np.searchsorted(_tops(num, den), len(s)))
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mixed(s), out=sums[1:])
    out, marks, needs = [], b"", [own, 1, 1]
    for c in (own, own - 1):
        if c < 0 or not classes[c][1] or (c < own and num * len(s) > den * classes[c][0]):
            continue
        _, k, parts = classes[c]
        cut_at = np.concatenate([[0], np.searchsorted(s, part_edges(parts)), [len(s)]])
        key = mixed(sums[cut_at[1:]] - sums[cut_at[:-1]] + (np.arange(parts, dtype=np.uint64) + (_U(c) << _U(40))) * _PLACES[0])
        marks += (key >> _U(56)).astype(np.uint8).tobytes()
        key = key & ~_U(1023) | _U(c)
        empty = cut_at[1:] == cut_at[:-1]
        out.append(key if empty.sum() >= parts - k else key[~empty])
        # Similar sets agree in parts - k parts, of which the empty ones may be no cells.
        needs[1 + own - c] = max(1, parts - k - int(empty.sum()))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), marks, needs


def agreeing(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, marks: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that meet in a cell and whose signatures agree as far as similar sets' must, enough to connect all such pairs; rows are sorted by key."""
    classes, tops = size_classes(num, den), _tops(num, den)
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    a, b = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        c = int(keys[lo]) & 1023
        _, k, parts = classes[c]
        rows = []
        for i in range(lo, hi):
            own = int(np.searchsorted(tops, sizes[i]))
            skip = 0 if own == c else classes[own][2] if classes[own][1] else 0
            rows.append(np.frombuffer(marks[i], np.uint8, parts, skip))
        m = np.stack(rows)
        left = np.arange(len(m))
        while len(left) > 1:  # a tree of each component, not all its pairs
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                i = reached.pop()
                hit = (m[left] == m[i]).sum(1) >= parts - k
                j, left = left[hit], left[~hit]
                a.append(nodes[lo + j])
                b.append(np.full(len(j), nodes[lo + i]))
                reached.extend(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


@cache
def _tops(num: int, den: int) -> np.ndarray:
    return np.array([hi for hi, _, _ in size_classes(num, den)])


class Region:
    """Some sets, the components found among them, and how often two sets meet."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.n = num, den, np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.n)
        _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        again = count[col] > 1  # elements that one set alone has meet nothing
        fresh = np.cumsum(count > 1) - 1
        col, owner = fresh[col[again]], owner[again]
        order = np.argsort(col, kind="stable")
        self.col, self.owner = col[order], owner[order]
        self.width = int((count > 1).sum())
        self.up = np.arange(len(sets))

    def meets(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Sizes of intersections."""
        out = np.zeros((len(rows), len(cols)), np.float32)
        at_r, at_c = np.full(len(self.n), -1), np.full(len(self.n), -1)
        at_r[rows], at_c[cols] = np.arange(len(rows)), np.arange(len(cols))
        use = (at_r[self.owner] >= 0) | (at_c[self.owner] >= 0)
        col, owner = self.col[use], self.owner[use]
        if len(col):
            col = np.cumsum(np.append(0, col[1:] != col[:-1]))
        step = max(256, 4_000_000 // (len(rows) + len(cols)))
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
            a, b = np.searchsorted(col, [lo, lo + step])
            c, o = col[a:b] - lo, owner[a:b]
            x, y = np.zeros((len(rows), step), np.float32), np.zeros((len(cols), step), np.float32)
            k = at_r[o] >= 0
            x[at_r[o[k]], c[k]] = 1
            k = at_c[o] >= 0
            y[at_c[o[k]], c[k]] = 1
            out += x @ y.T
        return out

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def link(self, rows: np.ndarray, cols: np.ndarray, meet: np.ndarray) -> None:
        union = self.n[rows][:, None] + self.n[cols][None, :] - meet
        for i, j in zip(*np.nonzero(self.den * meet.astype(np.float64) >= self.num * union.astype(np.float64)), strict=True):
            a, b = self.root(int(rows[i])), self.root(int(cols[j]))
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def compare(self, rows: np.ndarray, cols: np.ndarray) -> None:
        for lo in range(0, len(rows), 256):
            part = rows[lo : lo + 256]
            self.link(part, cols, self.meets(part, cols))

    def join(self, who: np.ndarray) -> None:
        """All links among ``who``, up to connection."""
        if len(who) <= PIVOTS:  # all are pivots
            self.compare(who, who)
            return
        pivots = who[np.linspace(0, len(who) - 1, PIVOTS).astype(int)]
        meet = self.meets(pivots, who)
        self.link(pivots, who, meet)
        far = 1 - meet / (self.n[pivots][:, None] + self.n[who][None, :] - meet)
        slack = 2 * (self.den - self.num) / self.den + 1e-6
        cells = [who[row <= far.min(0) + slack] for row in far]
        if max(map(len, cells)) <= 0.7 * len(who):
            for c in cells:
                self.join(c)
            return
        roots = np.array([self.root(int(i)) for i in who])
        names, count = np.unique(roots, return_counts=True)
        self.compare(who[roots != names[count.argmax()]], who)


def _sets_of(binary: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in binary]


def document_sets(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """A row per document: id, n_shingles, node (digest of its set, null if empty), t1 and t2 (digests of the text), keys, marks and needs (of its cells, once per set and task)."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, at in flat.blocks(batch, "text"):
                size, node, keys, marks, needs = [], [], [], [], []
                for s in shingle_sets(data, at, words):
                    name = int((mixed(s).sum(dtype=np.uint64) ^ mixed(np.array([len(s)], np.uint64))[0]).view(np.int64)) if len(s) else None
                    size.append(len(s))
                    node.append(name)
                    if name is None or name in seen:
                        keys.append(None)
                        marks.append(None)
                        needs.append(None)
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        key, mark, need = cells(s, num, den)
                        keys.append(key.view(np.int64))
                        marks.append(mark)
                        needs.append(need)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), part.column("t1"), part.column("t2"), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(needs, pa.list_(pa.int32()))], ["id", "n_shingles", "node", "t1", "t2", "keys", "marks", "needs"])

    return rows.mapInArrow(flat.tidy(run), f"id {kind}, n_shingles long, node long, t1 long, t2 long, keys array<long>, marks binary, needs array<int>")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``id_col``, n_shingles, component_id (the least id reachable by links), t1 and t2 (xxhash64 of the text and of 1 and the text), and root of each row.

    ``root`` names the component, also where ids repeat; it is null for rows that are alone.

    Two documents link when ``den * |A & B| >= num * |A | B|``.  Texts of fewer than ``words`` words have one shingle, the
    whole sequence; texts without words and null ones have none, link with nothing and are components of their own.  Rows
    with the same set always link, so rows that repeat are of one component.  A null id is never the least unless no other id is
    there.  Whole texts count however long they are: a task holds the set of one text at a time.  Other columns of ``docs`` aren't
    read.  An empty table gives an empty result.
    """
    if not 0 < num < den or not 1 <= words <= len(_PLACES):
        raise ValueError("0 < num < den and 1 to 8 words are needed")
    held = Scratch(docs.sparkSession)
    sets = held.keep(document_sets(docs, id_col, text_col, words, num, den), "shingles")
    rows, links = _links(docs, text_col, sets, held, words, num, den)
    roots = held.keep(components(links), "roots")
    held.drop(links)
    # A component's least id is settled on its nodes, so that a row is joined once.
    each = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    some = held.keep(each.join(small_side(roots), "node", "left").where("n > 1 or root is not null").select("node", "least", F.coalesce("root", "node").alias("root")), "nodes")
    least = held.keep(some.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = held.keep(some.join(small_side(least), "root").select("node", "component_id", "root"), "named")
    held.drop(roots, some, least)
    # Texts without words have no node, and stay out of the join.
    met = rows.where("node is not null").join(small_side(named), "node", "left")
    out = met.unionByName(rows.where("node is null"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "t1", "t2", "root")


def _meetings(sets: DataFrame, held: Scratch) -> DataFrame:
    """A written table (key, node, least, crowd, times) of the cells in which several sets meet, with the least one and their number; of cells with the same sets and class only one, and how many there are."""
    each = sets.where("keys is not null").select("node", F.explode("keys").alias("key"))
    cell = Window.partitionBy("key")
    meet = each.withColumn("lo", F.min("node").over(cell)).withColumn("hi", F.max("node").over(cell)).where("lo < hi").select("key", "node")
    meet = held.keep(meet.groupBy("key", "node").agg(F.lit(1).alias("one")).select("key", "node"), "meet")
    # Near copies meet in most of their cells: their signatures needn't travel to each of them.
    whose = meet.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    one = held.keep(whose.groupBy(F.col("key").bitwiseAND(F.lit(1023)).alias("size_class"), "n", "x", "y").agg(F.min(F.struct("key", "least")).alias("one"), F.count(F.lit(1)).alias("times")).select("one.*", F.col("n").alias("crowd"), "times"), "one")
    out = held.keep(meet.join(small_side(one), "key"), "meet")
    held.drop(meet, one)
    return out


def _uncrowded(meet: DataFrame, marks: DataFrame, held: Scratch) -> DataFrame:
    """A written table (key, node, least, crowd) of what is left of the crowded cells of ``meet``.

    A set stays in a cell if this and its more crowded ones are as many as a similar set must share.  The order of cells is the same
    for all sets, so of the cells that a pair shares, both stay in the rarest.
    """
    which = F.col("key").bitwiseAND(F.lit(1023))
    full = meet.where(F.col("crowd") > CROWDED).join(marks.select("node", "needs"), "node").withColumn("size_class", which)
    need = F.element_at("needs", (F.col("needs")[0] - F.col("size_class") + 2).cast("int"))
    down = Window.partitionBy("node", "size_class").orderBy(F.desc("crowd"), F.desc("key"))
    full = full.withColumn("up_to", F.sum("times").over(down)).where(F.col("up_to") >= need).select("key", "node")
    full = held.keep(full, "crowded")
    each = full.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    out = held.keep(full.join(small_side(each), "key"), "crowded")
    held.drop(full)
    return out


def _links(docs: DataFrame, text_col: str, sets: DataFrame, held: Scratch, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sets`` without keys and marks, and edges a, b between nodes, enough to connect all that is linked; both are written tables, ``sets`` is dropped."""
    spark = docs.sparkSession
    meet = _meetings(sets, held)
    named = held.keep(meet.select("node").distinct(), "named")
    marks = held.keep(sets.where("marks is not null").join(small_side(named), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("marks").alias("marks"), F.first("needs").alias("needs")), "marks")
    rows = held.keep(sets.drop("keys", "marks", "needs"), "rows")
    held.drop(sets, named)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = meet.where(F.col("crowd") <= CROWDED).select("key", "node")
    crowded = _uncrowded(meet, marks, held)
    few = few.unionByName(crowded.where(F.col("crowd") <= CROWDED).select("key", "node"))
    met = few.join(marks.drop("needs"), "node").repartition(parts, "key").sortWithinPartitions("key", "node")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key"], 5000):
            a, b = agreeing(t.column("key").to_numpy(), t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("marks").to_pylist(), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    near = met.select("key", "node", "n", "marks").mapInArrow(flat.tidy(agree), "a long, b long")
    # Crowds go to no task.
    near = near.unionByName(crowded.where((F.col("crowd") > CROWDED) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b")))
    near = held.keep(near.distinct(), "near")
    held.drop(meet, marks, crowded)
    region = held.keep(components(near).withColumnRenamed("root", "region"), "region")
    held.drop(near)
    crowd = region.groupBy("region").agg(F.count(F.lit(1)).alias("crowd"))
    one = rows.where("node is not null").join(small_side(region.select("node")), "node", "left_semi").groupBy("node").agg(F.min(F.struct("t1", "t2")).alias("t"))
    wanted = held.keep(one.select("node", "t.*").join(small_side(region), "node").join(small_side(crowd), "region"), "wanted")
    crowd = held.keep(crowd.where(F.col("crowd") > REGION), "crowd")
    held.drop(region)

    text = F.coalesce(docs[text_col], F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    texts = texts.join(small_side(wanted.select("t1", "t2")), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted, ["t1", "t2"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in flat.blocks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                found = [s.tobytes() for s in shingle_sets(data, at, words)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("region", "crowd", "node")), pa.array(found, pa.binary())], ["region", "crowd", "node", "set"])

    full = texts.select("region", "crowd", "node", "text").mapInArrow(flat.tidy(again), "region long, crowd long, node long, set binary")
    usual = full.where(F.col("crowd") <= REGION).select("region", "node", "set").repartition(parts, "region").sortWithinPartitions("region", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["region"], 200):
            which, node, found = t.column("region").to_numpy(), t.column("node").to_numpy(), _sets_of(t.column("set").to_pylist())
            cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                r = Region(found[lo:hi], num, den)
                r.join(np.arange(hi - lo))
                yield _edges(node[lo:hi], r)

    out = usual.mapInArrow(flat.tidy(join), "a long, b long")
    if not crowd.isEmpty():
        out = out.unionByName(_crowds(full.where(F.col("crowd") > REGION), parts, num, den))
    out = held.keep(out, "links")
    held.drop(wanted, crowd)
    return rows, out


def _edges(node: np.ndarray, r: Region) -> pa.RecordBatch:
    root = np.array([r.root(i) for i in range(len(node))], np.int64)
    apart = root != np.arange(len(node))
    return pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(node[root[apart]])], ["a", "b"])


def _crowds(full: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Links in regions too large for a task.

    Every set is compared with its region's pivots.  The sets that link with the pivot of most links are one component; those
    outside are dealt into blocks, each compared with each block of the region.
    """
    path = fresh_path(full.sparkSession, "crowds")
    full.write.parquet(path)
    full = full.sparkSession.read.parquet(path)
    rank = F.xxhash64(F.lit(7), "node")
    pivots = full.groupBy("region").agg(F.min(F.struct(rank, F.col("node").alias("n"), F.col("set").alias("s"))).alias("p0"), F.max(F.struct(rank, F.col("node").alias("n"), F.col("set").alias("s"))).alias("p1"))
    pivots = cut(pivots)
    near = full.join(pivots, "region")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets_of(batch.column("set").to_pylist())
            hit = []
            for p in ("s0", "s1"):
                seen = _sets_of(batch.column(p).to_pylist())
                meet = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(sets, seen, strict=True)]
                hit.append(pa.array([den * m >= num * (len(a) + len(b) - m) for a, b, m in zip(sets, seen, meet, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("region", "node", "n0", "n1")), *hit], ["region", "node", "n0", "n1", "h0", "h1"])

    got = near.select("region", "node", "set", F.col("p0.n").alias("n0"), F.col("p0.s").alias("s0"), F.col("p1.n").alias("n1"), F.col("p1.s").alias("s1"))
    got = cut(got.mapInArrow(flat.tidy(measure), "region long, node long, n0 long, n1 long, h0 boolean, h1 boolean"))
    star = got.select(F.explode(F.array(F.when(F.col("h0"), F.struct(F.col("node").alias("a"), F.col("n0").alias("b"))), F.when(F.col("h1"), F.struct(F.col("node").alias("a"), F.col("n1").alias("b"))))).alias("e")).where("e is not null").select("e.*")
    most = got.groupBy("region").agg((F.count_if("h0") >= F.count_if("h1")).alias("first"), F.greatest(F.count_if("h0"), F.count_if("h1")).alias("in"), F.count(F.lit(1)).alias("all"))
    rest = got.join(most, "region").where(~F.when(F.col("first"), F.col("h0")).otherwise(F.col("h1"))).select("region", "node")
    half = REGION // 2
    dealt = most.withColumn("out_blocks", F.ceil((F.col("all") - F.col("in")) / half)).withColumn("blocks", F.ceil(F.col("all") / half)).where("out_blocks > 0")
    sets = full.join(dealt.select("region", "out_blocks", "blocks"), "region").join(rest.withColumn("out", F.lit(True)), ["region", "node"], "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    own = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("out_blocks"))
    as_all = sets.select("region", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("i"), block.alias("j"), F.lit(False).alias("out"), "node", "set")
    as_out = sets.where("out").select("region", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("out"), "node", "set")
    tasks = as_all.unionByName(as_out).repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["region", "i", "j"], 1):
            keys = [t.column(c).to_numpy() for c in ("region", "i", "j")]
            change = np.zeros(t.num_rows, bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = t.slice(lo, hi - lo)
                out = part.column("out").to_numpy()
                r = Region(_sets_of(part.column("set").to_pylist()), num, den)
                if out.any() and not out.all():
                    r.compare(np.flatnonzero(out), np.flatnonzero(~out))
                yield _edges(part.column("node").to_numpy(), r)

    return star.unionByName(tasks.mapInArrow(flat.tidy(compare), "a long, b long"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near duplicates: one row of each component stays, that with the least doc_id.

    A row without id stays only if its whole component has none.  Of different texts with the least id the one of least digest stays,
    and of rows that repeat both id and text one.  Texts without words are all different, and stay.  An empty table gives an empty result.
    """
    met = cut(similar_components(docs, words=words, num=num, den=den).where("root is not null").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2").alias("row")))
    best = cut(met.groupBy("root").agg(F.min("row").alias("best")))
    judged = met.join(small_side(best), "root").groupBy("row").agg(F.first(F.col("row") == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = cut(judged.where("not stays or n > 1").select(F.col("row.doc_id").alias("__nj_id"), F.col("row.t1").alias("__nj_t1"), F.col("row.t2").alias("__nj_t2"), "stays"))
    text = F.coalesce(docs["text"], F.lit(""))
    on = docs["doc_id"].eqNullSafe(F.col("__nj_id")) & (F.xxhash64(text) == F.col("__nj_t1")) & (F.xxhash64(F.lit(1), text) == F.col("__nj_t2"))
    out = docs.join(small_side(marked), on, "left_anti")
    again = marked.where("stays")
    if again.isEmpty():
        return out
    # Rows that repeat: one of each, chosen before the shuffle.
    one = docs.join(small_side(again), on, "left_semi").groupBy("doc_id", F.xxhash64(text)).agg(F.first(F.struct(*docs.columns)).alias("__nj_row"))
    return out.unionByName(one.select("__nj_row.*"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    out = similar_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
k AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS at FROM n UNION SELECT r.node, k.y FROM r JOIN k ON k.x = r.at)
SELECT n.doc_id, n.n AS n_shingles, min(r.at) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""
