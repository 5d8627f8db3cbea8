"""Removal of byte strings that occur more than once, by a sorted array of sampled suffixes.

A *window* is a string of ``length`` bytes; every byte in a window that starts anywhere else too is removed.  Sorting
all suffixes of a corpus moves hundreds of bytes for each byte of text, so only suffixes at *anchors* are sorted: the anchor of
a window is the leftmost position of least hash among its first ``reach + 1`` positions, a function of the window's bytes
alone.  Equal windows thus have their anchors at the same distance from their starts, and nothing is lost.

1. Each anchor gives a digest of its core, the ``length - reach`` bytes from it on that all its windows contain, and one of
   its context, the union of its windows.  A core that occurs once can't belong to a repeat.
2. Of anchors whose core repeats, those whose whole context repeats are removed with all their windows.
3. The others' contexts, one of each kind, are range-partitioned by sampled splitters on leading bytes.  Each bucket sorts
   its suffixes by multikey quicksort on words of eight bytes, and the common prefixes of neighbours give for each
   suffix the suffixes it shares ``r`` bytes with; compared with the ``l`` bytes shared on the left, windows repeat
   exactly if ``l + r >= length``.  Buckets are only cut between different leading bytes and cores, and a core never
   crosses a cut, so no comparison across a boundary is missed.
4. A core with more than ``CROWD`` kinds of context isn't gathered in a bucket: its windows are counted by digest,
   added up before the shuffle.

Equality of cores and contexts is that of 64-bit digests in groups of equal digest; common prefixes are compared as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import BROADCAST_ROWS, cut, small_side, table
from .flat_hash import Rolling, groups, mixed

LENGTH, REACH, GRAM = 400, 256, 16
SEGMENT = 1 << 20
CROWD, PAIRED, TOGETHER, SEEN = 50_000, 32, 20_000, 200_000
_U = np.uint64
PLACE = _U(SEGMENT.bit_length())


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both sides of blocks."""
    n = len(key) - width + 1
    if n <= 0:
        return key[:0]
    full = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of texts given flat: text number, anchor, first and last window start that it serves (positions in ``data``), core and context digest."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    size = np.diff(at)
    windows = np.maximum(0, size - length + 1)
    if not windows.sum():
        return none
    one, two = Rolling(data, 0), Rolling(data, 1)
    n = len(data) - GRAM + 1
    h = (one.sums[GRAM:] - one.sums[:n]) * one.inverse[:n]
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    # Places fit in the low bits of any block, so that the part of the hash that decides doesn't depend on the block.
    key = (h >> PLACE << PLACE) | np.arange(n, dtype=np.uint64)
    least = sliding_least(key, reach + 1) & ((_U(1) << PLACE) - _U(1))
    text = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + at[:-1][text]
    a = least[start].astype(np.int64)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(a)) - 1
    a, first, last, text = a[lo], start[lo], start[hi], text[lo]
    core = one.of(a, a + (length - reach))
    context = mixed(two.of(first, last + length) ^ ((a - first).astype(np.uint64) << _U(32)) ^ (last - first).astype(np.uint64))
    return text, a, first, last, core, context


def segments(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset in its text, bytes, offsets), of fewer than two ``SEGMENT`` each: a block of whole texts as it is, a long text by stretches of its windows."""
    if len(at) == 2 and at[1] > SEGMENT:
        for s in range(0, int(at[1]) - length + 1, SEGMENT):
            e = min(int(at[1]), s + SEGMENT + length - 1)
            yield s, data[s:e], np.array([0, e - s])
    else:
        yield 0, data, at


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned words: sorted by a word, each run of equals is sorted by the next one."""
    order = np.arange(len(words))
    open_lo, open_n = np.array([0]), np.array([len(words)])
    for w in range(words.shape[1]):
        wide = open_n > 1
        open_lo, open_n = open_lo[wide], open_n[wide]
        if not len(open_lo):
            break
        run = np.repeat(np.arange(len(open_lo)), open_n)
        at = np.arange(len(run)) - np.repeat(np.cumsum(open_n) - open_n, open_n) + np.repeat(open_lo, open_n)
        col = words[order[at], w]
        sub = np.lexsort((col, run))
        order[at] = order[at][sub]
        col = col[sub]
        new = np.ones(len(col), bool)
        new[1:] = (col[1:] != col[:-1]) | (run[1:] != run[:-1])
        lo = np.flatnonzero(new)
        open_n = np.diff(np.append(lo, len(col)))
        open_lo = at[lo]
    return order


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading bytes of each row agree."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def shared_extents(right: np.ndarray, left: np.ndarray, right_n: np.ndarray, left_n: np.ndarray, core: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the most bytes left and right of its anchor that repeated windows cover; 0 where none does.

    ``right``: bytes from the anchor on; ``left``: bytes before it, nearest first; ``right_n`` and ``left_n``: how many there are, as
    rows are filled up with zeros, which never count.  Contexts of different cores share nothing.
    """
    m, reach = len(right), left.shape[1]
    far_l, far_r = np.zeros(m, np.int64), np.zeros(m, np.int64)
    order = multikey_sort(np.concatenate([core.astype(np.uint64)[:, None], big_words(right)], 1))
    r, lf, c, rn, ln = right[order], left[order], core[order], right_n[order], left_n[order]
    lcp = np.zeros(m, np.int64)  # with the row before
    for lo in range(1, m, 8192):
        hi = min(m, lo + 8192)
        lcp[lo:hi] = np.where(c[lo:hi] == c[lo - 1 : hi - 1], common(r[lo:hi], r[lo - 1 : hi - 1]), -1)
    run = np.cumsum(np.append(True, c[1:] != c[:-1])) - 1
    n_run = np.bincount(run)

    def note(i: np.ndarray, to_left: np.ndarray, to_right: np.ndarray) -> None:
        np.maximum.at(far_l, order[i], to_left)
        np.maximum.at(far_r, order[i], to_right)

    live = np.flatnonzero(n_run[run] <= PAIRED + 1)
    least = np.full(len(live), 1 << 40)
    for d in range(1, PAIRED + 1):  # rows d places apart share the least of the common prefixes between them
        ok = live + d < m
        live, least = live[ok], least[ok]
        least = np.minimum(least, lcp[live + d])
        ok = least >= length - reach
        live, least = live[ok], least[ok]
        for lo in range(0, len(live), 8192):
            i = live[lo : lo + 8192]
            rr = np.minimum(least[lo : lo + 8192], np.minimum(rn[i], rn[i + d]))
            ll = np.minimum(common(lf[i], lf[i + d]), np.minimum(ln[i], ln[i + d]))
            hit = ll + rr >= length
            i, ll, rr = i[hit], ll[hit], rr[hit]
            note(i, ll, rr)
            note(i + d, ll, rr)

    for g in np.flatnonzero(n_run > PAIRED + 1):  # many contexts: classes of equal windows for each distance from the anchor
        rows = np.flatnonzero(run == g)
        by_left = multikey_sort(big_words(lf[rows]))
        near = lf[rows[by_left]]
        same_left = np.append(-1, common(near[1:], near[:-1]))
        same_right = np.append(-1, lcp[rows[1:]])
        cls = np.empty(len(rows), np.int64)
        for dist in range(reach + 1):
            valid = np.flatnonzero((rn[rows] >= length - dist) & (ln[rows] >= dist))
            if len(valid) < 2:
                continue
            cls[by_left] = np.cumsum(same_left < dist)
            both = np.cumsum(same_right < length - dist) * (len(rows) + 1) + cls
            _, back, n = np.unique(both[valid], return_inverse=True, return_counts=True)
            hit = rows[valid[n[back] > 1]]
            note(hit, np.full(len(hit), dist), np.full(len(hit), length - dist))
    return far_l, far_r


def big_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as numbers of eight bytes that compare alike."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def padded_rows(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as rows of ``width`` bytes filled up with zeros, and the sizes."""
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    size = np.diff(at)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    if len(row):
        out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return out, size


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    lo = np.flatnonzero(new)
    return start[lo], end[np.append(lo[1:], len(start)) - 1]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null as empty) and two digests that name the text; rows with equal texts share them, and all that follows."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def texts_of(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """k1, k2 and text, once, of the rows that ``keys`` names; only these texts are shuffled where the keys are few."""
    few = small_side(keys.select("k1", "k2"))
    return keyed.join(few, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """k1, k2, starts, ends and n_removed: what is removed from each of ``keyed_texts`` that loses bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            names = list(zip(whole.column("k1").to_pylist(), whole.column("k2").to_pylist(), strict=True))
            if len(seen) + len(names) > SEEN:
                seen.clear()
            fresh = [i for i, x in enumerate(names) if x not in seen and not seen.add(x)]
            batch = whole.take(pa.array(fresh, pa.int64()))
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for row, _, data, at in flat.blocks(batch, "text", SEGMENT):
                for skip, part, part_at in segments(data, at, length):
                    doc, a, first, last, core, context = anchors(part, part_at, length, reach)
                    place = (a - part_at[doc] + skip) << 20 | (a - last) << 10 | (a - first)
                    yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), pa.array(k1[row + doc]), pa.array(k2[row + doc]), pa.array(place)], ["core", "context", "k1", "k2", "place"])

    long_rows = keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text")
    found = long_rows.mapInArrow(flat.tidy(find), "core long, context long, k1 long, k2 long, place long")
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1")
    # Settled first, so that the join can be split where a core is very common.
    cores = cut(cores.select("core", (F.col("c0") == F.col("c1")).alias("alike")))
    shared = cut(found.join(cores, "core"))

    kinds = shared.where("not alike").groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    kinds = cut(kinds)
    copies = shared.where("not alike").join(kinds.where("n > 1").select("core", "context"), ["core", "context"])
    anchor, near, far = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(0x3FF)), F.col("place").bitwiseAND(F.lit(0x3FF))
    whole = shared.where("alike").select("k1", "k2", "place").unionByName(copies.select("k1", "k2", "place"))
    whole = whole.select("k1", "k2", (anchor - far).alias("a"), (anchor + length - near).alias("b"))
    # A task gives the anchors of a text once, however many copies it reads: copies are known by their number and go whole.
    copied = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("b")).where((F.col("n") > 1) & (F.col("b") >= length))
    both = whole.unionByName(_compare(keyed, kinds, length, reach)).unionByName(copied.select("k1", "k2", F.lit(0).cast("long").alias("a"), "b"))
    lists = both.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("ab"))  # no longer than the document

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ab = batch.column("ab")
            at, values = ab.offsets.to_numpy(), ab.values
            starts, ends = values.field("a").to_numpy(), values.field("b").to_numpy()
            got = [merged(starts[i:j], ends[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            lists = [pa.array([x[k] for x in got], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *lists, pa.array([int((e - s).sum()) for s, e in got], pa.int64())], ["k1", "k2", "starts", "ends", "n_removed"])

    return lists.mapInArrow(flat.tidy(merge), "k1 long, k2 long, starts array<long>, ends array<long>, n_removed long")


CONTEXT = "core long, copies long, crowd long, k1 long, k2 long, place long, right binary, left binary"


def _compare(keyed: DataFrame, kinds: DataFrame, length: int, reach: int) -> DataFrame:
    """k1, k2, a, b: what is removed around the anchors whose context is the only one of its kind in a core of several kinds."""
    per_core = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("crowd"))
    listed = kinds.join(per_core, "core").select("core", F.col("n").alias("copies"), "crowd", "one.*")
    by_doc = cut(listed.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "copies", "crowd", "place")).alias("at")))  # no longer than the document

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = (batch.column("text")[row].as_py() or "").encode()
                at = batch.column("at")[row].values
                core, copies, crowd, place = (at.field(f) for f in ("core", "copies", "crowd", "place"))
                p = place.to_numpy()
                a, near, far = p >> 20, p >> 10 & 0x3FF, p & 0x3FF
                for lo in range(0, len(p), 4000):
                    s = slice(lo, lo + 4000)
                    right = [raw[x:y] for x, y in zip(a[s].tolist(), (a + length - near)[s].tolist(), strict=True)]
                    left = [raw[x:y][::-1] for x, y in zip((a - far)[s].tolist(), a[s].tolist(), strict=True)]
                    n = len(right)
                    keys = [pa.array(np.full(n, batch.column(k)[row].as_py(), np.int64)) for k in ("k1", "k2")]
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in (core, copies, crowd)), *keys, place.slice(lo, n), pa.array(right, pa.binary()), pa.array(left, pa.binary())], [x.split()[0] for x in CONTEXT.split(", ")])

    full = texts_of(keyed, by_doc).join(by_doc, ["k1", "k2"]).mapInArrow(flat.tidy(contexts), CONTEXT)
    parts = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = full.where(F.col("crowd") <= CROWD).drop("crowd").withColumn("lead", F.substring("right", 1, 24))
    buckets = buckets.repartitionByRange(parts, "lead", "core").sortWithinPartitions("core")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["core"], TOGETHER):
            (right, right_n), (left, left_n) = (padded_rows(pa.concat_arrays(t.column(c).chunks), w) for c, w in (("right", length), ("left", reach)))
            far_l, far_r = shared_extents(right, left, right_n, left_n, t.column("core").to_numpy().view(np.uint64), length)
            hit = np.flatnonzero((far_l + far_r >= length) & (t.column("copies").to_numpy() == 1))
            a = t.column("place").to_numpy() >> 20
            yield pa.RecordBatch.from_arrays([pa.array(t.column("k1").to_numpy()[hit]), pa.array(t.column("k2").to_numpy()[hit]), pa.array((a - far_l)[hit]), pa.array((a + far_r)[hit])], ["k1", "k2", "a", "b"])

    out = buckets.select("core", "copies", "k1", "k2", "place", "right", "left").mapInArrow(flat.tidy(resolve), "k1 long, k2 long, a long, b long")
    if not per_core.where(F.col("crowd") > CROWD).isEmpty():
        out = out.unionByName(_count_windows(full.where(F.col("crowd") > CROWD), length))
    return out


def _count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for cores of very many kinds: windows by digest, counted before the shuffle."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, place, right, left in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "place", "right", "left")), strict=True):
                data = np.frombuffer(left[::-1] + right, np.uint8)
                start = np.arange(len(data) - length + 1)
                h = Rolling(data).of(start, start + length).view(np.int64)
                a = (place >> 20) - len(left) + start
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(a), k1)), pa.array(np.full(len(a), k2)), pa.array(a)], ["h", "k1", "k2", "a"])

    each = contexts.select("k1", "k2", "place", "right", "left").mapInArrow(flat.tidy(windows), "h long, k1 long, k2 long, a long")
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return each.join(often, "h").select("k1", "k2", "a", (F.col("a") + length).alias("b"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """Of each row ``id_col``, n_bytes, n_removed, starts and ends of the maximal removed runs, kept: the other bytes, and left: the characters of which no byte is removed.

    Null and empty texts, and those of fewer than ``length`` bytes, lose nothing.  Rows that repeat are copies of each other: all their
    bytes go if they are long enough.  Texts of any length are searched, long ones by stretches that share their borders' windows.
    Matches never cross documents.  Other columns of ``docs`` aren't read.  An empty table gives an empty result.
    """
    if not GRAM + reach <= length or reach > 1000:
        raise ValueError("reach must be at most 1000, and length at least reach + 16")
    spark = docs.sparkSession
    keyed = keyed_texts(docs, id_col, text_col)
    spans = cut(repeated_spans(keyed, length, reach))
    n_bytes = F.octet_length("text").cast("long")
    # Texts with more copies than a partition has rows, of which there can't be more than partitions, don't go through the join.
    share = max(2, -(-keyed.count() // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    common_texts = cut(keyed.where(n_bytes >= length).groupBy("k1", "k2").count().where(F.col("count") > share).select("k1", "k2", F.lit(True).alias("all_gone")))
    rows = keyed.join(F.broadcast(common_texts), ["k1", "k2"], "left")
    moved = (n_bytes >= length) & F.col("all_gone").isNull()
    if spans.count() <= BROADCAST_ROWS:  # texts that lose nothing aren't moved
        rows = rows.join(F.broadcast(spans.select("k1", "k2", F.lit(True).alias("some"))), ["k1", "k2"], "left")
        moved = moved & F.col("some").isNotNull()
    stay = rows.where(~moved).withColumns({"starts": F.when(F.col("all_gone"), F.array(F.lit(0).cast("long"))), "ends": F.when(F.col("all_gone"), F.array(n_bytes))})
    lose = rows.where(moved).join(spans.select("k1", "k2", "starts", "ends"), ["k1", "k2"], "left")
    none = F.array().cast("array<long>")
    whole = stay.unionByName(lose).select("id", n_bytes.alias("n_bytes"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.col("text").cast("binary").alias("kept"))
    kind = docs.schema[id_col].dataType.simpleString()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                kept, left = [], []
                for raw, starts, ends in zip(*(part.column(c).to_pylist() for c in ("kept", "starts", "ends")), strict=True):
                    pieces = [raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)] if starts else [raw]
                    kept.append(b"".join(pieces))
                    left.append("".join(x.decode(errors="ignore") for x in pieces))
                gone = [n - len(k) for n, k in zip(part.column("n_bytes").to_pylist(), kept, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(gone, pa.int64()), part.column("starts"), part.column("ends"), pa.array(kept, pa.binary()), pa.array(left, pa.string())], ["id", "n_bytes", "n_removed", "starts", "ends", "kept", "left"])

    out = whole.mapInArrow(flat.tidy(strip), f"id {kind}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary, left string")
    return out.withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: n_kept, the bytes left, and text, the characters that are left whole."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.col("left").alias("text"))


def _doubled(k: int) -> str:
    return f"h{2 * k} AS (SELECT *, hash(h{k}, lead(h{k}, {k}) OVER p) AS h{2 * k} FROM {'b' if k == 1 else f'h{k}'} WINDOW p AS (PARTITION BY doc_id ORDER BY pos))"


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
b AS (SELECT doc_id, unnest(x) AS h1, unnest(range(0, len(x))) AS pos, len(x) AS n FROM d),
{", ".join(_doubled(1 << k) for k in range(8))},
w AS (SELECT doc_id, pos, n, h1, CASE WHEN pos + 400 <= n THEN hash(h256, lead(h128, 256) OVER p, lead(h16, 384) OVER p) END AS w FROM h256 WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS again FROM w),
g AS (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS 399 PRECEDING) AS gone FROM r),
s AS (SELECT *, gone = 1 AND lag(gone, 1, 0) OVER p = 0 AS first, sum((h1 NOT BETWEEN '80' AND 'BF')::INT) OVER p AS ch FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, max(gone) OVER (PARTITION BY doc_id, ch) AS cut FROM s),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (first)::BIGINT AS n_spans, coalesce(string_agg(h1, '' ORDER BY pos) FILTER (gone = 0), '') AS kept,
  coalesce(string_agg(h1, '' ORDER BY pos) FILTER (cut = 0), '') AS whole FROM c GROUP BY 1)
SELECT d.doc_id, len(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256,
  (len(x) - coalesce(n_removed, 0))::BIGINT AS n_kept, decode(unhex(coalesce(whole, ''))) AS text FROM d LEFT JOIN k USING (doc_id)
"""
