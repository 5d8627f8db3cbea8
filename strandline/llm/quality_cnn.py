"""Quality classifier: a byte-level convolutional network in numpy.

Every byte is embedded; filters of ``2 * BLOCK_BYTES`` bytes slide over the whole text in steps of ``BLOCK_BYTES``; their
responses are max-pooled over overlapping chunks; a hidden layer turns each chunk into features whose mean and
maximum over all chunks give one probability.  A text of any length is scored whole: memory follows the block of
texts at hand, not the table.

The network is fitted on the driver on at most ``max_rows`` labelled rows of at most ``max_total`` bytes together, taken in
the order of a hash of their id.  Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import table

BLOCK_BYTES, EMBED, FILTERS, HIDDEN = 4, 8, 32, 24
#: Blocks in a pooling cell; cells in a chunk; cells from one chunk's start to the next one's.
CELL, CHUNK, STEP = 16, 8, 6
#: Cells whose responses are held at once, whatever the length of a text.
SLAB = 4096
MAX_ROWS, MAX_TOTAL = 4000, 48 << 20


@dataclass
class Net:
    embed: np.ndarray  # 257 x EMBED; 256 is padding
    conv: np.ndarray  # 2 * BLOCK_BYTES * EMBED x FILTERS
    conv_b: np.ndarray
    hid: np.ndarray  # FILTERS x HIDDEN
    hid_b: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    out_b: np.ndarray

    @staticmethod
    def start(seed: int) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *shape, by: (r.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        width = 2 * BLOCK_BYTES * EMBED
        embed = f(257, EMBED, by=1)
        embed[256] = 0
        return Net(embed, f(width, FILTERS, by=width), np.zeros(FILTERS, np.float32), f(FILTERS, HIDDEN, by=FILTERS / 2), np.zeros(HIDDEN, np.float32), f(2 * HIDDEN, by=2 * HIDDEN), np.full(1, 1.0, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, x.name) for x in fields(self)]


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled with padding to whole cells, one more block at the end; the first cell of each, and the end."""
    unit = BLOCK_BYTES * CELL
    size = np.diff(at)
    cells = np.maximum(1, -(-size // unit))
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(cells, out=first[1:])
    out = np.full(int(first[-1]) * unit + BLOCK_BYTES, 256, np.int16)
    out[np.arange(len(data)) + np.repeat(first[:-1] * unit - at[:-1], size)] = data
    return out, first


def chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end cell of each chunk, and the first chunk of each text, and the end."""
    cells = np.diff(first)
    n = 1 + np.maximum(0, -(-(cells - CHUNK) // STEP))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    k = np.arange(at[-1]) - np.repeat(at[:-1], n)
    start = np.repeat(first[:-1], n) + k * STEP
    return start, np.minimum(start + CHUNK, np.repeat(first[1:], n)), at


def cell_maxima(net: Net, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the filter responses in each cell, ``SLAB`` cells at a time.  The last window of a text reaches into padding, never into the next text."""
    if net.embed[256].any():
        raise ValueError("padding must embed to 0")
    half, unit = BLOCK_BYTES * EMBED, BLOCK_BYTES * CELL
    ends = first[1:] * CELL - 1
    out = np.empty((int(first[-1]), FILTERS), net.conv.dtype)
    for lo in range(0, len(out), SLAB):
        hi = min(lo + SLAB, len(out))
        x = net.embed[codes[lo * unit : hi * unit + BLOCK_BYTES]].reshape(-1, half)
        nxt = x[1:] @ net.conv[half:]
        a, b = np.searchsorted(ends, [lo * CELL, hi * CELL])
        nxt[ends[a:b] - lo * CELL] = 0
        nxt += x[:-1] @ net.conv[:half]
        out[lo:hi] = nxt.reshape(-1, CELL, FILTERS).max(1)
    return out


def pool(cells: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = np.stack([start, end], 1).ravel()
    cells = np.concatenate([cells, cells[-1:]])  # reduceat wants ends inside
    return np.maximum.reduceat(cells, at, axis=0)[::2]


def score(net: Net, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text."""
    codes, first = padded(data, at)
    start, end, doc = chunk_bounds(first)
    p = np.maximum(pool(cell_maxima(net, codes, first), start, end) + net.conv_b, 0)
    h = np.maximum(p @ net.hid + net.hid_b, 0)
    mean = np.add.reduceat(h, doc[:-1], axis=0) / np.diff(doc)[:, None]
    most = np.maximum.reduceat(h, doc[:-1], axis=0)
    return 1 / (1 + np.exp(-np.clip(np.concatenate([mean, most], 1) @ net.out + net.out_b, -30, 30)))


def _gradients(net: Net, data: np.ndarray, at: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    codes, first = padded(data, at)
    start, end, doc = chunk_bounds(first)
    half = BLOCK_BYTES * EMBED
    x = net.embed[codes].reshape(-1, half)
    win = np.concatenate([x[:-1], x[1:]], 1)
    ends = first[1:] * CELL - 1
    win[ends, half:] = 0
    y = win @ net.conv
    which, top = np.empty((len(start), FILTERS), np.int64), np.empty((len(start), FILTERS), np.float32)
    for c, (a, b) in enumerate(zip(start * CELL, end * CELL, strict=True)):
        which[c] = a + y[a:b].argmax(0)
    top = np.take_along_axis(y, which, 0)
    p = np.maximum(top + net.conv_b, 0)
    h0 = p @ net.hid + net.hid_b
    h = np.maximum(h0, 0)
    n = np.diff(doc)
    owner = np.repeat(np.arange(len(n)), n)
    mean = np.add.reduceat(h, doc[:-1], axis=0) / n[:, None]
    most = np.maximum.reduceat(h, doc[:-1], axis=0)
    v = np.concatenate([mean, most], 1)
    g = ((1 / (1 + np.exp(-np.clip(v @ net.out + net.out_b, -30, 30))) - label) / len(label)).astype(np.float32)
    d_out, d_out_b = v.T @ g, g.sum(keepdims=True)
    dv = g[:, None] * net.out
    d_mean, d_most = dv[:, :HIDDEN] / n[:, None], dv[:, HIDDEN:]
    is_top = h == most[owner]
    ties = np.add.reduceat(is_top.astype(np.float32), doc[:-1], axis=0)
    dh = (d_mean[owner] + is_top * (d_most / ties)[owner]) * (h0 > 0)
    d_hid, d_hid_b = p.T @ dh, dh.sum(0)
    dp = (dh @ net.hid.T) * (p > 0)
    d_conv, d_embed = np.empty_like(net.conv), np.zeros_like(net.embed)
    blocks = codes.reshape(-1, BLOCK_BYTES)
    for f in range(FILTERS):
        rows, gf = which[:, f], dp[:, f]
        used = np.flatnonzero(gf)
        rows, gf = rows[used], gf[used]
        d_conv[:, f] = gf @ win[rows]
        inside = ~np.isin(rows, ends)
        both = np.concatenate([blocks[rows], np.where(inside[:, None], blocks[np.minimum(rows + 1, len(blocks) - 1)], 256)], 1)
        w = net.conv[:, f].reshape(-1, EMBED)
        for j in range(2 * BLOCK_BYTES):
            d_embed += np.bincount(both[:, j], gf, 257)[:, None] * w[j]
    d_embed[256] = 0
    return [d_embed, d_conv, dp.sum(0), d_hid, d_hid_b, d_out, d_out_b]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 3e-3, seed: int = 7, least_steps: int = 700) -> Net:
    """By Adam with a falling rate.  Reruns agree."""
    net = Net.start(seed)
    r = np.random.default_rng(seed)
    m, v, t = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()], 0
    per_epoch = max(1, -(-len(texts) // batch))
    total = max(epochs * per_epoch, least_steps)
    while texts and t < total:
        order = r.permutation(len(texts))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            joined = [texts[i] for i in part]
            at = np.cumsum([0, *map(len, joined)])
            grads = _gradients(net, np.frombuffer(b"".join(joined), np.uint8), at, labels[part].astype(np.float32))
            t += 1
            step = rate * min(1.0, t / 50) * max(0.02, 1 - t / total)
            for a, g, mm, vv in zip(net.arrays(), grads, m, v, strict=True):
                g = g + 1e-5 * a
                mm += 0.1 * (g - mm)
                vv += 0.002 * (g * g - vv)
                a -= (step * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.998**t)) + 1e-8)).astype(np.float32)
            net.embed[256] = 0
            if t >= total:
                break
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_total: int = MAX_TOTAL) -> Net:
    """On a bounded sample of the rows of ``labels`` (doc_id, quality) whose crc32(doc_id) mod 5 isn't 0: the first ones in the order of a hash of their
    id, ``max_rows`` at most and as many as have ``max_total`` bytes together; long texts count like others.

    Rows without a label of 0 or 1 or without a document don't count.  Without any row the network stays as it starts.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)  # so many rows at most are broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("size", F.octet_length("text"))
    order = [F.xxhash64("doc_id"), "doc_id", "size", F.xxhash64("text"), "quality"]
    sizes = rows.orderBy(*order).limit(max_rows).select("size").toArrow().column("size").to_numpy()
    n = int(np.searchsorted(np.cumsum(sizes), max_total, "right"))
    got = rows.orderBy(*order).limit(n).toArrow()
    return fit([t.encode() for t in got.column("text").to_pylist()], got.column("quality").to_numpy().astype(np.float32))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def classify(docs: DataFrame, net: Net, carry: list[str], score_col: str = "score") -> DataFrame:
    """The columns ``carry`` of each row with ``score_col``: the probability that its text has label 1.

    Null and empty texts have a score too: that of padding alone.  Rows repeat as they do in ``docs``.  ``carry`` may
    hold the text; a column named ``score_col`` is replaced.
    """
    carry = [c for c in carry if c != score_col]
    known = docs.sparkSession.sparkContext.broadcast(net)  # about 6,000 numbers
    name = "text" if "text" in carry else "__cnn_text"
    rows = docs.select(*carry, *([] if name == "text" else [F.col("text").alias(name)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in flat.blocks(batch, name):
                part = batch.slice(lo, hi - lo)
                found = score(known.value, data, at).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(found)], [*carry, score_col])

    schema = rows.select(*carry).schema.add(score_col, "double")
    return rows.mapInArrow(flat.tidy(run), schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    out = classify(docs, net, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
