"""Rolling hashes over flat byte arrays, modulo 2**64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_U = np.uint64


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the powers below n of a base, and of its inverse: any odd number has one.  One table of each base is kept, as long as the longest block needed it."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size, b = 1 << max(16, int(n - 1).bit_length()), int(BASES[which])
        out = []
        for x in (b, pow(b, -1, 1 << 64)):
            p = np.full(size, _U(x))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _POWERS[which] = (out[0], out[1])
    return held


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Rolling:
    """Hashes of any substrings of ``data``; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.power, self.inverse = powers(n + 1, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal ``keys``, from batches sorted by them: as many runs together as have ``most`` rows at least."""
    held: list[pa.RecordBatch] = []
    count = 0

    def starts(b: pa.RecordBatch | pa.Table) -> np.ndarray:
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = starts(whole)
        if len(cut):
            yield whole.slice(0, int(cut[-1]))
            rest = whole.slice(int(cut[-1]))
            held, count = rest.to_batches(), rest.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks()
