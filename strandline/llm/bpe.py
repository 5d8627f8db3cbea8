"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's root holds the leftmost pair of lowest rank.  Applying it changes two neighbouring pairs, each a point
update of logarithmic cost, until no pair can be merged.  A pre-token of n bytes thus takes O(n log n), however long
it is.  Encodings of short pre-tokens are remembered per worker, up to a bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import table
from .pretokens import Vocabulary, vocabulary

REMEMBERED, LONGEST = 200_000, 64
NONE = 1 << 62


def tree_encode(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one pre-token.

    Leaf i stands for the pair of the token at i and the next one that is alive; its key is ``rank << 32 | i``, so that
    the least key is the leftmost of the lowest ranks.
    """
    ids = [vocab.ids[piece[i : i + 1]] for i in range(len(piece))]
    n, merges = len(ids), vocab.merges
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if pair := merges.get((ids[i], ids[i + 1])):
            tree[size + i] = pair[0] << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def key_at(i: int) -> int:
        j = after[i]
        pair = merges.get((ids[i], ids[j])) if j < n else None
        return pair[0] << 32 | i if pair else NONE

    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        ids[i] = merges[ids[i], ids[j]][1]
        ids[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if j < n - 1:
            put(j, NONE)
        put(i, key_at(i))
        if before[i] >= 0:
            put(before[i], key_at(before[i]))
    return [t for t in ids if t >= 0]


class Codec:
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts = [self.vocab.bytes.get(i, b"") for i in range(max(self.vocab.bytes) + 1)]

    def piece(self, s: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if (out := self.older.get(s)) is not None:
            self.remember(s, out)
            return out
        if s in self.vocab.added:
            ids = [self.vocab.added[s]]
        else:
            ids = tree_encode(s.encode(), self.vocab)
        out = np.array(ids, "<u4").tobytes()
        if len(s) <= LONGEST:
            self.remember(s, out)
        return out

    def remember(self, s: str, out: bytes) -> None:
        """In the younger of two generations; when it is full it becomes the older one, whose pieces return as they are used."""
        if len(self.known) >= REMEMBERED:
            self.older = dict(self.known)
            self.known.clear()
        self.known[s] = out

    def encode(self, text: str) -> bytes:
        known, piece = self.known, self.piece
        get = known.get
        return b"".join([get(s) or piece(s) for s in self.vocab.pretokens(text)])

    def decode(self, ids: bytes) -> str:
        parts = self.parts
        return b"".join([parts[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of each row.

    Null and empty texts have no ids and decode to the empty text.  Rows repeat as they do in ``docs``, whose other columns
    aren't read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            step = 500
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(flat.tidy(run), f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
