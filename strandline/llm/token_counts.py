"""Token counts without token ids.

The pieces of each distinct pre-token are counted once over the corpus, and a document's count is the sum over its own
pre-token frequencies.  The most frequent pre-tokens, a bounded number, go to all workers as a
table, long ones by their digests; every other one is joined by a shuffle.  Which of the two ways a pre-token takes changes no count.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from . import flat
from .common import fresh_path, table
from .pretokens import vocabulary

#: At most so many pre-tokens are broadcast, those of more characters by their digests: under 60 MB.
HEAD, HEAD_LENGTH = 300_000, 32
FLUSH = 400_000


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def pretoken_vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """pretoken, freq, n_pieces of each distinct pre-token of the corpus; frequencies are added up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "freq"])
            seen.clear()
            return b

        for batch in batches:
            for text in batch.column(0):
                seen.update(vocab.pretokens(text.as_py() or ""))
                if len(seen) >= FLUSH:
                    yield out()
        yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n = [len(tok.encode(s, add_special_tokens=False)) for s in part.column("pretoken").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], ["pretoken", "freq", "n_pieces"])

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(flat.tidy(count), "pretoken string, freq long")
    return each.groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInArrow(flat.tidy(pieces), "pretoken string, freq long, n_pieces long")


def written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession, "tokens")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def short_name(s: str) -> str:
    """What a pre-token is known by: itself or, of a long one, a digest, which is longer than any short one."""
    return s if len(s) <= HEAD_LENGTH else "sha256 " + hashlib.sha256(s.encode()).hexdigest()


def most_frequent(vocab: DataFrame, head: int) -> DataFrame:
    """name, n_pieces of at most ``head`` pre-tokens: those above the least frequency at which so many are left.

    Frequencies are counted in bins of a sixteenth of an octave, a thousand at most, so no task gathers candidates.
    """
    binned = vocab.withColumn("step", F.floor(F.log2("freq") * 16).cast("int"))
    left, least = head, 1 << 30
    for row in sorted(binned.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    name = F.when(F.length("pretoken") <= HEAD_LENGTH, F.col("pretoken")).otherwise(F.concat(F.lit("sha256 "), F.sha2("pretoken", 256)))
    return binned.where(F.col("step") >= least).select(name.alias("name"), "n_pieces")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of each row.

    Null and empty texts have 0 of both.  Rows repeat as they do in ``docs``, whose other columns aren't read.  Only
    tokenizers files of byte-level BPE are accepted.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocab = written(pretoken_vocabulary(docs, path, text_col))
    top = most_frequent(vocab, head).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, pieces = vocabulary(path), known.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                size, total, ends, rare, times = [], [], [0], [], []
                for text in batch.column("text").to_pylist():
                    t = text or ""
                    n = 0
                    for s, k in Counter(v.pretokens(t)).items():
                        c = pieces.get(short_name(s))
                        if c is None:
                            rare.append(s)
                            times.append(k)
                        else:
                            n += c * k
                    size.append(len(t.encode()))
                    total.append(n)
                    ends.append(len(rare))
                tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], ["pretoken", "freq"]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.arange(row, row + len(size))), pa.array(size, pa.int64()), pa.array(total, pa.int64()), tail], ["id", "row", "n_bytes", "n", "tail"])
                row += len(size)

    kind = docs.schema[id_col].dataType.simpleString()
    per = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    per = written(per.mapInArrow(flat.tidy(sums), f"id {kind}, row long, n_bytes long, n long, tail array<struct<pretoken:string,freq:long>>"))
    rare = _tail(per, vocab)
    out = per.drop("tail").join(rare, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def _tail(per: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens of each row's rare pre-tokens."""
    rare = per.select("row", F.explode("tail").alias("t")).select("row", "t.pretoken", F.col("t.freq").alias("times"))
    return rare.join(vocab.select("pretoken", "n_pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("times") * F.col("n_pieces")).alias("more"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
