"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as Parquet
and read again as the next one's documents.  Most stages can't be expressed in SQL (a trained network, a Newton
iteration, a vocabulary), so there is no SQL for the whole; the tests run a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, dedup_exact, mixing, ngram_join, quality_cnn
from strandline.llm.common import fresh_path, table

#: Documents whose probability of being good is lower go.
LEAST_SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores ``LEAST_SCORE`` or more, by a network fitted on the labels of these documents.

    Null and empty texts have a score like any other; rows that repeat are decided alike.  Without labels the network stays as it starts.  An empty table stays empty.
    """
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.classify(docs, net, docs.columns, "__quality")
    return scored.where(F.col("__quality") >= LEAST_SCORE).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same text, A-Z in lower case, that with the least doc_id.

    Columns keep their names and values.  Null and empty texts are the same; a null id loses to any other, and of rows that repeat id and text one stays.  Texts of any length are compared whole.  An empty table stays empty.
    """
    own = {c: f"__own_{c}" for c in dedup_exact.ADDED if c in docs.columns}
    named = docs.withColumnsRenamed(own)
    kept = dedup_exact.content_sort(named).where("kept").select(*named.columns)
    return kept.withColumnsRenamed({v: k for k, v in own.items()})


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8), that with the least doc_id.

    Texts without words are alone and stay; ties of ids and rows that repeat are as in ``one_of_each``.  An empty table stays empty.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most twice.

    Null texts have no words; a null source is one of its own; rows that repeat are decided one by one.  Columns keep their names and values.  An empty table stays empty.
    """
    return mixing.copied(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of what they decode to, of each copy.

    Null and empty texts have no tokens.  An empty table gives an empty result.
    """
    out = bpe.encode_decode(docs, bpe.tokenizer_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_codec),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
