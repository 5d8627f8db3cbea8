"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally within each partition and compared
in full with their neighbours; one row of each run of equals stays.  Only DataFrame functions are used.

A text that alone has more rows than the average partition is cut into salted pieces, so that its copies spread
over several ranges; the pieces' winners are compared afterwards.  At most as many texts as there are shuffle
partitions can be that frequent, which bounds the broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, place_of, table

LEAD = 24
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty; all else stays."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """All rows and columns of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep``: whether the smallest or the largest id of equal texts stays.  Null and empty texts are equal.  A null
    id loses to any other; of rows with the same text and id exactly one is kept, and which of them is arbitrary.
    An empty table gives an empty result.  Texts of any length are compared whole.  The columns added replace ones of the same name; working columns are
    named ``__cs_*``.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ADDED if c in docs.columns and c not in (id_col, text_col)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(2, -(-docs.count() // parts))
    digest = docs.select(F.sha2(normalised(docs[text_col]), 256).alias("text_sha256"))
    hot = cut(digest.groupBy("text_sha256").count().where(F.col("count") > share).select("text_sha256", F.ceil(F.col("count") / share).cast("int").alias("__cs_pieces")))

    norm = normalised(F.col(text_col))
    rows = _spread(docs, id_col).withColumn("text_sha256", F.sha2(norm, 256)).join(F.broadcast(hot), "text_sha256", "left")  # at most ``parts`` rows
    rows = rows.withColumn("__cs_salt", F.coalesce(_salt(), F.lit(0)))
    # Splitters are short, for the driver gathers samples of them: the leading characters, and a digest where these are equal.
    rows = rows.withColumn("__cs_norm", norm).withColumn("__cs_lead", F.substring("__cs_norm", 1, LEAD))
    rows = rows.repartitionByRange(parts, "__cs_lead", "text_sha256", "__cs_salt")
    run = Window.partitionBy("__cs_lead", "text_sha256", "__cs_salt", "__cs_norm")
    best = F.col(id_col).desc_nulls_last() if keep == "max" else F.col(id_col).asc_nulls_last()
    seen = (
        rows.withColumn("__cs_rank", F.row_number().over(run.orderBy(best)))
        .withColumn("__cs_top", F.first(id_col).over(run.orderBy(best)))
        .withColumn("__cs_n", F.count(F.lit(1)).over(run.orderBy(best).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("__cs_norm", "__cs_lead")
    )

    heads = content_pieces(docs, id_col, text_col, hot, keep)
    out = seen.join(F.broadcast(heads), "text_sha256", "left")  # a row for each hot text: at most ``parts``
    split = F.col("__cs_win.salt").isNotNull()
    return out.select(
        *docs.columns,
        F.when(split, F.col("__cs_win.id")).otherwise(F.col("__cs_top")).alias("keep_id"),
        F.when(split, F.col("__cs_total")).otherwise(F.col("__cs_n")).alias("group_size"),
        ((F.col("__cs_rank") == 1) & (~split | (F.col("__cs_salt") == F.col("__cs_win.salt")))).alias("kept"),
        "text_sha256",
    )


def _spread(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with a hash of each row by its place in its file, which tells rows that repeat apart; of rows from no file by all they hold."""
    place = place_of(docs)
    return docs.withColumn("__cs_spread", F.xxhash64(*docs.columns) if place is None else F.xxhash64(F.col(id_col), place))


def _salt() -> Column:
    return F.pmod(F.col("__cs_spread"), F.col("__cs_pieces").cast("long"))


def content_pieces(docs: DataFrame, id_col: str, text_col: str, hot: DataFrame, keep: str) -> DataFrame:
    """The winner and size of each text that was cut into pieces, added up before the shuffle."""
    rows = _spread(docs, id_col).select(F.col(id_col), "__cs_spread", F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")).join(F.broadcast(hot), "text_sha256")
    pair = F.struct(F.col(id_col).alias("id"), _salt().alias("salt"))
    known = F.when(F.col(id_col).isNotNull(), pair)
    best = F.max(known) if keep == "max" else F.min(known)
    return rows.groupBy("text_sha256").agg(F.coalesce(best, F.max(pair)).alias("__cs_win"), F.count(F.lit(1)).alias("__cs_total"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d
"""
