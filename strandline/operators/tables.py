"""Table operators: latest rows, upserts, pending work, audits and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """The row of each key with the greatest version; a maximum combined before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*version)).alias("__row"))
    return best.select("__row.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A new snapshot: rows of ``current`` whose key isn't in ``incoming``, and all rows of ``incoming``."""
    cond = [current[k].eqNullSafe(incoming[k]) for k in keys]
    return current.join(incoming, cond, "left_anti").unionByName(incoming)


def ordered_upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The same where ``incoming`` may repeat keys: the greatest in ``order`` counts."""
    return upsert(current, latest(incoming, keys, order), keys)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def finished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_semi")


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, problem: missing, unexpected or repeated ids; empty if the two sets agree."""
    a, b = expected.groupBy(key).count(), found.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    both = a.join(b, F.col(key) == F.col("__k"), "full_outer")
    problem = F.when(F.col("__k").isNull(), "missing").when(F.col(key).isNull(), "unexpected").when((F.col("__n") > 1) | (F.col("count") > 1), "repeated")
    return both.select(F.coalesce(key, "__k").alias(key), problem.alias("problem")).where("problem is not null")


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def histogram(df: DataFrame, axes: list[str]) -> DataFrame:
    """axis, value, n: counts by each axis and in all, in one pass."""
    sets = [[F.lit(a), F.col(a).cast("string")] for a in axes] + [[F.lit("all"), F.lit(None).cast("string")]]
    pairs = F.explode(F.array(*[F.struct(n.alias("axis"), v.alias("value")) for n, v in sets]))
    return df.select(pairs.alias("p")).groupBy("p.axis", "p.value").agg(F.count(F.lit(1)).alias("n"))


def carry(df: DataFrame, keys: list[str], order: list[str], header: Column, out: str) -> DataFrame:
    """The last header at or before each row."""
    return df.withColumn(out, F.last(header, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
