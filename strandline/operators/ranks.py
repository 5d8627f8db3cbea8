"""Ranks of values in a corpus, without a window over all rows.

Values are counted first.  The distinct ones are range-partitioned, ranked within their range and shifted by what the ranges
before hold: no task sees more than a range, and a hot cohort spreads over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settle import settled


def running_counts(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    """``counted`` (by, value, n; one row per value) with ``below`` (rows), ``place`` (values before, within ``by``), and ``rows`` and ``values`` of the cohort."""
    spark = counted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Settled, for it is read twice and must be cut alike both times.
    ranged = settled(counted.repartitionByRange(parts, *by, value).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *by).orderBy(value)
    ranged = ranged.withColumn("__below", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("__place", F.row_number().over(inside) - 1)
    # One row per range and cohort: the windows over these are short.
    heads = ranged.groupBy("__range", *by).agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__v"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    heads = heads.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__k_{c}") for c in by], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__v0"), F.sum("__n").over(whole).alias("rows"), F.sum("__v").over(whole).alias("values"))
    cond = [F.col("__range") == F.col("__r"), *[F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]]
    return ranged.join(heads, cond).select(*by, value, "n", (F.col("__below") + F.col("__n0")).alias("below"), (F.col("__place") + F.col("__v0")).alias("place"), "rows", "values")


def count_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """by and a column per name in ``shares``: the exact quantile of ``value``, between two neighbouring values in proportion.

    Counted values are ranked in ranges, so no task gathers a cohort's values.  Nulls don't count.
    """
    c = running_counts(count_values(df, by, value), by, value)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value)))

    aggs = []
    for name, q in shares.items():
        place = (F.col("rows") - 1) * F.lit(q)
        aggs += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}"), F.max(place - F.floor(place)).alias(f"__part_{name}")]
    got = c.groupBy(*by).agg(*aggs)
    return got.select(*by, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n) for n in shares])


def distinct_rank(place: Column, values: Column) -> Column:
    """Share of the distinct values that are smaller; 0 where there is one value only."""
    return F.when(values > 1, place / (values - 1)).otherwise(F.lit(0.0))


def midrank(below: Column, n: Column, rows: Column) -> Column:
    """Middle place of the equal rows; a half where there is one row only."""
    return F.when(rows > 1, (below + (n - 1) / 2.0) / (rows - 1)).otherwise(F.lit(0.5))


def fit_distinct(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, value, rank: a normaliser over distinct values."""
    r = running_counts(count_values(df, by or [], value), by or [], value)
    return r.select(*(by or []), value, distinct_rank(F.col("place"), F.col("values")).alias("rank"))


def fit_midrank(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, value, rank, below, n, rows: a normaliser over values with their frequencies."""
    r = running_counts(count_values(df, by or [], value), by or [], value)
    return r.select(*(by or []), value, midrank(F.col("below"), F.col("n"), F.col("rows")).alias("rank"), "below", "n", "rows")


def apply_ranks(df: DataFrame, fitted: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """In-corpus transform: the rank of each row's own value."""
    return df.join(fitted.select(*(by or []), value, F.col("rank").alias(out)), [*(by or []), value], "left")


def rank_axes(df: DataFrame, id_col: str, axes: tuple[str, ...], by: list[str] | None = None, kind: str = "distinct") -> DataFrame:
    """id and the rank of each row's value on each axis: all axes in one long table, so one range partition serves them all.  Ids are unique."""
    by = by or []
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes]))
    long = df.select(id_col, *by, pair.alias("__p")).select(id_col, *by, "__p.axis", "__p.value")
    fitted = (fit_distinct if kind == "distinct" else fit_midrank)(long, "value", [*by, "axis"])
    ranked = apply_ranks(long, fitted, "value", "rank", [*by, "axis"])
    return ranked.groupBy(id_col).agg(*[F.max(F.when(F.col("axis") == a, F.col("rank"))).alias(a) for a in axes])


def rank_outside(target: DataFrame, fitted: DataFrame, value: str, out: str, kind: str, by: list[str] | None = None) -> DataFrame:
    """``target`` with the rank of values that needn't be in the corpus; null where their cohort isn't.

    Its values stand among the fitted ones with a count of 0, so one range partition places any number of them.
    """
    by = by or []
    n = F.col("n") if kind == "midrank" else F.lit(1)
    known = fitted.select(*by, value, n.cast("long").alias("n"))
    asked = target.select(*by, value).distinct().withColumn("n", F.lit(0).cast("long"))
    r = running_counts(known.unionByName(asked).groupBy(*by, value).agg(F.sum("n").alias("n")), by, value)
    lower, upper, total = F.col("below"), F.col("below") + F.col("n"), F.col("rows")
    if kind == "midrank":
        mid = F.when(upper > lower, (lower + upper - 1) / 2.0).otherwise(lower)
        rank = F.when(total == 1, 0.5).when(total > 1, F.least(mid / (total - 1), F.lit(1.0)))
    else:
        rank = F.when(total == 1, 0.0).when(total > 1, F.greatest(upper - 1, F.lit(0)) / (total - 1))
    return target.join(r.select(*by, value, rank.alias(out)), [*by, value], "left")
