"""Ordered-series operators: as-of carry, interval pairs, trailing windows, decayed sums, tolerance rows, sections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settle import settled


def asof_carry(points: DataFrame, rows: DataFrame, key: str, time: str, carried: list[str], tie: str) -> DataFrame:
    """``rows`` with each column of ``carried`` as of the latest point that has it, at or before the row's time.

    One shuffle on the key: points and rows are united, points first at equal times, and the last known values run on.
    """
    p = points.select(key, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(rows.schema[tie].dataType).alias("__tie"), F.struct(*carried).alias("__p"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("__r"))
    r = rows.select(key, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(p.schema["__p"].dataType).alias("__p"), F.struct(*rows.columns).alias("__r"))
    run = Window.partitionBy(key).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    got = p.unionByName(r).select("__side", "__r", *[F.last(F.col(f"__p.{c}"), ignorenulls=True).over(run).alias(f"__{c}") for c in carried])
    return got.where("__side = 1").select("__r.*", *[F.col(f"__{c}").alias(c) for c in carried])


def interval_pairs(rows: DataFrame, key: str, time: Column, window: float, cols: list[str]) -> DataFrame:
    """Pairs of rows of a key whose times are ``window`` apart at most, as structs ``cur`` and ``pri`` with ``cur.t >= pri.t``.

    An equi-join on time buckets as wide as the window; each prior row stands in its own bucket and the next one.  The work follows the pairs
    in the window, and a hot key spreads over its buckets.
    """
    base = rows.select(key, time.alias("t"), *cols)
    bucket = F.floor(F.col("t") / window)
    cur = base.select(key, bucket.alias("__b"), F.struct("t", *cols).alias("cur"))
    pri = base.select(key, F.explode(F.array(bucket, bucket + 1)).alias("__b"), F.struct("t", *cols).alias("pri"))
    out = cur.join(pri, [key, "__b"]).where((F.col("cur.t") >= F.col("pri.t")) & (F.col("cur.t") - F.col("pri.t") <= window))
    return out.drop("__b")


def trailing_counts(rows: DataFrame, key: str, micros: str, width: int, kinds: dict[str, Column]) -> DataFrame:
    """``rows`` with, per name in ``kinds``, how many rows of the key from ``width`` before up to this row's time fulfil its condition; times are whole numbers.

    A row counts from its time on and stops when it is too old.  Time is cut into blocks of ``width``; a row stands in its own block, and from the start of the next one
    until it is too old.  A running sum within a block is all that is needed: the work is linear, and a key of any length spreads over its blocks.
    """
    b = F.floor(F.col(micros) / F.lit(width)).cast("long")
    step = lambda block, at, sign, own: F.struct(block.alias("b"), at.alias("at"), F.lit(sign).alias("sign"), F.lit(own).alias("own"))
    steps = F.array(step(b, F.col(micros), 1, True), step(b + 1, (b + 1) * width, 1, False), step(b + 1, F.col(micros) + width + 1, -1, False))
    marked = rows.select(F.struct(*rows.columns).alias("__row"), F.col(key).alias("__key"), *[c.cast("int").alias(f"__{k}") for k, c in kinds.items()], F.explode(steps).alias("__s"))
    run = Window.partitionBy("__key", "__s.b").orderBy("__s.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.coalesce(F.col(f"__{k}"), F.lit(0)) * F.col("__s.sign")).over(run).alias(k) for k in kinds]
    return marked.select("__row", "__s.own", *sums).where("own").select("__row.*", *kinds)


def entropy_bits(counts: list[Column]) -> Column:
    """Bits of a distribution given by its counts."""
    n = sum(counts[1:], counts[0])
    parts = [F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0) for c in counts]
    return F.abs(sum(parts[1:], parts[0]))


def decayed_sum(rows: DataFrame, key: str, time: str, value: str, tau: float, tie: list[str], out: str) -> DataFrame:
    """``rows`` with the state of s <- s * exp(-dt / tau) + value after each row.

    Times are cut into blocks of eight tau.  Within a block the state is a running sum against the block's start, whose factors stay within e**8; what
    earlier blocks carry in is the sum of their totals, and five of them suffice for double precision (e**-40).  No window
    is longer than a block, so a key of any length spreads over its blocks.
    """
    width = 8.0 * tau
    b = rows.withColumn("__b", F.floor(F.col(time) / width)).withColumn("__o", F.col(time) - F.col("__b") * width)
    up = F.col(value) * F.exp(F.col("__o") / tau)
    run = Window.partitionBy(key, "__b").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, 0)
    totals = b.groupBy(key, "__b").agg(F.sum(up).alias("__t"))
    order = Window.partitionBy(key).orderBy("__b")
    carry = F.lit(0.0)
    for k in range(1, 6):
        carry = carry + F.coalesce(F.sum("__t").over(order.rangeBetween(-k, -k)), F.lit(0.0)) * math.exp(-8.0 * k)
    heads = totals.select(key, "__b", carry.alias("__c"))
    state = b.withColumn("__run", F.sum(up).over(run)).join(heads, [key, "__b"])
    return state.select(*rows.columns, ((F.col("__run") + F.col("__c")) * F.exp(-F.col("__o") / tau)).alias(out))


#: A block of tolerance rows is as long as so many tolerances.
ROW_BLOCK = 256


def _first_beyond(ts: np.ndarray, start: np.ndarray, width: float) -> np.ndarray:
    """Of each start, the place of the first of the sorted ``ts`` that is more than ``width`` later."""
    at = np.searchsorted(ts, start + width, "right")
    while (back := (at > 0) & (ts[np.maximum(at - 1, 0)] - start > width)).any():  # the sum may be rounded
        at = at - back
    while (on := (at < len(ts)) & (ts[np.minimum(at, len(ts) - 1)] - start <= width)).any():
        at = at + on
    return at


def tolerance_rows(rows: DataFrame, key: str, time: str, width: float) -> DataFrame:
    """key, row (from 0), start, n: events within ``width`` of a row's first event belong to it; rows don't chain.

    What a block of time does to the row that is open at its start depends only on which of the block's first events begins a new row: a small table of
    entries.  Blocks make theirs by themselves; a pass over the entries of a key, about one event in ``ROW_BLOCK``, tells where each block is entered; blocks then
    give their rows by themselves.  So a key of any length spreads over its blocks.  Null times don't count.
    """
    kind, span = rows.schema[key].dataType.simpleString(), ROW_BLOCK * width
    base = rows.where(F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).cast("double").alias("t")).withColumn("b", F.floor(F.col("t") / span).cast("long"))
    base = settled(base.repartition("k", "b"))

    def entries(f: pd.DataFrame) -> pd.DataFrame:
        ts, block = np.sort(f["t"].to_numpy()), int(f["b"].iloc[0])
        after = _first_beyond(ts, ts, width)
        last, count = np.arange(len(ts)), np.ones(len(ts), np.int64)
        for i in range(len(ts) - 1, -1, -1):
            if after[i] < len(ts):
                last[i], count[i] = last[after[i]], count[after[i]] + 1
        # The open row began before the block, so that it ends before this.
        n = min(len(ts), int(np.searchsorted(ts, block * span + 2 * width, "left")) + 1)
        return pd.DataFrame({"k": f["k"].iloc[0], "b": block, "entry": ts[:n], "last": ts[last[:n]], "starts": count[:n]})

    table = base.groupBy("k", "b").applyInPandas(entries, f"k {kind}, b long, entry double, last double, starts long")

    def follow(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["b", "entry"])
        block, entry, last, starts = (f[c].to_numpy() for c in ("b", "entry", "last", "starts"))
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        begun, done, out = np.nan, 0, []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = lo if np.isnan(begun) else lo + int(_first_beyond(entry[lo:hi], np.array([begun]), width)[0])
            out.append((block[lo], begun, entry[at] if at < hi else np.nan, done))
            if at < hi:
                begun, done = last[at], done + int(starts[at])
        return pd.DataFrame(out, columns=["b", "open", "entry", "done"]).assign(k=f["k"].iloc[0])[["k", "b", "open", "entry", "done"]]

    entered = table.groupBy("k").applyInPandas(follow, f"k {kind}, b long, open double, entry double, done long")
    entered = settled(entered.select(F.col("k").alias("k2"), F.col("b").alias("b2"), "open", "entry", "done"))

    def give(f: pd.DataFrame) -> pd.DataFrame:
        ts, opened, entry, done = np.sort(f["t"].to_numpy()), f["open"].iloc[0], f["entry"].iloc[0], int(f["done"].iloc[0])
        at = len(ts) if entry is None or np.isnan(entry) else int(np.searchsorted(ts, entry, "left"))
        out = [(done - 1, opened, at)] if at else []
        after = _first_beyond(ts, ts, width)
        while at < len(ts):
            out.append((done, ts[at], int(after[at]) - at))
            done, at = done + 1, int(after[at])
        return pd.DataFrame(out, columns=["row", "start", "n"]).assign(k=f["k"].iloc[0])[["k", "row", "start", "n"]]

    both = base.join(entered, base["k"].eqNullSafe(entered["k2"]) & (base["b"] == entered["b2"])).select("k", "b", "t", "open", "entry", "done")
    parts = both.groupBy("k", "b").applyInPandas(give, f"k {kind}, row long, start double, n long")
    return parts.groupBy(F.col("k").alias(key), "row", "start").agg(F.sum("n").alias("n")).select(key, "start", "n", "row")


def section_peaks(rows: DataFrame, key: str, offset: Column, width: float, value: Column) -> DataFrame:
    """key, section, peak: the largest value in each section of ``width``, dense up to the last, empty ones 0."""
    got = rows.groupBy(key, F.floor(offset / width).cast("long").alias("section")).agg(F.max(value).alias("peak"))
    last = got.groupBy(key).agg(F.max("section").alias("__last"))
    every = last.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "__last")).alias("section"))
    return every.join(got, [key, "section"], "left").select(key, "section", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def weighted_peaks(peaks: DataFrame, key: str, decay: float) -> DataFrame:
    """key, total, mean: peaks in falling order, weighted by powers of ``decay``."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("peak"), "section")) - 1
    w = peaks.withColumn("__w", F.pow(F.lit(decay), i))
    return w.groupBy(key).agg(F.sum(F.col("peak") * F.col("__w")).alias("total"), (F.sum(F.col("peak") * F.col("__w")) / F.sum("__w")).alias("mean"))
