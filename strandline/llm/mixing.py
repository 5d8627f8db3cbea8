"""Mixing sources to target weights by entropy balancing.

Each source must give a target number of words.  Among document rates between 0 and ``cap`` that meet the targets,
the one closest to 1 in relative entropy is ``min(cap, exp(lambda * z))`` with ``z`` the document's words over its
source's mean: the multiplier of each source solves a convex dual, found here by Newton steps in which every
aggregate is a distributed sum over a histogram of document sizes.  Rates are then rounded into copies: the whole part is
certain, and the fractions are filled in the order of a hashed priority until the source's words are reached.

Only DataFrame functions are used.  All that documents need is one row of parameters per source, so the copies of a
row follow from its own columns, without a shuffle of texts.  Rows that repeat both id and text are numbered, so that each has a
priority of its own; they are known by their place in their files.  Terms of the Newton sums are rounded to fixed
point and added as decimals: the result depends neither on the order of addition nor on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, cut, fresh_path, place_of, small_side, table

#: Newton steps at most, and the share of its target by which a settled source may miss it, besides a hundredth of a word.
STEPS, SETTLED = 24, 1e-6
BINS, TOP_BIN = 2048, 8191
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")
#: What orders rows of equal priority.
ROW = ("doc_id", "digest", "nth")
SALT, SPREAD = 0x6D69786572, 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size and target, by water filling.

    Sources by code point, null last, take the weights in turn.  A target stops at ``cap`` times its source's size;
    what exceeds it is shared among the others by weight.  The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(every)["level"])
    return per.select("source", "source_size", "source_docs", F.coalesce(F.least("most", F.col("w") * F.col("level")), F.col("most")).alias("target"))


def per_source(params: DataFrame, sources: int) -> DataFrame:
    """A row per source, to be broadcast if these are few."""
    return F.broadcast(params) if sources <= BROADCAST_ROWS else params


def _rate(cap: float) -> Column:
    """Rounded, so that the last bits of a multiplier don't decide."""
    z = F.when(F.col("source_size") > 0, F.col("size") * F.col("source_docs") / F.col("source_size")).otherwise(0.0)
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * z, F.lit(30.0))))
    return F.round(F.when(F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12)), F.lit(float(cap))).otherwise(tilted), 9)


def _priority() -> Column:
    """Of the fractional copy: a hash of the row's id, text and number over the fraction.  Smaller ones come first."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SALT), F.col("doc_id"), F.col("digest"), F.col("nth")), 11) + 0.5) / F.lit(float(1 << 53))
    f = F.col("rate") - F.floor("rate")
    return F.when(f > 0, u / f)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``; rows that come from no file are written first."""
    if place_of(docs) is None:
        path = fresh_path(docs.sparkSession, "mixed")
        docs.write.parquet(path)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
    return docs.select("*", place_of(docs).alias("place"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest and place of each row of ``placed`` ones, and ``nth``: its number among rows with the same id, source and text.

    Rows are numbered within ``SPREAD`` shares first, so that a row which repeats very often is no task's alone.
    """
    rows = cut(docs.select("doc_id", "source", words(docs["text"]).alias("size"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("digest"), "place"))
    key = ["doc_id", "source", "digest"]
    twice = cut(rows.groupBy(*key).count().where("count > 1").drop("count").withColumnsRenamed({c: f"t_{c}" for c in key}))
    if twice.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    twice = small_side(twice)
    same = [rows[c].eqNullSafe(twice[f"t_{c}"]) for c in key]
    here = rows.join(twice, same, "left_semi").withColumn("part", F.xxhash64("place") % SPREAD)
    local = here.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "part").orderBy("place")) - 1)
    heads = here.groupBy(*key, "part").count()
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = cut(heads.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count").withColumnsRenamed({c: f"t_{c}" for c in [*key, "part"]}))
    at = [local[c].eqNullSafe(heads[f"t_{c}"]) for c in [*key, "part"]]
    numbered = local.join(small_side(heads), at).select(*rows.columns, (F.col("nth") + F.col("base")).alias("nth"))
    return cut(rows.join(twice, same, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(numbered))


def fit_mix(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source with all that ``apply_mix`` needs.  ``sizes``: as ``measured`` gives them; read several times."""
    targets = cut(source_targets(sizes, weights, share, cap))
    hist = cut(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    n = targets.count()
    lam = targets.withColumns({"lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    fixed = lambda c: F.sum(F.round(c * 1e4).cast("decimal(38,0)")).cast("double") / 1e4
    for step in range(STEPS):
        z = F.col("size") * F.col("source_docs") / F.col("source_size")
        seen = hist.where("size > 0").join(per_source(lam, n), hist["source"].eqNullSafe(lam["source"])).drop(hist["source"]).withColumn("rate", _rate(cap))
        words_now = F.col("n") * F.col("size") * F.col("rate")
        slope = F.when(F.col("rate") < cap, words_now * z).otherwise(0.0)
        sums = seen.groupBy("source", "source_size", "source_docs", "target", "lam", "lo", "hi").agg(fixed(words_now).alias("g"), fixed(slope).alias("h"))
        low, high = F.col("g") < F.col("target"), F.col("g") > F.col("target")
        sums = sums.withColumns({"lo": F.when(low, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(high, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") + F.log(F.col("target") / F.col("g")) * F.col("g") / F.col("h")
        reach = F.greatest(F.abs(F.col("lam")), F.lit(0.5))
        free = F.when(F.col("h") > 0, F.least(F.greatest(newton, F.col("lam") - 2 * reach), F.col("lam") + 2 * reach)).otherwise(F.col("lam") + F.when(low, reach).otherwise(-reach))
        inside = (F.coalesce(free > F.col("lo"), F.lit(True))) & (F.coalesce(free < F.col("hi"), F.lit(True)))
        new = F.when(~low & ~high, F.col("lam")).when(inside | F.col("lo").isNull() | F.col("hi").isNull(), free).otherwise((F.col("lo") + F.col("hi")) / 2)
        lam = sums.select("source", "source_size", "source_docs", "target", F.coalesce(new, F.col("lam")).alias("lam"), "lo", "hi", (F.abs(F.col("g") - F.col("target")) <= SETTLED * F.col("target") + 0.01).alias("done"))
        if step % 4 == 3:
            lam = cut(lam)
            if lam.where(~F.col("done")).isEmpty():
                break
    none = targets.where("source_size = 0").withColumn("lam", F.lit(0.0))
    lam = cut(lam.select("source", "source_size", "source_docs", "target", "lam").unionByName(none))
    return _fill(sizes, lam, cap, n)


def _fill(sizes: DataFrame, lam: DataFrame, cap: float, n: int) -> DataFrame:
    """How far the fractional copies of each source go: up to the priority (tau, tau_id), and the one document besides that closes the gap best.

    A histogram of priorities finds the bin in which the target is reached; only that bin's rows are ranked.
    """
    rated = sizes.join(per_source(lam, n), sizes["source"].eqNullSafe(lam["source"])).drop(sizes["source"]).withColumn("rate", _rate(cap)).withColumn("p", _priority())
    rated = rated.withColumn("bin", F.least(F.floor(F.col("p") * BINS), F.lit(TOP_BIN)).cast("int"))
    sure = rated.groupBy("source").agg(F.sum(F.floor("rate") * F.col("size")).alias("sure"))
    need = lam.join(sure, lam["source"].eqNullSafe(sure["source"]), "left").drop(sure["source"]).withColumn("need", F.col("target") - F.coalesce("sure", F.lit(0)))
    bins = rated.where("p is not null and size > 0").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = bins.withColumn("upto", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")))
    need = need.select("source", "source_size", "source_docs", "target", "lam", "need")
    at = upto.join(need.select(F.col("source").alias("s2"), "need"), upto["source"].eqNullSafe(F.col("s2"))).where("upto - bin_size <= need")
    edge = cut(at.groupBy("s2").agg(F.max(F.struct("bin", F.expr("upto - bin_size").alias("below"))).alias("edge")).select(F.col("s2"), "edge.bin", "edge.below"))
    params = cut(need.join(edge, need["source"].eqNullSafe(edge["s2"]), "left").drop("s2").withColumnsRenamed({"bin": "edge_bin"}))

    small = params.select(F.col("source").alias("s3"), "need", "edge_bin", "below")
    near = rated.where("p is not null and size > 0").join(per_source(small, n), rated["source"].eqNullSafe(small["s3"])).where("bin = edge_bin")
    order = Window.partitionBy("source").orderBy("p", *ROW).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("below") + F.sum("size").over(order)).where("upto <= need")
    tau = cut(near.groupBy("source").agg(F.max(F.struct("p", *ROW)).alias("tau"), F.max("upto").alias("got")))
    tau = tau.select(F.col("source").alias("s4"), "tau", "got")
    params = params.join(tau, params["source"].eqNullSafe(tau["s4"]), "left").drop("s4")
    params = cut(params.withColumn("gap", F.col("need") - F.coalesce("got", "below", F.lit(0))))

    left = params.select(F.col("source").alias("s5"), "edge_bin", "tau", "gap")
    rest = rated.where("p is not null and size > 0").join(per_source(left, n), rated["source"].eqNullSafe(left["s5"]))
    rest = rest.where(~_within()).where("size < 2 * gap")
    close = rest.groupBy("s5").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), F.col("p"), F.struct(*ROW).alias("row"))).alias("close")).select(F.col("s5"), F.col("close.row").alias("extra"))
    return cut(params.join(close, params["source"].eqNullSafe(close["s5"]), "left").select("source", "source_size", "source_docs", "target", "lam", "edge_bin", "tau", "extra"))


def _within() -> Column:
    """Whether the fractional copy is taken: below the edge bin, or in it up to tau."""
    at = (F.col("bin") == F.col("edge_bin")) & (F.struct("p", *ROW) <= F.col("tau"))
    return F.coalesce((F.col("bin") < F.col("edge_bin")) | at, F.lit(False))


def apply_mix(rows: DataFrame, params: DataFrame, cap: float = 2.0) -> DataFrame:
    """The rows (doc_id, source, size, digest, nth and any others) with source_size, target, rate, copies and taken.

    ``params`` has a row per source.
    """
    p = params.withColumnRenamed("source", "__mix_source")
    out = rows.join(per_source(p, p.count()), rows["source"].eqNullSafe(p["__mix_source"]), "left").withColumn("rate", _rate(cap)).withColumn("p", _priority())
    out = out.withColumn("bin", F.least(F.floor(F.col("p") * BINS), F.lit(TOP_BIN)).cast("int"))
    more = (_within() | F.coalesce(F.struct(*ROW).eqNullSafe(F.col("extra")), F.lit(False))) & F.col("p").isNotNull()
    out = out.withColumn("copies", (F.floor("rate") + more.cast("int")).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*rows.columns, *ADDED[1:])


def mix(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    A null text has size 0; a null source is a source of its own, the last.  Rows that repeat an id, or have none, are decided one by one;
    of rows with the same id, source and text it is arbitrary which ones are taken, but not how many.  Documents of size 0 take nothing
    whatever their copies.  A table without words gives targets of 0.  An empty table gives an empty result.  Texts of any length are
    counted whole.  Columns of these names are replaced.
    """
    return _mixed(docs).select(*(f"whole.{c}" for c in docs.columns if c not in ADDED), *ADDED)


def _mixed(docs: DataFrame) -> DataFrame:
    """``whole``, the rows of ``docs`` as structs, so that no name clashes; and what ``mix`` adds."""
    rows = placed(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source", "text"))
    sizes = measured(rows)
    params = fit_mix(sizes)
    rows = rows.select("whole", "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "place")
    repeated = small_side(sizes.where("nth > 0").select(F.col("place").alias("t_place"), F.col("nth")))
    rows = rows.join(repeated, rows["place"] == repeated["t_place"], "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long")))
    return apply_mix(rows, params).select("whole", *ADDED)


def copied(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them."""
    return _mixed(docs).where("copies > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    sizes = measured(placed(table(spark, sf_dir, "documents")))
    return apply_mix(sizes, fit_mix(sizes)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """What a mix must reach: each document's size, and its source's size and target, which SQL can follow."""
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", words(docs["text"]).alias("size")))
    goals = cut(source_targets(sizes)).withColumnRenamed("source", "s1")
    return sizes.join(per_source(goals, goals.count()), sizes["source"].eqNullSafe(goals["s1"])).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


#: The water level is the least one that no source below it reaches.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY 1),
r AS (SELECT DISTINCT 2 * source_size / w AS r FROM s),
l AS (SELECT r, (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN 2 * source_size / w < r THEN 2 * source_size ELSE 0 END)) / sum(CASE WHEN 2 * source_size / w >= r THEN w END) AS level FROM r, s GROUP BY 1),
v AS (SELECT min_by(level, r) AS level FROM l WHERE level <= r)
SELECT doc_id, size, source_size, round(least(2 * source_size, w * level)::DOUBLE, 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, v
"""
