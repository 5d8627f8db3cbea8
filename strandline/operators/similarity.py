"""Exact nearest neighbours, reranking and adaptive candidate bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import BASE_TERMS, MANIA_AXES, PATTERNS, STD_AXES, STRUCTURE, Search
from ..settle import settled

#: Bounds of the candidate search.
SEARCH_MOST = 128


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def nearest(items: DataFrame, target: DataFrame, id_col: str, vector: Column, k: int) -> DataFrame:
    """The k items nearest to the target's vector, itself included, by (distance, id).

    ``target`` is one row with ``t_vec``; the items are scanned once, and each task sends its own best k.
    """
    near = items.join(F.broadcast(target.limit(1)), how="cross").withColumn("distance", squared_l2(vector, F.col("t_vec"))).drop("t_vec")
    return near.orderBy("distance", *S.unsigned_order(F.col(id_col))).limit(k)


def passes(bounds: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Whether all bounded columns lie within their bounds."""
    out = F.lit(True)
    for name, (least, most) in bounds.items():
        out = out & (F.lit(True) if least is None else F.col(name) >= least) & (F.lit(True) if most is None else F.col(name) <= most)
    return out


def base_distance(a: str, b: str, search: Search) -> Column:
    """Weighed differences of the base features of structs ``a`` and ``b``."""
    terms = []
    for name, (_, whole) in BASE_TERMS.items():
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        terms.append(search.weight(name) * (F.abs(x - y) if whole is None else S.capped_difference(x, y, whole)))
    return S.total(terms)


def similar(features: DataFrame, beatmap_id: int, search: Search | None = None, exhaustive: bool = False) -> DataFrame:
    """Charts that feel like one: candidates by plain distance of the five axes, filtered, reranked by 0.8 axes + 0.2 base.

    ``SEARCH_MOST`` candidates are taken at most; ``exhaustive`` takes all.  Bounds follow the choice of candidates, so fewer rows may come back.
    """
    search = search or Search()
    target = features.where(F.col("beatmap_id") == beatmap_id).select(F.struct(*STD_AXES).alias("t_axes"), F.col("base").alias("t_base")).limit(1)
    vec = F.array(*STD_AXES)
    t = target.withColumn("t_vec", F.array(*[F.col(f"t_axes.{a}") for a in STD_AXES]))
    if exhaustive:
        cand = features.join(F.broadcast(t.drop("t_vec")), how="cross")
    else:
        cand = nearest(features, t, "beatmap_id", vec, min(search.candidates, SEARCH_MOST))
    cand = cand.where((F.col("beatmap_id") != beatmap_id) & passes(search.bounds))
    d1 = S.weighted_l2([F.col(a) for a in STD_AXES], [F.col(f"t_axes.{a}") for a in STD_AXES], tuple(map(search.weight, STD_AXES)))
    out = cand.withColumn("difficulty_distance", d1).withColumn("base_distance", base_distance("t_base", "base", search))
    out = out.withColumn("final_distance", 0.8 * F.col("difficulty_distance") + 0.2 * F.col("base_distance"))
    return out.orderBy("final_distance", *S.unsigned_order(F.col("beatmap_id"))).limit(search.limit).select("beatmap_id", "beatmapset_id", "final_distance", "difficulty_distance", "base_distance", *STD_AXES)


def band_radius(candidates: DataFrame, center: Column, least_total: int, least_family: int) -> DataFrame:
    """One row: the least radius of bands around the centre with enough candidates and enough of the target's family, else 9.

    ``candidates``: band, same (whether the family agrees).  Counts by distance, at most ten rows, are added up.
    """
    by = candidates.groupBy(F.abs(F.col("band") - center).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("s"))
    listed = by.agg(F.collect_list(F.struct("d", "n", "s")).alias("x"))
    radii = F.sequence(F.lit(0), F.lit(9))
    upto = lambda r, f: F.aggregate(F.filter("x", lambda e: e["d"] <= r), F.lit(0).cast("long"), lambda s, e: s + e[f])
    good = F.filter(radii, lambda r: (upto(r, "n") >= least_total) & (upto(r, "s") >= least_family))
    return listed.select(F.coalesce(F.array_min(good), F.lit(9)).alias("radius"))


def searchable_vector() -> Column:
    """The 24 numbers of a lane chart that a vector search goes by: difficulty, then style."""
    return F.array(*[F.col(f"difficulty.{a}") for a in MANIA_AXES], *[F.col(f"style.{a}") for a in PATTERNS + STRUCTURE])


def mania_similar(features: DataFrame, target: DataFrame, limit: int = 20, same_set: bool = False) -> DataFrame:
    """Charts of the target's key count in bands around its own, by a distance of five weighted components; those of its set only if ``same_set``.

    ``features`` is best partitioned by key count and band.  ``target``: one row of the same columns, in the corpus or not; one of another
    analyzer or normalisation than the features is an error.
    """
    if not 1 <= limit <= 100:
        raise ValueError("the limit must be between 1 and 100")
    names = ["beatmap_id", "beatmapset_id", "key_count", "mode_family", "difficulty_band", "difficulty_percentile", "difficulty", "style", "base", "analyzer_version", "normalization_version"]
    t = settled(target.limit(1).select(*[F.col(n).alias(f"t_{n}") for n in names]))
    # The target's key count and, later, the radius are known here, so that only these partitions are read.
    at = t.select("t_key_count", "t_difficulty_band").first()
    if at is None:
        raise ValueError("no target")
    same = (F.col("analyzer_version") == F.col("t_analyzer_version")) & (F.col("normalization_version") == F.col("t_normalization_version"))
    cand = features.where(F.col("key_count") == at["t_key_count"]).join(F.broadcast(t))
    cand = cand.where(F.when(same, True).otherwise(F.raise_error(F.lit("the target is of another version")).cast("boolean")))
    out = F.col("beatmap_id") == F.col("t_beatmap_id")
    if not same_set:
        out = out | ((F.col("t_beatmapset_id") != 0) & (F.col("beatmapset_id") == F.col("t_beatmapset_id")))
    cand = cand.where(~out)
    gap = F.abs(F.col("difficulty_band") - F.col("t_difficulty_band"))
    radius = band_radius(cand.select(gap.alias("band"), (F.col("mode_family") == F.col("t_mode_family")).alias("same")), F.lit(0), max(256, 4 * limit), max(32, 2 * limit)).first()["radius"]
    cand = cand.where(F.col("difficulty_band").between(at["t_difficulty_band"] - radius, at["t_difficulty_band"] + radius))
    pick = lambda side, struct, fields: [F.col(f"{side}{struct}.{f}") for f in fields]
    cand = cand.withColumns({
        "skill": S.hellinger(pick("t_", "difficulty", MANIA_AXES), pick("", "difficulty", MANIA_AXES)),
        "pattern": S.hellinger(pick("t_", "style", PATTERNS), pick("", "style", PATTERNS)),
        "structure": S.rms_distance(pick("t_", "style", STRUCTURE), pick("", "style", STRUCTURE)),
        "level": F.abs(F.col("t_difficulty_percentile") - F.col("difficulty_percentile")),
        "context": 0.5 * S.log_ratio(F.col("t_base.bpm"), F.col("base.bpm"), 4.0) + 0.5 * S.log_ratio(F.col("t_base.active_length_seconds"), F.col("base.active_length_seconds"), 10.0),
    })
    final = 0.35 * F.col("skill") + 0.30 * F.col("pattern") + 0.20 * F.col("structure") + 0.10 * F.col("level") + 0.05 * F.col("context")
    out = cand.withColumn("final_distance", final).orderBy("final_distance", *S.unsigned_order(F.col("beatmap_id"))).limit(limit)
    return out.select("beatmap_id", "beatmapset_id", "key_count", "mode_family", "difficulty_percentile", "difficulty_band", "final_distance", "skill", "pattern", "structure", "level", "context")
