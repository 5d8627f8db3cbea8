"""Free-aim charts: base features, the slider dimension and the overlap dimension, all as DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import OVERLAP_STATS, STD_ANALYZER, STD_BASE, OverlapConfig
from ..settle import settled
from . import series, tokenise

SLIDER_SHARE, SLIDER_CHANGES = 0.30, 0.70
NEVER = float("inf")


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def point_to_segment(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sq = dx * dx + dy * dy
    t = F.when(sq == 0, 0.0).otherwise(S.clamp(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / sq, 0.0, 1.0))
    return length(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def segment_to_segment(a: Column, b: Column, c: Column, d: Column) -> Column:
    """0 where the lines cross, also where collinear segments don't meet."""
    crossing = (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)
    return F.when(crossing, 0.0).otherwise(F.least(point_to_segment(a, c, d), point_to_segment(b, c, d), point_to_segment(c, a, b), point_to_segment(d, a, b)))


def segments(path: Column) -> Column:
    """Neighbouring points of a path, as pairs."""
    n = F.size(path)
    return F.when(n > 1, F.zip_with(F.slice(path, F.lit(1), n - 1), F.slice(path, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.slice(F.array(F.struct(F.get(path, 0).alias("a"), F.get(path, 0).alias("b"))), 1, 0))


def point_to_path(p: Column, path: Column) -> Column:
    near = F.array_min(F.transform(segments(path), lambda s: point_to_segment(p, s["a"], s["b"])))
    head = F.get(path, 0)
    return F.least(F.coalesce(near, F.lit(NEVER)), length(p["x"] - head["x"], p["y"] - head["y"]))


def path_to_path(one: Column, two: Column) -> Column:
    """Without limit where either path is a single point."""
    near = F.transform(segments(one), lambda s: F.array_min(F.transform(segments(two), lambda t: segment_to_segment(s["a"], s["b"], t["a"], t["b"]))))
    return F.coalesce(F.array_min(near), F.lit(NEVER))


def object_distance(a: Column, b: Column) -> Column:
    sa, sb = a["kind"] == "slider", b["kind"] == "slider"
    return F.when(sa & sb, path_to_path(a["path"], b["path"])).when(sa, point_to_path(b, a["path"])).when(sb, point_to_path(a, b["path"])).otherwise(length(a["x"] - b["x"], a["y"] - b["y"]))


def ordered(objects: DataFrame) -> DataFrame:
    """With ``i``, the place by time (file order breaks ties), and the place of the object before."""
    w = Window.partitionBy("chart_id").orderBy("time", "line_no")
    before = F.lag(F.struct("x", "y")).over(w)
    return objects.withColumn("i", F.row_number().over(w) - 1).withColumn("before", before)


def overlap_pairs(objects: DataFrame, meta: DataFrame, cfg: OverlapConfig) -> DataFrame:
    """chart_id, i and, of each earlier object seen at the same time, its score and marks.  Spinners don't count, but are places between."""
    cols = ["i", "x", "y", "end_time", "kind", "path", "before"]
    seen = objects.where("kind <> 'spinner'")
    pairs = series.interval_pairs(seen, "chart_id", F.col("time"), cfg.window_ms, cols).where("pri.i < cur.i")
    p = pairs.join(meta.select("chart_id", S.preempt_ms(F.col("ar")).alias("preempt"), (54.4 - 4.48 * F.col("cs")).alias("radius")), "chart_id")
    cur, pri = F.col("cur"), F.col("pri")
    visible = S.interval_overlap(cur["t"] - F.col("preempt"), cur["end_time"], pri["t"] - F.col("preempt"), pri["end_time"])
    p = p.withColumn("visible", visible).where("visible > 0")
    # What several terms use is a column of its own: expressions that contain each other several times make code too long to compile.
    p = p.withColumns({"dt": F.abs(cur["t"] - pri["t"]), "q": object_distance(cur, pri) / F.greatest(2.0 * F.col("radius"), F.lit(1.0))})
    q = F.col("q")
    p = p.withColumns({"near": q <= cfg.maximum_distance_ratio, "fade": F.exp(-F.col("dt") / cfg.temporal_tau_ms), "push": S.speed_pressure(F.col("dt")), "a_slider": cur["kind"] == "slider", "b_slider": pri["kind"] == "slider"})
    square = lambda x: x * x
    spatial = 0.8 * square(F.greatest(1.0 - q, F.lit(0.0))) + 0.2 * square(F.greatest(1.0 - q / cfg.maximum_distance_ratio, F.lit(0.0)))
    p = p.withColumn("spatial", F.when(F.col("near"), spatial).otherwise(0.0))
    sp, push, near = F.col("spatial"), F.col("push"), F.col("near")
    p = p.withColumns({
        "circle": F.when(F.col("a_slider") & F.col("b_slider"), 0.0).otherwise(sp),
        "slider": F.when(F.col("a_slider") | F.col("b_slider"), sp).otherwise(0.0),
        "stack": F.when(near & (q <= cfg.stack_distance_ratio), sp * push).otherwise(0.0),
        "crossing": near & F.col("pri.before").isNotNull() & F.col("cur.before").isNotNull(),
        "ux": pri["x"] - pri["before"]["x"], "uy": pri["y"] - pri["before"]["y"], "vx": cur["x"] - cur["before"]["x"], "vy": cur["y"] - cur["before"]["y"],
    })
    p = p.withColumn("apart", F.when(F.col("crossing"), segment_to_segment(pri["before"], pri, cur["before"], cur)))
    u, v = length(F.col("ux"), F.col("uy")), length(F.col("vx"), F.col("vy"))
    angle = S.clamp(F.abs(F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx")) / F.greatest(u * v, F.lit(1.0)), 0.0, 1.0)
    p = p.withColumn("cross", F.when(F.col("apart") <= F.col("radius"), angle * F.col("fade")).otherwise(0.0))
    ambiguity = sp / F.sqrt((cur["i"] - pri["i"]).cast("double"))
    weighed = cfg.circle_weight * F.col("circle") + cfg.slider_weight * F.col("slider") + cfg.ambiguity_weight * ambiguity + cfg.stack_weight * F.col("stack") + cfg.crossing_weight * F.col("cross")
    score = F.when(near, F.col("visible") / F.greatest(F.col("preempt"), F.lit(1.0)) * F.col("fade") * push * weighed).otherwise(0.0)
    return p.select("chart_id", cur["i"].alias("i"), score.alias("score"), (F.col("stack") > 0).alias("stacks"), (F.col("slider") > 0).alias("occludes"), (F.col("cross") > 0).alias("crosses"))


def overlap_statistics(objects: DataFrame, meta: DataFrame, cfg: OverlapConfig | None = None) -> DataFrame:
    """chart_id and OVERLAP_STATS.

    The strain after each object decays between them.  A section's peak is the strain that stands at its end, so an object's strain counts as often as
    sections end before the next object, and once more at the end of the chart.
    """
    cfg = cfg or OverlapConfig()
    pairs = overlap_pairs(objects, meta, cfg)
    per = pairs.groupBy("chart_id", "i").agg(F.max("score").alias("most"), F.sum("score").alias("all"), F.count(F.lit(1)).alias("seen"), *[F.count_if(c).alias(c) for c in ("stacks", "occludes", "crosses")])
    o = objects.where("kind <> 'spinner'").select("chart_id", "i", "time").join(per, ["chart_id", "i"], "left")
    o = settled(o.withColumn("score", F.coalesce(0.65 * F.col("most") + 0.35 * F.log1p("all"), F.lit(0.0))))
    strain = series.decayed_sum(o.select("chart_id", "i", "time", "score"), "chart_id", "time", "score", 1000.0 / -math.log(cfg.strain_decay_base), ["i"], "strain")
    strain = settled(strain)
    w = Window.partitionBy("chart_id").orderBy("time", "i")
    at = lambda t: F.greatest(F.ceil(t / cfg.section_ms), F.lit(0))
    nxt = F.lead("time").over(w)
    times = strain.withColumn("times", F.when(nxt.isNull(), F.lit(1).cast("long")).otherwise(at(nxt) - at(F.col("time"))))
    first = strain.groupBy("chart_id").agg(F.min("time").alias("t")).select("chart_id", F.lit(0.0).alias("strain"), at(F.col("t")).alias("times"))
    peaks = times.select("chart_id", "strain", "times").unionByName(first).where("times > 0")
    down = Window.partitionBy("chart_id").orderBy(F.desc("strain")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = peaks.withColumn("upto", F.sum("times").over(down)).withColumn("n", F.sum("times").over(Window.partitionBy("chart_id")))
    d = cfg.peak_weight_decay
    weight = (F.pow(F.lit(d), F.col("upto") - F.col("times")) - F.pow(F.lit(d), F.col("upto"))) / (1 - d)
    place = F.floor((F.col("n") - 1) * 0.05)
    here = (F.col("upto") - F.col("times") <= place) & (place < F.col("upto"))
    top = ranked.groupBy("chart_id").agg(F.sum(F.col("strain") * weight).alias("peak"), F.max(F.when(here, F.col("strain"))).alias("p95"))
    sums = o.groupBy("chart_id").agg(F.count_if(F.col("score") > 0).alias("live"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "stacks", "occludes", "crosses")])
    count = objects.groupBy("chart_id").agg(F.count(F.lit(1)).alias("objects"))
    out = count.join(sums, "chart_id", "left").join(top, "chart_id", "left")
    share = lambda c: F.coalesce(F.col(c) / F.greatest(F.col("seen"), F.lit(1)), F.lit(0.0))
    values = {"peak": F.coalesce("peak", F.lit(0.0)), "p95": F.coalesce("p95", F.lit(0.0)), "sustained_ratio": F.coalesce(F.col("live") / F.col("objects"), F.lit(0.0)), "stack_rate": share("stacks"), "slider_occlusion_rate": share("occludes"), "path_crossing_rate": share("crosses")}
    return out.select("chart_id", *[values[k].cast("float").alias(k) for k in OVERLAP_STATS])


def slider_dimension(objects: DataFrame) -> DataFrame:
    """chart_id, slider: the share of sliders among hit objects, and how often their speed changes."""
    w = Window.partitionBy("chart_id").orderBy("i")
    s = objects.where("kind = 'slider'").withColumn("p", F.lag("slider_speed").over(w))
    changed = F.abs(F.col("slider_speed") - F.col("p")) > 1e-6 * F.greatest(F.abs("slider_speed"), F.abs("p"), F.lit(1.0))
    moves = s.groupBy("chart_id").agg(F.count("p").alias("moves"), F.count_if(changed).alias("changes"))
    kinds = objects.groupBy("chart_id").agg(F.count_if(F.col("kind") == "slider").alias("sliders"), F.count_if(F.col("kind") != "spinner").alias("hits"))
    both = kinds.join(moves, "chart_id", "left")
    return both.select("chart_id", (SLIDER_SHARE * S.safe_ratio(F.col("sliders"), F.col("hits")) + SLIDER_CHANGES * S.safe_ratio(F.col("changes"), F.col("moves"))).cast("float").alias("slider"))


def base_features(objects: DataFrame, meta: DataFrame, points: DataFrame) -> DataFrame:
    """chart_id and all STD_BASE but max_combo."""
    n = F.count(F.lit(1))
    per = objects.groupBy("chart_id").agg(n.alias("n"), (F.max_by("end_time", "i") - F.min_by("time", "i")).alias("ms"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("circle", "slider", "spinner")])
    good = F.col("uninherited") & (F.col("beat_length") > 0)
    bpm = points.where(good).groupBy("chart_id").agg((60000.0 / F.min_by("beat_length", "line_no")).alias("bpm"))
    b = meta.join(per, "chart_id", "left").join(bpm, "chart_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ms, count = zero(F.col("ms")), F.coalesce("n", F.lit(0))
    v = {"bpm": zero(F.col("bpm")), **{c: F.col(c) for c in ("ar", "od", "cs", "hp")}, "length_seconds": F.greatest(ms / 1000.0, F.lit(0.0)), "object_count": count, "object_density": F.when(ms > 0, count / (ms / 1000.0)).otherwise(0.0), **{f"{k}_ratio": S.safe_ratio(F.coalesce(k, F.lit(0)), count) for k in ("circle", "slider", "spinner")}}
    return b.select("chart_id", *[v[k].cast("float").alias(k) for k in STD_BASE if k != "max_combo"])


def std_features(charts: DataFrame, attributes: DataFrame, cfg: OverlapConfig | None = None) -> DataFrame:
    """A row per chart: ids, names, status, stars, the five axes, base, overlap, analyzer_version.

    ``charts``: chart_id, content; ``attributes``: sha256, aim, speed, reading, stars, max_combo, from a calculator outside.  Status: ok, invalid (not UTF-8), unsupported mode, or missing attributes.
    """
    lines = settled(tokenise.chart_lines(charts, lossy=False))
    meta = tokenise.std_meta(lines)
    points = tokenise.timing_points(lines)
    meta, points = settled(meta), settled(points)
    objects = settled(ordered(tokenise.with_slider_speeds(tokenise.std_objects(lines), points, meta)))
    ids = tokenise.identified(meta, charts)
    out = _joined(ids, objects, meta, points, cfg)
    out = out.join(attributes, "sha256", "left")
    valid = charts.select("chart_id", F.try_validate_utf8(F.col("content").cast("string")).isNotNull().alias("readable"))
    out = out.join(valid, "chart_id")
    status = F.when(~F.col("readable"), "invalid").when(F.coalesce("mode", F.lit(0)) != 0, "unsupported mode").when(F.col("stars").isNull(), "missing attributes").otherwise("ok")
    base = F.struct(*[F.col(f"b_{k}").alias(k) for k in STD_BASE if k != "max_combo"], F.col("max_combo").cast("float").alias("max_combo"))
    overlap = F.struct(*[F.col(f"o_{k}").alias(k) for k in OVERLAP_STATS])
    axes = [F.col("aim").cast("float").alias("aim"), F.col("speed").cast("float").alias("speed"), F.col("reading").cast("float").alias("reading"), F.coalesce("slider", F.lit(0.0)).cast("float").alias("slider"), F.coalesce("o_peak", F.lit(0.0)).cast("float").alias("overlap")]
    return out.select("chart_id", "beatmap_id", "beatmapset_id", "sha256", "artist", "title", "version", "creator", "online_url", status.alias("status"), "stars", *axes, base.alias("base"), overlap.alias("overlap_stats"), F.lit(STD_ANALYZER).alias("analyzer_version"), F.lit(0).alias("mod_profile"))


def _joined(ids: DataFrame, objects: DataFrame, meta: DataFrame, points: DataFrame, cfg: OverlapConfig | None) -> DataFrame:
    base = base_features(objects, meta, points)
    base = base.select("chart_id", *[F.col(c).alias(f"b_{c}") for c in base.columns if c != "chart_id"])
    over = overlap_statistics(objects, meta, cfg)
    over = over.select("chart_id", *[F.col(c).alias(f"o_{c}") for c in over.columns if c != "chart_id"])
    plain = ids.drop("ar", "od", "cs", "hp", "slider_multiplier")
    return plain.join(base, "chart_id", "left").join(slider_dimension(objects), "chart_id", "left").join(over, "chart_id", "left")
