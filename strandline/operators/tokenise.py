"""Chart text as tables: lines, sections, keys and values, timing points and hit objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import KEY_COUNTS
from .series import asof_carry



def trimmed(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$", "")


def chart_lines(charts: DataFrame, lossy: bool) -> DataFrame:
    """chart_id, line_no, section, line of each line that is neither blank nor a comment, headers left out.

    ``charts``: chart_id, content (binary).  Content that isn't UTF-8 is made valid if ``lossy``, else its chart has no lines.
    """
    text = F.make_valid_utf8(F.col("content").cast("string")) if lossy else F.try_validate_utf8(F.col("content").cast("string"))
    lines = charts.select("chart_id", F.posexplode(F.split(text, "\r?\n")).alias("line_no", "raw")).select("chart_id", "line_no", trimmed(F.col("raw")).alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("//"))
    header = F.col("line").startswith("[") & F.col("line").endswith("]") & (F.length("line") > 1)
    order = Window.partitionBy("chart_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.last(F.when(header, F.expr("substring(line, 2, length(line) - 2)")), ignorenulls=True).over(order))
    return named.where(~header & F.col("section").isNotNull()).select("chart_id", "line_no", "section", "line")


def last_value(section: str, key: str, exact: bool = False) -> Column:
    """The value of a key's last line in a section, as an aggregate.  ``exact``: the key starts the line, and ``:`` follows it."""
    if exact:
        here = (F.col("section") == section) & F.col("line").startswith(f"{key}:")
    else:
        here = (F.col("section") == section) & F.contains("line", F.lit(":")) & (trimmed(F.element_at(F.split("line", ":", 2), 1)) == key)
    value = trimmed(F.expr("substring(line, instr(line, ':') + 1)"))
    return F.max_by(F.when(here, value), F.when(here, F.col("line_no")))


META = ("Artist", "Title", "Version", "Creator")


def _ids(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^\+?[0-9]{1,20}$"), F.regexp_replace(text, r"^\+", "").try_cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))


def identified(meta: DataFrame, charts: DataFrame) -> DataFrame:
    """With sha256, and beatmap_id: the chart's own, or the first bytes of its digest, as a signed long."""
    sha = charts.select("chart_id", F.sha2("content", 256).alias("sha256"))
    both = sha.join(meta, "chart_id", "left")
    own = _ids(F.col("map_id"))
    unsigned = F.when((own > 0) & (own < F.lit(str(2**64)).cast("decimal(20,0)")), own.cast("string")).otherwise(S.unsigned_id(F.col("sha256")))
    set_id = _ids(F.col("set_id"))
    return both.withColumn("unsigned_id", unsigned).withColumn("beatmap_id", S.signed_id(unsigned)).withColumn("beatmapset_id", S.signed_id(F.when(set_id < F.lit(str(2**64)).cast("decimal(20,0)"), set_id).otherwise(F.lit(0)).cast("string"))).withColumn("online_url", S.chart_url(unsigned)).drop("map_id", "set_id")


def std_meta(lines: DataFrame) -> DataFrame:
    """One row per chart: mode, ids, names, ar, od, cs, hp, slider_multiplier.  Values that don't parse count as 5."""
    d = {"ar": ("ApproachRate", 5.0), "od": ("OverallDifficulty", 5.0), "cs": ("CircleSize", 5.0), "hp": ("HPDrainRate", 5.0), "slider_multiplier": ("SliderMultiplier", 1.4)}
    agg = [last_value("General", "Mode").alias("mode_text"), last_value("Metadata", "BeatmapID").alias("map_id"), last_value("Metadata", "BeatmapSetID").alias("set_id"), *(F.coalesce(last_value("Metadata", k), F.lit("")).alias(k.lower()) for k in META), *(last_value("Difficulty", k).alias(n) for n, (k, _) in d.items())]
    m = lines.groupBy("chart_id").agg(*agg)
    mode = F.when(F.col("mode_text").isNull(), 0).otherwise(F.coalesce(F.when(F.col("mode_text").rlike(r"^[+-]?[0-9]+$"), F.col("mode_text").try_cast("int")), F.lit(-1)))
    return m.withColumn("mode", mode).withColumns({n: F.when(F.col(n).isNull(), absent).otherwise(F.coalesce(S.number(F.col(n)), F.lit(5.0))) for n, (_, absent) in d.items()}).drop("mode_text")


def timing_points(lines: DataFrame) -> DataFrame:
    """chart_id, line_no, time, beat_length, uninherited of lines with two fields or more."""
    f = F.split("line", ",")
    beat = F.coalesce(S.number(F.get(f, 1)), F.lit(0.0))
    flag = F.get(f, 6)
    return lines.where((F.col("section") == "TimingPoints") & (F.size(f) > 1)).select("chart_id", "line_no", F.coalesce(S.number(F.get(f, 0)), F.lit(0.0)).alias("time"), beat.alias("beat_length"), F.when(flag.isNotNull(), trimmed(flag) == "1").otherwise(beat > 0).alias("uninherited"))


def std_objects(lines: DataFrame) -> DataFrame:
    """chart_id, line_no, x, y, time, end_time, kind and path (the head and the control points of a slider)."""
    f = F.split("line", ",")
    n = lambda i: F.coalesce(S.number(F.get(f, i)), F.lit(0.0))
    flags = F.coalesce(S.number(F.get(f, 3), "long"), F.lit(0).cast("long"))
    kind = F.when(flags.bitwiseAND(F.lit(8)) != 0, "spinner").when(flags.bitwiseAND(F.lit(2)) != 0, "slider").otherwise("circle")
    o = lines.where((F.col("section") == "HitObjects") & (F.size(f) >= 5)).select("chart_id", "line_no", n(0).alias("x"), n(1).alias("y"), n(2).alias("time"), kind.alias("kind"), F.get(f, 5).alias("extra"))
    fields = F.split("extra", r"\|")
    points = F.filter(F.slice(fields, F.lit(2), F.size(fields)), lambda p: F.contains(p, F.lit(":")))
    parsed = F.transform(points, lambda p: F.struct(F.coalesce(S.number(F.element_at(F.split(p, ":", 2), 1)), F.col("x")).alias("x"), F.coalesce(S.number(F.element_at(F.split(p, ":", 2), 2)), F.col("y")).alias("y")))
    head = F.array(F.struct("x", "y"))
    path = F.when((F.col("kind") == "slider") & F.col("extra").isNotNull(), F.concat(head, parsed)).otherwise(head)
    end = F.when(F.col("kind") == "spinner", F.coalesce(S.number(F.col("extra")), F.col("time"))).otherwise(F.col("time"))
    return o.select("chart_id", "line_no", "x", "y", "time", end.alias("end_time"), "kind", path.alias("path"))


def with_slider_speeds(objects: DataFrame, points: DataFrame, meta: DataFrame) -> DataFrame:
    """``objects`` with slider_speed, from the beat length and the velocity as of each object: two independent states."""
    beat = F.when(F.col("uninherited") & (F.col("beat_length") > 0), F.col("beat_length"))
    velocity = F.when(~F.col("uninherited") & (F.col("beat_length") < 0), S.clamp(-100.0 / F.col("beat_length"), 0.1, 10.0))
    # Of points at the same time the last line counts, for each state by itself.
    p = points.select("chart_id", "time", "line_no", beat.alias("beat"), velocity.alias("velocity")).groupBy("chart_id", "time").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in ("beat", "velocity")])
    got = asof_carry(p, objects, "chart_id", "time", ["beat", "velocity"], "line_no").join(meta.select("chart_id", "slider_multiplier"), "chart_id")
    speed = S.slider_speed(F.col("slider_multiplier"), F.coalesce("velocity", F.lit(1.0)), F.coalesce("beat", F.lit(1000.0)))
    return got.withColumn("slider_speed", F.when(F.col("kind") == "slider", speed).otherwise(0.0)).drop("beat", "velocity", "slider_multiplier")


def mania_meta(lines: DataFrame) -> DataFrame:
    """One row per chart: mode and key count (null where missing or unreadable), ids, names, bpm (upper median) and sv_changes."""
    f = F.split("line", ",")
    timed = (F.col("section") == "TimingPoints") & (F.size(f) >= 7)
    beat = F.coalesce(S.number(F.get(f, 1)), F.lit(0.0))
    red = trimmed(F.get(f, 6)) == "1"
    bpms = F.sort_array(F.collect_list(F.when(timed & red & (beat > 0), 60000.0 / beat)))
    keys = S.number(last_value("Difficulty", "CircleSize", True))
    mode = S.number(last_value("General", "Mode", True), "long")
    m = lines.groupBy("chart_id").agg(F.when(mode <= 255, mode).cast("int").alias("mode"), F.when(keys.isNotNull(), F.floor(F.least(F.greatest(keys, F.lit(0.0)), F.lit(255.0)) + 0.5)).cast("int").alias("key_count"), last_value("Metadata", "BeatmapID", True).alias("map_id"), last_value("Metadata", "BeatmapSetID", True).alias("set_id"), *(F.coalesce(last_value("Metadata", k, True), F.lit("")).alias(k.lower()) for k in META), bpms.alias("bpms"), F.count_if(timed & ~red & (beat < 0)).alias("sv_changes"))
    return m.withColumn("bpm", F.coalesce(F.get("bpms", F.floor(F.size("bpms") / 2).cast("int")), F.lit(0.0))).drop("bpms")


def mania_objects(lines: DataFrame, meta: DataFrame) -> DataFrame:
    """chart_id, line_no, start, column, end, long, valid."""
    f = F.split("line", ",")
    x, t = S.number(F.get(f, 0)), S.number(F.get(f, 2))
    flags = F.coalesce(S.number(F.get(f, 3), "long"), F.lit(0).cast("long"))
    tail = S.number(F.element_at(F.split(F.get(f, 5), ":"), 1))
    o = lines.where((F.col("section") == "HitObjects") & (F.size(f) >= 5)).select("chart_id", "line_no", x.alias("x"), t.alias("start"), (flags.bitwiseAND(F.lit(128)) != 0).alias("long"), tail.alias("tail"))
    end = F.when(F.col("long"), F.greatest(F.coalesce("tail", F.col("start")), F.col("start"))).otherwise(F.col("start"))
    both = o.join(meta.select("chart_id", "key_count"), "chart_id")
    return both.select("chart_id", "line_no", "start", S.lane_of(F.col("x"), F.col("key_count")).alias("column"), end.alias("end"), "long", (F.col("x").isNotNull() & F.col("start").isNotNull()).alias("valid"))


def mania_status(meta: DataFrame, objects: DataFrame) -> DataFrame:
    """chart_id, status: ok, invalid, unsupported mode or unsupported keys."""
    seen = objects.groupBy("chart_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("valid").cast("int")).alias("sound"))
    both = meta.select("chart_id", "mode", "key_count").join(seen, "chart_id", "left")
    bad = F.col("mode").isNull() | (F.coalesce("sound", F.lit(1)) == 0)
    status = F.when(bad, "invalid").when(F.col("mode") != 3, "unsupported mode").when(F.col("key_count").isNull(), "invalid").when(~F.col("key_count").isin(*KEY_COUNTS), "unsupported keys").when(F.coalesce("n", F.lit(0)) == 0, "invalid").otherwise("ok")
    return both.select("chart_id", status.alias("status"))


def lenient_mode(content: Column) -> Column:
    """The mode that an importer goes by: standard where it is missing, unreadable or not UTF-8."""
    text = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    found = F.regexp_extract(text, r"(?im)^\s*mode\s*:\s*(.*?)\s*$", 1)
    return F.coalesce(F.when(found.rlike(r"^[+-]?[0-9]+$"), found.try_cast("int")), F.lit(0))
