"""From chart files to feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import mania_features as M
from ..operators import ranks, tokenise
from ..schema import FAMILIES, MANIA_ANALYZER, MANIA_AXES, PATTERN_LABELS, STD_AXES
from ..settle import settled


def mania_charts(charts: DataFrame) -> DataFrame:
    """A row per chart (chart_id, content, and source_id where the file's name has one): ids, names, key_count, status and features.

    Status: ok, invalid, unsupported mode or unsupported keys; features are null unless it is ok.  A source id counts more than the chart's own.
    """
    lines = settled(tokenise.chart_lines(charts, lossy=True))
    meta = settled(tokenise.mania_meta(lines))
    objects = tokenise.mania_objects(lines, meta)
    status = tokenise.mania_status(meta, objects)
    sound = status.where("status = 'ok'").select("chart_id")
    found = settled(M.mania_features(objects.join(sound, "chart_id").select("chart_id", "start", "column", "end", "long"), meta.select("chart_id", "key_count", "bpm", "sv_changes")))
    ids = tokenise.identified(meta, charts)
    if "source_id" in charts.columns:
        named = charts.select("chart_id", F.when(F.col("source_id") != 0, F.col("source_id")).alias("source_id"))
        ids = ids.join(named, "chart_id").withColumn("beatmap_id", F.coalesce("source_id", "beatmap_id"))
    out = ids.join(status, "chart_id", "left").join(found.withColumnRenamed("status", "found"), "chart_id", "left")
    whole = F.when((F.col("status") == "ok") & (F.col("found") != "ok"), "invalid").otherwise(F.coalesce("status", F.lit("invalid")))
    return out.select("chart_id", "beatmap_id", "beatmapset_id", "sha256", "artist", "title", "version", "creator", S.chart_url(F.col("beatmap_id").cast("string")).alias("online_url"), F.col("key_count").cast("byte").alias("key_count"), whole.alias("status"), "difficulty", "style", "base", F.col("mode_family").cast("byte").alias("mode_family"), F.col("dominant_pattern").cast("byte").alias("dominant_pattern"), F.lit(MANIA_ANALYZER).alias("analyzer_version"))


def normalise_std(raw: DataFrame, version: int) -> DataFrame:
    """``raw`` (status ok) with its axes as shares of smaller distinct values."""
    raw = settled(raw)
    rows = raw.where("status = 'ok'")
    missing = raw.where("status = 'missing attributes'")
    if not missing.isEmpty():
        raise ValueError("some charts have no attributes; analyse them again first")
    ranked = ranks.rank_axes(rows, "beatmap_id", STD_AXES)
    ranked = ranked.select("beatmap_id", *[F.col(a).cast("float").alias(a) for a in STD_AXES])
    return rows.drop(*STD_AXES).join(ranked, "beatmap_id").withColumn("normalization_version", F.lit(version)).withColumn("flags", F.lit(0))


def _axis_table(rows: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"difficulty.{a}").alias("value")) for a in MANIA_AXES]))
    return rows.select("beatmap_id", "key_count", pairs.alias("p")).select("beatmap_id", "key_count", "p.*")


def fit_mania(raw: DataFrame) -> dict[str, DataFrame]:
    """Normalisers per key count: of each axis, and of the overall intensity."""
    rows = raw.where("status = 'ok'")
    long = settled(_axis_table(rows))
    axes = settled(ranks.fit_midrank(long, "value", ["key_count", "axis"]))
    overall = settled(_overall(ranks.apply_ranks(long, axes, "value", "rank", ["key_count", "axis"])))
    return {"axes": axes, "overall": settled(ranks.fit_midrank(overall, "overall", ["key_count"]))}


def _overall(ranked: DataFrame) -> DataFrame:
    wide = ranked.groupBy("beatmap_id", "key_count").agg(*[F.max(F.when(F.col("axis") == a, F.col("rank").cast("float"))).alias(a) for a in MANIA_AXES])
    return wide.withColumn("overall", S.overall_intensity([F.col(a) for a in MANIA_AXES]).cast("float"))


def normalise_mania(raw: DataFrame, version: int, fitted: dict[str, DataFrame] | None = None) -> DataFrame:
    """``raw`` (status ok) with difficulty as midranks among charts of its key count, difficulty_percentile and difficulty_band."""
    raw = settled(raw)
    rows = raw.where("status = 'ok'")
    if not rows.where(F.col("analyzer_version") != MANIA_ANALYZER).isEmpty():
        raise ValueError("charts of another analyzer version; analyse them again first")
    fitted = fitted or fit_mania(raw)
    wide = _overall(ranks.apply_ranks(_axis_table(rows), fitted["axes"], "value", "rank", ["key_count", "axis"]))
    whole = ranks.apply_ranks(wide, fitted["overall"], "overall", "difficulty_percentile", ["key_count"])
    got = whole.select("beatmap_id", F.struct(*MANIA_AXES).alias("difficulty"), F.col("difficulty_percentile").cast("float").alias("difficulty_percentile"))
    out = rows.drop("difficulty").join(got, "beatmap_id")
    return out.withColumn("difficulty_band", S.band(F.col("difficulty_percentile")).cast("byte")).withColumn("normalization_version", F.lit(version))


def fit_std(raw: DataFrame) -> dict[str, DataFrame]:
    """The std normaliser: axis, value, rank and n of each distinct value."""
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in STD_AXES]))
    long = raw.where("status = 'ok'").select(pair.alias("p")).select("p.*")
    return {"axes": settled(ranks.fit_distinct(long, "value", ["axis"]))}


def std_target(raw: DataFrame, fitted: dict[str, DataFrame], version: int) -> DataFrame:
    """Analysed charts that needn't be in the corpus, normalised as the corpus was."""
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in STD_AXES]))
    rows = raw.where("status = 'ok'")
    long = rows.select("beatmap_id", pair.alias("p")).select("beatmap_id", "p.*")
    ranked = ranks.rank_outside(long, fitted["axes"], "value", "rank", "distinct", ["axis"])
    wide = ranked.groupBy("beatmap_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("rank").cast("float"))).alias(a) for a in STD_AXES])
    return rows.drop(*STD_AXES).join(wide, "beatmap_id").withColumn("normalization_version", F.lit(version)).withColumn("flags", F.lit(0))


def mania_target(raw: DataFrame, fitted: dict[str, DataFrame], version: int) -> DataFrame:
    """One analysed chart that needn't be in the corpus, normalised as the corpus was."""
    long = _axis_table(raw.where("status = 'ok'").limit(1))
    wide = _overall(ranks.rank_outside(long, fitted["axes"], "value", "rank", "midrank", ["key_count", "axis"]))
    ranked = ranks.rank_outside(wide, fitted["overall"], "overall", "difficulty_percentile", "midrank", ["key_count"])
    got = ranked.select("beatmap_id", F.struct(*MANIA_AXES).alias("difficulty"), F.col("difficulty_percentile").cast("float").alias("difficulty_percentile"))
    return raw.drop("difficulty").join(got, "beatmap_id").withColumn("difficulty_band", S.band(F.col("difficulty_percentile")).cast("byte")).withColumn("normalization_version", F.lit(version))


def labelled(features: DataFrame) -> DataFrame:
    return features.withColumn("family", S.label(F.col("mode_family"), FAMILIES)).withColumn("pattern", S.label(F.col("dominant_pattern"), PATTERN_LABELS))


def import_archives(store, path: str, version: int, attributes: DataFrame | None = None) -> dict:
    """All of an import in one call: archives, analysis, upsert, sources, failures, fit, publication and audit; the report of it.

    Archives and charts that fail are counted and logged; the others are published.  ``attributes``: what the calculator outside says of standard charts.
    """
    from ..operators.std_features import std_features
    from ..sources.archives import archive_charts

    files = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    members = settled(archive_charts(files, standard_only=store.mode == "std"))
    charts = members.where("status = 'ok'").select("chart_id", "path", "content")
    found = settled(std_features(charts, attributes) if store.mode == "std" else mania_charts(charts))
    report = store.upsert_raw(found)
    store.retain_sources(charts, found)
    broken = members.where("status not in ('ok', 'empty')").select("chart_id", "status")
    report["failed"] += broken.count()
    store.log_failures(found.select("chart_id", "status").unionByName(broken))
    raw = store.raw()
    fitted = fit_std(raw) if store.mode == "std" else fit_mania(raw)
    store.save_normaliser(version, fitted)
    store.publish(version, normalise_std(raw, version) if store.mode == "std" else normalise_mania(raw, version, fitted))
    report["sound"] = store.doctor(version).where("not ok").isEmpty()
    return report
