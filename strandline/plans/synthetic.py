"""Chart texts made from the events table, one per user, so that the chart plans run over a whole table.

Every event is a hit object: its time and value place it, its type makes it a circle, a slider or a spinner (free aim), or a note or a
long note (lanes).  There are no chart files among the driver's tables.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.archives import RAR, SEVEN_ZIP


def _text(events: DataFrame, line, header) -> DataFrame:
    """chart_id, content: a chart of all events of each user, in order.  A chart is one file, so a user's lines do meet in one row."""
    lines = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ms", "event_id", line.alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    return lines.select(F.col("user_id").alias("chart_id"), F.concat(header, body).cast("binary").alias("content"))


def _events(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = e.agg(F.min("ts").alias("t0"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    # A tenth of a second of play for each second and a half or so of the table's months.
    return e.join(F.broadcast(first)).withColumn("ms", F.floor(micros / 10_000_000).cast("long"))


def std_charts(spark, sf_dir: str) -> DataFrame:
    x, y = F.pmod(F.floor(F.col("value") * 37).cast("long"), F.lit(512)), F.pmod(F.col("event_id") * 53, F.lit(384))
    flags = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 8).otherwise(1)
    extra = F.when(flags == 2, F.concat(F.lit(",L|"), (x + 40).cast("string"), F.lit(":"), (y + 30).cast("string"), F.lit(",1,70"))).when(flags == 8, F.concat(F.lit(","), (F.col("ms") + 500).cast("string"))).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(",", x, y, "ms", flags, F.lit(0)), extra)
    head = F.concat(F.lit("[General]\nMode: 0\n[Metadata]\nBeatmapID:"), (F.col("user_id") + 1).cast("string"), F.lit("\n[Difficulty]\nCircleSize:4\nApproachRate:8\n[TimingPoints]\n0,500,4,2,1,60,1,0\n90000,-50,4,2,1,60,0,0\n[HitObjects]\n"))
    return _text(_events(spark, sf_dir), line, head)


def lane_charts(spark, sf_dir: str) -> DataFrame:
    x = F.pmod(F.floor(F.col("value") * 37).cast("long"), F.lit(512))
    long = F.col("event_type") == "purchase"
    line = F.concat_ws(",", x, F.lit(192), "ms", F.when(long, 128).otherwise(1), F.lit(0), F.when(long, F.concat((F.col("ms") + 300).cast("string"), F.lit(":0:0:0:0:"))).otherwise("0:0:0:0:"))
    keys = F.element_at(F.array(F.lit("4"), F.lit("6"), F.lit("7"), F.lit("5")), (F.pmod(F.col("user_id"), F.lit(4)) + 1).cast("int"))
    head = F.concat(F.lit("[General]\nMode: 3\n[Metadata]\nBeatmapID:"), (F.col("user_id") + 1).cast("string"), F.lit("\n[Difficulty]\nCircleSize:"), keys, F.lit("\n[TimingPoints]\n0,500,4,2,1,60,1,0\n[HitObjects]\n"))
    return _text(_events(spark, sf_dir), line, head)


#: Documents of an archive; what its number makes of it: packs within, a RAR or 7z head, half an archive, one without charts, or plain members.
IN_ARCHIVE = 20
ARCHIVE_KINDS = ("nested", "7z", "rar", "broken", "empty", "plain")


def archives(spark, sf_dir: str) -> DataFrame:
    """path, content: archives whose charts are the texts of ``IN_ARCHIVE`` documents with neighbouring ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.floor(F.col("doc_id") / IN_ARCHIVE).cast("long").alias("a"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f, a = f.sort_values("doc_id"), int(f["a"].iloc[0])
        kind = ARCHIVE_KINDS[a % len(ARCHIVE_KINDS)]

        def zipped(suffix: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for i, text in zip(f["doc_id"], f["text"], strict=True):
                    z.writestr(f"{i}.{suffix}", (text or "").encode())
            return out.getvalue()

        raw = {"7z": SEVEN_ZIP, "rar": RAR, "empty": zipped("txt")}.get(kind) or zipped("osu")
        if kind == "nested":
            outer = io.BytesIO()
            with zipfile.ZipFile(outer, "w") as z:
                z.writestr("in.osz", raw)
            raw = outer.getvalue()
        return pd.DataFrame({"path": [f"a{a}"], "content": [raw[: len(raw) // 2] if kind == "broken" else raw]})

    return docs.groupBy("a").applyInPandas(pack, "path string, content binary")


def rated(charts: DataFrame) -> DataFrame:
    """What a calculator might say of the std charts: small numbers made of their ids."""
    n = lambda k, by: (F.pmod(F.col("chart_id") * k, F.lit(by)) / 10.0)
    return charts.select(F.sha2("content", 256).alias("sha256"), n(7, 31).alias("aim"), n(5, 17).alias("speed"), n(3, 13).alias("reading"), (3.0 + n(11, 29)).alias("stars"), F.lit(100).alias("max_combo"))
