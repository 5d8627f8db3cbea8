"""Chart files in folders and archives.

Archives are read with ``binaryFile``; one row is one archive, and members leave a task one by one.  7z and RAR have no reader in the standard
library: such archives, and broken ones, become rows with a status, never silence.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How containers begin.
SEVEN_ZIP, RAR = bytes([0x37, 0x7A, 0xBC, 0xAF, 0x27, 0x1C]), b"Rar!\x1a\x07"
CHART, PACK = ".osu", ".osz"
#: A member that claims more unpacked bytes than this is refused.
MOST_BYTES = 256 << 20


def chart_folder(spark: SparkSession, path: str) -> DataFrame:
    """chart_id (the file name's number, or else a digest), source_id, path, content of each chart file in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{CHART}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    source = F.regexp_extract("path", r"/(\d+)\.osu$", 1).try_cast("long")
    return files.select(F.coalesce(source, F.xxhash64("path")).alias("chart_id"), source.alias("source_id"), "path", "content")


MEMBERS = "archive string, member string, status string, content binary"


def archive_members(archives: DataFrame) -> DataFrame:
    """MEMBERS of archives (path, content): a row per chart, also of packs one level down, and a row without content per failure.

    Status: ok, failed (broken archive or member), unsupported, or empty (no chart at all).
    """

    def walk(raw: bytes, deep: bool) -> Iterator[tuple[str, str, bytes | None]]:
        try:
            z = zipfile.ZipFile(io.BytesIO(raw))
        except (zipfile.BadZipFile, ValueError, NotImplementedError):
            yield "", "failed", None
            return
        with z:
            for info in z.infolist():
                name = info.filename.lower()
                if not name.endswith((CHART, PACK)) or info.is_dir() or (name.endswith(PACK) and not deep):
                    continue
                try:
                    if info.file_size > MOST_BYTES:
                        raise zipfile.BadZipFile("too large")
                    data = z.read(info)
                except (zipfile.BadZipFile, ValueError, NotImplementedError, RuntimeError, EOFError, OSError):
                    yield info.filename, "failed", None
                    continue
                except Exception as e:  # zlib.error isn't one of these
                    if type(e).__name__ != "error":
                        raise
                    yield info.filename, "failed", None
                    continue
                if name.endswith(CHART):
                    yield info.filename, "ok", data
                else:
                    for inner, status, content in walk(data, False):
                        yield f"{info.filename}/{inner}", status, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                kind = "7z" if raw[:6] == SEVEN_ZIP else "rar" if raw[:6] == RAR else "zip"
                found = 0
                for member, status, content in walk(raw, True) if kind == "zip" else [(kind, "unsupported", None)]:
                    found += 1
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member]), pa.array([status]), pa.array([content], pa.binary())], ["archive", "member", "status", "content"])
                if not found:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([""]), pa.array(["empty"]), pa.array([None], pa.binary())], ["archive", "member", "status", "content"])

    return archives.select("path", "content").mapInArrow(run, MEMBERS)


def verify_archives(archives: DataFrame) -> DataFrame:
    """path, status of each archive after unpacking every member: ok, failed or unsupported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("content").to_pylist():
                if raw[:6] in (SEVEN_ZIP, RAR):
                    out.append("unsupported")
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        out.append("ok" if z.testzip() is None else "failed")
                except Exception:  # whatever a broken archive raises means the same
                    out.append("failed")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out)], ["path", "status"])

    return archives.select("path", "content").mapInArrow(run, "path string, status string")


def archive_charts(files: DataFrame, standard_only: bool) -> DataFrame:
    """Charts (chart_id, path, status, content) of archives (path, content); failures of members have no content."""
    from ..operators.tokenise import lenient_mode

    m = archive_members(files)
    wanted = F.when(m["content"].isNull(), True).otherwise(lenient_mode(m["content"]) == 0) if standard_only else F.lit(True)
    return m.where(wanted).select(F.xxhash64("archive", "member").alias("chart_id"), F.concat_ws("!", "archive", "member").alias("path"), "status", "content")


def ingest_archives(spark: SparkSession, path: str) -> DataFrame:
    """Standard charts of all archives under a path, with status."""
    return archive_charts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), True)
