"""Parsers of catalogue pages, mirror answers, cookie files, API records and logs.  Nothing here opens a connection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The named entities that links use.
NAMED = {"amp": "&", "apos": "'", "quot": '"', "lt": "<", "gt": ">"}
SLOW_BYTES, SLOW_SECONDS = 60 << 20, 60


def decode_entities(text: str) -> str:
    """One pass from left to right: an ampersand takes all up to the next semicolon as its name, and unknown names stay as they are."""
    out, at = [], 0
    while (amp := text.find("&", at)) >= 0:
        out.append(text[at:amp])
        end = text.find(";", amp)
        if end < 0:
            return "".join([*out, text[amp:]])
        name = text[amp + 1 : end]
        value = NAMED.get(name)
        if value is None and name[:1] == "#":
            hexa = name[1:2] in ("x", "X")
            try:
                code = int(name[2:] if hexa else name[1:], 16 if hexa else 10)
                value = chr(code) if not 0xD800 <= code < 0xE000 else None
            except (ValueError, OverflowError):
                value = None
        out.append(text[amp : end + 1] if value is None else value)
        at = end + 1
    return "".join([*out, text[at:]])


def _decode(s: pd.Series) -> pd.Series:
    """Texts without an ampersand, most of them, stay as they are."""
    some = s.str.contains("&", regex=False, na=False)
    return s.mask(some, s[some].map(decode_entities))


def entities(text: Column) -> Column:
    """``decode_entities`` over Arrow batches: its single pass can't be had by replacing names one after another."""
    return F.pandas_udf(_decode, "string")(text)


def pack_ids(html: DataFrame, col: str = "html") -> DataFrame:
    """pack_id: the distinct ids that follow /beatmaps/packs/, in order; they begin with a letter and have two characters or more."""
    found = F.explode(F.regexp_extract_all(col, F.lit(r"/beatmaps/packs/([A-Za-z0-9]+)"), F.lit(1)))
    return html.select(found.alias("pack_id")).where(F.col("pack_id").rlike("^[A-Za-z].+$")).distinct().orderBy("pack_id")


#: Fixed value: what a page with a following one holds.
MORE_PAGES = "pagination-v2__link pagination-v2__link--quick"


def paged_pack_ids(pages: DataFrame) -> DataFrame:
    """pack_id: distinct ids of all pages (kind, page, html) that a reader reaches who begins at the first page of a kind and stops at a page without ids, or behind one that
    doesn't link to another."""
    ids = F.filter(F.regexp_extract_all("html", F.lit(r"/beatmaps/packs/([A-Za-z0-9]+)"), F.lit(1)), lambda x: x.rlike("^[A-Za-z].+$"))
    each = pages.select("kind", "page", ids.alias("ids"), F.contains("html", F.lit(MORE_PAGES)).alias("more"))
    # The page at which the reader stops: the first gap, empty page or last link; pages of a kind are few.
    order = Window.partitionBy("kind").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max((~F.col("more")).cast("int")).over(before)
    empty = F.max((F.size("ids") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    reached = each.withColumn("n", F.row_number().over(order)).withColumn("stopped", F.coalesce(stopped, F.lit(0))).withColumn("empty", empty)
    return reached.where("n = page and stopped = 0 and empty = 0").select(F.explode("ids").alias("pack_id")).distinct().orderBy("pack_id")


def pack_class(pack_id: Column) -> Column:
    """standard, excluded (other modes) or mixed."""
    return F.when(pack_id.rlike(r"^S\d+$"), "standard").when(pack_id.rlike(r"^S[TMC]\d+$"), "excluded").otherwise("mixed")


def standard_packs(packs: DataFrame) -> DataFrame:
    return packs.where(pack_class(F.col("pack_id")) == "standard")


def download_link(html: Column, hosts: list[str]) -> Column:
    """The first href, entities decoded, whose host is allowed (or lies under one that is)."""
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    plain = F.split(entities(F.array_join(links, "\n")), "\n")
    allowed = "|".join(h.replace(".", r"\.") for h in hosts)
    return F.try_element_at(F.filter(plain, lambda u: u.rlike(rf"^https://([^/?#@]*\.)?({allowed})(:\d+)?([/?#]|$)")), F.lit(1))


def mirror_link(answer: Column) -> Column:
    """The link of a mirror's JSON that says success and gives a secure address, else null."""
    j = F.from_json(answer, "success boolean, url string, download_url string")
    url = F.coalesce(j["url"], j["download_url"])
    return F.when(j["success"] & url.startswith("https://"), url)


def source_link(mirror: Column, official: Column) -> Column:
    return F.coalesce(mirror, official)


def too_slow(bytes_in_window: Column) -> Column:
    """Of the bytes that came in a window of SLOW_SECONDS."""
    return bytes_in_window < SLOW_BYTES


def cookies(lines: DataFrame, domain: str) -> DataFrame:
    """cookie: one header of all cookies for a domain or those under it, in file order.  ``lines``: line_no, value."""
    data = F.regexp_replace("value", "^#HttpOnly_", "")
    f = F.split(data, "\t")
    host = F.regexp_replace(F.get(f, 0), r"^\.", "")
    good = ~data.startswith("#") & (F.size(f) >= 7) & ((host == domain) | host.endswith(f".{domain}"))
    pair = F.concat(F.get(f, 5), F.lit("="), F.get(f, 6))
    listed = lines.where(good).agg(F.sort_array(F.collect_list(F.struct("line_no", pair.alias("pair")))).alias("x"))  # as long as a cookie file
    return listed.select(F.array_join(F.transform("x", lambda r: r["pair"]), "; ").alias("cookie"))


def ranked_charts(spark: SparkSession, path: str) -> DataFrame:
    """beatmap_id, beatmapset_id, version, mode of ranked lane charts in JSON records of sets with nested charts."""
    schema = "id long, ranked int, status string, beatmaps array<struct<id:long,mode:string,ranked:int,status:string,version:string>>"
    sets = spark.read.schema(schema).json(path).where((F.col("ranked") == 1) | (F.col("status") == "ranked"))
    each = sets.select(F.col("id").alias("beatmapset_id"), F.explode("beatmaps").alias("b"))
    ranked = (F.col("b.ranked") == 1) | (F.col("b.status") == "ranked")
    return each.where((F.col("b.mode") == "mania") & ranked).select(F.col("b.id").alias("beatmap_id"), "beatmapset_id", F.col("b.version").alias("version"), F.col("b.mode").alias("mode"))


def manifest(charts: DataFrame, files: DataFrame, failures: DataFrame) -> DataFrame:
    """``charts`` with status: downloaded where a file is there, failed where a failure is, else pending."""
    f = files.select("beatmap_id").distinct().withColumn("__file", F.lit(True))
    x = failures.select("beatmap_id").distinct().withColumn("__failed", F.lit(True))
    both = charts.join(f, "beatmap_id", "left").join(x, "beatmap_id", "left")
    return both.withColumn("status", F.when(F.col("__file"), "downloaded").when(F.col("__failed"), "failed").otherwise("pending")).drop("__file", "__failed")


def log_outcomes(lines: DataFrame) -> DataFrame:
    """outcome, n: how many lines of a retry log say downloaded, skipped or failed."""
    found = F.regexp_extract(F.lower("value"), r"\b(downloaded|skipped|failed)\b", 1)
    return lines.select(found.alias("outcome")).where("outcome <> ''").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
