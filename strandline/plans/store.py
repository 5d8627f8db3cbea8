"""A versioned store of charts: Parquet snapshots and one state that names those that count, validated before they are published.

A table is a folder of snapshots.  The state is a small JSON file of its own number; the greatest number counts, so a change of any number of tables is one
write, and a failed or half-done publication changes nothing.  Nothing is ever overwritten.  Paths go through Hadoop's file systems, so the store
may lie wherever Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import tables
from ..schema import KEY_COUNTS, MANIA_ANALYZER, MANIA_AXES, MANIA_BASE, PATTERNS, STD_ANALYZER, STD_AXES, STD_BASE, STRUCTURE

META = ("beatmapset_id", "artist", "title", "version", "creator", "online_url", "stars")


class Store:
    def __init__(self, spark: SparkSession, root: str, mode: str = "std", algorithm: str = "1"):
        if mode not in ("std", "mania"):
            raise ValueError("mode must be std or mania")
        self.spark, self.root, self.mode, self.algorithm = spark, f"{root.rstrip('/')}/{mode}", mode, algorithm

    @classmethod
    def open(cls, spark: SparkSession, root: str, mode: str = "std", algorithm: str = "1") -> Store:
        return cls(spark, root, mode, algorithm)

    # Files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(f"{self.root}/state")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self) -> dict:
        """The snapshot of each table, and values by name."""
        numbers = self._numbers()
        if not numbers:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/state/{numbers[-1]:012d}.json").first()[0])

    def _change(self, **values) -> None:
        """A new state with these values; None takes one away."""
        new = {k: v for k, v in (self.state() | values).items() if v is not None}
        number = (self._numbers() or [0])[-1] + 1
        fs, part = self._fs(f"{self.root}/state/{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        _, target = self._fs(f"{self.root}/state/{number:012d}.json")
        if fs.exists(target) or not fs.rename(part, target):
            raise OSError("another writer has changed the store")

    def read(self, name: str) -> DataFrame | None:
        at = self.state().get(name)
        return None if at is None else self.spark.read.parquet(f"{self.root}/{name}/{at}")

    def _write(self, name: str, df: DataFrame, by: list[str] | None = None) -> str:
        at = uuid.uuid4().hex
        w = df.write.partitionBy(*by) if by else df.write
        w.parquet(f"{self.root}/{name}/{at}")
        return at

    # Raw features

    def snapshot_ok(self) -> bool:
        return self.state().get("algorithm", self.algorithm) == self.algorithm

    def reset_snapshot(self) -> bool:
        """Drops what another algorithm made of this version; whether there was any."""
        stale = not self.snapshot_ok()
        gone = dict.fromkeys(("raw", "features", "stats", "index", "normaliser"), None) if stale else {}
        self._change(algorithm=self.algorithm, **gone)
        return stale

    def pending(self, charts: DataFrame) -> DataFrame:
        """``charts`` (sha256, and beatmap_id where it is known) without those that are analysed already, by the same algorithm."""
        done = self.read("raw") if self.snapshot_ok() else None
        return charts if done is None else tables.pending(charts, done, ["sha256"])

    def upsert_raw(self, df: DataFrame) -> dict[str, int]:
        """Adds analysed charts; the same content again changes nothing, other content replaces the chart's row and voids what was published."""
        if not self.snapshot_ok():
            raise ValueError("the store was made by another algorithm: reset it first")
        bad = df.where(F.col("status") == "ok").where(~F.coalesce(self.valid_raw(), F.lit(False)))
        if not bad.isEmpty():
            raise ValueError("raw features outside their range")
        good = tables.latest(df.where(F.col("status") == "ok"), ["beatmap_id"], [F.col("sha256")])
        old = self.read("raw")
        known = good.limit(0) if old is None else good.join(old.select("beatmap_id", "sha256"), ["beatmap_id", "sha256"], "left_semi")
        fresh = good.join(known.select("beatmap_id"), "beatmap_id", "left_anti")
        counts = {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
        n = fresh.count()
        report = {"processed": sum(counts.values()), "inserted": n, "skipped": counts.get("ok", 0) - n, "failed": sum(v for k, v in counts.items() if k != "ok")}
        stale = self._stale(known, old)
        if n:
            merged = fresh if old is None else tables.upsert(_renamed(old, stale), fresh.select(*old.columns), ["beatmap_id"])
            self._change(algorithm=self.algorithm, stats=None, features=None, index=None, raw=self._write("raw", merged))
        elif stale is not None:
            self._change(algorithm=self.algorithm, stats=None, raw=self._write("raw", _renamed(old, stale)))
        self._count_scan(counts)
        return report

    def _stale(self, known: DataFrame, old: DataFrame | None) -> DataFrame | None:
        """Names and stars of charts whose content is the same and whose stars aren't; None if there is no such chart."""
        if old is None or self.mode != "std":
            return None
        before = old.select("beatmap_id", F.col("stars").alias("__stars"))
        new = known.join(before, "beatmap_id").where(~F.col("stars").eqNullSafe(F.col("__stars"))).select("beatmap_id", *META)
        return None if new.isEmpty() else new

    def _count_scan(self, counts: dict[str, int]) -> None:
        unsupported = sum(v for k, v in counts.items() if k.startswith("unsupported"))
        eligible = counts.get("ok", 0)
        self._change(scan={"eligible": eligible, "unsupported": unsupported, "failed": sum(counts.values()) - eligible - unsupported})

    def scan_counts(self) -> dict[str, int]:
        """How many charts of the last run were eligible, unsupported and failed."""
        return self.state().get("scan", {"eligible": 0, "unsupported": 0, "failed": 0})

    def valid_raw(self) -> Column:
        if self.mode == "std":
            parts = [_finite(a) for a in STD_AXES] + [_finite(f"base.{b}") for b in STD_BASE] + [F.col("mod_profile") == 0, F.col("analyzer_version") == STD_ANALYZER, _finite("stars") & (F.col("stars") >= 0)]
        else:
            parts = [_finite(f"difficulty.{a}", 0) for a in MANIA_AXES] + [_finite(f"style.{a}", 0, 1) for a in PATTERNS + STRUCTURE] + [_finite(f"base.{b}", 0) for b in MANIA_BASE]
            parts += [F.col("key_count").isin(*KEY_COUNTS), F.col("analyzer_version") == MANIA_ANALYZER]
        return _all(parts)

    def raw(self) -> DataFrame:
        found = self.read("raw")
        if found is None:
            raise ValueError("nothing has been analysed")
        return found

    def raw_for(self, beatmap_id: int) -> DataFrame:
        return self.raw().where(F.col("beatmap_id") == beatmap_id)

    def meta(self) -> DataFrame:
        """Ids, digest, names and address of each analysed chart."""
        return self.raw().select("beatmap_id", "beatmapset_id", "sha256", "artist", "title", "version", "creator", "online_url")

    def named(self, results: DataFrame) -> DataFrame:
        """Query results with artist, title and version; an error where a result's chart isn't in the store."""
        names = self.raw().select("beatmap_id", "artist", "title", "version", F.lit(True).alias("__known"))
        both = F.broadcast(results).join(names, "beatmap_id", "left")  # at most a query's limit of rows
        title = F.when(F.col("__known"), F.col("title")).otherwise(F.raise_error(F.concat(F.lit("no names of chart "), F.col("beatmap_id"))).cast("string"))
        return both.withColumn("title", title).drop("__known")

    # Sources, failures and packs

    def _merge(self, name: str, incoming: DataFrame, keys: list[str]) -> int:
        old = self.read(name)
        n = incoming.count()
        if n:
            self._change(**{name: self._write(name, incoming if old is None else tables.upsert(old, incoming.select(*old.columns), keys))})
        return n

    def retain_sources(self, charts: DataFrame, analysed: DataFrame) -> int:
        """Keeps the content (chart_id, content) of charts that were analysed, by beatmap_id."""
        ids = analysed.where("status = 'ok'").select("chart_id", "beatmap_id", "sha256")
        return self._merge("sources", tables.latest(charts.select("chart_id", "content").join(ids, "chart_id").select("beatmap_id", "sha256", "content"), ["beatmap_id"], [F.col("sha256")]), ["beatmap_id"])

    def log_failures(self, analysed: DataFrame) -> DataFrame:
        """chart_id, status of the charts of this run that failed; it replaces the log of the run before, and is empty after a run without failures."""
        self._change(failures=self._write("failures", analysed.where("status <> 'ok'").select("chart_id", "status")))
        return self.read("failures")

    def upsert_packs(self, packs: DataFrame) -> int:
        """pack_id, source_url, status, error, updated_at: the latest state of a pack counts; its address stays the first one."""
        new = tables.latest(packs.select("pack_id", "source_url", "status", "error", "updated_at"), ["pack_id"], [F.col("updated_at"), F.col("status")])
        old = self.read("packs")
        if old is not None:
            first = old.select("pack_id", F.col("source_url").alias("__url"))
            new = new.join(first, "pack_id", "left").withColumn("source_url", F.coalesce("__url", "source_url")).drop("__url")
        return self._merge("packs", new, ["pack_id"])

    def pack_is(self, pack_id: str, status: str) -> bool:
        packs = self.read("packs")
        return packs is not None and not packs.where((F.col("pack_id") == pack_id) & (F.col("status") == status)).isEmpty()

    # Normalisers

    def save_normaliser(self, version: int, fitted: dict[str, DataFrame]) -> None:
        """Keeps the tables of a fitted normaliser, so that charts from outside are placed without fitting the corpus again."""
        tables_ = {k: self._write(f"normaliser-{k}", df) for k, df in fitted.items()}
        self._change(normaliser={"version": version, "analyzer": self._analyzer(), "tables": tables_})

    def load_normaliser(self, version: int) -> dict[str, DataFrame]:
        kept = self.state().get("normaliser")
        if kept is None or (kept["version"], kept["analyzer"]) != (version, self._analyzer()):
            raise ValueError("no normaliser of this version and analyzer")
        return {k: self.spark.read.parquet(f"{self.root}/normaliser-{k}/{at}") for k, at in kept["tables"].items()}

    def _analyzer(self) -> int:
        return STD_ANALYZER if self.mode == "std" else MANIA_ANALYZER

    # Publication

    def publish(self, version: int, df: DataFrame) -> None:
        """Validates and publishes normalised features, and with them the statistics of star sections (std) and a digest of their content."""
        if df.isEmpty():
            raise ValueError("nothing to publish")
        at = self._write("features", df, ["key_count", "difficulty_band"] if self.mode == "mania" else None)
        staged = self.spark.read.parquet(f"{self.root}/features/{at}")
        problems = self.problems(version, staged)
        if not problems.isEmpty():
            raise ValueError(f"invalid features: {[tuple(r) for r in problems.limit(5).collect()]}")
        stats = self._write("stats", section_stats(staged)) if self.mode == "std" else None
        self._change(features=at, stats=stats, index={"version": version, **content_digest(staged)})

    def problems(self, version: int, df: DataFrame) -> DataFrame:
        """beatmap_id, problem of rows that must not be published."""
        if self.mode == "std":
            good = [_finite(a, 0, 1) for a in STD_AXES] + [_finite(f"base.{c}") for c in ("ar", "cs", "od")] + [F.col("mod_profile") == 0, _finite("stars", 0)]
        else:
            good = [_finite(f"difficulty.{a}", 0, 1) for a in MANIA_AXES] + [_finite(f"style.{a}", 0, 1) for a in PATTERNS + STRUCTURE] + [_finite("difficulty_percentile", 0, 1), F.col("difficulty_band").between(0, 9), F.col("key_count").isin(*KEY_COUNTS)]
        good += [F.col("normalization_version") == version, F.col("analyzer_version") == self._analyzer()]
        range_ = df.where(~F.coalesce(_all(good), F.lit(False))).select("beatmap_id", F.lit("out of range").alias("problem"))
        twice = df.groupBy("beatmap_id").count().where("count > 1").select("beatmap_id", F.lit("repeated").alias("problem"))
        return range_.unionByName(twice).unionByName(tables.coverage(self.raw(), df, "beatmap_id")).unionByName(self._disagreeing(df))

    def _disagreeing(self, df: DataFrame) -> DataFrame:
        """Features whose set, keys, family or pattern isn't that of the chart they were made from."""
        same = ["beatmapset_id", *(("key_count", "mode_family", "dominant_pattern") if self.mode == "mania" else ())]
        raw = self.raw().select("beatmap_id", *[F.col(c).cast("long").alias(f"__{c}") for c in same])
        agree = _all([F.col(c).cast("long").eqNullSafe(F.col(f"__{c}")) for c in same])
        return df.join(raw, "beatmap_id").where(~agree).select("beatmap_id", F.lit("disagrees with its chart").alias("problem"))

    def features(self, version: int, verify: bool = False) -> DataFrame:
        """What is published.  ``verify``: reads it once more and compares its digest with the one kept; an error where they differ."""
        found, index = self.read("features"), self.state().get("index")
        if found is None or not self.snapshot_ok():
            raise ValueError("nothing is published")
        if index["version"] != version:
            raise ValueError(f"version {index['version']} is published, not {version}")
        if verify and content_digest(found) != {k: index[k] for k in ("rows", "digest")}:
            raise ValueError("the published features aren't those that were written")
        return found

    def stats(self) -> DataFrame | None:
        return self.read("stats")

    def doctor(self, version: int) -> DataFrame:
        """check, ok, detail: whether the published state is whole, with counts by key, band and family (mania)."""
        f = self.read("features")
        rows = [("algorithm", self.snapshot_ok(), ""), ("published", f is not None, "")]
        if f is not None:
            n = self.problems(version, f).count()
            rows.append(("features", n == 0, f"{n} problems in {f.count()} rows"))
            index = self.state().get("index", {})
            rows.append(("content", content_digest(f) == {k: index.get(k) for k in ("rows", "digest")}, ""))
            rows += [(k, True, str(v)) for k, v in sorted(self.scan_counts().items())]
            if self.mode == "std":
                want, got = section_stats(f), self.stats()
                rows.append(("section statistics", got is not None and _close(want, got), ""))
            else:
                rows += [(f"{r['axis']}={r['value']}", True, str(r["n"])) for r in tables.histogram(f, ["key_count", "difficulty_band", "mode_family"]).collect()]
        return self.spark.createDataFrame(rows, "check string, ok boolean, detail string")


def _finite(c: str, lo: float | None = None, hi: float | None = None) -> Column:
    x = F.col(c).cast("double")
    parts = [F.col(c).isNotNull(), ~F.isnan(x), F.abs(x) < float("inf")]
    return _all([*parts, *([x >= lo] if lo is not None else []), *([x <= hi] if hi is not None else [])])


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _renamed(old: DataFrame, stale: DataFrame | None) -> DataFrame:
    """``old`` with the names and stars of ``stale``; vectors stay as they are."""
    if stale is None:
        return old
    new = stale.select("beatmap_id", F.struct(*META).alias("__new"))
    both = old.join(new, "beatmap_id", "left")
    return both.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in META else F.col(c) for c in old.columns])


def content_digest(df: DataFrame) -> dict:
    """Rows and a digest that depends neither on their order nor on their files."""
    cols = sorted(df.columns)
    # Partition columns come back with types of their own.
    flat = F.xxhash64(F.to_json(F.struct(*[F.col(c) if "struct" in df.schema[c].dataType.simpleString() else F.col(c).cast("string").alias(c) for c in cols])))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(flat.cast("decimal(38,0)")).alias("d"), F.bit_xor(flat).alias("x")).first()
    return {"rows": r["n"], "digest": f"{r['d']}:{r['x']}"}


def section_stats(df: DataFrame) -> DataFrame:
    """Counts, sums and sums of squares of the axes and of ar, cs and od by tenth of a star."""
    m = {a: F.col(a).cast("double") for a in STD_AXES} | {c: F.col(f"base.{c}").cast("double") for c in ("ar", "cs", "od")}
    aggs = [F.sum(x).alias(f"sum_{k}") for k, x in m.items()] + [F.sum(x * x).alias(f"sumsq_{k}") for k, x in m.items()]
    return df.withColumn("star_section", S.star_section(F.col("stars"))).groupBy("star_section", "analyzer_version", "normalization_version").agg(F.count(F.lit(1)).alias("count"), *aggs)


def _close(a: DataFrame, b: DataFrame) -> bool:
    """Equal up to the order of addition."""
    keys = ["star_section", "analyzer_version", "normalization_version"]
    values = [c for c in a.columns if c not in keys]
    both = a.join(b.select(*keys, *[F.col(c).alias(f"__{c}") for c in values]), keys, "full_outer")
    bad = F.lit(False)
    for c in values:
        bad = bad | F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) > 1e-9 * F.greatest(F.abs(c), F.lit(1.0)), F.lit(True))
    return both.where(bad).isEmpty()


def printed(results: DataFrame, digits: int = 4) -> DataFrame:
    """line: id, distances and axes of query results, tab-separated; ids as unsigned numbers."""
    numbers = [c for c, t in results.dtypes if t in ("float", "double")]
    unsigned = F.conv(F.hex("beatmap_id"), 16, 10)
    return results.select(F.concat_ws("\t", unsigned, *[F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in numbers]).alias("line"))


STD_EXPORT = ("beatmap_id", "beatmapset_id", *STD_AXES, "ar", "cs", "bpm")


def export(df: DataFrame, path: str, fmt: str, mode: str = "std") -> None:
    """CSV with a header, or Parquet, of flat columns.  CSV has labels where Parquet has codes."""
    from ..schema import FAMILIES, MANIA_BASE, PATTERN_LABELS

    if mode == "std":
        flat = df.select("beatmap_id", "beatmapset_id", *[F.col(a).cast("float").alias(a) for a in STD_AXES], *[F.col(f"base.{c}").cast("float").alias(c) for c in ("ar", "cs", "bpm")])
    else:
        kinds = [F.col("mode_family"), F.col("dominant_pattern")] if fmt == "parquet" else [S.label(F.col("mode_family"), FAMILIES).alias("mode_family"), S.label(F.col("dominant_pattern"), PATTERN_LABELS).alias("dominant_pattern")]
        flat = df.select("beatmap_id", "beatmapset_id", "key_count", *kinds, "difficulty_percentile", "difficulty_band", *[F.col(f"difficulty.{a}").alias(a) for a in MANIA_AXES], *[F.col(f"style.{a}").alias(a) for a in PATTERNS + STRUCTURE], *[F.col(f"base.{a}").alias(f"base_{a}") for a in MANIA_BASE])
    if fmt == "csv":
        flat.write.csv(path, header=True)
    elif fmt == "parquet":
        flat.write.parquet(path)
    else:
        raise ValueError("csv or parquet")
