import io
import math
import random
import zipfile

import pytest
from charts import lane_chart, std_chart, stream
from pyspark.sql import functions as F

from strandline.functions import scalar as S
from strandline.operators import similarity, std_features
from strandline.plans import charts as P
from strandline.plans.store import Store, export, section_stats
from strandline.sources import archives, catalogue_text
from strandline.streaming import ingest
from test_charts import attributes, frame

A = [(i * 100 % 500, i * 70 % 380, 1000 + i * 150) for i in range(20)]


def analysed(spark, texts):
    df = frame(spark, texts)
    return std_features.std_features(df, attributes(df)).cache()


def test_store_std(spark, tmp_path):
    s = Store.open(spark, str(tmp_path), "std", "a1")
    first = analysed(spark, [std_chart(10, A), std_chart(20, A[:10]), std_chart(30, A, mode=3)])
    assert s.upsert_raw(first) == {"processed": 3, "inserted": 2, "skipped": 0, "failed": 1}
    assert s.upsert_raw(first)["inserted"] == 0 and s.pending(first).count() == 1
    features = P.normalise_std(s.raw(), 1)
    s.publish(1, features)
    assert s.features(1).count() == 2 and s.doctor(1).where("not ok").isEmpty()
    for bad in (features.withColumn("aim", F.lit(float("nan")).cast("float")), features.unionByName(features), features.where("beatmap_id = 10"), features.limit(0)):
        with pytest.raises(ValueError):
            s.publish(1, bad)
    assert s.features(1).count() == 2 and s.doctor(1).where("not ok").isEmpty()
    changed = analysed(spark, [std_chart(10, A[:15])])
    assert s.upsert_raw(changed)["inserted"] == 1 and s.raw().count() == 2
    with pytest.raises(ValueError):
        s.features(1)
    other = Store.open(spark, str(tmp_path), "std", "a2")
    assert not other.snapshot_ok()
    with pytest.raises(ValueError):
        other.upsert_raw(changed)
    assert other.reset_snapshot() and other.upsert_raw(changed)["inserted"] == 1


def test_publication_is_checked_and_stale_stars_only_rename(spark, tmp_path):
    s = Store.open(spark, str(tmp_path), "std", "a1")
    first = analysed(spark, [std_chart(10, A), std_chart(20, A[:10]), std_chart(30, A, mode=3), b"\xff"])
    s.upsert_raw(first)
    assert s.scan_counts() == {"eligible": 2, "unsupported": 1, "failed": 1}
    fitted = P.fit_std(s.raw())
    s.save_normaliser(1, fitted)
    features = P.normalise_std(s.raw(), 1)
    s.publish(1, features)
    # Rows placed by the kept normaliser are those of the corpus.
    kept = Store.open(spark, str(tmp_path), "std", "a1").load_normaliser(1)
    same = lambda df: sorted(tuple(round(x[a], 6) for a in ("beatmap_id", "aim", "slider", "overlap")) for x in df.collect())
    assert same(P.std_target(s.raw(), kept, 1)) == same(features)
    with pytest.raises(ValueError):
        s.load_normaliser(2)
    for bad in (features.withColumn("analyzer_version", F.lit(3)), features.withColumn("base", F.col("base").withField("cs", F.lit(float("inf")).cast("float"))), features.withColumn("beatmapset_id", F.lit(77).cast("long"))):
        with pytest.raises(ValueError):
            s.publish(1, bad)
    assert s.features(1, verify=True).count() == 2
    with pytest.raises(ValueError):
        s.features(2)
    named = s.named(s.features(1).select("beatmap_id", F.lit(0.5).alias("distance"))).collect()
    assert {(x["beatmap_id"], x["title"]) for x in named} == {(10, "Song 10"), (20, "Song 20")}
    with pytest.raises(Exception, match="no names of chart 5"):
        s.named(spark.createDataFrame([(5, 0.1)], "beatmap_id long, distance double")).collect()
    # The same content with other stars: names and stars change, features stay, statistics go.
    again = first.withColumn("stars", F.col("stars") + 1)
    assert s.upsert_raw(again)["inserted"] == 0
    assert {x["stars"] for x in s.raw().collect()} == {6.7} and s.stats() is None and s.features(1).count() == 2
    # A file that was changed by other hands is noticed.
    at = s.state()["features"]
    s.features(1).withColumn("aim", (F.col("aim") + 0.25).cast("float")).write.parquet(f"{s.root}/features/other")
    s._change(features="other")
    assert s.doctor(1).where("not ok and check = 'content'").count() == 1
    with pytest.raises(ValueError):
        s.features(1, verify=True)
    s._change(features=at)


def test_wrong_base_features_are_refused(spark, tmp_path):
    s = Store.open(spark, str(tmp_path), "mania")
    raw = P.mania_charts(frame(spark, [lane_chart(10, 4, stream(4, 140)), lane_chart(20, 4, stream(4, 100))])).cache()
    for name in ("bpm", "peak_nps"):
        with pytest.raises(ValueError):
            s.upsert_raw(raw.withColumn("base", F.col("base").withField(name, F.lit(-1.0).cast("float"))))
    for column, value in (("analyzer_version", 9), ("key_count", 5)):
        with pytest.raises(ValueError):
            s.upsert_raw(raw.withColumn(column, F.lit(value)))
    with pytest.raises(ValueError):
        P.normalise_mania(raw.withColumn("analyzer_version", F.lit(9)), 1)
    assert s.state() == {}


def test_an_import_in_one_call(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pack = zipped({"a/x.osu": lane_chart(10, 4, stream(4, 140)), "b.osu": lane_chart(20, 4, stream(4, 100)), "c.osu": lane_chart(30, 5, stream(5, 100))})
    (tmp_path / "in" / "one.osz").write_bytes(pack)
    (tmp_path / "in" / "two.zip").write_bytes(zipped({"in.osz": pack, "d.osu": lane_chart(40, 7, stream(7, 90))})[:-40])
    s = Store.open(spark, str(tmp_path / "store"), "mania")
    report = P.import_archives(s, str(tmp_path / "in"), 1)
    assert report == {"processed": 3, "inserted": 2, "skipped": 0, "failed": 2, "sound": True}
    assert s.features(1, verify=True).count() == 2 and s.read("sources").count() == 2
    assert sorted(x["status"] for x in s.read("failures").collect()) == ["failed", "unsupported keys"]
    outside = P.mania_target(s.raw_for(10), s.load_normaliser(1), 1)
    assert [x["beatmap_id"] for x in similarity.mania_similar(s.features(1), outside).collect()] == [20]
    with pytest.raises(Exception, match="another version"):
        similarity.mania_similar(s.features(1), outside.withColumn("normalization_version", F.lit(2))).collect()
    assert s.features(1).select(F.size(similarity.searchable_vector())).first()[0] == 24


def test_sources_failures_and_packs(spark, tmp_path):
    from strandline.plans.store import printed

    s = Store.open(spark, str(tmp_path), "std")
    df = frame(spark, [std_chart(10, A), std_chart(30, A, mode=3)])
    got = std_features.std_features(df, attributes(df)).cache()
    assert s.retain_sources(df, got) == 1 and bytes(s.read("sources").first()["content"]) == std_chart(10, A).encode()
    assert [r["status"] for r in s.log_failures(got).collect()] == ["unsupported mode"]
    assert s.log_failures(got.where("status = 'ok'")).isEmpty()
    schema = "pack_id string, source_url string, status string, error string, updated_at long"
    s.upsert_packs(spark.createDataFrame([("S1", "u1", "downloading", None, 1), ("S1", "u1", "failed", "x", 2)], schema))
    assert s.pack_is("S1", "failed") and not s.pack_is("S1", "complete")
    s.upsert_packs(spark.createDataFrame([("S1", "u2", "complete", None, 3)], schema))
    assert s.pack_is("S1", "complete") and s.read("packs").first()["source_url"] == "u1"
    rows = spark.createDataFrame([(-1, 0.25)], "beatmap_id long, d double")
    assert printed(rows).first()[0] == "18446744073709551615\t0.2500"


def test_section_statistics(spark):
    r = random.Random(4)
    axes, base = ("aim", "speed", "reading", "slider", "overlap"), ("ar", "cs", "od")
    rows = [(i, r.choice([0.0, 2.3, 2.34, 2.39999, 4.0, 9.95]), *[r.random() for _ in axes], tuple(r.uniform(1, 10) for _ in base)) for i in range(60)]
    df = spark.createDataFrame(rows, "beatmap_id long, stars double, aim double, speed double, reading double, slider double, overlap double, base struct<ar:double,cs:double,od:double>")
    got = {x["star_section"]: x for x in section_stats(df.withColumn("analyzer_version", F.lit(4)).withColumn("normalization_version", F.lit(1))).collect()}
    assert set(got) == {0, 23, 40, 99}
    for section, x in got.items():
        mine = [row for row in rows if math.floor(row[1] * 10 + 1e-6) == section]
        assert x["count"] == len(mine)
        for k, name in enumerate(axes + base):
            values = [(row[2 + k] if k < 5 else row[7][k - 5]) for row in mine]
            total = squares = 0.0
            for v in values:
                total, squares = total + v, squares + v * v
            assert (x[f"sum_{name}"], x[f"sumsq_{name}"]) == pytest.approx((total, squares))


def test_store_mania_and_exports(spark, tmp_path):
    s = Store.open(spark, str(tmp_path), "mania")
    raw = P.mania_charts(frame(spark, [lane_chart(10, 4, stream(4, 140)), lane_chart(20, 4, stream(4, 100)), lane_chart(40, 6, stream(6, 140)), lane_chart(60, 5, stream(5, 9))])).cache()
    assert s.upsert_raw(raw)["inserted"] == 3
    s.publish(1, P.normalise_mania(s.raw(), 1))
    f = s.features(1)
    assert {(r["beatmap_id"], r["difficulty_band"]) for r in f.collect()} == {(10, 0), (20, 9), (40, 5)}
    assert s.doctor(1).where("not ok").isEmpty()
    export(f, str(tmp_path / "csv"), "csv", "mania")
    export(f, str(tmp_path / "pq"), "parquet", "mania")
    assert len(spark.read.csv(str(tmp_path / "csv"), header=True).columns) == len(spark.read.parquet(str(tmp_path / "pq")).columns) == 40
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["mode_family"] == "RC"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    chart = std_chart(10, A).encode()
    pack = zipped({"a/x.osu": chart, "song.mp3": b"no"})
    whole = zipped({"one.osz": pack, "two.OSU": lane_chart(5, 4, stream(4, 100)).encode(), "cover.jpg": b"j"})
    for name, data in {"a.zip": whole, "b.zip": whole[: len(whole) // 2], "c.7z": archives.SEVEN_ZIP + b"..", "d.rar": archives.RAR + b"..", "e.zip": zipped({"x.txt": b"x"})}.items():
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {(r["archive"][-5:], r["member"], r["status"]) for r in archives.archive_members(files).collect()}
    assert got == {("a.zip", "one.osz/a/x.osu", "ok"), ("a.zip", "two.OSU", "ok"), ("b.zip", "", "failed"), ("/c.7z", "7z", "unsupported"), ("d.rar", "rar", "unsupported"), ("e.zip", "", "empty")}
    assert {r["path"][-5:]: r["status"] for r in archives.verify_archives(files).collect()} == {"a.zip": "ok", "b.zip": "failed", "/c.7z": "unsupported", "d.rar": "unsupported", "e.zip": "ok"}
    standard = archives.ingest_archives(spark, str(tmp_path)).where("status = 'ok'").collect()
    assert len(standard) == 1 and bytes(standard[0]["content"]) == chart


def test_text_parsers(spark):
    one = lambda expr, **cols: spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr).first()[0]
    html = '<a href="https://evil.org/x">x</a><a href="https://b.example.org/d?a=1&amp;b=&#039;c&#039;">y</a>'
    assert one(catalogue_text.download_link(F.col("h"), ["example.org"]), h=html) == "https://b.example.org/d?a=1&b='c'"
    assert one(catalogue_text.download_link(F.col("h"), ["ample.org"]), h=html) is None
    assert catalogue_text.decode_entities("a & b; &lt;&#x41;&nope;&#65") == "a & b; <A&nope;&#65"
    assert one(catalogue_text.mirror_link(F.col("j")), j='{"success": true, "url": "https://m/x"}') == "https://m/x"
    assert one(catalogue_text.mirror_link(F.col("j")), j='{"success": false, "url": "https://m/x"}') is None
    packs = spark.createDataFrame([('<a href="/beatmaps/packs/S12">/beatmaps/packs/S12 /beatmaps/packs/SM3 /beatmaps/packs/9x /beatmaps/packs/R</a>',)], ["html"])
    assert [r[0] for r in catalogue_text.pack_ids(packs).collect()] == ["S12", "SM3"]
    assert [one(catalogue_text.pack_class(F.col("p")), p=p) for p in ("S1", "SM1", "ST2", "SC3", "R4", "S1x")] == ["standard", "excluded", "excluded", "excluded", "mixed", "mixed"]
    link = '<a href="/beatmaps/packs/{}">' + catalogue_text.MORE_PAGES
    paged = [("standard", 1, link.format("S1")), ("standard", 2, link.format("S2").split(">")[0]), ("standard", 3, link.format("S3")), ("mania", 1, link.format("SM1")), ("mania", 2, "none"), ("mania", 3, link.format("SM3")), ("loved", 2, link.format("L2"))]
    pages = spark.createDataFrame(paged, "kind string, page int, html string")
    assert [r[0] for r in catalogue_text.paged_pack_ids(pages).collect()] == ["S1", "S2", "SM1"]
    jar = ["# comment", "#HttpOnly_.x.org\tTRUE\t/\tTRUE\t0\ta\t1", "x.org\tTRUE\t/\tTRUE\t0\tb\t2", "notx.org\tTRUE\t/\tTRUE\t0\tc\t3", "x.org\tshort"]
    lines = spark.createDataFrame(list(enumerate(jar)), ["line_no", "value"])
    assert catalogue_text.cookies(lines, "x.org").first()[0] == "a=1; b=2"
    assert [one(catalogue_text.too_slow(F.col("b")), b=b << 20) for b in (59, 60)] == [True, False]
    charts = spark.createDataFrame([(1,), (2,), (3,)], ["beatmap_id"])
    got = catalogue_text.manifest(charts, charts.where("beatmap_id = 1"), charts.where("beatmap_id < 3")).orderBy("beatmap_id").collect()
    assert [r["status"] for r in got] == ["downloaded", "failed", "pending"]


def test_streamed_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    s = Store.open(spark, str(tmp_path / "store"), "mania")
    for step, (name, text) in enumerate([("10", lane_chart(10, 4, stream(4, 140))), ("20", lane_chart(99, 4, stream(4, 100)))]):
        (folder / f"{name}.osu").write_text(text)
        q = ingest.ingest_stream(spark, str(folder), s, P.mania_charts, str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert s.raw().count() == step + 1
    assert {r["beatmap_id"] for r in s.raw().collect()} == {10, 20}
