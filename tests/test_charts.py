import math

import numpy as np
import pytest
from charts import lane_chart, std_chart, stream
from pyspark.sql import functions as F

from strandline.operators import mania_features as M
from strandline.operators import similarity, std_features, tokenise
from strandline.plans import charts as P
from strandline.schema import Search


def frame(spark, texts):
    return spark.createDataFrame([(i, bytearray(t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)], "chart_id long, content binary")


def attributes(df):
    sha = df.select(F.sha2("content", 256).alias("sha256")).distinct()
    return sha.select("sha256", F.lit(1.5).alias("aim"), F.lit(2.5).alias("speed"), F.lit(0.5).alias("reading"), F.lit(5.7).alias("stars"), F.lit(99).alias("max_combo"))


# A plain version of the overlap dimension, pair by pair.


def brute_overlap(objects, ar, cs):
    pre, rad = (1800 - 120 * ar if ar < 5 else 1200 - 150 * (ar - 5)), 54.4 - 4.48 * cs
    press = lambda d: min(max(math.sqrt(200 / max(d, 50)), 0.5), 2)
    seen = marks = 0
    scores = []
    for i, (x, y, t) in enumerate(objects):
        got = []
        for j in range(i):
            u, v, s = objects[j]
            vis = max(0, min(t, s) - max(t, s) + pre)
            if t - s > 3000 or vis <= 0:
                continue
            seen += 1
            tw, q = math.exp(-(t - s) / 700), math.dist((x, y), (u, v)) / max(2 * rad, 1)
            if q > 1.5:
                continue
            sp = 0.8 * max(1 - q, 0) ** 2 + 0.2 * max(1 - q / 1.5, 0) ** 2
            st = sp * press(t - s) if q <= 0.5 else 0
            marks += st > 0
            a, b, c, d = objects[j - 1] if j else None, objects[j], objects[i - 1], objects[i]
            cr = 0
            if j:
                seg = lambda p: {"x": p[0], "y": p[1]}
                cr = brute_cross(seg(a), seg(b), seg(c), seg(d), rad) * tw
            got.append(vis / max(pre, 1) * tw * press(t - s) * (0.35 * sp + 0.15 * sp / math.sqrt(i - j) + 0.15 * st + 0.10 * cr))
        got = [g for g in got if g > 0]
        scores.append(0.65 * max(got, default=0) + 0.35 * math.log1p(sum(got)))
    strain, peaks, edge, last = 0, [], 0, None
    for (_, _, t), s in zip(objects, scores):
        while t > edge:
            peaks.append(strain)
            edge += 400
        strain = strain * 0.25 ** ((t - last if last is not None else 0) / 1000) + s
        last = t
    peaks = sorted([*peaks, strain], reverse=True)
    return sum(p * 0.9**k for k, p in enumerate(peaks)), peaks[int((len(peaks) - 1) * 0.05)], sum(s > 0 for s in scores) / len(objects), marks / max(seen, 1)


def brute_cross(a, b, c, d, rad):
    def near(p, s, e):
        dx, dy = e["x"] - s["x"], e["y"] - s["y"]
        n = dx * dx + dy * dy
        t = min(max(((p["x"] - s["x"]) * dx + (p["y"] - s["y"]) * dy) / n, 0), 1) if n else 0
        return math.hypot(p["x"] - s["x"] - t * dx, p["y"] - s["y"] - t * dy)

    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    hit = turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0
    if not hit and min(near(a, c, d), near(b, c, d), near(c, a, b), near(d, a, b)) > rad:
        return 0
    u, v = (b["x"] - a["x"], b["y"] - a["y"]), (d["x"] - c["x"], d["y"] - c["y"])
    return min(abs(u[0] * v[1] - u[1] * v[0]) / max(math.hypot(*u) * math.hypot(*v), 1), 1)


def test_std_features(spark):
    r = np.random.default_rng(1)
    random_map = [(int(x), int(y), int(t)) for x, y, t in zip(r.integers(0, 512, 40), r.integers(0, 384, 40), np.cumsum(r.integers(1, 900, 40)), strict=True)]
    spread = [(i * 100 % 500, i * 70 % 380, 1000 + i * 150) for i in range(20)]
    stack = [(256, 192, 1000 + i * 150) for i in range(20)]
    speeds = ["64,64,500,2,0,L|128:64,1,70", "64,64,1500,2,0,L|128:64,1,70", "64,64,2500,2,0,L|128:64,1,70", "10,10,3000,1,0"]
    df = frame(spark, [std_chart(10, spread), std_chart(20, stack), std_chart(30, random_map), std_chart(40, speeds, timing="0,500,4,2,1,60,1,0\n1000,-50,4,2,1,60,0,0", difficulty="SliderMultiplier:1.4"), std_chart(0, stack), std_chart(50, stack, mode=3), b"\xff\xfe[General]", std_chart(60, [])])
    got = {x["chart_id"]: x for x in std_features.std_features(df, attributes(df)).collect()}
    assert [got[i]["status"] for i in range(8)] == ["ok"] * 5 + ["unsupported mode", "invalid", "ok"]
    assert got[1]["overlap"] > got[0]["overlap"]
    peak, p95, live, stacked = brute_overlap(random_map, 9, 4)
    o = got[2]["overlap_stats"]
    assert (o["peak"], o["p95"], o["sustained_ratio"], o["stack_rate"]) == pytest.approx((peak, p95, live, stacked), rel=1e-5)
    assert brute_overlap(stack, 9, 4)[0] == pytest.approx(got[1]["overlap"], rel=1e-5)
    assert got[3]["slider"] == pytest.approx(0.575)  # three sliders of four, one change of two
    assert (got[0]["base"]["bpm"], got[0]["base"]["object_count"], got[0]["base"]["max_combo"]) == (120, 20, 99)
    assert got[0]["base"]["length_seconds"] == pytest.approx(2.85) and got[3]["base"]["slider_ratio"] == pytest.approx(0.75)
    assert got[4]["beatmap_id"] != 0 and got[0]["beatmap_id"] == 10 and got[0]["beatmapset_id"] == 1 and got[0]["title"] == "Song 10"
    assert got[7]["overlap"] == 0
    missing = std_features.std_features(df.where("chart_id = 0"), attributes(df).limit(0)).collect()
    assert missing[0]["status"] == "missing attributes"


def test_slider_speeds_and_paths(spark):
    df = frame(spark, [std_chart(1, ["64,64,500,2,0,L|128:64,1,70", "64,64,1500,2,0,B|128:64|bad|x:9,1,70", "0,0,2500,2,0,L|9:9,1,70", "5,5,9000,8,0,9500"], timing="0,500,4,2,1,60,1,0\n1000,-50,4,2,1,60,0,0", difficulty="SliderMultiplier:1.4")])
    lines = tokenise.chart_lines(df, lossy=False)
    o = tokenise.with_slider_speeds(tokenise.std_objects(lines), tokenise.timing_points(lines), tokenise.std_meta(lines)).orderBy("time").collect()
    assert [x["slider_speed"] for x in o] == pytest.approx([280, 560, 560, 0])
    assert [tuple(p) for p in o[1]["path"]] == [(64, 64), (128, 64), (64, 9)]
    assert (o[3]["kind"], o[3]["end_time"]) == ("spinner", 9500)


def test_std_similarity(spark):
    a, b = [(i * 100 % 500, i * 70 % 380, 1000 + i * 150) for i in range(20)], [(256, 192, 1000 + i * 90) for i in range(40)]
    df = frame(spark, [std_chart(10, a), std_chart(20, a), std_chart(30, b)])
    features = P.normalise_std(std_features.std_features(df, attributes(df)), 1).cache()
    got = similarity.similar(features, 10).collect()
    assert [r["beatmap_id"] for r in got] == [20, 30] and got[0]["final_distance"] == 0
    assert [r["beatmap_id"] for r in similarity.similar(features, 10, Search(limit=1), exhaustive=True).collect()] == [20]
    ids = lambda search: [r["beatmap_id"] for r in similarity.similar(features, 10, search, exhaustive=True).collect()]
    assert ids(Search(bounds={"base.ar": (9, 9), "base.bpm": (None, 120)})) == [20, 30] and ids(Search(bounds={"base.bpm": (121, None)})) == []
    assert ids(Search(bounds={"beatmapset_id": (3, 3)})) == [30]
    plain, heavy = (similarity.similar(features, 10, s, exhaustive=True).where("beatmap_id = 30").first() for s in (None, Search(weights={"overlap": 4.0, "bpm": 0.0, "object_density": 0.0})))
    assert heavy["difficulty_distance"] > plain["difficulty_distance"] and heavy["base_distance"] < plain["base_distance"]
    with pytest.raises(ValueError):
        P.normalise_std(std_features.std_features(df, attributes(df).limit(0)), 1)


def test_lane_search_leaves_out_the_set(spark):
    texts = [lane_chart(10, 4, stream(4, 140), 1), lane_chart(20, 4, stream(4, 140), 1), lane_chart(30, 4, stream(4, 90), 2)]
    features = P.normalise_mania(P.mania_charts(frame(spark, texts)), 1).cache()
    ids = lambda **how: [r["beatmap_id"] for r in similarity.mania_similar(features, features.where("beatmap_id = 10"), **how).collect()]
    assert ids() == [30] and ids(same_set=True) == [20, 30] and ids(limit=1, same_set=True) == [20]


def chart_arrays(keys, notes):
    start = np.array([n[1] for n in notes], float)
    end = np.array([n[-1] for n in notes], float)
    return start, np.array([n[0] for n in notes]), end, np.array([len(n) == 3 for n in notes]), keys, 120.0, 0


def axes(keys, notes):
    r = M.analyse(*chart_arrays(keys, notes))
    return r["difficulty"], r["style"], r["base"]


def test_lane_relations():
    fast, slow = axes(4, stream(4, 100, 32)), axes(4, stream(4, 200, 32))
    assert fast[0]["speed"] > slow[0]["speed"] and fast[0]["stamina"] > slow[0]["stamina"]
    jacks = axes(4, [(0, 1000 + 120 * i) for i in range(32)])
    assert jacks[0]["jack"] > axes(4, stream(4, 120, 32))[0]["jack"] and jacks[1]["jacks"] > 0.5
    chords = axes(4, [(c, 1000 + 120 * i) for i in range(32) for c in (0, 2)])
    assert chords[0]["chordjack"] > jacks[0]["chordjack"]
    held = axes(4, [(i % 4, 1000 + 200 * i, 1150 + 200 * i) for i in range(32)])
    assert held[0]["long_note"] > slow[0]["long_note"] and held[1]["ln_note_ratio"] == 1


@pytest.mark.parametrize("keys", [4, 7])
def test_lane_invariances(keys):
    notes = [*stream(keys, 130), (0, 9000, 9500), (keys - 1, 9100)]
    a, b = axes(keys, notes), axes(keys, [(keys - 1 - n[0], *[t + 5000 for t in n[1:]]) for n in notes])
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-5)


def test_two_ms_rows_do_not_chain():
    t = M.timeline(np.array([100.0, 102.0, 103.0]), np.array([0, 1, 2]), np.array([100.0, 102.0, 103.0]), np.zeros(3, bool), 4)
    assert list(t["t"]) == [100, 103] and list(t["head"]) == [3, 4]
    assert axes(4, [(0, 100), (1, 102)])[1]["chord_rate"] == 1


def test_lane_charts(spark):
    texts = [lane_chart(10, 4, stream(4, 140), 1), lane_chart(20, 4, stream(4, 145), 2), lane_chart(30, 4, [(0, 1000 + 100 * i) for i in range(48)], 3), lane_chart(40, 6, stream(6, 140), 4), lane_chart(50, 7, stream(7, 140), 5), lane_chart(60, 5, stream(5, 140)), lane_chart(70, 4, [], 1), lane_chart(80, 4, stream(4, 99), mode=0), "[General]\nMode: 3\n", lane_chart(90, 4, stream(4, 140)).replace(",192,1000,", ",192,x,")]
    raw = P.mania_charts(frame(spark, texts)).cache()
    got = {r["chart_id"]: r for r in raw.collect()}
    assert [got[i]["status"] for i in range(10)] == ["ok"] * 5 + ["unsupported keys", "invalid", "unsupported mode", "invalid", "invalid"]
    assert got[0]["base"]["bpm"] == 120 and got[0]["online_url"].endswith("/10")
    features = P.normalise_mania(raw, 1).cache()
    target = features.where("beatmap_id = 10")
    near = similarity.mania_similar(features, target).collect()
    assert [r["beatmap_id"] for r in near] == [20, 30] and near[0]["final_distance"] < near[1]["final_distance"]
    outside = P.mania_target(raw.where("beatmap_id = 10"), P.fit_mania(raw), 1)
    again = similarity.mania_similar(features, outside).collect()
    assert [(r["beatmap_id"], round(r["final_distance"], 6)) for r in again] == [(r["beatmap_id"], round(r["final_distance"], 6)) for r in near]
    with pytest.raises(ValueError):
        similarity.mania_similar(features, target, 101)


def test_lanes_are_dealt_in_two_steps(spark):
    from strandline.functions.scalar import lane_of

    got = spark.createDataFrame([(74.0, 7), (511.9, 7), (-3.0, 4), (600.0, 4)], "x double, k int").select(lane_of(F.col("x"), F.col("k"))).collect()
    assert [r[0] for r in got] == [0, 6, 0, 3]


def test_a_long_slider_keeps_its_tail(spark):
    n = (1 << 20) + 5
    extra = F.concat(F.lit("0,0,100,2,0,B"), F.repeat(F.lit("|1:2"), F.lit(n)), F.lit("|7:8,1,100"))
    lines = spark.range(1).select(F.lit(1).alias("chart_id"), F.lit(1).alias("line_no"), F.lit("HitObjects").alias("section"), extra.alias("line"))
    got = tokenise.std_objects(lines).select(F.size("path").alias("n"), F.element_at("path", -1).alias("last")).first()
    assert got["n"] == n + 2 and (got["last"]["x"], got["last"]["y"]) == (7, 8)
