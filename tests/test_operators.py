"""Series and rank operators against plain versions on small random input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalar as S
from strandline.operators import ranks, series, tables


def test_midranks_and_distinct_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 3.0), (None, 4.0), ("a", None)], "k string, v double")
    got = {(r["k"], r["v"]): r["rank"] for r in ranks.fit_midrank(df, "v", ["k"]).collect()}
    assert got == {("a", 1.0): 0.25, ("a", 2.0): 1.0, ("b", 5.0): 0.5, (None, 3.0): 0.0, (None, 4.0): 1.0}
    plain = {r["v"]: r["rank"] for r in ranks.fit_distinct(df, "v").collect()}
    assert plain == {1.0: 0.0, 2.0: 0.25, 3.0: 0.5, 4.0: 0.75, 5.0: 1.0}
    asked = spark.createDataFrame([(1, 0.0), (2, 1.5), (3, 3.0), (4, 9.0)], "id long, v double")
    out = ranks.rank_outside(asked, ranks.fit_distinct(df, "v"), "v", "r", "distinct")
    assert {r["id"]: r["r"] for r in out.collect()} == {1: 0.0, 2: 0.0, 3: 0.5, 4: 1.0}
    mid = ranks.rank_outside(asked.withColumn("k", F.lit("a")), ranks.fit_midrank(df, "v", ["k"]), "v", "r", "midrank", ["k"])
    assert {r["id"]: r["r"] for r in mid.collect()} == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_decayed_sum(spark):
    r = random.Random(1)
    rows = sorted((r.randrange(2), r.uniform(0, 50_000), r.uniform(0, 3)) for _ in range(300))
    df = spark.createDataFrame([(k, t, x, i) for i, (k, t, x) in enumerate(rows)], "k int, t double, x double, i int")
    got = {x["i"]: x["s"] for x in series.decayed_sum(df, "k", "t", "x", 220.0, ["i"], "s").collect()}
    state, last = 0.0, (None, 0.0)
    for i, (k, t, x) in enumerate(rows):
        state = x + (state * math.exp(-(t - last[1]) / 220.0) if last[0] == k else 0.0)
        last = (k, t)
        assert got[i] == pytest.approx(state, rel=1e-9)


def test_tolerance_rows_and_pairs(spark):
    r = random.Random(2)
    ts = sorted(r.uniform(0, 60) for _ in range(200))
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(ts)], "k string, t double, i int")
    want, start = [], None
    for t in ts:
        if start is None or t - start > 2:
            start = t
            want.append([t, 0])
        want[-1][1] += 1
    got = [(x["start"], x["n"]) for x in series.tolerance_rows(df, "k", "t", 2.0).orderBy("row").collect()]
    assert got == [tuple(w) for w in want]
    pairs = series.interval_pairs(df, "k", F.col("t"), 3.0, ["i"]).where("pri.i < cur.i").count()
    assert pairs == sum(1 for a in range(200) for b in range(a) if ts[a] - ts[b] <= 3)


def test_tolerance_rows_over_many_blocks(spark):
    r = random.Random(3)
    dense = [round(r.uniform(-900, 900), 1) for _ in range(6000)]
    sparse = [r.choice([-5000.0, 0.0, 256.0, 512.0, 511.0, 513.0, 7000.0]) + r.choice([0.0, 1.0, 2.0]) for _ in range(60)]
    rows = [("d", t) for t in dense] + [(None, t) for t in sparse] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, t double")
    for width in (1.0, 0.1):
        got = sorted((str(x["k"]), x["row"], x["start"], x["n"]) for x in series.tolerance_rows(df, "k", "t", width).collect())
        want = []
        for key, ts in (("None", sparse), ("d", dense)):
            start, row = None, -1
            for t in sorted(ts):
                if start is None or t - start > width:
                    start, row = t, row + 1
                    want.append([key, row, t, 0])
                want[-1][3] += 1
        assert got == [tuple(w) for w in sorted(want)]
    assert series.tolerance_rows(df.limit(0), "k", "t", 1.0).count() == 0


def test_trailing_counts_and_quantiles(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), r.randrange(-300, 300), r.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, us long, kind string")
    got = {x["i"]: (x["n"], x["x"]) for x in series.trailing_counts(df, "k", "us", 50, {"n": F.lit(True), "x": F.col("kind") == "x"}).collect()}
    for i, k, us, _ in rows:
        near = [o for o in rows if o[1] == k and us - 50 <= o[2] <= us]
        assert got[i] == (len(near), sum(o[3] == "x" for o in near))
    q = {x["k"]: (x["lo"], x["hi"]) for x in ranks.quantiles(df, "us", {"lo": 0.1, "hi": 0.97}, ["k"]).collect()}
    for k in "ab":
        values = sorted(o[2] for o in rows if o[1] == k)
        at = lambda share: (len(values) - 1) * share
        want = [values[math.floor(at(s))] + (values[math.ceil(at(s))] - values[math.floor(at(s))]) * (at(s) % 1) for s in (0.1, 0.97)]
        assert q[k] == pytest.approx(want)


def test_upserts_and_audits(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id long, v string")
    assert sorted(map(tuple, tables.ordered_upsert(old, new, ["id"], [F.col("v")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, tables.coverage(old, new, "id").collect())) == [(1, "missing"), (2, "repeated"), (3, "unexpected")]
    assert tables.same_sets(old, old) and not tables.same_sets(old, new)


def test_ids_and_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.unsigned_id(F.lit("0000000000000080" + "0" * 48))) == str(2**63)
    assert one(S.signed_id(F.lit(str(2**63)))) == -(2**63) and one(S.unsigned_id(F.lit("0" * 64))) == "1"
    assert [one(S.number(F.lit(x))) for x in (" 12", "12d", "1e3", ".5", "5.", "x")] == [None, None, 1000.0, 0.5, 5.0, None]
    with pytest.raises(Exception, match="stars"):
        one(S.star_section(F.lit(-1.0)))
