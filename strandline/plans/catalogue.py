"""Queries over the driver's tables, by name, each with its SQL.

They apply the operators to whole tables: ranks and series to parts, line items and events, the similarity operators to
vectors made of them, the table operators to orders, documents and conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ranks, series, similarity, tables
from ..schema import MANIA_AXES, PATTERNS, STRUCTURE
from ..settle import settled
from . import chart_sql

QUERIES: dict = {}
ORACLE: dict = {}

TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """With ``us`` and ``t``: microseconds and seconds."""
    return read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("t", F.col("us") / F.lit(1e6))


EV = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts)::DOUBLE / 1e6::DOUBLE AS t FROM events)"
DAY = 86400.0


def r6(c):
    return F.round(c, 6)


# Ranks


@query("""SELECT p_partkey, CASE WHEN m > 1 THEN (k - 1)::DOUBLE / (m - 1)::DOUBLE ELSE 0::DOUBLE END AS rank FROM
  (SELECT *, max(k) OVER () AS m FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_retailprice) AS k FROM part))""")
def distinct_rank(spark, d):
    part = read(spark, d, "part")
    return ranks.apply_ranks(part, ranks.fit_distinct(part, "p_retailprice"), "p_retailprice", "rank").select("p_partkey", "rank")


MID = """SELECT p_partkey, p_size::BIGINT AS p_size, CASE WHEN n > 1 THEN ((k - 1)::DOUBLE + (c - 1)::DOUBLE / 2::DOUBLE) / (n - 1)::DOUBLE ELSE 0.5::DOUBLE END AS rank FROM
  (SELECT *, rank() OVER (PARTITION BY p_size ORDER BY p_retailprice) AS k, count(*) OVER (PARTITION BY p_size, p_retailprice) AS c, count(*) OVER (PARTITION BY p_size) AS n FROM part)"""


def _midranks(spark, d):
    part = read(spark, d, "part").withColumn("p_size", F.col("p_size").cast("long"))
    return ranks.apply_ranks(part, ranks.fit_midrank(part, "p_retailprice", ["p_size"]), "p_retailprice", "rank", ["p_size"]).select("p_partkey", "p_size", "rank")


@query(MID)
def midrank_by_group(spark, d):
    return _midranks(spark, d)


@query(f"SELECT p_partkey, least(floor(rank * 10::DOUBLE), 9)::BIGINT AS band FROM ({MID})")
def band_assign(spark, d):
    return _midranks(spark, d).select("p_partkey", S.band(F.col("rank")).alias("band"))


@query("""WITH f AS (SELECT p_retailprice AS v, rank FROM (SELECT DISTINCT p_retailprice, CASE WHEN m > 1 THEN (k - 1)::DOUBLE / (m - 1) ELSE 0 END AS rank FROM
  (SELECT *, max(k) OVER () AS m FROM (SELECT p_retailprice, dense_rank() OVER (ORDER BY p_retailprice) AS k FROM part)))),
t AS (SELECT s_suppkey AS id, abs(s_acctbal) AS x FROM supplier)
SELECT id, greatest(u - 1, 0)::DOUBLE / (m - 1)::DOUBLE AS rank FROM (SELECT id, count(*) FILTER (v <= x) AS u, count(*) AS m FROM t, f GROUP BY id)""")
def rank_outside(spark, d):
    fitted = ranks.fit_distinct(read(spark, d, "part"), "p_retailprice")
    target = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.abs("s_acctbal").alias("x"))
    return ranks.rank_outside(target.withColumnRenamed("x", "p_retailprice"), fitted, "p_retailprice", "rank", "distinct").select("id", "rank")


@query("""SELECT floor(l_extendedprice / 1000::DOUBLE / 0.1::DOUBLE + 1e-6::DOUBLE)::BIGINT AS section, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS sum_quantity,
  round(sum(l_quantity * l_quantity), 4) AS sumsq_quantity, round(sum(l_discount), 4) AS sum_discount, round(sum(l_discount * l_discount), 4) AS sumsq_discount FROM lineitem GROUP BY 1""")
def section_stats(spark, d):
    li = read(spark, d, "lineitem").withColumn("section", S.star_section(F.col("l_extendedprice") / F.lit(1000.0)))
    m = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount")}
    aggs = [F.round(F.sum(x), 4).alias(f"sum_{k}") for k, x in m.items()] + [F.round(F.sum(x * x), 4).alias(f"sumsq_{k}") for k, x in m.items()]
    return li.groupBy("section").agg(F.count(F.lit(1)).alias("n"), *aggs)


@query("""SELECT event_type, round(quantile_cont(value, 0.97), 6) AS q97, round(quantile_cont(value, 0.90), 6) AS q90,
  round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.50), 6) AS q50 FROM events GROUP BY 1""")
def exact_quantile(spark, d):
    q = ranks.quantiles(read(spark, d, "events"), "value", {"q97": 0.97, "q90": 0.90, "q75": 0.75, "q50": 0.50}, ["event_type"])
    return q.select("event_type", *[r6(c).alias(c) for c in ("q97", "q90", "q75", "q50")])


@query("SELECT p_brand, list_sort(list(p_retailprice))[count(*) // 2 + 1] AS median FROM part GROUP BY 1")
def upper_median(spark, d):
    part = read(spark, d, "part")
    c = ranks.running_counts(ranks.count_values(part, ["p_brand"], "p_retailprice"), ["p_brand"], "p_retailprice")
    middle = F.floor(F.col("rows") / 2)
    return c.where((F.col("below") <= middle) & (middle < F.col("below") + F.col("n"))).select("p_brand", F.col("p_retailprice").alias("median"))


@query("""SELECT event_type, round(avg(value), 6) AS tail_mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k,
  count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k <= ceil(n * 0.04::DOUBLE) GROUP BY 1""")
def top4pct_mean(spark, d):
    ev = read(spark, d, "events")
    c = ranks.running_counts(ranks.count_values(ev, ["event_type"], "value"), ["event_type"], "value")
    k = F.ceil(F.col("rows") * F.lit(0.04))
    above = F.col("rows") - F.col("below") - F.col("n")
    take = F.least(F.col("n"), F.greatest(k - above, F.lit(0)))
    return c.groupBy("event_type").agg(r6(F.sum(F.col("value") * take) / F.sum(take)).alias("tail_mean"))


@query("""SELECT user_id, event_type AS dominant FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS k
  FROM events GROUP BY 1, 2) WHERE k = 1""")
def argmax_last_tie(spark, d):
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("dominant"))


# Series


@query(EV + " SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM e")
def trailing_range_count(spark, d):
    return series.trailing_counts(events(spark, d), "user_id", "us", 86_400_000_000, {"n": F.lit(True)}).select("event_id", "n")


@query(EV + """, w AS (SELECT a.event_id, b.event_type, count(*) AS c FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 259200 AND a.t GROUP BY 1, 2),
s AS (SELECT *, sum(c) OVER (PARTITION BY event_id) AS n FROM w) SELECT event_id, round(abs(sum(-(c / n::DOUBLE) * log2(c / n::DOUBLE))), 6) AS bits FROM s GROUP BY 1""")
def entropy_window(spark, d):
    kinds = {f"n_{x}": F.col("event_type") == x for x in TYPES}
    seen = series.trailing_counts(events(spark, d), "user_id", "us", 3 * 86_400_000_000, kinds)
    return seen.select("event_id", r6(series.entropy_bits([F.col(k) for k in kinds])).alias("bits"))


@query(EV + """ SELECT a.event_id, round(sum(b.value * exp(-(a.t - b.t) / 21600::DOUBLE)), 6) AS state FROM e a JOIN e b ON a.user_id = b.user_id
  AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id)) GROUP BY 1""")
def decay_state(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "t", "value")
    return series.decayed_sum(ev, "user_id", "t", "value", 21600.0, ["event_id"], "state").select("event_id", r6("state").alias("state"))


@query(EV.replace("WITH e", "WITH RECURSIVE e") + """, a AS (SELECT event_type, min(t) AS start, 0::BIGINT AS k FROM e GROUP BY 1
  UNION ALL SELECT a.event_type, (SELECT min(t) FROM e WHERE e.event_type = a.event_type AND e.t - a.start > 120) AS start, k + 1 FROM a
  WHERE EXISTS (SELECT 1 FROM e WHERE e.event_type = a.event_type AND e.t - a.start > 120)),
b AS (SELECT *, lead(start) OVER (PARTITION BY event_type ORDER BY start) AS stop FROM a)
SELECT b.event_type, b.k AS row, b.start, count(*)::BIGINT AS n FROM b JOIN e ON e.event_type = b.event_type AND e.t >= b.start AND (b.stop IS NULL OR e.t < b.stop) GROUP BY 1, 2, 3""")
def tolerance_rows(spark, d):
    return series.tolerance_rows(events(spark, d), "event_type", "t", 120.0).select("event_type", "row", "start", "n")


@query(EV + """, b AS (SELECT user_id, floor((t - min(t) OVER (PARTITION BY user_id)) / 86400)::BIGINT AS s, value FROM e),
p AS (SELECT user_id, s, max(value) AS peak FROM b GROUP BY 1, 2), w AS (SELECT user_id, unnest(range(0, max(s) + 1)) AS s FROM p GROUP BY 1),
f AS (SELECT w.user_id, w.s, coalesce(peak, 0) AS peak FROM w LEFT JOIN p USING (user_id, s)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY peak DESC, s) - 1 AS i FROM f)
SELECT user_id, count(*)::BIGINT AS sections, round(sum(peak * pow(0.9::DOUBLE, i)), 6) AS total, round(sum(peak * pow(0.9::DOUBLE, i)) / sum(pow(0.9::DOUBLE, i)), 6) AS mean FROM k GROUP BY 1""")
def section_peaks(spark, d):
    ev = events(spark, d)
    first = ev.groupBy("user_id").agg(F.min("t").alias("t0"))
    p = series.section_peaks(ev.join(first, "user_id"), "user_id", F.col("t") - F.col("t0"), DAY, F.col("value"))
    n = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("sections"))
    return series.weighted_peaks(p, "user_id", 0.9).join(n, "user_id").select("user_id", "sections", r6("total").alias("total"), r6("mean").alias("mean"))


@query(EV + """, g AS (SELECT user_id, event_type, least(greatest(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t, 1), 1), 3600) AS a FROM e)
SELECT user_id, event_type, round(sum(a) / greatest(sum(sum(a)) OVER (PARTITION BY user_id), 1), 6) AS share FROM g GROUP BY 1, 2""")
def lead_share(spark, d):
    gap = F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")) - F.col("t")
    g = events(spark, d).withColumn("a", S.clamp(F.coalesce(gap, F.lit(1.0)), 1.0, 3600.0)).groupBy("user_id", "event_type").agg(F.sum("a").alias("a"))
    whole = F.greatest(F.sum("a").over(Window.partitionBy("user_id")), F.lit(1.0))
    return g.select("user_id", "event_type", r6(F.col("a") / whole).alias("share"))


@query("""WITH x AS (SELECT l_orderkey, l_extendedprice AS v, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem)
SELECT l_orderkey, count(p)::BIGINT AS transitions, count(*) FILTER (abs(v - p) > 1e-6::DOUBLE * greatest(abs(v), abs(p), 1))::BIGINT AS changes FROM x GROUP BY 1""")
def lag_change_rate(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = read(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("v"), F.lag("l_extendedprice").over(w).alias("p"))
    changed = F.abs(F.col("v") - F.col("p")) > 1e-6 * F.greatest(F.abs("v"), F.abs("p"), F.lit(1.0))
    return x.groupBy("l_orderkey").agg(F.count("p").alias("transitions"), F.count_if(changed).alias("changes"))


@query(EV + """, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e)
SELECT user_id, count(*) FILTER (gap > 86400)::BIGINT AS breaks, round(coalesce(sum(gap - 86400) FILTER (gap > 86400), 0), 3) AS inactive FROM g GROUP BY 1""")
def breaks_gap(spark, d):
    g = events(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    long = F.col("gap") > DAY
    return g.groupBy("user_id").agg(F.count_if(long).alias("breaks"), F.round(F.coalesce(F.sum(F.when(long, F.col("gap") - DAY)), F.lit(0.0)), 3).alias("inactive"))


@query("""SELECT l_orderkey, bit_or(1::BIGINT << (l_linenumber % 60)) AS mask, bit_count(bit_or(1::BIGINT << (l_linenumber % 60)))::BIGINT AS lanes FROM lineitem GROUP BY 1""")
def bitmask_popcount(spark, d):
    m = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr("bit_or(shiftleft(1L, cast(l_linenumber % 60 as int)))").alias("mask"))
    return m.select("l_orderkey", "mask", S.popcount(F.col("mask")).cast("long").alias("lanes"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, k AS keys, least(floor(floor(least(greatest(x, 0), 511.999::DOUBLE) / 512::DOUBLE * 128::DOUBLE) * k / 128::DOUBLE), k - 1)::BIGINT AS lane FROM
  (SELECT *, l_extendedprice % 512 AS x, CASE l_linenumber % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 7 END::BIGINT AS k FROM lineitem)""")
def lane_quantise(spark, d):
    k = F.element_at(F.array(F.lit(4), F.lit(6), F.lit(7)), (F.col("l_linenumber") % 3 + 1).cast("int")).cast("long")
    return read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", k.alias("keys"), S.lane_of(F.col("l_extendedprice") % 512.0, k).cast("long").alias("lane"))


@query(EV + """ SELECT event_id, carried FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY t, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM e) WHERE event_type <> 'error'""")
def asof_carry(spark, d):
    ev = events(spark, d)
    points = ev.where("event_type = 'error'").groupBy("user_id", "t").agg(F.max_by("value", "event_id").alias("carried"))
    rows = ev.where("event_type <> 'error'").select("event_id", "user_id", "t")
    return series.asof_carry(points, rows, "user_id", "t", ["carried"], "event_id").select("event_id", "carried")


@query(EV + """ SELECT a.event_id, count(*)::BIGINT AS pairs, round(sum(greatest(least(a.t + a.value, b.t + b.value) - greatest(a.t - 600, b.t - 600), 0)), 3) AS overlap FROM e a JOIN e b ON a.user_id = b.user_id
  AND (b.t < a.t OR (b.t = a.t AND b.event_id < a.event_id)) AND a.t - b.t <= 7200 GROUP BY 1""")
def interval_self_join(spark, d):
    p = series.interval_pairs(events(spark, d), "user_id", F.col("t"), 7200.0, ["event_id", "value"])
    p = p.where((F.col("pri.t") < F.col("cur.t")) | (F.col("pri.event_id") < F.col("cur.event_id")))
    o = S.interval_overlap(F.col("cur.t") - 600.0, F.col("cur.t") + F.col("cur.value"), F.col("pri.t") - 600.0, F.col("pri.t") + F.col("pri.value"))
    return p.groupBy(F.col("cur.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(o), 3).alias("overlap"))


# Similarity

KNN = """WITH t AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
k AS (SELECT vec_id, label, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: pow(embedding[i]::DOUBLE - v[i]::DOUBLE, 2))) AS s FROM embeddings, t)"""


def _near(spark, d, k):
    emb = read(spark, d, "embeddings")
    target = emb.orderBy("vec_id").limit(1).select(F.col("embedding").alias("t_vec"), F.col("label").alias("t_label"))
    return similarity.nearest(emb, target, "vec_id", F.col("embedding"), k)


@query(KNN + " SELECT vec_id, round(s, 5) AS distance FROM k ORDER BY s, vec_id LIMIT 20")
def knn_l2(spark, d):
    return _near(spark, d, 20).select("vec_id", F.round("distance", 5).alias("distance"))


@query(KNN + " SELECT vec_id, round(s, 5) AS distance FROM (SELECT * FROM k ORDER BY s, vec_id LIMIT 128) WHERE label = (SELECT label FROM embeddings ORDER BY vec_id LIMIT 1)")
def post_topk_filter(spark, d):
    return _near(spark, d, 128).where("label = t_label").select("vec_id", F.round("distance", 5).alias("distance"))


AXES = ("quantity", "price", "discount", "tax", "orders")
PER_PART = """p AS (SELECT l_partkey, round(sum(l_quantity), 2) AS quantity, round(max(l_extendedprice), 2) AS price, round(avg(l_discount), 4) AS discount, round(avg(l_tax), 4) AS tax, count(*)::DOUBLE AS orders FROM lineitem GROUP BY 1)"""


def _per_part(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.max("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 4).alias("discount"), F.round(F.avg("l_tax"), 4).alias("tax"), F.count(F.lit(1)).cast("double").alias("orders"))


@query("WITH " + PER_PART + ", " + """r AS (SELECT l_partkey, """ + ", ".join(f"(dense_rank() OVER (ORDER BY {a}) - 1)::DOUBLE AS k_{a}" for a in AXES) + """ FROM p),
n AS (SELECT l_partkey, """ + ", ".join(f"CASE WHEN max(k_{a}) OVER () > 0 THEN k_{a} / max(k_{a}) OVER () ELSE 0 END AS {a}" for a in AXES) + """ FROM r),
t AS (SELECT * FROM n ORDER BY l_partkey LIMIT 1)
SELECT n.l_partkey, round(sqrt(""" + " + ".join(f"pow(n.{a} - t.{a}, 2)" for a in AXES) + """), 6) AS distance FROM n, t WHERE n.l_partkey <> t.l_partkey
ORDER BY round(sqrt(""" + " + ".join(f"pow(n.{a} - t.{a}, 2)" for a in AXES) + "), 9), n.l_partkey LIMIT 20")
def weighted_rerank(spark, d):
    n = settled(ranks.rank_axes(settled(_per_part(spark, d)), "l_partkey", AXES))
    target = n.orderBy("l_partkey").limit(1).select(F.struct("*").alias("t"))
    dist = S.weighted_l2([F.col(a) for a in AXES], [F.col(f"t.{a}") for a in AXES])
    near = n.join(F.broadcast(target), F.col("l_partkey") != F.col("t.l_partkey")).withColumn("d", F.round(dist, 9)).orderBy("d", "l_partkey").limit(20)
    return near.select("l_partkey", r6("d").alias("distance"))


@query("WITH " + PER_PART + """, t AS (SELECT * FROM p ORDER BY l_partkey LIMIT 1) SELECT p.l_partkey, round(0.15::DOUBLE * least(abs(p.quantity - t.quantity) / 300, 1) + 0.25::DOUBLE * least(abs(p.price - t.price) / 10000, 1)
  + 0.10::DOUBLE * least(abs(p.orders - t.orders) / 10, 1) + 0.20::DOUBLE * abs(p.discount - t.discount), 9) AS distance FROM p, t""")
def base_distance(spark, d):
    p = _per_part(spark, d)
    t = p.orderBy("l_partkey").limit(1).select(F.struct("*").alias("t"))
    cap = lambda a, s: S.capped_difference(F.col(a), F.col(f"t.{a}"), s)
    out = 0.15 * cap("quantity", 300.0) + 0.25 * cap("price", 10000.0) + 0.10 * cap("orders", 10.0) + 0.20 * F.abs(F.col("discount") - F.col("t.discount"))
    return p.join(F.broadcast(t)).select("l_partkey", F.round(out, 9).alias("distance"))


PER_USER = "c AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{x}')::DOUBLE AS {x}" for x in TYPES) + ", avg(value) AS mean, max(value) AS most FROM events GROUP BY 1), t AS (SELECT * FROM c ORDER BY user_id LIMIT 1)"


def _per_user(spark, d):
    c = read(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == x).cast("double").alias(x) for x in TYPES], F.avg("value").alias("mean"), F.max("value").alias("most"))
    return c.join(F.broadcast(c.orderBy("user_id").limit(1).select(F.struct("*").alias("t"))))


def _share(x, side):
    return f"sqrt(({side}.{x} + 1e-6::DOUBLE) / ({' + '.join(f'{side}.{y}' for y in TYPES)} + 5e-6::DOUBLE))"


@query("WITH " + PER_USER + " SELECT c.user_id, round(sqrt((" + " + ".join(f"pow({_share(x, 'c')} - {_share(x, 't')}, 2)" for x in TYPES) + ") / 2), 6) AS distance FROM c, t")
def hellinger_rerank(spark, d):
    u = _per_user(spark, d)
    return u.select("user_id", r6(S.hellinger([F.col(x) for x in TYPES], [F.col(f"t.{x}") for x in TYPES])).alias("distance"))


@query("WITH " + PER_USER + """ SELECT c.user_id, round(least(sqrt((pow(c.click / 100 - t.click / 100, 2) + pow(c.view / 100 - t.view / 100, 2)) / 2), 1), 6) AS rms,
  round(least(abs(ln((greatest(c.mean, 0) + 1) / (greatest(t.mean, 0) + 1))) / ln(4), 1), 6) AS ratio FROM c, t""")
def rms_log_ratio(spark, d):
    u = _per_user(spark, d)
    two = lambda s: [F.col(f"{s}{x}") / 100.0 for x in ("click", "view")]
    return u.select("user_id", r6(S.rms_distance(two(""), two("t."))).alias("rms"), r6(S.log_ratio(F.col("mean"), F.col("t.mean"), 4.0)).alias("ratio"))


@query(f"""WITH m AS ({MID}), b AS (SELECT m.p_partkey, m.p_size, least(floor(rank * 10::DOUBLE), 9)::BIGINT AS band, p.p_brand FROM m JOIN part p USING (p_partkey)),
t AS (SELECT * FROM b ORDER BY p_partkey LIMIT 1), g AS (SELECT abs(b.band - t.band) AS d, b.p_brand = t.p_brand AS same FROM b, t WHERE b.p_partkey <> t.p_partkey),
r AS (SELECT unnest(range(0, 10)) AS r), s AS (SELECT r, count(*) AS n, count(*) FILTER (same) AS f FROM r JOIN g ON g.d <= r GROUP BY r)
SELECT coalesce(min(r) FILTER (n >= 256 AND f >= 32), 9)::BIGINT AS radius FROM s""")
def band_expansion(spark, d):
    b = _midranks(spark, d).join(read(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").withColumn("band", S.band(F.col("rank")))
    t = b.orderBy("p_partkey").limit(1).select(F.struct("*").alias("t"))
    g = b.join(F.broadcast(t), F.col("p_partkey") != F.col("t.p_partkey")).select(F.abs(F.col("band") - F.col("t.band")).alias("band"), (F.col("p_brand") == F.col("t.p_brand")).alias("same"))
    return similarity.band_radius(g, F.lit(0), 256, 32).select(F.col("radius").cast("long").alias("radius"))


# Tables and text


@query("SELECT doc_id, sha256(text) AS sha, CASE WHEN v = 0 THEN '1' ELSE v::VARCHAR END AS unsigned_id FROM (SELECT doc_id, text, ('0x' || substr(s, 15, 2) || substr(s, 13, 2) || substr(s, 11, 2) || substr(s, 9, 2) || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2))::UBIGINT AS v FROM (SELECT doc_id, text, sha256(text) AS s FROM documents))")
def sha_id(spark, d):
    sha = F.sha2("text", 256)
    return read(spark, d, "documents").select("doc_id", sha.alias("sha"), S.unsigned_id(sha).alias("unsigned_id"))


@query(r"""SELECT doc_id, (i - 1)::BIGINT AS line_no, trim(line, E' \t\r\f\x0b') AS line FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS i FROM documents)
  WHERE trim(line, E' \t\r\f\x0b') <> '' AND NOT starts_with(trim(line, E' \t\r\f\x0b'), '//')""")
def line_tokenise(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("//"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), -1) AS section FROM conversations")
def section_carry(spark, d):
    c = read(spark, d, "conversations")
    return tables.carry(c, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", F.coalesce("section", F.lit(-1)).alias("section"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract_string(props, '$.k'))::DOUBLE AS number FROM events")
def kv_split_json(spark, d):
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", k.alias("k"), S.number(k).alias("number"))


@query("SELECT page_id, split_part(url, ':', 1) AS scheme, split_part(substr(url, strpos(url, '://') + 3), '/', 1) AS host FROM pages")
def kv_split_url(spark, d):
    rest = F.element_at(F.split("url", "://", 2), 2)
    return read(spark, d, "pages").select("page_id", F.element_at(F.split("url", ":", 2), 1).alias("scheme"), F.element_at(F.split(rest, "/", 2), 1).alias("host"))


@query("""SELECT page_id, i::BIGINT AS at, href FROM (SELECT page_id, unnest(l) AS href, unnest(range(0, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def href_extract(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, d, "pages").select("page_id", F.posexplode(found).alias("at", "href")).select("page_id", F.col("at").cast("long").alias("at"), "href")


@query("SELECT d.doc_id, lang, source, quality::BIGINT AS quality FROM documents d JOIN labels l USING (doc_id)")
def inner_meta(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", F.col("quality").cast("long").alias("quality"))


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_resume(spark, d):
    return tables.finished(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_pending(spark, d):
    return tables.pending(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"])


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
  FROM (SELECT doc_id FROM documents WHERE source <> 'src0') d FULL OUTER JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def coverage_audit(spark, d):
    return tables.coverage(read(spark, d, "documents").where("source <> 'src0'"), read(spark, d, "labels"), "doc_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k FROM conversations) WHERE k = 1")
def latest_version(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return tables.latest(c, ["conv_id"], [F.col("turn"), F.col("role")])


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src DESC, event_id DESC) AS k FROM
  (SELECT user_id, event_id, value, 0 AS src FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, event_id, value, 1 FROM events WHERE event_type = 'purchase')) WHERE k = 1""")
def upsert_snapshot(spark, d):
    ev = read(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    of = lambda t: ev.where(F.col("event_type") == t).drop("event_type")
    old = tables.latest(of("signup"), ["user_id"], [F.col("event_id")])
    return tables.ordered_upsert(old, of("purchase"), ["user_id"], [F.col("event_id")])


@query("SELECT c_custkey AS custkey FROM customer UNION SELECT o_custkey FROM orders")
def union_distinct(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).union(read(spark, d, "orders").select("o_custkey")).distinct()


@query("SELECT c_custkey AS custkey, 'customer' AS kind FROM customer UNION ALL SELECT o_custkey, 'order' FROM orders")
def union_all_events(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.lit("customer").alias("kind"))
    return c.unionByName(read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.lit("order").alias("kind")))


@query("""SELECT 'o_orderstatus' AS axis, o_orderstatus AS value, count(*)::BIGINT AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*)::BIGINT FROM orders GROUP BY 2
  UNION ALL SELECT 'all', NULL, count(*)::BIGINT FROM orders""")
def doctor_histogram(spark, d):
    return tables.histogram(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT p_partkey, p_size::SMALLINT AS p_size, p_retailprice::FLOAT AS price, CASE p_size % 4 WHEN 0 THEN 'RC' WHEN 1 THEN 'HB' WHEN 2 THEN 'Mix' ELSE 'LN' END AS family FROM part""")
def export_projection(spark, d):
    from ..schema import FAMILIES

    return read(spark, d, "part").select("p_partkey", F.col("p_size").cast("short").alias("p_size"), F.col("p_retailprice").cast("float").alias("price"), S.label(F.col("p_size") % 4, FAMILIES).alias("family"))


@query("""SELECT s_suppkey, printf('%d' || chr(9) || '%.2f' || chr(9) || '%s', s_suppkey, abs(s_acctbal), s_name) AS line FROM supplier""")
def print_rows(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", F.format_string("%d\t%.2f\t%s", "s_suppkey", F.abs("s_acctbal"), "s_name").alias("line"))


@query("""SELECT p_partkey, CASE WHEN r <= 0.15::DOUBLE THEN 'RC' WHEN r >= 0.90::DOUBLE THEN 'LN' WHEN h >= 0.10::DOUBLE THEN 'HB' ELSE 'Mix' END AS family FROM
  (SELECT p_partkey, p_size / 50::DOUBLE AS r, (p_partkey % 10) / 50::DOUBLE AS h FROM part)""")
def family_rule(spark, d):
    from ..operators.mania_features import family_code
    from ..schema import FAMILIES

    code = family_code(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 50.0)
    return read(spark, d, "part").select("p_partkey", S.label(code, FAMILIES).alias("family"))


@query("""WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS e, count(*) FILTER (event_type = 'view')::DOUBLE / count(*) AS v,
  count(*) FILTER (event_type = 'click')::DOUBLE / count(*) AS c, count(*) FILTER (event_type = 'signup')::DOUBLE / count(*) AS s FROM events GROUP BY 1)
SELECT user_id, round(least(0.5::DOUBLE * greatest(e, v, c, s) + 0.3::DOUBLE * sqrt((e * e + v * v + c * c + s * s) / 4) + 0.2::DOUBLE * (e + v + c + s - least(e, v, c, s)) / 3, 1), 6) AS overall FROM f""")
def overall_intensity(spark, d):
    n = F.count(F.lit(1))
    share = lambda x: (F.count_if(F.col("event_type") == x) / n).alias(x)
    f = read(spark, d, "events").groupBy("user_id").agg(*[share(x) for x in ("error", "view", "click", "signup")])
    return f.select("user_id", r6(S.overall_intensity([F.col(x) for x in ("error", "view", "click", "signup")])).alias("overall"))


# Charts, made from events; their SQL goes by the events.


@query(chart_sql.OBJECTS)
def chart_objects(spark, d):
    from ..operators import std_features, tokenise
    from .synthetic import std_charts

    lines = settled(tokenise.chart_lines(std_charts(spark, d), lossy=False))
    o = std_features.ordered(tokenise.with_slider_speeds(tokenise.std_objects(lines), tokenise.timing_points(lines), tokenise.std_meta(lines)))
    tail = F.when(F.col("kind") == "slider", F.element_at("path", -1))
    return o.select("chart_id", F.col("i").cast("long").alias("i"), "x", "y", "time", "end_time", "kind", tail["x"].alias("x2"), tail["y"].alias("y2"), "slider_speed")


@query(chart_sql.BASE)
def chart_base(spark, d):
    from ..operators import std_features, tokenise
    from .synthetic import std_charts

    charts = settled(std_charts(spark, d))
    lines = settled(tokenise.chart_lines(charts, lossy=False))
    meta, points = settled(tokenise.std_meta(lines)), tokenise.timing_points(lines)
    objects = settled(std_features.ordered(tokenise.with_slider_speeds(tokenise.std_objects(lines), points, meta)))
    b = std_features.base_features(objects, meta, points).join(tokenise.identified(meta, charts).select("chart_id", "beatmap_id", F.col("mode").cast("long").alias("mode")), "chart_id")
    whole, parts = ("bpm", "ar", "od", "cs", "hp", "object_count"), {"length_seconds": 3, "object_density": 5, "circle_ratio": 5, "slider_ratio": 5, "spinner_ratio": 5}
    return b.select("chart_id", "beatmap_id", "mode", *[F.col(c).cast("double").alias(c) for c in whole], *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in parts.items()])


@query(chart_sql.FEATURES)
def chart_std_features(spark, d):
    from ..operators.std_features import std_features
    from .synthetic import std_charts

    charts = settled(std_charts(spark, d))
    attrs = charts.select(F.sha2("content", 256).alias("sha256"), F.lit(1.0).alias("aim"), F.lit(1.0).alias("speed"), F.lit(1.0).alias("reading"), F.lit(5.0).alias("stars"), F.lit(100).alias("max_combo"))
    out = std_features(charts, attrs)
    rates = ("sustained_ratio", "stack_rate", "slider_occlusion_rate", "path_crossing_rate")
    d6 = lambda c: F.round(F.col(c).cast("double"), 6)
    return out.select("chart_id", "beatmap_id", "status", d6("slider").alias("slider"), F.round(F.col("overlap").cast("double"), 4).alias("overlap"), F.round(F.col("overlap_stats.p95").cast("double"), 4).alias("p95"), F.col("base.object_count").cast("double").alias("object_count"), *[d6(f"overlap_stats.{r}").alias(r) for r in rates])


@query(chart_sql.LANE_OBJECTS)
def lane_objects(spark, d):
    from ..operators import tokenise
    from .synthetic import lane_charts

    lines = settled(tokenise.chart_lines(lane_charts(spark, d), lossy=True))
    o = tokenise.mania_objects(lines, tokenise.mania_meta(lines)).where("valid")
    return o.groupBy("chart_id", "start", F.col("column").cast("long").alias("lane"), "end", "long").agg(F.count(F.lit(1)).alias("n"))


@query(chart_sql.LANE_BASE)
def lane_base(spark, d):
    from .charts import mania_charts
    from .synthetic import lane_charts

    f = mania_charts(lane_charts(spark, d)).where("status = 'ok'")
    rounded = {"bpm": 3, "length_seconds": 3, "active_length_seconds": 3, "note_count": 0, "row_count": 0, "avg_nps": 3, "break_density": 4}
    return f.select("chart_id", *[F.round(F.col(f"base.{c}").cast("double"), n).alias(c) for c, n in rounded.items()], F.round(F.col("style.ln_note_ratio").cast("double"), 5).alias("ln_note_ratio"))


@query(chart_sql.LANE_FEATURES)
def chart_mania_features(spark, d):
    from .charts import labelled, mania_charts
    from .synthetic import lane_charts

    out = labelled(mania_charts(lane_charts(spark, d)))
    n = lambda c, k: F.round(F.col(c).cast("double"), k).alias(c.split(".")[-1])
    values = [*[n(f"difficulty.{a}", 4) for a in MANIA_AXES], *[n(f"style.{a}", 5) for a in PATTERNS + STRUCTURE], *[F.col(f"base.{c}").cast("double").alias(c) for c in ("note_count", "peak_nps")]]
    named = [F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("family", "pattern")]
    return out.select("chart_id", "beatmap_id", "status", F.col("key_count").cast("long").alias("key_count"), *values, *named)


@query(chart_sql.LANE_SIMILAR)
def chart_mania_similar(spark, d):
    from .charts import mania_charts, normalise_mania
    from .synthetic import lane_charts

    features = settled(normalise_mania(mania_charts(lane_charts(spark, d)), 1))
    target = features.orderBy("beatmap_id").limit(1)
    return similarity.mania_similar(features, target).select("beatmap_id", F.col("key_count").cast("long").alias("key_count"), F.round("final_distance", 5).alias("distance"))


# Stores, archives and text sources


def _store(spark, mode):
    import uuid

    from ..settle import shared_folder
    from .store import Store

    return Store.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", mode)


@query(chart_sql.LANE_STORE)
def lane_store(spark, d):
    """Lane charts added, added again, normalised by a kept normaliser, published and read back."""
    from .charts import fit_mania, mania_charts, normalise_mania
    from .synthetic import lane_charts

    store, raw = _store(spark, "mania"), settled(mania_charts(lane_charts(spark, d)))
    store.upsert_raw(raw)
    if store.upsert_raw(raw)["inserted"]:
        raise RuntimeError("the same charts were added twice")
    store.save_normaliser(1, fit_mania(store.raw()))
    store.publish(1, normalise_mania(store.raw(), 1, store.load_normaliser(1)))
    f = store.features(1, verify=True)
    return f.select("beatmap_id", F.col("key_count").cast("long").alias("key_count"), F.col("difficulty_band").cast("long").alias("band"), F.round(F.col("difficulty_percentile").cast("double"), 6).alias("percentile"), *[F.round(F.col(f"difficulty.{a}").cast("double"), 6).alias(a) for a in MANIA_AXES])


@query(chart_sql.STD_STORE)
def std_store(spark, d):
    """Free-aim charts added, normalised and published: the statistics of their star sections."""
    from ..operators.std_features import std_features
    from .charts import normalise_std
    from .synthetic import rated, std_charts

    store, charts = _store(spark, "std"), settled(std_charts(spark, d))
    store.upsert_raw(settled(std_features(charts, rated(charts))))
    store.publish(1, normalise_std(store.raw(), 1))
    stats = store.stats()
    sums = [F.round(f"{k}_{a}", 6).alias(f"{k}_{a}") for a in ("aim", "speed", "reading", "slider") for k in ("sum", "sumsq")]
    return stats.select("star_section", F.col("count").alias("n"), *sums, "sum_ar", "sumsq_cs")


@query(chart_sql.MEMBERS)
def archive_members(spark, d):
    from ..sources.archives import archive_members
    from .synthetic import archives

    m = archive_members(archives(spark, d))
    return m.select("archive", "member", "status", F.sha2("content", 256).alias("sha"))


@query(chart_sql.VERIFIED)
def archive_check(spark, d):
    from ..sources.archives import verify_archives
    from .synthetic import archives

    return verify_archives(archives(spark, d))


@query("""WITH p AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'SM' ELSE 'R' END AS kind, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS page, doc_id, n_chars FROM documents),
s AS (SELECT *, coalesce(max((n_chars < 120)::INT) OVER (PARTITION BY kind ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM p)
SELECT kind || doc_id AS pack_id, CASE kind WHEN 'S' THEN 'standard' WHEN 'SM' THEN 'excluded' ELSE 'mixed' END AS class FROM s WHERE stopped = 0""")
def paged_packs(spark, d):
    """Pages of three kinds made of documents, one pack each; short documents make pages that link to no further one."""
    from ..sources.catalogue_text import MORE_PAGES, pack_class, paged_pack_ids

    docs = read(spark, d, "documents")
    kind = F.element_at(F.array(F.lit("S"), F.lit("SM"), F.lit("R")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    more = F.when(F.col("n_chars") < 120, "").otherwise(MORE_PAGES)
    page = F.row_number().over(Window.partitionBy("kind").orderBy("doc_id"))
    pages = docs.withColumn("kind", kind).withColumn("page", page).select("kind", "page", F.concat(F.lit('<a href="/beatmaps/packs/'), "kind", F.col("doc_id").cast("string"), F.lit('">x</a>'), more).alias("html"))
    ids = paged_pack_ids(pages)
    return ids.select("pack_id", pack_class(F.col("pack_id")).alias("class"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://official/' || page_id ELSE 'https://mirror/' || page_id END AS link FROM (SELECT page_id, replace(url, 'http://', 'https://') AS url FROM pages)""")
def source_links(spark, d):
    """A mirror's answer for each page: with its address, failed, or under another name; the official link serves where there is none."""
    from ..sources.catalogue_text import mirror_link, source_link

    url, n = F.regexp_replace("url", "^http://", "https://"), F.pmod("page_id", F.lit(4))
    other = F.concat(F.lit("https://mirror/"), F.col("page_id").cast("string"))
    answer = F.when(n == 0, F.to_json(F.struct(F.lit(True).alias("success"), url.alias("url")))).when(n == 1, F.to_json(F.struct(F.lit(False).alias("success"), url.alias("url")))).otherwise(F.to_json(F.struct(F.lit(True).alias("success"), other.alias("download_url"))))
    official = F.concat(F.lit("https://official/"), F.col("page_id").cast("string"))
    return read(spark, d, "pages").select("page_id", source_link(mirror_link(answer), official).alias("link"))


@query("""SELECT string_agg('c' || s_suppkey || '=' || s_name, '; ' ORDER BY s_suppkey) AS cookie FROM supplier WHERE s_nationkey % 3 <> 2 AND s_suppkey % 7 <> 0""")
def cookie_header(spark, d):
    """A cookie file made of suppliers: for the domain, for hosts under it, for another one, and comments."""
    from ..sources.catalogue_text import cookies

    host = F.element_at(F.array(F.lit("#HttpOnly_.x.org"), F.lit("a.x.org"), F.lit("notx.org")), (F.pmod("s_nationkey", F.lit(3)) + 1).cast("int"))
    line = F.concat_ws("\t", host, F.lit("TRUE"), F.lit("/"), F.lit("TRUE"), F.lit("0"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")), "s_name")
    lines = read(spark, d, "supplier").select(F.col("s_suppkey").alias("line_no"), F.when(F.pmod("s_suppkey", F.lit(7)) == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return cookies(lines, "x.org")


@query("""SELECT CASE event_type WHEN 'click' THEN 'downloaded' WHEN 'view' THEN 'skipped' ELSE 'failed' END AS outcome, count(*)::BIGINT AS n FROM events WHERE event_type <> 'signup' GROUP BY 1""")
def retry_outcomes(spark, d):
    """A retry log made of events."""
    from ..sources.catalogue_text import log_outcomes

    said = F.when(F.col("event_type") == "click", "Downloaded").when(F.col("event_type") == "view", "SKIPPED").when(F.col("event_type") == "signup", "undownloaded").otherwise("has failed:")
    return log_outcomes(read(spark, d, "events").select(F.concat_ws(" ", F.col("event_id").cast("string"), said, "props").alias("value")))


@query("""SELECT d.doc_id AS beatmap_id, CASE WHEN l.quality = 1 THEN 'downloaded' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def manifest_status(spark, d):
    from ..sources.catalogue_text import manifest

    charts, labels = read(spark, d, "documents").select(F.col("doc_id").alias("beatmap_id")), read(spark, d, "labels").withColumnRenamed("doc_id", "beatmap_id")
    return manifest(charts, labels.where("quality = 1"), labels)


@query("""SELECT l_orderkey * 100 + l_linenumber AS beatmap_id, l_orderkey AS beatmapset_id, l_shipdate::DATE::VARCHAR AS version, 'mania' AS mode FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderstatus = 'F' AND l_returnflag <> 'N' AND l_linestatus = 'F'""")
def ranked_catalogue(spark, d):
    """API records of sets with nested charts, made of orders and their lines, written and read as JSON."""
    import uuid

    from ..settle import shared_folder
    from ..sources.catalogue_text import ranked_charts

    b = F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "F", "mania").otherwise("osu").alias("mode"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("ranked"), F.when(F.col("l_returnflag") == "R", "ranked").otherwise("loved").alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("version"))
    sets = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(b).alias("beatmaps")).join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    path = f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    sets.select(F.col("l_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ranked").otherwise("graveyard").alias("status"), F.lit(0).alias("ranked"), "beatmaps").write.json(path)
    return ranked_charts(spark, path)


@query()
def windowed_counts(spark, d):
    from ..streaming.ingest import windowed_counts

    ev = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(ev).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


ORACLE["windowed_counts"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("""SELECT page_id, i::BIGINT AS "at", replace(replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#039;', ''''), '&amp;', '&') AS href FROM
  (SELECT page_id, unnest(l) AS href, unnest(range(0, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def entity_decode(spark, d):
    from ..sources.catalogue_text import entities

    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = read(spark, d, "pages").select("page_id", F.posexplode(found).alias("at", "href"))
    return links.select("page_id", F.col("at").cast("long").alias("at"), entities(F.col("href")).alias("href"))
