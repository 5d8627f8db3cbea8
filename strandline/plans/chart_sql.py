"""What the chart plans must give for the synthetic charts, as SQL over the events these are made from.

Nothing here is parsed: an event's place, time and kind are what its line was written from, so the SQL stands on the other side of the text.
"""

from __future__ import annotations

#: Objects of the free-aim charts: i is the place in the chart, px and py those of the object before.
STD = """o AS (SELECT user_id AS c, event_id, t, x, y, x2, y2, kind, row_number() OVER p - 1 AS i, lag(x) OVER p AS px, lag(y) OVER p AS py FROM (
  SELECT user_id, event_id, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 10000000)::DOUBLE AS t, ((floor(value * 37)::BIGINT % 512 + 512) % 512)::DOUBLE AS x, (event_id * 53 % 384)::DOUBLE AS y,
    ((floor(value * 37)::BIGINT % 512 + 512) % 512 + 40)::DOUBLE AS x2, (event_id * 53 % 384 + 30)::DOUBLE AS y2, CASE event_type WHEN 'purchase' THEN 'slider' WHEN 'signup' THEN 'spinner' ELSE 'circle' END AS kind FROM events)
  WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id))"""

OBJECTS = f"""WITH {STD} SELECT c AS chart_id, i::BIGINT AS i, x, y, t AS time, CASE kind WHEN 'spinner' THEN t + 500 ELSE t END AS end_time, kind,
  CASE kind WHEN 'slider' THEN x2 END AS x2, CASE kind WHEN 'slider' THEN y2 END AS y2, CASE WHEN kind <> 'slider' THEN 0 WHEN t >= 90000 THEN 560 ELSE 280 END::DOUBLE AS slider_speed FROM o"""

BASE = f"""WITH {STD}, s AS (SELECT c, count(*) AS n, max(t + CASE kind WHEN 'spinner' THEN 500 ELSE 0 END) FILTER (i = last) - min(t) AS ms, count(*) FILTER (kind = 'circle') AS circles, count(*) FILTER (kind = 'slider') AS sliders,
  count(*) FILTER (kind = 'spinner') AS spinners FROM (SELECT *, max(i) OVER (PARTITION BY c) AS last FROM o) GROUP BY 1)
SELECT c AS chart_id, c + 1 AS beatmap_id, 0::BIGINT AS mode, 120::DOUBLE AS bpm, 8::DOUBLE AS ar, 5::DOUBLE AS od, 4::DOUBLE AS cs, 5::DOUBLE AS hp, round((ms / 1000)::FLOAT::DOUBLE, 3) AS length_seconds, n::DOUBLE AS object_count,
  round(CASE WHEN ms > 0 THEN n / (ms / 1000) ELSE 0 END::FLOAT::DOUBLE, 5) AS object_density, round((circles / n)::FLOAT::DOUBLE, 5) AS circle_ratio, round((sliders / n)::FLOAT::DOUBLE, 5) AS slider_ratio, round((spinners / n)::FLOAT::DOUBLE, 5) AS spinner_ratio FROM s"""


def _point_to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = f"(CASE WHEN {dx} = 0 AND {dy} = 0 THEN 0 ELSE least(greatest((({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / ({dx} * {dx} + {dy} * {dy}), 0), 1) END)"
    return f"sqrt(pow({px} - {ax} - {t} * {dx}, 2) + pow({py} - {ay} - {t} * {dy}, 2))"


def _side(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return f"(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def _segment_to_segment(a, b, c, d) -> str:
    cross = f"{_side(a, b, c)} * {_side(a, b, d)} <= 0 AND {_side(c, d, a)} * {_side(c, d, b)} <= 0"
    near = ", ".join(_point_to_segment(*p, *s, *e) for p, s, e in ((a, c, d), (b, c, d), (c, a, b), (d, a, b)))
    return f"(CASE WHEN {cross} THEN 0 ELSE least({near}) END)"


def _at(t: str) -> str:
    return f"greatest(ceil({t} / 400), 0)"


_A, _A2, _B, _B2 = ("a.x", "a.y"), ("a.x2", "a.y2"), ("b.x", "b.y"), ("b.x2", "b.y2")
_PA, _PB = ("a.px", "a.py"), ("b.px", "b.py")

#: a is the later object of a pair, b the earlier one; 750 ms of preempt and a radius of 36.48 follow from the charts' settings.
FEATURES = f"""WITH {STD}, pairs AS (SELECT a.c, a.i, a.i - b.i AS apart, least(a.t, b.t) - greatest(a.t, b.t) + 750 AS visible, a.t - b.t AS dt, a.kind = 'slider' AS sa, b.kind = 'slider' AS sb,
    CASE WHEN a.kind = 'slider' AND b.kind = 'slider' THEN {_segment_to_segment(_A, _A2, _B, _B2)} WHEN a.kind = 'slider' THEN {_point_to_segment(*_B, *_A, *_A2)} WHEN b.kind = 'slider' THEN {_point_to_segment(*_A, *_B, *_B2)}
      ELSE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) END / 72.96 AS q,
    CASE WHEN a.px IS NULL OR b.px IS NULL THEN 0 WHEN {_segment_to_segment(_PB, _B, _PA, _A)} > 36.48 THEN 0 ELSE least(abs((b.x - b.px) * (a.y - a.py) - (b.y - b.py) * (a.x - a.px))
      / greatest(sqrt(pow(b.x - b.px, 2) + pow(b.y - b.py, 2)) * sqrt(pow(a.x - a.px, 2) + pow(a.y - a.py, 2)), 1), 1) END AS angle
  FROM o a JOIN o b ON a.c = b.c AND b.i < a.i AND a.t - b.t <= 3000 WHERE a.kind <> 'spinner' AND b.kind <> 'spinner'),
seen AS (SELECT *, CASE WHEN q <= 1.5 THEN 0.8::DOUBLE * pow(greatest(1 - q, 0), 2) + 0.2::DOUBLE * pow(greatest(1 - q / 1.5::DOUBLE, 0), 2) ELSE 0 END AS sp, least(greatest(sqrt(200 / greatest(dt, 50)), 0.5::DOUBLE), 2) AS push, exp(-dt / 700) AS fade FROM pairs WHERE visible > 0),
scored AS (SELECT *, CASE WHEN q <= 0.5 THEN sp * push ELSE 0 END AS stack, CASE WHEN q <= 1.5 THEN visible / 750 * fade * push * (0.35::DOUBLE * CASE WHEN sa AND sb THEN 0 ELSE sp END + 0.25::DOUBLE * CASE WHEN sa OR sb THEN sp ELSE 0 END
  + 0.15::DOUBLE * sp / sqrt(apart) + 0.15::DOUBLE * CASE WHEN q <= 0.5 THEN sp * push ELSE 0 END + 0.10::DOUBLE * angle * fade) ELSE 0 END AS score FROM seen),
per AS (SELECT c, i, 0.65::DOUBLE * max(score) + 0.35::DOUBLE * ln(1 + sum(score)) AS score, count(*) AS seen, count(*) FILTER (stack > 0) AS stacks, count(*) FILTER (sp > 0 AND (sa OR sb)) AS occludes, count(*) FILTER (q <= 1.5 AND angle > 0) AS crosses FROM scored GROUP BY 1, 2),
hits AS (SELECT o.c, o.i, o.t, coalesce(score, 0) AS score, coalesce(seen, 0) AS seen, coalesce(stacks, 0) AS stacks, coalesce(occludes, 0) AS occludes, coalesce(crosses, 0) AS crosses FROM o LEFT JOIN per USING (c, i) WHERE kind <> 'spinner'),
strain AS (SELECT a.c, a.i, a.t, sum(b.score * pow(0.25::DOUBLE, (a.t - b.t) / 1000)) AS s FROM hits a JOIN hits b ON a.c = b.c AND b.i <= a.i GROUP BY 1, 2, 3),
times AS (SELECT c, s, CASE WHEN lead(t) OVER p IS NULL THEN 1 ELSE {_at('lead(t) OVER p')} - {_at('t')} END AS n FROM strain WINDOW p AS (PARTITION BY c ORDER BY t, i)),
peaks AS (SELECT c, s, unnest(range(0, n::BIGINT)) AS k FROM (SELECT * FROM times UNION ALL SELECT c, 0, {_at('min(t)')} FROM strain GROUP BY c) WHERE n > 0),
ranked AS (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY s DESC) - 1 AS k, count(*) OVER (PARTITION BY c) AS n FROM peaks),
top AS (SELECT c, sum(s * pow(0.9::DOUBLE, k)) AS peak, max(s) FILTER (k = floor((n - 1) * 0.05::DOUBLE)) AS p95 FROM ranked GROUP BY 1),
sums AS (SELECT c, count(*) FILTER (score > 0) AS live, sum(seen) AS seen, sum(stacks) AS stacks, sum(occludes) AS occludes, sum(crosses) AS crosses FROM hits GROUP BY 1),
speeds AS (SELECT c, (t >= 90000)::INT AS v, lag((t >= 90000)::INT) OVER (PARTITION BY c ORDER BY i) AS p FROM o WHERE kind = 'slider'),
changes AS (SELECT c, count(p) AS moves, count(*) FILTER (v <> p) AS changes FROM speeds GROUP BY 1),
n AS (SELECT c, count(*) AS n, count(*) FILTER (kind = 'slider') AS sliders, count(*) FILTER (kind <> 'spinner') AS hits FROM o GROUP BY 1)
SELECT c AS chart_id, c + 1 AS beatmap_id, 'ok' AS status, round((0.3::DOUBLE * CASE WHEN hits > 0 THEN sliders / hits ELSE 0 END + 0.7::DOUBLE * CASE WHEN moves > 0 THEN changes / moves ELSE 0 END)::FLOAT::DOUBLE, 6) AS slider,
  round(coalesce(peak, 0)::FLOAT::DOUBLE, 4) AS overlap, round(coalesce(p95, 0)::FLOAT::DOUBLE, 4) AS p95, n.n::DOUBLE AS object_count, round((coalesce(live, 0) / n.n)::FLOAT::DOUBLE, 6) AS sustained_ratio, round(coalesce(stacks / greatest(seen, 1), 0)::FLOAT::DOUBLE, 6) AS stack_rate,
  round(coalesce(occludes / greatest(seen, 1), 0)::FLOAT::DOUBLE, 6) AS slider_occlusion_rate, round(coalesce(crosses / greatest(seen, 1), 0)::FLOAT::DOUBLE, 6) AS path_crossing_rate
FROM n LEFT JOIN top USING (c) LEFT JOIN sums USING (c) LEFT JOIN changes USING (c)"""

#: Objects of the lane charts; only charts of 4, 6 and 7 lanes are read.
LANES = """o AS (SELECT user_id AS c, event_id, keys, t, least(floor(floor(least(x, 511.999::DOUBLE) / 512 * 128) * keys / 128), keys - 1)::BIGINT AS lane, CASE WHEN long THEN t + 300 ELSE t END AS stop, long FROM (
  SELECT user_id, event_id, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 10000000)::DOUBLE AS t, ((floor(value * 37)::BIGINT % 512 + 512) % 512)::DOUBLE AS x, event_type = 'purchase' AS long,
    CASE user_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE 5 END::BIGINT AS keys FROM events))"""

LANE_OBJECTS = f"WITH {LANES} SELECT c AS chart_id, t AS start, lane, stop AS end, long, count(*)::BIGINT AS n FROM o GROUP BY ALL"

#: Rows of heads, of events no more than 2 ms after the row's first one, are found by recursion; releases are events too.
LANE_BASE = f"""WITH RECURSIVE {LANES}, ev AS (SELECT c, t, true AS head FROM o WHERE keys <> 5 UNION ALL SELECT c, stop, false FROM o WHERE long AND keys <> 5),
a AS (SELECT c, min(t) AS start FROM ev GROUP BY 1 UNION ALL SELECT c, (SELECT min(t) FROM ev WHERE ev.c = a.c AND ev.t - a.start > 2) FROM a WHERE EXISTS (SELECT 1 FROM ev WHERE ev.c = a.c AND ev.t - a.start > 2)),
r AS (SELECT c, start, lead(start) OVER (PARTITION BY c ORDER BY start) AS stop FROM a),
h AS (SELECT r.c, r.start, bool_or(head) AS head FROM r JOIN ev ON ev.c = r.c AND ev.t >= r.start AND (r.stop IS NULL OR ev.t < r.stop) GROUP BY 1, 2),
g AS (SELECT c, start, start - lag(start) OVER (PARTITION BY c ORDER BY start) AS gap FROM h WHERE head),
b AS (SELECT c, count(*) AS rows, coalesce(sum(gap - 1000) FILTER (gap > 1000), 0) AS idle, count(*) FILTER (gap > 1000) AS breaks FROM g GROUP BY 1),
d AS (SELECT c, greatest(max(start) - min(start), 1) AS ms FROM h GROUP BY 1),
m AS (SELECT r.c, r.start, o.lane, bool_or(o.long) AS long FROM r JOIN o ON o.c = r.c AND o.t >= r.start AND (r.stop IS NULL OR o.t < r.stop) GROUP BY ALL),
n AS (SELECT c, count(*) AS notes, count(*) FILTER (long) AS longs FROM m GROUP BY 1)
SELECT c AS chart_id, 120::DOUBLE AS bpm, round((ms / 1000)::FLOAT::DOUBLE, 3) AS length_seconds, round((greatest(ms - idle, 1) / 1000)::FLOAT::DOUBLE, 3) AS active_length_seconds, notes::DOUBLE AS note_count, rows::DOUBLE AS row_count,
  round((notes / (greatest(ms - idle, 1) / 1000))::FLOAT::DOUBLE, 3) AS avg_nps, round((breaks / greatest(greatest(ms - idle, 1) / 60000, 1))::FLOAT::DOUBLE, 4) AS break_density, round((longs / notes)::FLOAT::DOUBLE, 5) AS ln_note_ratio FROM b JOIN d USING (c) JOIN n USING (c)"""


def _rate(dt: str, base: int, offset: int, power: float) -> str:
    return f"least(pow({base} / greatest({dt} + {offset}, 16), {power}::DOUBLE), 8)"


# The axes, their decay times, the burst's share, and their weights in the local strain.
_AXES = ("speed", "hand_stream", "jack", "chordjack", "technical", "stamina", "long_note", "course")
_BURST, _SUSTAIN = (220, 260, 300, 260, 450, 1200, 450, 30000), (1600, 2200, 1800, 2400, 3200, 10000, 4000, 120000)
_MIX, _LOCAL = (0.78, 0.80, 0.88, 0.82, 0.70, 0.58, 0.65, 0.35), (0.20, 0.16, 0.14, 0.14, 0.11, 0.10, 0.10, 0.05)
_KINDS = ("stream", "chordstream", "jacks", "coordination", "density", "wildcard")


def _state(k: int) -> str:
    faded = lambda tau: f"sum(b.in{k} * exp(-(a.t - b.t) / {tau}))"
    return f"{_MIX[k]}::DOUBLE * {faded(_BURST[k])} + (1 - {_MIX[k]}::DOUBLE) * {faded(_SUSTAIN[k])} AS v{k}"


_WINDOWED = """{name} AS (SELECT c, t, least(greatest(-sum(n / total * log2(n / total)) / ({bits} * any_value(keys)), 0), 1) AS {name} FROM
  (SELECT a.c, a.t, a.keys, {item} AS item, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY a.c, a.t) AS total FROM h a JOIN h b ON a.c = b.c AND b.t <= a.t AND a.t - b.t <= 750 {where} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""

#: Masks of lanes as numbers; h are the rows with heads, z their zones, l their lanes.  Zones: masks 3 and 12 of four lanes, 7 and 56 of six, 7, 8 and 112 of seven.
_LANE_ROWS = f"""WITH RECURSIVE {LANES},
ev AS (SELECT c, keys, t, lane, CASE WHEN long THEN 2 ELSE 1 END AS kind, stop FROM o WHERE keys <> 5 UNION ALL SELECT c, keys, stop, lane, 0, stop FROM o WHERE long AND keys <> 5),
a AS (SELECT c, min(t) AS t FROM ev GROUP BY 1 UNION ALL SELECT c, (SELECT min(t) FROM ev WHERE ev.c = a.c AND ev.t - a.t > 2) FROM a WHERE EXISTS (SELECT 1 FROM ev WHERE ev.c = a.c AND ev.t - a.t > 2)),
r AS (SELECT c, t, lead(t) OVER (PARTITION BY c ORDER BY t) AS nt FROM a),
er AS (SELECT r.c, r.t, keys, lane, kind, stop, 1::BIGINT << lane AS bit FROM r JOIN ev ON ev.c = r.c AND ev.t >= r.t AND (r.nt IS NULL OR ev.t < r.nt)),
held AS (SELECT r.c, r.t, bit_or(bit) AS act FROM r JOIN er ON er.c = r.c AND er.kind = 2 AND er.t <= r.t AND er.stop + 2 >= r.t GROUP BY 1, 2),
rows_ AS (SELECT c, t, keys, nt, head, tap, lng, rel, coalesce(act, 0) AS act FROM (SELECT c, t, any_value(keys) AS keys, bit_or(CASE WHEN kind > 0 THEN bit ELSE 0 END) AS head, bit_or(CASE WHEN kind = 1 THEN bit ELSE 0 END) AS tap,
  bit_or(CASE WHEN kind = 2 THEN bit ELSE 0 END) AS lng, bit_or(CASE WHEN kind = 0 THEN bit ELSE 0 END) AS rel FROM er GROUP BY 1, 2) JOIN r USING (c, t) LEFT JOIN held USING (c, t)),
h AS (SELECT *, bit_count(head) AS n, coalesce(t - lag(t) OVER p, 1000) AS dt, lag(t) OVER p IS NOT NULL AS known, coalesce(lag(head) OVER p, 0) AS before FROM rows_ WHERE head <> 0 WINDOW p AS (PARTITION BY c ORDER BY t)),
zones AS (SELECT unnest([4, 4, 6, 6, 7, 7, 7]) AS keys, unnest([3, 12, 7, 56, 7, 8, 112])::BIGINT AS mask),
z0 AS (SELECT c, t, mask, head & mask AS used, lag(head & mask) OVER p AS last, t - lag(t) OVER p AS dt FROM h JOIN zones USING (keys) WHERE head & mask <> 0 WINDOW p AS (PARTITION BY c, mask ORDER BY t)),
z AS (SELECT *, CASE WHEN dt IS NULL THEN 0 ELSE {_rate('dt', 180, 40, 1.08)} END AS strain, last IS NOT NULL AS moved, coalesce(last & used = 0, false) AS turned, coalesce(last & used <> 0, false) AS kept,
  CASE WHEN coalesce(last & used = 0, false) THEN {_rate('dt', 205, 45, 1.05)} ELSE 0 END AS turning FROM z0),
zl AS (SELECT a.c, a.mask, a.t, sum(b.strain * exp(-(a.t - b.t) / 8000)) AS level FROM z a JOIN z b ON a.c = b.c AND a.mask = b.mask AND b.t <= a.t GROUP BY 1, 2, 3),
zs AS (SELECT c, t, max(level) AS stamina FROM (SELECT h.c, h.t, zl.mask, max_by(level, zl.t) AS level FROM h JOIN zl ON zl.c = h.c AND zl.t <= h.t GROUP BY 1, 2, 3) GROUP BY 1, 2),
zr AS (SELECT c, t, count(*) AS busy, max(strain) AS most, sum(strain) AS strains, max(0.70::DOUBLE * strain + 0.30::DOUBLE * turning) AS hand, sum(kept::INT) AS kept, sum(greatest(bit_count(used) - 1, 0)) AS together, sum(turned::INT) AS turned, sum(moved::INT) AS moved FROM z GROUP BY 1, 2),
l AS (SELECT c, t, t - lag(t) OVER (PARTITION BY c, lane ORDER BY t) AS dt FROM (SELECT DISTINCT c, t, lane FROM er WHERE kind > 0)),
lr AS (SELECT c, t, max(CASE WHEN dt IS NULL THEN 0 ELSE {_rate('dt', 185, 35, 1.18)} END) AS jack, coalesce(bool_or(dt <= 220), false) AS anchor FROM l GROUP BY 1, 2),
{_WINDOWED.format(name='rhythm', bits=1, item='b.head', where='')},
{_WINDOWED.format(name='change', bits=2, item='(b.before, b.head)', where='AND b.before <> 0')},
near AS (SELECT a.c, a.t, sum(b.n) FILTER (a.t - b.t <= 1000) AS second, sum(b.n) AS four FROM h a JOIN h b ON a.c = b.c AND b.t <= a.t AND a.t - b.t <= 4000 GROUP BY 1, 2),
i0 AS (SELECT h.*, busy, kept, together, turned, moved, jack, anchor, coalesce(rhythm, 0) AS rhythm, coalesce(change, 0) AS change, second, four, coalesce(stamina, 0) AS stamina, (n - 1) / greatest(keys - 1, 1)::DOUBLE AS chord,
  together / greatest(keys - CASE keys WHEN 7 THEN 3 ELSE 2 END, 1)::DOUBLE AS hands, 0.55::DOUBLE * CASE WHEN known THEN {_rate('dt', 155, 30, 1.06)} ELSE 0 END + 0.30::DOUBLE * most + 0.15::DOUBLE * strains / busy AS in0, greatest(hand, 0) AS in1,
  CASE WHEN known THEN least(abs(log2((dt + 24) / (lag(dt) OVER (PARTITION BY c ORDER BY t) + 24))) / 2, 1) ELSE 0 END AS chaos FROM h JOIN zr USING (c, t) JOIN lr USING (c, t) JOIN near USING (c, t) LEFT JOIN zs USING (c, t) LEFT JOIN rhythm USING (c, t) LEFT JOIN change USING (c, t)),
i1 AS (SELECT *, jack * (1 + 0.20::DOUBLE * chord + 0.15::DOUBLE * anchor::INT) AS in2 FROM i0),
i2 AS (SELECT *, (chord * (1 + 0.18::DOUBLE * in0) + 0.22::DOUBLE * hands) * (0.55::DOUBLE * in2 + 0.30::DOUBLE * kept / busy + 0.15::DOUBLE * in1) AS in3,
  0.32::DOUBLE * chaos + 0.24::DOUBLE * rhythm + 0.24::DOUBLE * change + 0.20::DOUBLE * (before <> 0 AND before <> head)::INT AS in4,
  (0.40::DOUBLE * ln(1 + second) + 0.35::DOUBLE * ln(1 + four / 4)) / ln(24) + 0.25::DOUBLE * stamina AS in5 FROM i1),
i AS (SELECT r.c, r.t, r.keys, r.nt, r.head, r.tap, r.lng, r.rel, r.act, {", ".join(f"coalesce(in{k}, 0) AS in{k}" for k in range(6))}, (0.35::DOUBLE * bit_count(r.act) + 0.25::DOUBLE * bit_count(r.rel) + 0.20::DOUBLE * bit_count(r.lng)) / r.keys
  + 0.20::DOUBLE * (r.lng <> 0 AND r.tap <> 0)::INT AS in6, coalesce(0.45::DOUBLE * in0 + 0.20::DOUBLE * in1 + 0.15::DOUBLE * in2 + 0.10::DOUBLE * in3 + 0.10::DOUBLE * in4, 0) AS in7, coalesce(anchor, false) AS anchor, coalesce(chord, 0) AS chord FROM rows_ r LEFT JOIN i2 USING (c, t)),
v AS (SELECT a.c, a.t, {", ".join(_state(k) for k in range(8))} FROM i a JOIN i b ON a.c = b.c AND b.t <= a.t GROUP BY 1, 2),
lv AS (SELECT c, t, unnest({list(range(9))}) AS axis, unnest([{", ".join(f"v{k}" for k in range(8))}, {" + ".join(f"{_LOCAL[k]}::DOUBLE * v{k}" for k in range(8))}]) AS x FROM v),
q AS (SELECT c, axis, quantile_cont(x, 0.97) AS q97, quantile_cont(x, 0.90) AS q90, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.50) AS q50, pow(avg(pow(greatest(x, 0), 2.4::DOUBLE)), 1 / 2.4::DOUBLE) AS power FROM lv GROUP BY 1, 2),
tail AS (SELECT c, axis, avg(x) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY c, axis ORDER BY x DESC) AS k, count(*) OVER (PARTITION BY c, axis) AS n FROM lv) WHERE k <= greatest(1, ceil(n * 0.04::DOUBLE)) GROUP BY 1, 2),
peaks AS (SELECT c, axis, section, max(x) AS peak FROM (SELECT *, floor(greatest(t - min(t) OVER (PARTITION BY c, axis), 0) / 400) AS section FROM lv) GROUP BY 1, 2, 3),
sections AS (SELECT c, axis, sum(peak * pow(0.9::DOUBLE, k)) / any_value((1 - pow(0.9::DOUBLE, n)) / (1 - 0.9::DOUBLE)) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY c, axis ORDER BY peak DESC) - 1 AS k, max(section) OVER (PARTITION BY c, axis) + 1 AS n FROM peaks) GROUP BY 1, 2),
d AS (SELECT c, axis, (0.80::DOUBLE * (0.30::DOUBLE * q97 + 0.22::DOUBLE * q90 + 0.18::DOUBLE * tail + 0.15::DOUBLE * q75 + 0.10::DOUBLE * power + 0.05::DOUBLE * q50) + 0.20::DOUBLE * mean)::FLOAT AS x FROM q JOIN tail USING (c, axis) JOIN sections USING (c, axis) WHERE axis < 8),
dw AS (SELECT c, {", ".join(f"max(x) FILTER (axis = {k}) AS {a}" for k, a in enumerate(_AXES))} FROM d GROUP BY 1),
kind AS (SELECT c, least(greatest(coalesce(nt - t, 1), 1), 1000) AS ms, CASE WHEN (lng <> 0 AND tap <> 0) OR rel & head <> 0 THEN 3 WHEN lng <> 0 AND (bit_count(head) >= 2 OR bit_count(act) >= 2) THEN 4 WHEN lng <> 0 OR rel <> 0 OR act <> 0 THEN 5
  WHEN anchor OR coalesce(last_value(nullif(head, 0) IGNORE NULLS) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) & head <> 0 THEN 2 WHEN chord > 0 THEN 1 WHEN head <> 0 THEN 0 ELSE 5 END AS kind FROM i),
share AS (SELECT c, {", ".join(f"(coalesce(sum(ms) FILTER (kind = {k}), 0) / greatest(sum(ms), 1))::FLOAT AS {x}" for k, x in enumerate(_KINDS))} FROM kind GROUP BY 1),
span AS (SELECT c, any_value(keys) AS keys, greatest(max(t) - min(t), 1) AS ms, sum(coalesce(nt - t, 0) * bit_count(act)) AS held FROM rows_ GROUP BY 1),
top AS (SELECT c, CASE WHEN q97 > 1e-9 THEN least(greatest((q97 - q50) / q97, 0), 1) ELSE 0 END AS gap FROM q WHERE axis = 8),
st AS (SELECT c, avg((n >= 2)::INT) AS chord_rate, avg((n >= ceil(keys / 2))::INT) AS large_chord_rate, coalesce(sum(turned) / nullif(sum(moved), 0), 0) AS rotation_rate, avg(anchor::INT) AS anchor_rate, avg(rhythm) AS rhythm_entropy, avg(change) AS transition_entropy,
  sum(bit_count(lng)) / sum(n) AS ln_note_ratio, avg((lng <> 0 AND tap <> 0)::INT) AS hybrid_row_ratio, max(second) AS peak_nps, sum(n) AS notes, count(*) AS heads, sum(greatest(dt - 1000, 0)) AS idle FROM i2 GROUP BY 1),
f AS (SELECT c, keys, {", ".join(_AXES)}, {", ".join(_KINDS)}, {", ".join(f"{x}::FLOAT AS {x}" for x in ("chord_rate", "large_chord_rate", "rotation_rate", "anchor_rate", "rhythm_entropy", "transition_entropy", "ln_note_ratio", "hybrid_row_ratio", "peak_nps"))},
  least(greatest(held / (ms * keys), 0), 1)::FLOAT AS hold_occupancy, gap::FLOAT AS peak_to_sustain_gap, notes::FLOAT AS note_count, (greatest(ms - idle, 1) / 1000)::FLOAT AS active_length_seconds, 120::FLOAT AS bpm FROM dw JOIN share USING (c) JOIN span USING (c) JOIN top USING (c) JOIN st USING (c)),
g AS (SELECT *, CASE WHEN ln_note_ratio <= 0.15::FLOAT THEN 0 WHEN ln_note_ratio >= 0.90::FLOAT THEN 3 WHEN hybrid_row_ratio >= 0.10::FLOAT THEN 1 ELSE 2 END AS family, list_max(list_transform([{", ".join(_KINDS)}], lambda x, i: (x, i))) AS best FROM f)"""

_STRUCTURE = ("chord_rate", "large_chord_rate", "rotation_rate", "anchor_rate", "rhythm_entropy", "transition_entropy", "ln_note_ratio", "hold_occupancy", "hybrid_row_ratio", "peak_to_sustain_gap")
LANE_FEATURES = f"""{_LANE_ROWS} SELECT c AS chart_id, c + 1 AS beatmap_id, 'ok' AS status, keys::BIGINT AS key_count, {", ".join(f"round({a}::DOUBLE, 4) AS {a}" for a in _AXES)}, {", ".join(f"round({a}::DOUBLE, 5) AS {a}" for a in _KINDS + _STRUCTURE)},
  note_count::DOUBLE AS note_count, peak_nps::DOUBLE AS peak_nps, ['RC', 'HB', 'Mix', 'LN'][family + 1] AS family, ['Stream', 'Chordstream', 'Jacks', 'Coordination', 'Density', 'Wildcard'][best[2]] AS pattern FROM g
UNION ALL SELECT DISTINCT user_id, user_id + 1, 'unsupported keys', 5, {", ".join("NULL" for _ in _AXES + _KINDS + _STRUCTURE)}, NULL, NULL, NULL, NULL FROM events WHERE user_id % 4 = 3"""


def _midrank(c: str, by: str) -> str:
    below, n, rows = f"rank() OVER (PARTITION BY {by} ORDER BY {c})", f"count(*) OVER (PARTITION BY {by}, {c})", f"count(*) OVER (PARTITION BY {by})"
    return f"(CASE WHEN {rows} > 1 THEN ({below} - 1 + ({n} - 1) / 2.0::DOUBLE) / ({rows} - 1) ELSE 0.5 END)::FLOAT"


def _hellinger(names: tuple[str, ...]) -> str:
    total = lambda s: "(" + " + ".join(f"{s}.{x}" for x in names) + f" + {1e-6 * len(names)}::DOUBLE)"
    parts = " + ".join(f"pow(sqrt((t.{x} + 1e-6::DOUBLE) / {total('t')}) - sqrt((b.{x} + 1e-6::DOUBLE) / {total('b')}), 2)" for x in names)
    return f"least(greatest(sqrt(({parts}) / 2), 0), 1)"


_RMS = "least(sqrt((" + " + ".join(f"(t.{x} - b.{x}) * (t.{x} - b.{x})" for x in _STRUCTURE) + ") / 10::DOUBLE), 1)"
_LOG = "least(abs(ln((greatest(t.active_length_seconds::DOUBLE, 0) + 1) / (greatest(b.active_length_seconds::DOUBLE, 0) + 1))) / ln(10), 1)"

#: The chart of least id and those like it: bands widen until 256 charts and 40 of its family are in.
LANE_SIMILAR = f"""{_LANE_ROWS}, m AS (SELECT c, keys, family, active_length_seconds, {", ".join(_KINDS + _STRUCTURE)}, {", ".join(f"{_midrank(a, 'keys')} AS {a}" for a in _AXES)} FROM g),
w AS (SELECT *, least(greatest(0.50::DOUBLE * greatest({", ".join(_AXES)}, 0) + 0.30::DOUBLE * sqrt(({" + ".join(f"{a} * {a}" for a in _AXES)}) / 8::DOUBLE) + 0.20::DOUBLE * list_sum(list_reverse_sort([{", ".join(f"{a}::DOUBLE" for a in _AXES)}])[1:3]) / 3, 0), 1)::FLOAT AS overall FROM m),
b AS (SELECT *, least(floor(p::DOUBLE * 10), 9) AS band FROM (SELECT *, {_midrank('overall', 'keys')} AS p FROM w)),
t AS (SELECT * FROM b ORDER BY c LIMIT 1),
x AS (SELECT b.c, b.keys, abs(b.band - t.band) AS gap, b.family = t.family AS same, 0.35::DOUBLE * {_hellinger(_AXES)} + 0.30::DOUBLE * {_hellinger(_KINDS)} + 0.20::DOUBLE * {_RMS} + 0.10::DOUBLE * abs(t.p - b.p) + 0.05::DOUBLE * (0.5::DOUBLE * {_LOG}) AS d
  FROM b JOIN t ON b.keys = t.keys AND b.c <> t.c),
radius AS (SELECT coalesce(min(r) FILTER (n >= 256 AND s >= 40), 9) AS r FROM (SELECT r, count(*) AS n, count(*) FILTER (same) AS s FROM (SELECT unnest(range(0, 10)) AS r) JOIN x ON gap <= r GROUP BY r))
SELECT c + 1 AS beatmap_id, keys::BIGINT AS key_count, round(d, 5) AS distance FROM x, radius WHERE gap <= radius.r ORDER BY d, c LIMIT 20"""

LANE_STORE = LANE_SIMILAR[: LANE_SIMILAR.index("t AS (SELECT * FROM b ORDER BY c LIMIT 1)")].rstrip().rstrip(",") + """
SELECT c + 1 AS beatmap_id, keys::BIGINT AS key_count, band::BIGINT AS band, round(p::DOUBLE, 6) AS percentile, """ + ", ".join(f"round({a}::DOUBLE, 6) AS {a}" for a in _AXES) + " FROM b"


def _share(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE (dense_rank() OVER (ORDER BY {c}) - 1)::DOUBLE / ((SELECT count(DISTINCT {c}) FROM a) - 1) END"


STD_STORE = FEATURES[: FEATURES.rindex("SELECT c AS chart_id")].rstrip() + f""",
a AS (SELECT c, (c * 7 % 31 / 10)::FLOAT AS aim, (c * 5 % 17 / 10)::FLOAT AS speed, (c * 3 % 13 / 10)::FLOAT AS reading, 3 + c * 11 % 29 / 10 AS stars,
  (0.3::DOUBLE * CASE WHEN hits > 0 THEN sliders / hits ELSE 0 END + 0.7::DOUBLE * CASE WHEN moves > 0 THEN changes / moves ELSE 0 END)::FLOAT AS slider FROM n LEFT JOIN changes USING (c)),
f AS (SELECT c, stars, {", ".join(f"({_share(x)})::FLOAT::DOUBLE AS {x}" for x in ("aim", "speed", "reading", "slider"))} FROM a)
SELECT floor(stars / 0.1::DOUBLE + 1e-6::DOUBLE)::BIGINT AS star_section, count(*)::BIGINT AS n, {", ".join(f"round(sum({x}), 6) AS sum_{x}, round(sum({x} * {x}), 6) AS sumsq_{x}" for x in ("aim", "speed", "reading", "slider"))}, 8.0::DOUBLE * count(*) AS sum_ar, 16.0::DOUBLE * count(*) AS sumsq_cs FROM f GROUP BY 1"""

MEMBERS = """WITH a AS (SELECT doc_id // 20 AS a, doc_id, coalesce(text, '') AS text, ['nested', '7z', 'rar', 'broken', 'empty', 'plain'][(doc_id // 20) % 6 + 1] AS kind FROM documents)
SELECT 'a' || a AS archive, CASE kind WHEN 'nested' THEN 'in.osz/' ELSE '' END || doc_id || '.osu' AS member, 'ok' AS status, sha256(text) AS sha FROM a WHERE kind IN ('nested', 'plain')
UNION ALL SELECT DISTINCT 'a' || a, CASE WHEN kind IN ('7z', 'rar') THEN kind ELSE '' END, CASE kind WHEN 'broken' THEN 'failed' WHEN 'empty' THEN 'empty' ELSE 'unsupported' END, NULL FROM a WHERE kind NOT IN ('nested', 'plain')"""

VERIFIED = """SELECT DISTINCT 'a' || doc_id // 20 AS path, CASE (doc_id // 20) % 6 WHEN 1 THEN 'unsupported' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'failed' ELSE 'ok' END AS status FROM documents"""
