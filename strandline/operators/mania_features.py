"""Lane charts: timeline rows, eight strain axes, pattern shares and structure, one chart at a time in numpy.

State runs from row to row, so a chart is one group; charts are many and short, which spreads them.  Within a chart all that doesn't
carry state is computed for all rows at once; the decaying states step through the rows together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ZONES
from ..schema import MANIA_AXES, MANIA_BASE, PATTERNS, STRUCTURE

# Tolerance and window lengths in ms; decay times and mixes of the eight axes; weights.
ROW_MS, ENTROPY_MS, SECTION_MS, SECTION_DECAY, GAP_MS = 2.0, 750.0, 400.0, 0.9, 1000.0
BURST_TAU = (220.0, 260.0, 300.0, 260.0, 450.0, 1200.0, 450.0, 30000.0)
SUSTAIN_TAU = (1600.0, 2200.0, 1800.0, 2400.0, 3200.0, 10000.0, 4000.0, 120000.0)
BURST_MIX = (0.78, 0.80, 0.88, 0.82, 0.70, 0.58, 0.65, 0.35)
LOCAL = (0.20, 0.16, 0.14, 0.14, 0.11, 0.10, 0.10, 0.05)
HAND_TAU = 8000.0


# Of the family rule.
FEW_LONG, MOST_LONG, HYBRID = 0.15, 0.90, 0.10


def family_code(ln_ratio: Column, hybrid_ratio: Column, kind: str = "double") -> Column:
    """``kind``: of the ratios, for the bounds are compared as such."""
    few, most, hybrid = (F.lit(x).cast(kind) for x in (FEW_LONG, MOST_LONG, HYBRID))
    return F.when(ln_ratio <= few, 0).when(ln_ratio >= most, 3).when(hybrid_ratio >= hybrid, 1).otherwise(2)


def bits(mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count(mask.astype(np.uint64)).astype(np.int64)


# Fixed values further down: of each strain's rates, of the parts of each input, and of the parts of an axis.


def rate(dt: np.ndarray, base: float, offset: float, power: float) -> np.ndarray:
    return np.minimum((base / np.maximum(dt + offset, 16.0)) ** power, 8.0)


def timeline(start: np.ndarray, column: np.ndarray, end: np.ndarray, long: np.ndarray, keys: int) -> dict[str, np.ndarray]:
    """Rows: times, and masks of heads, taps, long heads, releases and active holds.

    An event belongs to a row while it is within ROW_MS of the row's first one.
    """
    time = np.concatenate([start, end[long]])
    lane = np.concatenate([column, column[long]])
    order = np.concatenate([np.where(long, 2, 1), np.zeros(int(long.sum()), int)])
    until = np.concatenate([end, end[long]])
    by = np.lexsort((order, lane, time))
    time, lane, order, until = time[by], lane[by], order[by], until[by]
    firsts, i = [], 0
    while i < len(time):
        firsts.append(i)
        t = time[i]
        i += 1
        while i < len(time) and time[i] - t <= ROW_MS:
            i += 1
    at = np.array(firsts)
    bit = 1 << lane.astype(np.int64)
    fold = lambda chosen: np.bitwise_or.reduceat(np.where(chosen, bit, 0), at)
    row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(time))))
    held = np.full((len(at), keys), -np.inf)
    heads = order == 2
    np.maximum.at(held, (row[heads], lane[heads]), until[heads])
    held = np.maximum.accumulate(held, 0)
    t = time[at]
    active = ((held + ROW_MS >= t[:, None]) * (1 << np.arange(keys))).sum(1)
    return {"t": t, "head": fold(order > 0), "tap": fold(order == 1), "long": fold(order == 2), "release": fold(order == 0), "active": active}


def gaps(t: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows where ``used``: the time since the one before, and whether there is one."""
    at = np.flatnonzero(used)
    dt, known = np.full(len(t), GAP_MS), np.zeros(len(t), bool)
    dt[at[1:]] = np.diff(t[at])
    known[at[1:]] = True
    return dt, known


def window_start(t: np.ndarray, width: float) -> np.ndarray:
    """The first row that is at most ``width`` before each."""
    lo = np.searchsorted(t, t - width, "left")
    while (far := t - t[lo] > width).any():  # the difference may be rounded
        lo = lo + far
    while (more := (lo > 0) & (t - t[np.maximum(lo - 1, 0)] <= width)).any():
        lo = lo - more
    return lo


def trailing_entropy(items: np.ndarray, lo: np.ndarray, most_bits: float) -> np.ndarray:
    """Of the non-negative items in each trailing window, as a share of ``most_bits``.

    Counts run along with the window; with n items of which c are equal, the bits are log n - sum(c log c) / n.
    """
    weigh = np.append(0.0, np.arange(1, len(items) + 1) * np.log2(np.arange(1, len(items) + 1))).tolist()
    _, kind = np.unique(items, return_inverse=True)
    kind, counts, out = np.where(items < 0, -1, kind).tolist(), [0] * (len(items) + 1), np.zeros(len(items))
    n, total, first = 0, 0.0, 0

    def add(k: int, by: int) -> None:
        nonlocal n, total
        if k >= 0:
            total += weigh[counts[k] + by] - weigh[counts[k]]
            counts[k] += by
            n += by

    for i, start in enumerate(lo.tolist()):
        add(kind[i], 1)
        while first < start:
            add(kind[first], -1)
            first += 1
        if n:
            out[i] = min(max((math.log2(n) - total / n) / most_bits, 0.0), 1.0)
    return out


def quantile(values: np.ndarray, q: float) -> float:
    return float(np.quantile(values, q)) if len(values) else 0.0


def axis_value(values: np.ndarray, t: np.ndarray) -> float:
    """One number for a chart's axis: quantiles, tail and power mean, and the decaying mean of section peaks."""
    tail = np.sort(values)[-max(1, int(np.ceil(len(values) * 0.04))) :].mean()
    power = float((np.maximum(values, 0.0) ** 2.4).mean() ** (1 / 2.4))
    q = {p: quantile(values, p / 100) for p in (97, 90, 75, 50)}
    body = 0.30 * q[97] + 0.22 * q[90] + 0.18 * tail + 0.15 * q[75] + 0.10 * power + 0.05 * q[50]
    section = np.floor(np.maximum(t - t[0], 0.0) / SECTION_MS).astype(np.int64)
    peaks = np.zeros(section[-1] + 1)
    np.maximum.at(peaks, section, values)
    weight = SECTION_DECAY ** np.arange(len(peaks))
    return 0.80 * body + 0.20 * float((np.sort(peaks)[::-1] * weight).sum() / weight.sum())


def analyse(start: np.ndarray, column: np.ndarray, end: np.ndarray, long: np.ndarray, keys: int, bpm: float, sv_changes: int) -> dict | None:
    """Difficulty, style and base features of a chart, and its dominant pattern; None where a value isn't finite."""
    rows = timeline(start, column, end, long, keys)
    h = rows["head"] != 0
    t, head, tap, ln = (rows[k][h] for k in ("t", "head", "tap", "long"))
    n, count = len(t), bits(head)
    zones = ZONES[keys]
    if not n:
        return None
    dt, known = gaps(t, np.ones(n, bool))
    before = np.append(0, head[:-1])
    row_rate = np.where(known, rate(dt, 155.0, 30.0, 1.06), 0.0)

    used = np.stack([(head & z) for z in zones])
    strain, turning, overlap, moved, turned = (np.zeros((len(zones), n)) for _ in range(5))
    stamina = np.zeros((len(zones), n))
    for z in range(len(zones)):
        on = used[z] != 0
        zdt, zknown = gaps(t, on)
        at = np.flatnonzero(on)
        last = np.zeros(n, np.int64)
        last[at[1:]] = used[z][at[:-1]]
        strain[z] = np.where(on & zknown, rate(zdt, 180.0, 40.0, 1.08), 0.0)
        moved[z] = on & (last != 0)
        turned[z] = on & (last != 0) & (last & used[z] == 0)
        turning[z] = np.where(turned[z] > 0, rate(zdt, 205.0, 45.0, 1.05), 0.0)
        overlap[z] = on & (last & used[z] != 0)
        levels = [0.0]
        for fade, x in zip(np.exp(-np.maximum(zdt[at], 0.0) / HAND_TAU).tolist(), strain[z][at].tolist(), strict=True):
            levels.append(levels[-1] * fade + x)
        stamina[z] = np.array(levels)[np.cumsum(on)]
    busy = (used != 0).sum(0)
    in0 = 0.55 * row_rate + 0.30 * strain.max(0) + 0.15 * strain.sum(0) / np.maximum(busy, 1)
    in1 = np.maximum((0.70 * strain + 0.30 * turning).max(0), 0.0)

    jack, anchor = np.zeros(n), np.zeros(n, bool)
    for c in range(keys):
        on = head & (1 << c) != 0
        cdt, cknown = gaps(t, on)
        jack = np.maximum(jack, np.where(on & cknown, rate(cdt, 185.0, 35.0, 1.18), 0.0))
        anchor |= on & cknown & (cdt <= 220.0)
    chord = (count - 1) / max(keys - 1, 1)
    same_hand = np.maximum(bits(used.ravel()).reshape(used.shape) - 1, 0).sum(0) / max(keys - len(zones), 1)
    in2 = jack * (1.0 + 0.20 * chord + 0.15 * anchor)
    in3 = (chord * (1.0 + 0.18 * in0) + 0.22 * same_hand) * (0.55 * in2 + 0.30 * overlap.sum(0) / np.maximum(busy, 1) + 0.15 * in1)

    lo = window_start(t, ENTROPY_MS)
    rhythm = trailing_entropy(head, lo, float(keys))
    change = trailing_entropy(np.where(before == 0, -1, before << keys | head), lo, 2.0 * keys)
    chaos = np.zeros(n)
    chaos[1:] = np.minimum(np.abs(np.log2((dt[1:] + 24.0) / (dt[:-1] + 24.0))) / 2.0, 1.0)
    in4 = 0.32 * chaos + 0.24 * rhythm + 0.24 * change + 0.20 * ((before != 0) & (before != head))

    sums = np.append(0, np.cumsum(count))
    second, four = (sums[1:] - sums[window_start(t, w)] for w in (1000.0, 4000.0))
    in5 = (0.40 * np.log1p(second) + 0.35 * np.log1p(four / 4.0)) / np.log(24.0) + 0.25 * stamina.max(0)

    all_t, active, release = rows["t"], rows["active"], rows["release"]
    hybrid = (rows["long"] != 0) & (rows["tap"] != 0)
    inputs = np.zeros((len(all_t), 8))
    for k, x in enumerate((in0, in1, in2, in3, in4, in5)):
        inputs[h, k] = x
    inputs[:, 6] = (0.35 * bits(active) + 0.25 * bits(release) + 0.20 * bits(rows["long"])) / keys + 0.20 * hybrid
    inputs[:, 7] = inputs[:, :5] @ np.array([0.45, 0.20, 0.15, 0.10, 0.10])

    taus = np.array([BURST_TAU, SUSTAIN_TAU])
    fade = np.exp(-np.maximum(np.append(0.0, np.diff(all_t)), 0.0)[:, None, None] / taus)
    state, states = np.zeros((2, 8)), np.empty((len(all_t), 2, 8))
    for i in range(len(all_t)):
        state = state * fade[i] + inputs[i]
        states[i] = state
    mix = np.array(BURST_MIX)
    values = mix * states[:, 0] + (1 - mix) * states[:, 1]
    local = values @ np.array(LOCAL)

    # Of all rows: what the head row before had, and the marks of head rows themselves.
    seen = np.append(0, head)[np.cumsum(h) - h]
    on_all = lambda x: np.where(h, _spread(x, h), 0)
    heads, held = bits(rows["head"]), bits(active)
    kinds = np.select(
        [
            hybrid | (release & rows["head"] != 0),
            (rows["long"] != 0) & ((heads >= 2) | (held >= 2)),
            (rows["long"] != 0) | (release != 0) | (active != 0),
            (on_all(anchor) > 0) | (seen & rows["head"] != 0),
            on_all(chord) > 0,
            rows["head"] != 0,
        ],
        [3, 4, 5, 2, 1, 0],
        5,
    )
    length = np.clip(np.append(np.diff(all_t), 1.0), 1.0, 1000.0)
    shares = np.bincount(kinds, length, 6)
    shares = (shares / max(shares.sum(), 1.0)).astype(np.float32)

    duration = max(all_t[-1] - all_t[0], 1.0)
    breaks = dt > GAP_MS
    playing = max(duration - (dt[breaks] - GAP_MS).sum(), 1.0)
    notes = int(count.sum())
    top = quantile(local, 0.97)
    hold = float((np.diff(all_t) * held[:-1]).sum() / (duration * keys))
    f4 = lambda a, b: np.float32(a) / np.float32(b) if b else np.float32(0)
    structure = (
        f4((count >= 2).sum(), n), f4((count >= -(-keys // 2)).sum(), n), f4(turned.sum(), moved.sum()), f4(anchor.sum(), n), np.float32(rhythm.mean()), np.float32(change.mean()),
        f4(bits(ln).sum(), notes), np.float32(min(max(hold, 0.0), 1.0)), f4(((ln != 0) & (tap != 0)).sum(), n), np.float32(min(max((top - quantile(local, 0.50)) / top, 0.0), 1.0) if top > 1e-9 else 0.0),
    )
    base = (bpm, duration / 1000, playing / 1000, notes, n, notes / (playing / 1000), second.max(), breaks.sum() / max(playing / 60000, 1.0), sv_changes / max(duration / 60000, 1.0))
    difficulty = [axis_value(values[:, k], all_t) for k in range(8)]
    if not np.isfinite([*difficulty, *shares, *structure, *base]).all():
        return None
    dominant = max(range(6), key=lambda k: (shares[k], k))
    as_f = lambda names, xs: dict(zip(names, map(float, map(np.float32, xs)), strict=True))
    return {"difficulty": as_f(MANIA_AXES, difficulty), "style": as_f(PATTERNS + STRUCTURE, [*shares, *structure]), "base": as_f(MANIA_BASE, base), "dominant_pattern": dominant}


def _spread(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h))
    out[h] = x
    return out


def _struct(names: tuple[str, ...]) -> str:
    return "struct<" + ",".join(f"{n}:float" for n in names) + ">"


FEATURES = f"chart_id long, status string, difficulty {_struct(MANIA_AXES)}, style {_struct(PATTERNS + STRUCTURE)}, base {_struct(MANIA_BASE)}, dominant_pattern int"


def mania_features(objects: DataFrame, charts: DataFrame) -> DataFrame:
    """FEATURES and mode_family of each chart.  ``objects``: chart_id, start, column, end, long; ``charts``: chart_id, key_count, bpm, sv_changes."""
    whole = objects.join(charts, "chart_id")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        r = analyse(f["start"].to_numpy(float), f["column"].to_numpy(np.int64), f["end"].to_numpy(float), f["long"].to_numpy(bool), int(f["key_count"].iloc[0]), float(f["bpm"].iloc[0]), int(f["sv_changes"].iloc[0]))
        names = ("difficulty", "style", "base", "dominant_pattern")
        return pd.DataFrame([[f["chart_id"].iloc[0], "ok" if r else "invalid", *((r or {}).get(k) for k in names)]], columns=["chart_id", "status", *names])

    found = whole.groupBy("chart_id").applyInPandas(one, FEATURES)
    family = family_code(F.col("style.ln_note_ratio"), F.col("style.hybrid_row_ratio"), "float")
    return found.withColumn("mode_family", F.when(F.col("style").isNotNull(), family))
