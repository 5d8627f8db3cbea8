"""Scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanes of each hand by key count, as bit masks.
ZONES = {4: (0b0011, 0b1100), 6: (0b000111, 0b111000), 7: (0b0000111, 0b0001000, 0b1110000)}


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def star_section(stars: Column) -> Column:
    """Tenths of a star, whole; an error where stars are negative or not finite, null where they are missing."""
    bad = F.isnan(stars) | (stars < 0) | (stars == float("inf"))
    return F.when(bad, F.raise_error(F.lit("stars must be finite and not negative")).cast("long")).otherwise(F.floor(stars / F.lit(0.1) + F.lit(1e-6)))


def preempt_ms(ar: Column) -> Column:
    return F.when(ar < 5, 1800.0 - 120.0 * ar).otherwise(1200.0 - 150.0 * (ar - 5.0))


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def speed_pressure(delta: Column) -> Column:
    return clamp(F.sqrt(200.0 / F.greatest(delta, F.lit(50.0))), 0.5, 2.0)


def slider_speed(multiplier: Column, velocity: Column, beat: Column) -> Column:
    return F.greatest(multiplier, F.lit(0.0)) * 100.0 * velocity * 1000.0 / F.greatest(beat, F.lit(1.0))


def lane_of(x: Column, keys: Column) -> Column:
    """In two steps, by 128ths: not the same as one division."""
    fine = F.floor(clamp(x, 0.0, 511.999) / 512.0 * 128.0)
    return F.least(F.floor(fine * keys / 128.0), keys - 1).cast("int")


def popcount(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def band(percentile: Column) -> Column:
    return F.least(F.floor(percentile * 10.0), F.lit(9)).cast("long")


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def weighted_l2(a: list[Column], b: list[Column], w: tuple[float, ...] | None = None) -> Column:
    w = w or (1.0,) * len(a)
    return F.sqrt(total([F.lit(k) * (x - y) * (x - y) for k, x, y in zip(w, a, b, strict=True)]))


def capped_difference(a: Column, b: Column, scale: float) -> Column:
    return F.least(F.abs(a - b) / scale, F.lit(1.0))


def hellinger(a: list[Column], b: list[Column], eps: float = 1e-6) -> Column:
    """Of two vectors of amounts, each smoothed and taken as shares."""
    n = len(a)
    sa, sb = total(a) + eps * n, total(b) + eps * n
    return clamp(F.sqrt(total([F.pow(F.sqrt((x + eps) / sa) - F.sqrt((y + eps) / sb), F.lit(2.0)) for x, y in zip(a, b, strict=True)]) / 2.0), 0.0, 1.0)


def rms_distance(a: list[Column], b: list[Column]) -> Column:
    return clamp(F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]) / float(len(a))), 0.0, 1.0)


def log_ratio(a: Column, b: Column, most: float) -> Column:
    low = lambda x: F.greatest(x, F.lit(0.0)) + 1.0
    return clamp(F.abs(F.ln(low(a) / low(b))) / F.ln(F.lit(float(most))), 0.0, 1.0)


def overall_intensity(axes: list[Column]) -> Column:
    top = F.slice(F.sort_array(F.array(*axes), asc=False), 1, 3)
    mean3 = F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / 3.0
    rms = F.sqrt(total([x * x for x in axes]) / float(len(axes)))
    return clamp(0.50 * F.greatest(*axes, F.lit(0.0)) + 0.30 * rms + 0.20 * mean3, 0.0, 1.0)


def unsigned_id(digest_hex: Column) -> Column:
    """The first eight bytes of a hex digest, little-endian, as an unsigned decimal string; 0 becomes 1."""
    le = F.concat(*[F.substring(digest_hex, 15 - 2 * i, 2) for i in range(8)])
    value = F.conv(le, 16, 10)
    return F.when(value == "0", F.lit("1")).otherwise(value)


def signed_id(unsigned: Column) -> Column:
    """The same 64 bits as a signed long."""
    return F.when(unsigned.cast("decimal(20,0)") >= F.lit(str(2**63)).cast("decimal(20,0)"), (unsigned.cast("decimal(20,0)") - F.lit(str(2**64)).cast("decimal(20,0)")).cast("long")).otherwise(unsigned.cast("long"))


def unsigned_order(id_col: Column) -> list[Column]:
    """Sort keys that order signed longs as unsigned ones."""
    return [id_col < 0, id_col]


def chart_url(unsigned: Column) -> Column:
    return F.concat(F.lit("https://osu.ppy.sh/b/"), unsigned)


def label(code: Column, names: tuple[str, ...]) -> Column:
    """Unknown codes get the first name."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), code.cast("int")), F.lit(names[0]))


def number(text: Column, kind: str = "double") -> Column:
    """A number as the charts write it; null for padding, suffixes and anything else that isn't one."""
    form = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$" if kind == "double" else r"^\+?[0-9]+$"
    return F.when(text.rlike(form), text.try_cast(kind))
