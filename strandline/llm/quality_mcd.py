"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Each document has counts (words, their characters, symbols, repeated lines, repeated five-word windows).  Base rules reject short and
repetitive texts.  The others' counts become a vector of logarithms of rates, drawn towards a constant where a text is
short.  Per language and source, the ``SHARE`` of documents is sought whose covariance has the least determinant.  The search has
four deterministic starts: medians and quartiles alone, with the correlations of spatial signs, with those of hyperbolic tangents, and
the moments of all documents.  A concentration step takes the documents nearest by Mahalanobis distance and
estimates anew; after ``TRIAL`` steps the ``LEFT`` starts of least determinant go on until no determinant falls any more, and
the least one wins.  A last step reweights.  A document is rejected beyond the distance that a normal vector exceeds with
probability ``REJECT``.

A concentration step is one aggregate: documents are counted and their moments summed by bins of distance, before the shuffle; the bins of a
group, at most ``BINS``, then give the subset and its moments at once.  The bin at the subset's edge counts in part, all
its documents alike, so that a subset has exactly its share.  Vectors are whole thousandths, so that all sums
are exact integers and reruns agree.  Most texts have no symbols and no repeats, where a plain covariance is singular: estimates
are regularised by a diagonal of least variances, which counts in the determinant too.  Groups with fewer than ``LEAST`` documents
use their language's estimate, or else all documents'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .common import BROADCAST_ROWS, cut, fresh_path, table
from .flat_hash import Rolling, mixed

DIMS = 4
SHARE, LEAST, BINS = 0.75, 100, 320
#: Starts of the search; steps that all make; starts that go on; steps at most, and the fall of a determinant below which they end.
STARTS, TRIAL, LEFT, STEPS, FALL = 4, 2, 2, 20, 1e-6
#: Least standard deviation of each coordinate, in thousandths.
FLOOR = (60, 500, 500, 500)
REJECT = 2e-6
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeats(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash occurs more than once in its text."""
    key = mixed(h ^ mixed(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order] = same | np.append(same[1:], False)[: len(k)]
    return out


def distinct(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    key = mixed(h ^ mixed(text.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(text[first], minlength=n)


def text_stats(data: np.ndarray, at: np.ndarray, window: int = 5) -> np.ndarray:
    """A row of STATS of each text."""
    n, texts = len(data), len(at) - 1
    if not n:
        return np.zeros((texts, 5), np.int64)
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first = first[:n]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    roll = Rolling(data)
    start = np.flatnonzero(inside & (first | ~np.append(False, inside[:-1])))
    end = np.flatnonzero(inside & (np.append(first[1:], True) | ~np.append(inside[1:], False))) + 1
    text = np.searchsorted(at, start, "right") - 1
    words = np.bincount(text, minlength=texts)
    w = roll.of(start, end)
    covered = np.zeros(texts, np.int64)
    k = len(w) - window + 1
    if k > 0:
        h = np.zeros(k, np.uint64)
        for j in range(window):
            h = mixed(h) + w[j : j + k]
        whole = text[:k] == text[window - 1 :]
        again = np.zeros(k, bool)
        again[whole] = repeats(text[:k][whole], h[whole])
        depth = np.zeros(len(w) + 1, np.int64)
        depth[:k] += again
        depth[window : window + k] -= again
        covered = np.bincount(text[np.cumsum(depth[:-1]) > 0], minlength=texts)

    line_start = np.flatnonzero(first | np.append(False, data[:-1] == 10))
    line_end = np.append(line_start[1:], n)
    some = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=some[1:])
    worded = some[line_end] > some[line_start]
    line_start, line_end = line_start[worded], line_end[worded]
    line_end = line_end - (data[line_end - 1] == 10)
    owner = np.searchsorted(at, line_start, "right") - 1
    dup = np.bincount(owner, minlength=texts) - distinct(owner, roll.of(line_start, line_end), texts)
    symbols = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    return np.stack([words, per_text(inside & ((data & 0xC0) != 0x80)), per_text(symbols), dup, covered], 1)


def vectors(stats: np.ndarray) -> np.ndarray:
    """Rates in thousandths of logarithms; a short text's are drawn towards a constant."""
    words, chars, symbols, dup, covered = stats.astype(float).T
    rate = lambda x: np.log1p(100 * x / (words + 50))
    return np.rint(1000 * np.stack([np.log((chars + 250) / (words + 50)), rate(symbols), rate(dup), rate(covered)], 1)).astype(np.int64)


def document_stats(docs: DataFrame) -> DataFrame:
    """A written table with a row per document: doc_id, lang, source, STATS, base_failed and the vector v0 to v3."""
    path = fresh_path(docs.sparkSession, "stats")
    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in flat.blocks(batch, "text"):
                s = text_stats(data, at)
                failed = (s[:, 0] < 10) | (100 * s[:, 4] > 20 * s[:, 0])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "source")), *map(pa.array, s.T), pa.array(failed), *map(pa.array, vectors(s).T)], ["doc_id", "lang", "source", *STATS, "base_failed", *(f"v{i}" for i in range(DIMS))])

    schema = ", ".join([*(f"{c} {k}" for c, k in zip(("doc_id", "lang", "source"), kinds, strict=True)), *(f"{c} long" for c in STATS), "base_failed boolean", *(f"v{i} long" for i in range(DIMS))])
    docs.select("doc_id", "lang", "source", "text").mapInArrow(flat.tidy(run), schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def chi_square(x: float, dims: int) -> float:
    """Its distribution function for an even number of dimensions."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def chi_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return lo


def consistency(p: float, dims: int) -> float:
    """What makes the covariance of the nearest share ``p`` of normal rows that of all of them."""
    return p / chi_square(chi_quantile(p, dims), dims + 2)


PARAMS = "gid string, start int, docs long, det double, fell boolean, " + ", ".join([*(f"m{i} double" for i in range(DIMS)), *(f"p{i}{j} double" for i, j in PAIRS)])


def _rows(rows: list[tuple]) -> pd.DataFrame:
    """PARAMS from (gid, start, docs, determinant before, mean, covariance)."""
    out, low = [], np.diag(np.array(FLOOR, float) ** 2)
    for gid, start, docs, before, mean, cov in rows:
        whole = cov + low
        inverse, det = np.linalg.inv(whole), float(np.linalg.det(whole))
        out.append([gid, start, docs, det, bool(det < before * (1 - FALL)), *mean, *(inverse[i, j] for i, j in PAIRS)])
    return pd.DataFrame(out, columns=[x.split()[0] for x in PARAMS.split(", ")])


def _distance():
    """Squared Mahalanobis distance of v from m under p."""
    d = [F.col(f"v{i}") - F.col(f"m{i}") for i in range(DIMS)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + d[i] * d[j] * F.col(f"p{i}{j}") * F.lit(1.0 if i == j else 2.0)
    return F.greatest(out, F.lit(0.0))


def _square(values: list[float]) -> np.ndarray:
    out = np.empty((DIMS, DIMS))
    for (i, j), x in zip(PAIRS, values, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _correlation(cov: np.ndarray) -> np.ndarray:
    """Coordinates that don't vary correlate with none."""
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    return np.where(np.eye(DIMS, dtype=bool), 1.0, cov / np.where(scale > 0, scale, np.inf)[:, None] / np.where(scale > 0, scale, np.inf)[None, :])


def _moments(prefix: str, x: list) -> list:
    """Sums of values and of products, rounded to whole numbers."""
    exact = lambda c: F.sum(F.round(c).cast("long"))
    return [*(exact(x[i]).alias(f"{prefix}s{i}") for i in range(DIMS)), *(exact(x[i] * x[j]).alias(f"{prefix}x{i}{j}") for i, j in PAIRS)]


def _covariance(f, prefix: str, n: int, unit: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([int(f[f"{prefix}s{i}"]) / n for i in range(DIMS)])
    return mean, _square([int(f[f"{prefix}x{i}{j}"]) / n - mean[i] * mean[j] for i, j in PAIRS]) / unit**2


def starts(levels: DataFrame, spread) -> DataFrame:
    """PARAMS of each group and start."""
    q = levels.groupBy("gid").agg(F.count(F.lit(1)).alias("docs"), *(F.percentile(f"v{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(DIMS)))
    q = cut(q.select("gid", "docs", *(F.col(f"q{i}")[1].alias(f"c{i}") for i in range(DIMS)), *(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(1.0)).alias(f"w{i}") for i in range(DIMS))))
    z = [(F.col(f"v{i}") - F.col(f"c{i}")) / F.greatest(F.col(f"w{i}"), F.lit(float(FLOOR[i]))) for i in range(DIMS)]
    size = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    unit = 1000.0
    signs = [F.when(size > 0, unit * x / size).otherwise(0.0) for x in z]
    plain = [F.col(f"v{i}") for i in range(DIMS)]
    seen = levels.join(spread(q), "gid").groupBy("gid", "docs", *(f"c{i}" for i in range(DIMS)), *(f"w{i}" for i in range(DIMS)))
    sums = seen.agg(*_moments("a", signs), *_moments("b", [unit * F.tanh(x) for x in z]), *_moments("p", plain))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                n, centre, scale = int(r["docs"]), np.array([r[f"c{i}"] for i in range(DIMS)]), np.array([r[f"w{i}"] for i in range(DIMS)])
                wide = np.outer(scale, scale)
                guesses = [np.diag(scale**2), *(wide * _correlation(_covariance(r, k, n, unit)[1]) for k in "ab")]
                guesses = [(centre, c) for c in guesses] + [_covariance(r, "p", n)]
                out += [(r["gid"], k, n, math.inf, m, c) for k, (m, c) in enumerate(guesses)]
            if out:
                yield _rows(out)

    return cut(sums.mapInPandas(run, PARAMS))


def _concentrate(last: bool):
    """The next estimate from a group's bins: of the nearest SHARE of its documents, or at last of all that aren't far."""
    edge = _bin_of(chi_quantile(0.975, DIMS))

    def step(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bin")
        n = f["n"].to_numpy()
        docs = int(n.sum())
        before = np.cumsum(n) - n
        part = (f["bin"].to_numpy() < edge).astype(float) if last else np.clip((SHARE * docs - before) / n, 0, 1)
        part[0] = max(part[0], 1.0 if last else 0.0)
        c = float((part * n).sum())
        total = lambda k: float((part * f[k].to_numpy(dtype=float)).sum())
        # About the group's centre, so that no digits are lost.
        mean = np.array([total(f"s{i}") / c for i in range(DIMS)])
        cov = _square([total(f"x{i}{j}") / c - mean[i] * mean[j] for i, j in PAIRS])
        first = f.iloc[0]
        base = np.array([first[f"b{i}"] for i in range(DIMS)], float)
        return _rows([(first["gid"], int(first["start"]), docs, float(first["det"]), mean + base, cov * consistency(0.975 if last else SHARE, DIMS))])

    return step


def _step(levels: DataFrame, params: DataFrame, spread, last: bool = False) -> DataFrame:
    """A concentration step of each group and start in ``params``; moments are taken about the estimate's centre, rounded to whole numbers."""
    at = params.select("*", *(F.round(f"m{i}").cast("long").alias(f"b{i}") for i in range(DIMS)))
    seen = levels.join(spread(at), "gid").withColumn("bin", _bin(_distance()))
    u = [F.col(f"v{i}") - F.col(f"b{i}") for i in range(DIMS)]
    moments = seen.groupBy("gid", "start", "det", *(f"b{i}" for i in range(DIMS)), "bin").agg(F.count(F.lit(1)).alias("n"), *(F.sum(u[i]).alias(f"s{i}") for i in range(DIMS)), *(F.sum(u[i] * u[j]).alias(f"x{i}{j}") for i, j in PAIRS))
    return cut(moments.groupBy("gid", "start").applyInPandas(_concentrate(last), PARAMS))


def _sides(levels: DataFrame):
    """How the estimates of each group and start are joined: by a broadcast where they are few."""
    few = levels.select("gid").distinct().count() * STARTS <= BROADCAST_ROWS
    return F.broadcast if few else (lambda x: x)


def estimate(levels: DataFrame) -> DataFrame:
    """PARAMS of each group: of the documents that aren't far by its least determinant.  ``levels``: gid and the vector; read once per step."""
    spread = _sides(levels)
    return _step(levels, least_determinant(levels, spread), spread, last=True)


def least_determinant(levels: DataFrame, spread=None) -> DataFrame:
    """PARAMS of the best start of each group."""
    spread = spread or _sides(levels)
    going = starts(levels, spread)
    # A start's own determinant is of another estimator: the first steps fall by definition.
    going = going.withColumn("det", F.lit(math.inf))
    for _ in range(TRIAL):
        going = _step(levels, going, spread)
    order = F.row_number().over(Window.partitionBy("gid").orderBy("det", "start"))
    going = cut(going.withColumn("k", order).where(F.col("k") <= LEFT).drop("k"))
    settled = None
    for _ in range(STEPS - TRIAL):
        stepped = _step(levels, going, spread)
        # Where the determinant no longer falls, the estimate before stands.
        ended = going.join(stepped.where("not fell").select("gid", "start"), ["gid", "start"], "left_semi")
        settled = ended if settled is None else settled.unionByName(ended)
        going = stepped.where("fell")
        if going.isEmpty():
            break
    settled = settled.unionByName(going)
    return cut(settled.withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy("det", "start"))).where("k = 1").drop("k"))


def _bin(d):
    """Bins grow by about five per cent: 0 below a hundredth."""
    return F.least(F.greatest(F.floor(F.log(F.greatest(d, F.lit(1e-9)) * 100) * 20), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _bin_of(d: float) -> int:
    return min(max(math.floor(math.log(d * 100) * 20), 0), BINS - 1)


def judge(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, lang, source, STATS, base_failed, distance (squared, null if base_failed) and kept of each row of ``docs``.

    Null and empty texts have no words and fail; null languages and sources are groups of their own.  Rows that repeat
    count as often as they stand there and get the same verdict.  Where no document passes the base rules none is kept.  Other columns aren't read.  An empty
    table gives an empty result.
    """
    rows = document_stats(docs)
    by_source = F.to_json(F.struct(F.lit("source").alias("by"), "lang", "source"))
    by_lang = F.to_json(F.struct(F.lit("lang").alias("by"), "lang"))
    passed = rows.where("not base_failed").select(F.explode(F.array(by_source, by_lang, F.lit("all"))).alias("gid"), *(f"v{i}" for i in range(DIMS)))
    params = estimate(passed)
    enough = F.broadcast if params.count() <= BROADCAST_ROWS else (lambda x: x)
    named = rows.withColumns({"g0": by_source, "g1": by_lang})
    size = params.select(F.col("gid").alias("sg"), "docs")
    named = named.join(enough(size.withColumnsRenamed({"sg": "g0", "docs": "d0"})), "g0", "left").join(enough(size.withColumnsRenamed({"sg": "g1", "docs": "d1"})), "g1", "left")
    named = named.withColumn("gid", F.when(F.col("d0") >= LEAST, F.col("g0")).when(F.col("d1") >= LEAST, F.col("g1")).otherwise("all"))
    out = named.join(enough(params), "gid", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select("doc_id", "lang", "source", *STATS, "base_failed", "distance", F.coalesce(~F.col("base_failed") & (F.col("distance") <= chi_quantile(1 - reject, DIMS)), F.lit(False)).alias("kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The counts and base rules alone, which SQL can follow."""
    return document_stats(table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS again FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(again, 0) > 20 * len(w) AS base_failed FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""
