"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal what they find.

*Base.*  Addresses, IPs, card and phone numbers are found by pattern and checked.  Matches and the stretches between them come
from one split of each text; positions are running sums of lengths in code points.

*Method.*  Each distinct value is a protected entity.  Over the whole corpus, ``n_e`` documents hold the entity, ``n_t`` a term, and
``n_et`` both, wherever they stand.  A term tells PMI = log(N n_et / (n_e n_t)) of the entity's information IC = log(N / n_e); where that is
at least ``ALPHA`` of it, and so many shared documents would come about by chance with a probability of at most ``LEVEL``, the term
discloses the entity and is marked everywhere in the documents that hold it.  No number of documents is asked for: an entity of one
document is judged like any other, and copies count as the documents they are.  Entities that stand in exactly the same documents
are judged as one group (named by two 64-bit hashes), so that a list of thousands in one document costs what one does.

Only DataFrame functions are used.  Patterns start at the beginning of a run or the end of a match and don't go back,
so that no text takes more than linear time; they match what the plain patterns match.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, small_side, table

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the four kinds; that of cards with the least number of digits that counts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must contain.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A term: any word, of letters, marks and digits, outside the mentions.
TERM = r"[\p{L}\p{M}\p{N}]++"
ALPHA, LEVEL = 0.9, 0.05


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its own digits added."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(digits, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2).alias("odd")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x["odd"] == 0, x["d"]).when(x["d"] < 5, x["d"] * 2).otherwise(x["d"] * 2 - 9))
    return total % 10 == 0


def _holds(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(hit, r"\."), lambda p: p.rlike(f"^{OCTET}$")))
        .when(kind == "card", F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False))
        .otherwise((n >= 9) & (n <= 15))
    )


def _of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda s: s["ord"] == k)


def _after(parts: Column):
    """Of a match: itself and the length of what stands between it and the match before."""
    return lambda h, i: F.struct(h.alias("hit"), F.length(F.get(parts, i)).alias("gap"))


def _blank(kind: str):
    return lambda h: F.when(_holds(F.lit(kind), h), F.repeat(F.lit(" "), F.length(h))).otherwise(h)


def _plain(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a column "plain": the text with spaces for each match that holds, so that words keep their places; and one "may": whether there can be any match.

    Every match has a digit or an "@": texts without either are looked at once.  Kinds are taken in order of which holds which; what a
    number leaves before an address that it runs into counts as words.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.withColumns({"plain": text, "may": F.contains(text, F.lit("@")) | text.rlike("[0-9]")})
    for kind in ("email", "phone", "ip", "card"):
        text, pattern = F.col("plain"), PATTERNS[kind]
        hits = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _blank(kind)), F.array(F.lit("")))
        blank = F.array_join(F.zip_with(F.split(text, pattern, -1), hits, lambda a, b: F.concat(a, b)), "")
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike(pattern)
        out = out.withColumn("plain", F.when(F.col("may") & may, blank).otherwise(text))
    return out


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table with a row per document: row, id, and of each kind the matches with the lengths before them; the plain text where there are any."""
    docs = _plain(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text")
    text = F.coalesce("text", F.lit(""))
    cols = [F.monotonically_increasing_id().alias("row"), F.col("id")]
    for kind, pattern in PATTERNS.items():
        parts = F.split(text, pattern, -1)
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        each = F.transform(hits, _after(parts))
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike(pattern)
        cols.append(F.when(F.col("may") & may, each).alias(kind))
    path = fresh_path(docs.sparkSession, "pii")
    some = reduce(lambda x, y: x | y, [F.coalesce(F.size(k) > 0, F.lit(False)) for k in PATTERNS])
    docs.select(*cols, F.col("plain").alias("text")).withColumn("text", F.when(some, F.col("text"))).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _mentions(scan: DataFrame) -> DataFrame:
    """row, kind, start, end, hit of each match that holds; all matches are passed over, failing ones too."""
    every = None
    for kind in PATTERNS:
        one = scan.where(F.size(kind) > 0).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("at", "m")).select("row", "kind", "at", "m.*")
        every = one if every is None else every.unionByName(one)
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit")
    out = every.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    return out.where(_holds(F.col("kind"), F.col("hit"))).select("row", "kind", "start", "end", "hit")


def _entity() -> Column:
    """Of a mention: numbers without their separators, addresses in lower case."""
    return F.concat("kind", F.lit(":"), F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("hit", "[^0-9]", "")).otherwise(F.lower("hit")))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _holders(scan: DataFrame, mentions: DataFrame) -> DataFrame:
    """row, text and groups (g1, g2, n_e) of each document that holds an entity: entities of the same documents are one group."""
    held = cut(mentions.select("row", _entity().alias("entity")).distinct())
    each = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("g1"), F.bit_xor(F.xxhash64(F.lit(2), "row")).alias("g2"))
    groups = held.join(small_side(cut(each)), "entity").groupBy("row").agg(F.collect_set(F.struct("g1", "g2", "n_e")).alias("groups"))
    return cut(scan.where("text is not null").select("row", "text").join(groups, "row"))


def _together(holders: DataFrame) -> DataFrame:
    """row, g1, g2, n_e, term: each group of a document with each of its terms, once."""
    return holders.select("row", "groups", F.explode(_words(F.col("text"))).alias("term")).select("row", "term", F.explode("groups").alias("g")).select("row", "g.*", "term")


def _surprise(k: Column, n: Column, p: Column) -> Column:
    """-log of Hoeffding's bound on the chance of k or more hits (k > n p) in n draws without replacement, of which a share p hits."""
    miss = F.when((k < n) & (p < 1), (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    return k * F.log(k / (n * p)) + miss


def disclosing(holders: DataFrame, docs: DataFrame, text_col: str, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """g1, g2, term: the pairs in which the term discloses the entities of the group."""
    pairs = cut(_together(holders).groupBy("g1", "g2", "n_e", "term").agg(F.count(F.lit(1)).alias("n_et")))
    wanted = cut(pairs.select("term").distinct())
    # Terms are counted before the join: its rows follow the terms, however many documents hold them.
    used = _plain(docs.select(docs[text_col].alias("text")), "text").select(F.explode(_words(F.col("plain"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    terms = used.join(small_side(wanted), "term")
    total = F.lit(float(max(1, docs.count())))
    told = pairs.join(terms, "term")
    pmi, ic = F.log(total * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log(total / F.col("n_e"))
    # The bound holds with either as the draws.
    chance = F.greatest(_surprise(F.col("n_et"), F.col("n_t"), F.col("n_e") / total), _surprise(F.col("n_et"), F.col("n_e"), F.col("n_t") / total))
    return told.where((ic > 0) & (pmi >= alpha * ic) & (chance >= -math.log(level))).select("g1", "g2", "term")


def _term_spans(holders: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, start, end of the terms that disclose an entity of their document, wherever they stand in it."""
    marked = cut(_together(holders).join(small_side(pairs), ["g1", "g2", "term"]).select("row", "term").distinct())
    text = F.col("text")
    # Both arrays are made once: inside a function of the elements the text would be split for each word.
    placed = F.zip_with(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1), lambda h, p: F.struct(h.alias("hit"), F.length(p).alias("gap")))
    each = holders.join(marked.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(placed).alias("at", "w")).select("row", "at", "w.*").where("hit is not null")
    order = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit")
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).select("row", F.lower("hit").alias("term"), (F.col("end") - size).alias("start"), "end")
    return each.join(marked, ["row", "term"]).select("row", "start", "end")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """``id_col`` and spans: an array of (start, ord, end) in code points, in order, of each row; ``KINDS[ord]`` is the kind.

    Null and empty texts have none.  Rows repeat as they do in ``docs``, whose other columns aren't read.  An empty table gives an empty
    result.  Spans of different kinds may overlap.
    """
    scan = _scan(docs, id_col, text_col)
    mentions = cut(_mentions(scan))
    holders = _holders(scan, mentions)
    terms = _term_spans(holders, cut(disclosing(holders, docs, text_col, alpha, level)))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    base = mentions.select("row", "start", order[F.col("kind")].alias("ord"), "end")
    spans = base.unionByName(terms.select("row", "start", F.lit(4).alias("ord"), "end"))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end"))).alias("spans"))
    out = scan.select("row", "id").join(listed, "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span's kind in brackets in its place; of overlapping spans the first stands for all."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"].cast("long") >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.get(names, s["ord"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"].cast("long")).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < 4)
    count = [F.size(_of_kind("spans", i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return out.select("doc_id", *count, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same for DuckDB, whose patterns need no care for linear time; entities are judged one by one."""
    plain = {"email": PATTERNS["email"].split(r"(?:\G|(?<![A-Za-z0-9._%+-]))")[1].replace("++", "+"), "phone": PATTERNS["phone"], "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+"}
    digits = "regexp_replace({h}, '[^0-9]', '', 'g')"
    digit = "coalesce(try_cast(substr({d}, length({d}) - j + 1, 1) AS INT), 0)"
    luhn = f"list_sum(list_transform(range(1, length({{d}}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {digit} WHEN {digit} < 5 THEN 2 * {digit} ELSE 2 * {digit} - 9 END)) % 10 = 0"

    def holds(kind: str, h: str) -> str:
        d = digits.format(h=h)
        return {
            "email": "true",
            "ip": f"len(list_filter(string_split({h}, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
            "card": f"CASE WHEN length({d}) BETWEEN 12 AND 19 THEN {luhn.format(d=d)} ELSE false END",
            "phone": f"length({d}) BETWEEN 9 AND 15",
        }[kind]

    steps, last = ["s0 AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(text, '') AS plain FROM documents)"], "s0"
    for kind in ("email", "phone", "ip", "card"):
        steps.append(f"g_{kind} AS (SELECT doc_id, text, regexp_extract_all(plain, '{plain[kind]}') AS h, string_split_regex(plain, '{plain[kind]}') AS g FROM {last})")
        piece = f"g[i] || CASE WHEN i > len(h) THEN '' WHEN {holds(kind, 'h[i]')} THEN repeat(' ', length(h[i])) ELSE h[i] END"
        steps.append(f"s_{kind} AS (SELECT doc_id, text, list_aggregate(list_transform(range(1, len(g) + 1), lambda i: {piece}), 'string_agg', '') AS plain FROM g_{kind})")
        last = f"s_{kind}"
    for k, (kind, pattern) in enumerate((k, plain[k]) for k in KINDS[:4]):
        steps.append(f"x_{kind} AS (SELECT doc_id, unnest(h) AS h, unnest(g[1:len(h)]) AS g, unnest(range(0, len(h))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM s0))")
        steps.append(f"m_{kind} AS (SELECT * FROM (SELECT doc_id, '{kind}' AS kind, {k} AS ord, h, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM x_{kind}) WHERE {holds(kind, 'h')})")
    entity = f"kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {digits.format(h='h')} ELSE lower(h) END"
    word = r"[\p{L}\p{M}\p{N}]+"
    surprise = "{k} * ln({k} / ({n} * {p})) + CASE WHEN {k} < {n} AND {p} < 1 THEN ({n} - {k}) * ln(({n} - {k}) / ({n} * (1 - {p}))) ELSE 0 END"
    one, two = surprise.format(k="n_et", n="n_t", p="(n_e / n)"), surprise.format(k="n_et", n="n_e", p="(n_t / n)")
    steps += [
        "m AS (" + " UNION ALL ".join(f"SELECT * FROM m_{k}" for k in KINDS[:4]) + ")",
        f"e AS (SELECT DISTINCT doc_id, {entity} AS entity FROM m)",
        "ne AS (SELECT entity, count(*)::DOUBLE AS n_e FROM e GROUP BY 1)",
        f"t AS (SELECT DISTINCT doc_id, lower(w) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(plain, '{word}')) AS w FROM {last}))",
        "nt AS (SELECT term, count(*)::DOUBLE AS n_t FROM t GROUP BY 1)",
        "n AS (SELECT count(*)::DOUBLE AS n FROM documents)",
        "p AS (SELECT entity, term, count(*)::DOUBLE AS n_et FROM e JOIN t USING (doc_id) GROUP BY 1, 2)",
        f"told AS (SELECT entity, term FROM p JOIN ne USING (entity) JOIN nt USING (term), n WHERE ln(n / n_e) > 0 AND ln(n * n_et / (n_e * n_t)) >= {ALPHA}::DOUBLE * ln(n / n_e) AND greatest({one}, {two}) >= -ln({LEVEL}::DOUBLE))",
        "marked AS (SELECT DISTINCT doc_id, term FROM e JOIN told USING (entity) JOIN t USING (doc_id, term))",
        f"w AS (SELECT doc_id, unnest(h) AS h, unnest(g[1:len(h)]) AS g, unnest(range(0, len(h))) AS i FROM (SELECT doc_id, regexp_extract_all(plain, '{word}') AS h, string_split_regex(plain, '{word}') AS g FROM {last} WHERE doc_id IN (SELECT doc_id FROM marked)))",
        "wt AS (SELECT doc_id, h, lower(h) AS term, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM w)",
        "every AS (SELECT doc_id, kind, ord, stop - length(h) AS start, stop FROM m UNION ALL SELECT doc_id, 'term', 4, stop - length(h), stop FROM wt JOIN marked USING (doc_id, term))",
        "listed AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (ord = {i}) AS n_{k}" for i, k in enumerate(KINDS[:4])) + ", string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord, stop) FILTER (ord < 4) AS base, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord, stop) AS spans FROM every GROUP BY 1)",
    ]
    out = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS[:4])
    return "WITH " + ",\n".join(steps) + f"\nSELECT d.doc_id, {out}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN listed USING (doc_id)"


SQL = _sql()
