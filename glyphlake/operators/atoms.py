"""Atoms with their places: graphemes, coordinate maps, flag positions, runs by category, and encodings."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions import arrays, chars

#: The legacy encodings whose coverage is reported.
ENCODINGS = ("cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "iso8859_1", "cp866", "shift_jis", "gb18030", "big5", "euc_kr")


def codepoints(docs: DataFrame) -> DataFrame:
    """doc_id, idx, ch of docs(doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1))).alias("idx", "ch"))


def _placed(text: str) -> F.Column:
    """array<struct<x: struct<g, n_cp, units>, cp_start, unit_start>> of a text's clusters; places are summed inside the array."""
    zero, add = F.lit(0).cast("bigint"), lambda a, v: a + v
    sized = F.transform(F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1)), lambda g: F.struct(g.alias("g"), F.length(g).cast("long").alias("n_cp"), (F.length(g) + F.regexp_count(g, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long").alias("units")))

    def placed(x):
        return F.arrays_zip(x.alias("x"), arrays.before(F.transform(x, lambda r: r["n_cp"]), zero, add).alias("cp_start"), arrays.before(F.transform(x, lambda r: r["units"]), zero, add).alias("unit_start"))

    return arrays.bound(sized, placed)


def graphemes(docs: DataFrame) -> DataFrame:
    """doc_id, g_idx, g, n_cp, cp_start, unit_start: clusters with their places in code points and in UTF-16 units; no row is shuffled."""
    rows = docs.select("doc_id", F.posexplode(_placed("text")).alias("g_idx", "r"))
    return rows.select("doc_id", "g_idx", "r.x.g", "r.x.n_cp", "r.cp_start", "r.unit_start")


def grapheme_places(docs: DataFrame) -> DataFrame:
    """doc_id, graphemes, cp_end, unit_end, places: the map of a text's clusters to code points and UTF-16 units, as a digest of `cp:unit` of each."""
    rows = docs.where("text <> ''").select("doc_id", _placed("text").alias("p"))
    last = F.element_at("p", -1)
    places = F.array_join(F.transform("p", lambda r: F.concat_ws(":", r["cp_start"], r["unit_start"])), ",")
    return rows.select("doc_id", F.size("p").cast("long").alias("graphemes"), (last["cp_start"] + last["x"]["n_cp"]).alias("cp_end"), (last["unit_start"] + last["x"]["units"]).alias("unit_end"), F.sha2(places, 256).alias("places"))


def distinct_counts(text: str = "text") -> F.Column:
    """array<struct<c, n>>: the distinct characters of a text and how often each is there (a text has few)."""
    chars = F.array_distinct(F.split(text, ""))
    return F.transform(chars, lambda c: F.struct(c.alias("c"), ((F.length(text) - F.length(F.replace(F.col(text), c, F.lit("")))) / F.length(c)).cast("long").alias("n")))


def codepoint_counts(docs: DataFrame) -> DataFrame:
    """c, n, docs: each character, how often it is there and in how many texts; counted inside each text first."""
    rows = docs.where("text <> ''").select(F.explode(distinct_counts()).alias("x"))
    return rows.groupBy("x.c").agg(F.sum("x.n").alias("n"), F.count("*").alias("docs"))


CODEPOINT_COUNTS = "SELECT c, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM pdocs) GROUP BY c"


def char_entropy(docs: DataFrame) -> DataFrame:
    """doc_id, entropy, min_entropy, renyi2, n over the characters of each text that has any, without a shuffle."""
    rows = docs.where("text <> ''").select("doc_id", F.length("text").cast("long").alias("n"), F.transform(distinct_counts(), lambda x: x["n"].cast("double") / F.length("text")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda s, p: s + f(p))
    return rows.select("doc_id", (-total(lambda p: p * F.log2(p))).alias("entropy"), (-F.log2(F.array_max("p"))).alias("min_entropy"), (-F.log2(total(lambda p: p * p))).alias("renyi2"), "n")


CHAR_ENTROPY = """SELECT doc_id, -sum(p * log2(p)) AS entropy, -log2(max(p)) AS min_entropy, -log2(sum(p * p)) AS renyi2, max(total) AS n FROM (SELECT doc_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id) AS p, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total
 FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM pdocs WHERE text <> '') GROUP BY doc_id, c)) GROUP BY doc_id"""


def grapheme_profile(docs: DataFrame) -> DataFrame:
    """doc_id, graphemes, single, multi, marks, most_marks, average_marks (of a grapheme)."""
    g = F.regexp_extract_all("text", F.lit(r"(\X)"), F.lit(1))
    marks = F.transform(g, lambda x: F.regexp_count(x, F.lit(r"\p{M}")))
    single = F.size(F.filter(g, lambda x: F.length(x) == 1))
    return docs.select(
        "doc_id", F.size(g).cast("long").alias("graphemes"), single.cast("long").alias("single"), (F.size(g) - single).cast("long").alias("multi"),
        F.regexp_count("text", F.lit(r"\p{M}")).cast("long").alias("marks"), F.coalesce(F.array_max(marks), F.lit(0)).cast("long").alias("most_marks"),
        F.when(F.size(g) > 0, F.regexp_count("text", F.lit(r"\p{M}")) / F.size(g)).otherwise(0.0).alias("average_marks"),
    )


def flag_positions(docs: DataFrame) -> DataFrame:
    """doc_id, flag, severity, count, positions (`#i,#j`) of every flag of one code point.

    Texts without a flagged character are left before they are split.
    """
    patterns = {k: (s, p) for k, (s, p) in chars.FLAGS.items() if s != "info"}
    whole = "|".join(p for _, p in patterns.values())
    # Printable ASCII, most of a text, has none of these flags, which a comparison of numbers tells.
    hit = codepoints(docs.where(F.col("text").rlike(r"[^\x{0009}\x{000A}\x{000D}\x{0020}-\x{007E}]"))).where(~F.ascii("ch").between(32, 126) & F.col("ch").rlike(whole))
    found = F.array_compact(F.array(*[F.when(F.col("ch").rlike(p), F.struct(F.lit(k).alias("flag"), F.lit(s).alias("severity"))) for k, (s, p) in patterns.items()]))
    rows = hit.select("doc_id", "idx", F.explode(found).alias("f"))
    places = F.transform(F.array_sort(F.collect_list("idx")), lambda i: F.concat(F.lit("#"), i.cast("string")))
    return rows.groupBy("doc_id", "f.flag", "f.severity").agg(F.count("*").alias("n"), F.array_join(places, ",").alias("positions"))


def flag_totals(docs: DataFrame) -> DataFrame:
    """flag, docs, n over all texts, which are read once for all flags."""
    each = F.array(*[F.struct(F.lit(k).alias("flag"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, (_, p) in chars.FLAGS.items()])
    # No flag names an ASCII letter, digit or space, which most of a text is.
    rest = docs.select(F.regexp_replace("text", "[A-Za-z0-9 ]+", "").alias("text"))
    return rest.select(F.explode(each).alias("f")).where("f.n > 0").groupBy("f.flag").agg(F.count("*").alias("docs"), F.sum("f.n").alias("n"))


def flag_totals_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS flag, len(regexp_extract_all(text, '{p}')) AS n FROM pdocs" for k, (_, p) in chars.FLAGS.items())
    return f"SELECT flag, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS n FROM ({parts}) WHERE n > 0 GROUP BY flag"


def flag_positions_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, i, '{k}' AS flag, '{s}' AS severity FROM c WHERE regexp_matches(ch, '{p}')" for k, (s, p) in chars.FLAGS.items() if s != "info")
    return f"""WITH l AS (SELECT doc_id, string_split(text, '') AS a FROM pdocs), c AS (SELECT doc_id, unnest(a) AS ch, generate_subscripts(a, 1) - 1 AS i FROM l), f AS ({parts})
    SELECT doc_id, flag, severity, CAST(count(*) AS BIGINT) AS n, string_agg('#' || i, ',' ORDER BY i) AS positions FROM f GROUP BY doc_id, flag, severity"""


#: Category letters in the order in which they are tried.
CATEGORIES = "LMNPSZ"


def category_runs(docs: DataFrame) -> DataFrame:
    """doc_id, value, runs, longest: runs of one major category, as matches (no shuffle before the aggregate)."""
    kinds = [*((c, rf"(\p{{{c}}}+)") for c in CATEGORIES), ("C", r"(\p{C}+)")]
    runs = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _labelled(c)) for c, p in kinds])
    return docs.select("doc_id", F.explode(runs).alias("r")).groupBy("doc_id", F.col("r.value").alias("value")).agg(F.count("*").alias("runs"), F.max("r.n").cast("long").alias("longest"))


def _labelled(value: str):
    return lambda r: F.struct(F.lit(value).alias("value"), F.length(r).alias("n"))


def category_runs_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS value, unnest(regexp_extract_all(text, '\\p{{{c}}}+')) AS r FROM pdocs" for c in CATEGORIES + "C")
    return f"SELECT doc_id, value, CAST(count(*) AS BIGINT) AS runs, CAST(max(length(r)) AS BIGINT) AS longest FROM ({parts}) GROUP BY doc_id, value"


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, ch, n and own (the legacy encodings of ch), counted inside each text: one scan, no shuffle."""
    return docs.where("text <> ''").select("doc_id", F.explode(distinct_counts()).alias("x")).select("doc_id", F.col("x.c").alias("ch"), "x.n").withColumn("own", encodings_of("ch"))


def encoding_coverage(docs: DataFrame) -> DataFrame:
    """doc_id, encoding, all_share, signal_share: of all characters and of those beyond ASCII that an encoding holds.

    Encodings are tried once for each distinct character in a worker; their number is bounded by Unicode's size.
    """
    beyond = F.when(F.ascii("ch") > 127, F.col("n")).otherwise(0)
    rows = _counted(docs).select("doc_id", "n", beyond.alias("b"), "own")
    sums = [F.sum(F.when(F.array_contains("own", e), F.col(c)).otherwise(0)).alias(f"{c}_{e}") for e in ENCODINGS for c in ("n", "b")]
    wide = rows.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum("b").alias("u"), *sums)
    each = F.array(*[F.struct(F.lit(e).alias("encoding"), (F.col(f"n_{e}") / F.col("t")).alias("all_share"), F.when(F.col("u") > 0, F.col(f"b_{e}") / F.col("u")).alias("signal_share")) for e in ENCODINGS])
    return wide.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.*")


def encoding_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, pure_ascii, sole (characters that one legacy encoding alone holds, which then explains them), nowhere (those in none)."""
    rows = _counted(docs).withColumn("k", F.size("own"))
    total = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    return rows.groupBy("doc_id").agg(
        (F.max(F.ascii("ch")) < 128).alias("pure_ascii"), total(F.col("k") == 1).alias("sole"), total(F.col("k") <= 0).alias("nowhere"),
        F.array_sort(F.collect_set(F.when(F.col("k") == 1, F.col("own")[0]))).alias("explained_by"),
    )


def valid_bytes(blobs: DataFrame) -> DataFrame:
    """blobs(id, raw binary): whether the bytes are UTF-8, and encoded halves of surrogate pairs in them."""
    return blobs.select("id", F.is_valid_utf8(F.col("raw")).alias("utf8"), F.regexp_count(F.hex("raw"), F.lit("(?=ED[AB][0-9A-F][89AB][0-9A-F])(?:..)")).cast("long").alias("surrogates"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def encodings_of(x: pd.Series) -> pd.Series:
    """The legacy encodings that hold a character."""
    return x.map(_encodings)


@cache
def _encodings(c: str) -> list[str]:
    return [e for e in ENCODINGS if _encodes(c, e)]


def _encodes(c: str, encoding: str) -> bool:
    try:
        c.encode(encoding)
    except UnicodeError:
        return False
    return True
