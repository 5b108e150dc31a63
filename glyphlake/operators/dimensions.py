"""Documents against tables that `sources.ucd` reads: counts by range, members of a list, mirror pairs, whole sequences.

Texts become counts of their distinct characters or graphemes first, so that what is joined is small; the tables are equi-joined.
Each operator takes docs(doc_id, text); null and empty texts have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.atoms import codepoints, distinct_counts
from glyphlake.sources import ucd


def _counts(docs: DataFrame) -> DataFrame:
    rows = docs.where("text <> ''").select("doc_id", F.explode(distinct_counts()).alias("x"))
    return rows.select("doc_id", F.col("x.c").alias("ch"), "x.n", F.ascii("x.c").alias("cp"))


def runs_by(docs: DataFrame, ranges: DataFrame, value: str, default: str) -> DataFrame:
    """doc_id, value, runs, longest: runs of neighbours whose ranges have one value (vertical orientation, or any property of a file)."""
    from pyspark.sql import Window

    rows = ucd.lookup(codepoints(docs).withColumn("cp", F.ascii("ch")), ranges, value, default)
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = rows.withColumn("fresh", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).withColumn("run", F.sum("fresh").over(w))
    lengths = rows.groupBy("doc_id", value, "run").agg(F.count("*").alias("n"))
    return lengths.groupBy("doc_id", value).agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def with_fallback(points: DataFrame, table: DataFrame, value: str, runtime) -> DataFrame:
    """points(cp, ...) with the value of table(lo, hi, value) where it has one, else what runtime(ch) says."""
    found = ucd.lookup(points, table, value)
    return found.withColumn(value, F.coalesce(value, runtime(F.decode(F.unhex(F.lpad(F.hex("cp"), 8, "0")), "UTF-32"))))


def restricted(docs: DataFrame, allowed: DataFrame) -> DataFrame:
    """doc_id, ch, n of the characters of a text that ranges allowed(lo, hi, status) don't allow: the default is to restrict."""
    return ucd.lookup(_counts(docs), allowed, "status", "Restricted").where("status <> 'Allowed'").select("doc_id", "ch", "n")


def counts_by(docs: DataFrame, ranges: DataFrame, value: str, default: str) -> DataFrame:
    """doc_id, value, n: characters of a text by the value of the range that holds them (blocks, scripts, numeric types, ...)."""
    return ucd.lookup(_counts(docs), ranges, value, default).groupBy("doc_id", value).agg(F.sum("n").alias("n"))


def members(docs: DataFrame, points: DataFrame) -> DataFrame:
    """doc_id, ch, n of the characters that a list points(cp) holds (composition exclusions, carrier symbols, drifted ideographs)."""
    return _counts(docs).join(points.select("cp").distinct(), "cp", "left_semi").select("doc_id", "ch", "n")


def mirrored(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, ch, mirror, n of characters with a mirror image, from pairs(lo, mirror)."""
    other = pairs.select(F.col("lo").alias("cp"), "mirror").dropDuplicates(["cp"])
    text = F.decode(F.unhex(F.lpad(F.hex("mirror"), 8, "0")), "UTF-32")
    return _counts(docs).join(other, "cp").select("doc_id", "ch", text.alias("mirror"), "n")


def sequences(docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, name, n: graphemes of a text that are a sequence of named(name, seq)."""
    g = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\X)"), F.lit(1))).alias("seq")).groupBy("doc_id", "seq").agg(F.count("*").alias("n"))
    return g.join(named.select("name", "seq").distinct(), "seq").select("doc_id", "name", "n")
