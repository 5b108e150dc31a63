"""Readers of the Unicode data formats: `lo[..hi] ; value ; value # comment`, tab-parted fields, and JSON lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format -> columns after the code points; all files of a format are read by one function.
FORMATS = {
    "blocks": ("block",), "scx": ("scx",), "bidi_brackets": ("paired", "kind"), "bidi_mirroring": ("mirror",), "binary_props": ("property",), "numeric_type": ("nt",),
    "composition_exclusions": (), "norm_corrections": ("bad", "good", "version"), "name_aliases": ("alias", "type"), "unified_ideographs": ("unified",),
    "math_class": ("math_class",), "intentional": ("other",),
    "ages": ("age",), "vertical_orientation": ("vo",), "identifier_status": ("status",), "identifier_type": ("types",), "idna": ("status", "mapping", "extra"),
}


def read_fields(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """f: the trimmed fields of each line that holds data; comments and blank lines go."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("line")).where("line <> ''").select(F.transform(F.split("line", separator), lambda x: F.trim(x)).alias("f"))


def _hex(x) -> F.Column:
    return F.conv(x, 16, 10).cast("int")


def read_range_file(spark: SparkSession, path: str, columns: tuple[str, ...], only: list[str] | None = None) -> DataFrame:
    """lo, hi and columns; rows whose code points can't be read are skipped; `only` keeps values of the first column."""
    rows = read_fields(spark, path).withColumn("r", F.get("f", F.lit(0)))
    rows = rows.where(F.col("r").rlike(r"^[0-9A-Fa-f]{4,6}(\.\.[0-9A-Fa-f]{4,6})?$"))
    ends = F.split("r", r"\.\.")
    out = rows.select(_hex(ends[0]).alias("lo"), _hex(F.element_at(ends, -1)).alias("hi"), *[F.get("f", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])
    return out.where(F.col(columns[0]).isin(only)) if only else out


def read_format(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of FORMATS; code points in columns named paired, mirror, unified and other become numbers."""
    out = read_range_file(spark, path, FORMATS[name])
    for c in set(out.columns) & {"paired", "mirror", "unified", "other"}:
        out = out.withColumn(c, _hex(c))
    return out.withColumn("scx", F.split("scx", r"\s+")) if name == "scx" else out


def read_tabbed(spark: SparkSession, path: str) -> DataFrame:
    """cp, field, value of `U+X<tab>field<tab>value` lines (numeric values of ideographs, sources)."""
    rows = read_fields(spark, path, "\t").where(F.get("f", F.lit(0)).rlike(r"^U\+[0-9A-F]+$") & (F.size("f") >= 3))
    return rows.select(_hex(F.substring(F.get("f", F.lit(0)), 3, 8)).alias("cp"), F.get("f", F.lit(1)).alias("field"), F.get("f", F.lit(2)).alias("value"))


def read_sequences(spark: SparkSession, path: str, name_first: bool = True) -> DataFrame:
    """name and seq (text) of `NAME;cp cp` lines, or the fields after `cp cp;` as an array."""
    rows = read_fields(spark, path)
    points = F.get("f", F.lit(1 if name_first else 0))
    text = F.array_join(F.transform(F.split(points, r"\s+"), lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")), "")
    return rows.select(*([F.get("f", F.lit(0)).alias("name")] if name_first else [F.slice("f", 2, 8).alias("values")]), text.alias("seq"))


def _text_of(points) -> F.Column:
    return F.array_join(F.transform(F.split(F.trim(points), r"\s+"), lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")), "")


def read_confusables(spark: SparkSession, path: str) -> DataFrame:
    """source, target (texts) and type of `cp ; cp cp ; type` lines."""
    rows = read_fields(spark, path).where((F.size("f") >= 3) & F.get("f", F.lit(0)).rlike(r"^[0-9A-Fa-f]{4,6}( [0-9A-Fa-f]{4,6})*$"))
    return rows.select(_text_of(F.get("f", F.lit(0))).alias("source"), _text_of(F.get("f", F.lit(1))).alias("target"), F.get("f", F.lit(2)).alias("type"))


def read_standardized_variants(spark: SparkSession, path: str) -> DataFrame:
    """seq and its description of `cp cp; description; contexts` lines."""
    return read_sequences(spark, path, name_first=False).select("seq", F.get("values", F.lit(0)).alias("description"))


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """cp of a JSON array of numbers."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<int>")).alias("cp"))


def load_all(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """All of the files or none: a missing one raises."""
    return {name: read_format(spark, path, name) for name, path in paths.items()}


def expanded(ranges: DataFrame) -> DataFrame:
    """One row of each code point, so that a range lookup is an equi-join (at most 1,114,112 rows)."""
    return ranges.withColumn("cp", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def lookup(points: DataFrame, ranges: DataFrame, value: str, default: str | None = None) -> DataFrame:
    """points(cp, ...) with the value of the range that holds cp, else default. The expanded side is bounded by Unicode's size."""
    known = expanded(ranges.select("lo", "hi", value)).dropDuplicates(["cp"])
    return points.join(F.broadcast(known), "cp", "left").withColumn(value, F.coalesce(value, F.lit(default)))


def confusable_clusters(lines: DataFrame) -> DataFrame:
    """cluster, cp of summary lines(n, value): `#` headers and blank lines end a cluster; the token after `)` is hex."""
    from pyspark.sql import Window

    clean = F.trim(F.regexp_replace("value", "[\u200e\u200f]", ""))
    rows = lines.select("n", clean.alias("line")).withColumn("end", ((F.col("line") == "") | F.col("line").startswith("#")).cast("int"))
    # A file of clusters is small and ordered by line, so its running count is one window.
    rows = rows.withColumn("cluster", F.sum("end").over(Window.orderBy("n"))).where("end = 0")
    found = F.regexp_extract("line", r"\)\S*\s+([0-9A-F]{4,6})\b", 1)
    return rows.withColumn("hex", found).where("hex <> ''").select("cluster", _hex("hex").alias("cp")).distinct()


def inverse_confusables(clusters: DataFrame) -> DataFrame:
    """cp -> the other members of its last cluster as U+XXXX."""
    last = clusters.groupBy("cp").agg(F.max("cluster").alias("cluster"))
    other = clusters.select("cluster", F.col("cp").alias("o"))
    label = F.concat(F.lit("U+"), F.when(F.col("o") < 65536, F.lpad(F.hex("o"), 4, "0")).otherwise(F.hex("o")))
    return last.join(other, "cluster").where("o <> cp").groupBy("cp").agg(F.array_sort(F.collect_list(label)).alias("others"))


def ascii_risk_set(clusters: DataFrame) -> DataFrame:
    """ASCII members of clusters that hold ASCII and other characters."""
    mixed = clusters.groupBy("cluster").agg(F.min("cp").alias("lo"), F.max("cp").alias("hi")).where("lo < 128 and hi >= 128").select("cluster")
    return clusters.join(mixed, "cluster").where("cp < 128").select("cp").distinct()


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs(a, b)."""
    return pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
