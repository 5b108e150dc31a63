"""Snapshots of an analysed text (graphemes, their lengths, flags with places), and exports of results as JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import arrays

SCHEMA = "doc_id long, grapheme_list array<string>, grapheme_lengths_codepoints array<int>, forensic_flags map<string, struct<count:int, positions:array<string>>>, timestamp string"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots from JSON lines; fields that are missing are null."""
    return spark.read.schema(SCHEMA).json(path)


def flag_places(snapshots: DataFrame) -> DataFrame:
    """doc_id, flag, place of flags that name no mere property (`Prop:`) and count something; places that are no numbers are skipped."""
    rows = snapshots.select("doc_id", F.explode("forensic_flags").alias("flag", "found")).where(~F.startswith("flag", F.lit("Prop:")) & (F.col("found.count") > 0))
    first = F.regexp_extract("p", r"^#*([+-]?\d+)(?: |$)", 1)
    return rows.select("doc_id", "flag", F.explode("found.positions").alias("p")).select("doc_id", "flag", first.try_cast("int").alias("place")).where("place is not null")


#: The critical flags of a snapshot.
CRITICAL = ("Bidi Control (UAX #9)", "Join Control (Structural)")
SEGMENTS = 10


def segment_threats(snapshots: DataFrame) -> DataFrame:
    """doc_id, seg, cp_start, cp_end, threats_all, threats_critical: distinct places of flags inside each segment of graphemes.

    A snapshot without graphemes has no segments. Segments of one snapshot are at most ten, so its places meet ten rows.
    """
    starts = arrays.before(F.transform("grapheme_lengths_codepoints", lambda n: n.cast("long")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    total = F.aggregate("grapheme_lengths_codepoints", F.lit(0).cast("bigint"), lambda a, v: a + v)
    rows = snapshots.where(F.size("grapheme_list") > 0).select("doc_id", F.size("grapheme_list").cast("long").alias("t"), F.concat(starts, F.array(total)).alias("cp"))
    rows = rows.withColumn("n_seg", F.least(F.lit(SEGMENTS).cast("long"), "t")).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_seg") - 1)))
    at = lambda k: F.get("cp", F.floor(k * F.col("t") / F.col("n_seg")).cast("int"))
    rows = rows.select("doc_id", "seg", at(F.col("seg")).alias("cp_start"), at(F.col("seg") + 1).alias("cp_end"))
    places = flag_places(snapshots).groupBy(F.col("doc_id").alias("_doc"), "place").agg(F.max(F.col("flag").isin(*CRITICAL)).alias("critical"))
    joined = rows.join(places, (F.col("doc_id") == F.col("_doc")) & (F.col("place") >= F.col("cp_start")) & (F.col("place") < F.col("cp_end")), "left")
    return joined.groupBy("doc_id", "seg", "cp_start", "cp_end").agg(F.count("place").alias("threats_all"), F.count(F.when(F.col("critical"), 1)).alias("threats_critical"))


def segments_json(rows: DataFrame) -> DataFrame:
    """doc_id, report: the segments of a text in order as one JSON array of their whole-number metrics."""
    fields = ("volume", "content_volume", "run_count", "max_run", "space_runs", "line_breaks", "bidi_atoms", "join_atoms", "other_invisibles", "threats_all", "threats_critical")
    metrics = F.struct(*[F.col(f).cast("long").alias(f) for f in fields])
    one = F.struct(F.col("seg").alias("seg"), F.expr("concat(seg + 1, ' / ', n_seg)").alias("segment_id"), F.col("start").cast("long").alias("start_grapheme_index"), F.col("end").cast("long").alias("end_grapheme_index"), metrics.alias("metrics"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["segment_id"].alias("segment_id"), s["start_grapheme_index"].alias("start_grapheme_index"), s["end_grapheme_index"].alias("end_grapheme_index"), s["metrics"].alias("metrics")))
    return rows.groupBy("doc_id").agg(F.to_json(ordered).alias("report"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str, section: str | None = None) -> None:
    """Lines (doc_id, section, line_no, line) as text files, a document's lines together and in order; one section alone if it is named."""
    kept = lines.where(F.col("section") == section) if section else lines
    whole = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    whole.select("value").write.mode("overwrite").text(path)


def write_confusable_maps(inverse: DataFrame, ascii_risk: DataFrame, path: str) -> None:
    """inverse(cp, others) as an object of lists with code points as keys, and ascii_risk(cp) as an ordered list; both are bounded by Unicode's size."""
    keyed = inverse.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("cp").cast("string"), "others"))))).alias("value"))
    keyed.coalesce(1).write.mode("overwrite").text(f"{path}/inverse_confusables")
    ascii_risk.agg(F.to_json(F.array_sort(F.collect_set("cp"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/ascii_confusables")
