"""Tables, and the perturbed view of documents that gives detectors something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ALEF, _ZWSP, _RLO, _PDF, _NBSP, _TAGS, _ACUTES = "\u0430", "\u200b", "\u202e", "\u202c", "\u00a0", "\U000e0068\U000e0069", "x" + "\u0301" * 5
#: Every document stays; each of seven kinds gets one change (the last none). The same text in Spark and in the oracle.
PERTURBED = f"""CASE doc_id % 7 WHEN 0 THEN replace(text, 'a', '{_ALEF}') WHEN 1 THEN replace(text, 'th', 'th{_ZWSP}') WHEN 2 THEN concat('{_RLO}', text, '{_PDF}')
 WHEN 3 THEN replace(text, ' ', '{_NBSP}') WHEN 4 THEN concat(text, '{_TAGS}') WHEN 5 THEN concat(text, '{_ACUTES}') ELSE text END"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the changed text; a table of fewer partitions than cores is spread, as the work on a text outweighs its shuffle."""
    docs, cores = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    return docs.selectExpr("doc_id", "lang", "source", f"{PERTURBED} AS text")
