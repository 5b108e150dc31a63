"""A training-data pipeline of five operators. Each stage takes (spark, docs, sf_dir) and gives what the next one reads.

Defined cases, for every stage: null or empty texts aren't toxic, hold no secrets, form one group of near duplicates, and are packed
as the end id alone; rows may repeat (one of equal rows stays) and doc_id may be null or name several texts; a null source is a source;
an empty table gives an empty result; columns that documents has besides its own are kept up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import mixing, packing, secrets, simhash, toxicity
from glyphlake.llm.common import shared_dir, table

#: The pieces' token ids and places in the sequences aren't expressible in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the model is learnt from the labels and documents of sf_dir."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first by doc_id. Groups are linked by five-word shingles at a similarity of 0.8."""
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; rows and files are in the order of the schedule, which holds the target weights by source."""
    return mixing.mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    A file of docs is a run of the mixture's schedule: sequences hold pieces of one file, and their ids follow the numbers of
    the files, so that the sequences too come in the target weights. Documents that come from no such file are one run.
    """
    run = F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1)
    return packing.packed_by_stretch(docs, F.when(run != "", run.cast("long")).otherwise(F.lit(0)))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
