"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; whole texts go through Python, so batches stay small.
BATCH_ROWS = 1000

_own_dir: str | None = None


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode if unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="glyphlake-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return _own_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove what `materialize` wrote, when nothing reads it any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are built and run inside go as soon as a query has ended, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text is divisible by 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def map_rows(df: DataFrame, schema: str, function: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow with Python lists: function takes the columns of a batch and gives those of schema."""
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kinds)


def map_groups(df: DataFrame, keys: list[str], order: list[str], schema, function: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Rows with equal keys, which are the first columns, meet in one task, in order; function gets tables of whole groups, many at a time.

    Only for groups of bounded size: the caller splits larger ones before.
    """
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(i)[batch.num_rows - 1] for i in range(width)]
            n = batch.num_rows
            while n and all(batch.column(i)[n - 1] == last[i] for i in range(width)):
                n -= 1
            if held and n == 0 and all(held[-1].column(i)[held[-1].num_rows - 1] == last[i] for i in range(width)):
                held.append(batch)
                continue
            if n:
                held.append(batch.slice(0, n))
            if held:
                yield from function(pa.Table.from_batches(held)).to_batches()
            held = [batch.slice(n)]
        if held:
            yield from function(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps over DataFrames (Kiveris et al. 2014). Nothing is collected; minima are
    aggregated before they are shuffled, and written, so that a hub's rows can be split in the join. What a round wrote goes when the
    next one is written.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        seen = sign
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        second = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(second, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(second.select("u", F.col("m").alias("v"))).distinct())
        discard(e, first, large, second)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
