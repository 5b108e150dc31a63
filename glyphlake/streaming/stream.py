"""Structured Streaming forms: the same transformations over documents and events that arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by type and window; rows later than `late` are dropped by the watermark."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def debounced(events: DataFrame, gap: str = "400 milliseconds", late: str = "1 hour") -> DataFrame:
    """The last event of each user's burst."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("user_id", F.col("w.start").alias("start"), "event_id")


def once_each(signals: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _timed(signals).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def changed(docs: DataFrame, forget: int | None = None) -> DataFrame:
    """docs(doc_id, text) that arrive again and again: a row only when a document's text is new or differs from the last one seen.

    The state of a document is a digest and a count, however long its texts are. It is kept for ever, or until the document
    hasn't come for `forget` milliseconds.
    """
    out = "doc_id long, digest string, version long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        digest, version = state.get if state.exists else (None, 0)
        rows = []
        for f in frames:
            for new in f.digest:
                if new != digest:
                    digest, version = new, version + 1
                    rows.append((key[0], digest, version))
        state.update((digest, version))
        if forget is not None:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame(rows, columns=["doc_id", "digest", "version"])

    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return digests.groupBy("doc_id").applyInPandasWithState(step, out, "digest string, version long", "append", timeout)


TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL"
SLIDING = """SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' for k in [0, 1, 2, 3]]) AS start FROM events) GROUP BY ALL"""
DEBOUNCED = """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '400 milliseconds' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id, min(ts) AS start, max_by(event_id, (ts, event_id)) AS event_id FROM s GROUP BY user_id, burst"""


def run_available(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, mode: str = "append", files: int = 1000) -> DataFrame:
    """Score all documents of a folder that have arrived, in micro-batches of so many files, into files below the checkpoint.

    Each batch writes a folder of its own, which a repeated batch overwrites. In append mode the result is all batches,
    in complete mode the last one.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    rows = transform(source)
    out = f"{checkpoint.rstrip('/')}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    q = rows.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint.rstrip('/')}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(f"{_ddl(rows)}, batch string").option("basePath", out).parquet(f"{out}/batch=*")
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
