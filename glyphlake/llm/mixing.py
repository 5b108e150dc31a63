"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash, form blocks of `block_size` (a document counts its characters and one). With
w the source's share of all weights, block i is released at floor(i / w) and due at ceil((i + 1) / w); each slot takes the
released block with the earliest deadline. Shares are exact fractions and sum to one, so all deadlines hold (unit jobs, whole release
times), and after any number of slots a source that has blocks left got its share of them to less than one block, however
long the schedule is. In characters that is one block and the longest document, as a document lies in the block it starts in.

The schedule of all blocks is made on the driver. Blocks grow with the corpus so that there are never more than `MOST_BLOCKS`
and one for each source.

When a source has no more blocks, its slots stay empty and the others go on: every document has a place. The order
of documents is (slot, place in the block). Sources of weight 0 have no share and follow when all others have ended.

Defined cases: a null source is a source of its own; null or empty texts have no characters and join the block at that
point; repeated rows are rows of their own; an empty table gives an empty result; other columns are kept, whatever their
names; sources that the weights don't name weigh 0, if all weigh 0 they are equal; negative weights count as 0.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ALPHA, BLOCK_SIZE, MOST_BLOCKS = 0.5, 1 << 16, 1 << 18
#: Documents in one group of the two-level running sum.
GROUP_ROWS = 500
#: Size of a file that `mixed_order` writes, one block at least.
FILE_SIZE = 16 << 20

Source = str | None


def shares(weights: dict[Source, float]) -> dict[Source, int]:
    """Whole numbers in the exact proportion of the weights."""
    exact = {s: max(Fraction(0), Fraction(w)) for s, w in weights.items()}
    if not any(exact.values()):
        exact = dict.fromkeys(exact, Fraction(1))
    whole = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * whole) for s, x in exact.items()}


def schedule(weights: dict[Source, float], blocks: dict[Source, int]) -> list[tuple[Source, int, int]]:
    """(source, block, slot) of all blocks by slot: earliest deadline first among released blocks.

    weights and blocks have the same sources. Sources of weight 0 are scheduled with each other, behind the others.
    """
    whole = shares(weights)
    total = sum(whole.values())
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    out: list[tuple[Source, int, int]] = []
    later = [(0, k, 0) for k, s in enumerate(names) if whole[s] and blocks[s]]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    slot = 0
    while later or ready:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            _, k, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[names[k]]), k, i))
        due, k, i = heapq.heappop(ready)
        assert due > slot, "a deadline was missed"
        out.append((names[k], i, slot))
        slot += 1
        if i + 1 < blocks[names[k]]:
            heapq.heappush(later, ((i + 1) * total // whole[names[k]], k, i + 1))
    rest = [s for s in names if not whole[s] and blocks[s]]
    if rest:
        out += [(s, i, slot + at) for s, i, at in schedule(dict.fromkeys(rest, 1), {s: blocks[s] for s in rest})]
    return out


def _size(text: str = "text") -> F.Column:
    return (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long")


def sizes_of(docs: DataFrame) -> dict[Source, tuple[int, int]]:
    """Size and number of documents of each source. Sources are few: one row of each comes to the driver."""
    return {r.source: (r.size, r.n) for r in docs.groupBy("source").agg(F.sum(_size()).alias("size"), F.count("*").alias("n")).collect()}


def _placed(docs: DataFrame, weights: dict[Source, float] | None, block_size: int) -> tuple[DataFrame, int]:
    """docs with _mix_block, _mix_slot, _mix_place and _mix_file (number of the file in mixed order), and the number of files."""
    spark = docs.sparkSession
    natural = sizes_of(docs)
    if not natural:
        return docs.withColumns({f"_mix_{c}": F.lit(0).cast("long") for c in ("block", "slot", "place", "file")}), 1
    weights = {s: (weights.get(s, 0) if weights else n**ALPHA) for s, (n, _) in natural.items()}
    block_size = max(block_size, -(-sum(n for n, _ in natural.values()) // MOST_BLOCKS))
    plan = schedule(weights, {s: -(-n // block_size) for s, (n, _) in natural.items()})
    in_file = max(1, FILE_SIZE // block_size)
    source, block, slot = zip(*plan, strict=True)
    # MOST_BLOCKS rows and one for each source at most; and a row for each source.
    table = spark.createDataFrame(pa.table({"_mix_s": pa.array(source, pa.string()), "_mix_b": pa.array(block, pa.int64()), "_mix_slot": pa.array(slot, pa.int64()), "_mix_file": pa.array([k // in_file for k in range(len(plan))], pa.int64())}))
    groups = spark.createDataFrame([(s, -(-n // GROUP_ROWS)) for s, (_, n) in natural.items()], "_mix_s string, _mix_n long")
    base = docs.withColumns({"_mix_c": _size(), "_mix_h": F.xxhash64("doc_id", "text")})
    base = base.join(F.broadcast(groups), base["source"].eqNullSafe(groups["_mix_s"])).drop("_mix_s")
    base = base.withColumn("_mix_g", F.pmod("_mix_h", "_mix_n")).drop("_mix_n")
    sums = base.groupBy("source", "_mix_g").agg(F.sum("_mix_c").alias("c"))
    before = Window.partitionBy("source").orderBy("_mix_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select(F.col("source").alias("_mix_s"), F.col("_mix_g").alias("_mix_k"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_mix_start")))
    inside = Window.partitionBy("source", "_mix_g").orderBy("_mix_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("_mix_c", F.sum("_mix_c").over(inside) - F.col("_mix_c"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_mix_s"]) & (rows["_mix_g"] == sums["_mix_k"])).drop("_mix_s", "_mix_k")
    start = F.col("_mix_start") + F.col("_mix_c")
    rows = rows.withColumns({"_mix_block": F.floor(start / block_size).cast("long"), "_mix_place": start % block_size})
    rows = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["_mix_s"]) & (rows["_mix_block"] == table["_mix_b"]))
    return rows.drop("_mix_c", "_mix_h", "_mix_g", "_mix_start", "_mix_s", "_mix_b"), -(-len(plan) // in_file)


def mixed(docs: DataFrame, weights: dict[Source, float] | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """doc_id, source, block (of the source), slot and place (in the block) for every row of docs(doc_id, text, source).

    Weights: those given by source, else the sizes of the sources to the power ALPHA.
    """
    rows, _ = _placed(docs.select("doc_id", "text", "source"), weights, block_size)
    return rows.select("doc_id", "source", *(F.col(f"_mix_{c}").alias(c) for c in ("block", "slot", "place")))


def mixed_order(docs: DataFrame, weights: dict[Source, float] | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """All of docs with its own columns, in the order of the schedule: partitions, and so the numbers of written files, follow it."""
    rows, files = _placed(docs, weights, block_size)
    return rows.repartitionById(files, F.col("_mix_file").cast("int")).sortWithinPartitions("_mix_slot", "_mix_place").select(*docs.columns)
