"""Best-fit packing of token pieces into sequences, by large-item matching.

Pieces above a third of the capacity go at most two to a sequence: greedily, the longest with the longest that still fits.
Smaller pieces then go, longest first, to the fullest sequence that still has room.

Lengths are integers up to the capacity, so the plan is made on the histogram of lengths (at most `capacity` counts,
whatever the size of the corpus) and holds runs of equal sequences. Pieces find their place by their rank among those
of their length: each task counts its own as it reads, and the tasks' counts are summed up by length, so that no task sees all
pieces of a frequent length.

Defined cases: a null text counts as empty, which is one piece that holds the end id alone; repeated rows are pieces
of their own; an empty table gives an empty result; columns other than doc_id and text are not read; a null
doc_id stays null.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_groups, materialize, prepare

CAPACITY, END_ID = 2048, 0


class Encoder:
    """Ids of byte_bpe_50k.json as little-endian uint32 bytes.

    The byte-level vocabulary also comes as ranks with its pattern, which tiktoken encodes five times as fast as the JSON
    file's own library, to the same ids (tests hold both against each other).
    """

    def __init__(self, name: str = "byte_bpe_50k.tiktoken") -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@cache
def encoder() -> Encoder:
    return Encoder()


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, the columns in keep, and part and nth.

    Longer documents are cut; the first piece may be shorter. part is the task that read the document, nth counts the pieces
    of that length which the task has met before.
    """
    prepare(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()
    keep = keep or []
    rows = docs.select("doc_id", "text", *keep)
    kinds = docs.sparkSession.createDataFrame([], PIECE).schema
    kinds = T.StructType([*kinds.fields, *(rows.schema[k] for k in keep), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            texts, at, out = batch.column(1).to_pylist(), [], []
            for k, text in enumerate(texts):
                ids = encoder().ids(text or "") + end
                n = len(ids) // 4
                start, length, piece = 0, n % capacity or capacity, 0
                while start < n:
                    at.append(k)
                    out.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, met[length]))
                    met[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            if out:
                piece, start, length, crc, own, nth = zip(*out, strict=True)
                kept = [batch.column(i).take(pa.array(at)) for i in (0, *range(2, 2 + len(keep)))]
                columns = [kept[0], piece, start, length, crc, *kept[1:], own, nth]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, kinds)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, pieces in each sequence, offset of the first) and the sequences.

    In a run, piece first + i lies in sequence first_sequence + i // each at offset + (i % each) * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, each, offset))
        used[length] += n
        left[length] -= n

    #: Room left -> runs (first sequence, sequences) with that room.
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, a in enumerate(large):
        for b in large[i:]:
            if a + b > capacity or not left[a]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:
                continue
            if a == b:
                put(a, 2 * n, sequences, 2, 0)
            else:
                put(a, n, sequences, 1, 0)
                put(b, n, sequences, 1, a)
            room[capacity - a - b].append((sequences, n))
            sequences += n
        if left[a]:
            n = left[a]
            room[capacity - a].append((sequences, n))
            put(a, n, sequences, 1, 0)
            sequences += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for space in range(a, capacity + 1):
            each = space // a
            while left[a] and room.get(space):
                sequence, n = room[space].pop()
                full = min(n, left[a] // each)
                if full:
                    put(a, full * each, sequence, each, capacity - space)
                    room[space - each * a].append((sequence, full))
                elif left[a]:
                    rest, full = left[a], 1
                    put(a, rest, sequence, rest, capacity - space)
                    room[space - rest * a].append((sequence, 1))
                if full < n:
                    room[space].append((sequence + full, n - full))
            if not left[a]:
                break
        if left[a]:
            each = capacity // a
            full, rest = divmod(left[a], each)
            if full:
                put(a, full * each, sequences, each, 0)
                room[capacity - each * a].append((sequences, full))
                sequences += full
            if rest:
                put(a, rest, sequences, rest, 0)
                room[capacity - rest * a].append((sequences, 1))
                sequences += 1
    return runs, sequences


def placed(t: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank among those of their length; t: the sorted runs of a plan."""
    at = np.searchsorted((t[:, 0] << 44) + t[:, 1], (length << 44) + rank, side="right") - 1
    i, each = rank - t[at, 1], t[at, 4]
    return t[at, 3] + i // each, t[at, 5] + i % each * length


def _table(runs: list[tuple[int, ...]]) -> np.ndarray:
    return np.array(sorted(runs), np.int64)


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text)."""
    spark = docs.sparkSession
    found = materialize(pieces(docs, capacity))
    sizes = materialize(found.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if not runs:
        return found.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = spark.sparkContext.broadcast(_table(runs))  # its size is bounded by the capacity alone
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    rows = found.join(sizes, ["length", "part"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = placed(shared.value, batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, PIECE + ", sequence_id long, offset long")


#: Sequences that one stretch may have: ids of the next stretch go on there.
STRETCH_IDS = 1 << 32


def packed_by_stretch(docs: DataFrame, stretch: F.Column, capacity: int = CAPACITY) -> DataFrame:
    """As `packed`, but sequences hold pieces of one stretch only and their ids follow the stretches.

    stretch (a long from 0): a bounded run of documents in a given order, such as a file that `mixing.mixed_order` wrote.
    One task packs a stretch, from its pieces' lengths.
    """
    found = pieces(docs.withColumn("_stretch", stretch.cast("long")), capacity, ["_stretch"]).drop("part", "nth")
    found = found.select("_stretch", *found.drop("_stretch").columns)
    schema = found.drop("_stretch").schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def pack(t: pa.Table) -> pa.Table:
        length, own = t.column("length").to_numpy(), t.column("_stretch").to_numpy()
        sequence, offset = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for s in np.unique(own):
            mine = np.flatnonzero(own == s)
            mine = mine[np.argsort(length[mine], kind="stable")]
            values, first, n = np.unique(length[mine], return_index=True, return_counts=True)
            runs, _ = plan(dict(zip(values.tolist(), n.tolist(), strict=True)), capacity)
            at, place = placed(_table(runs), length[mine], np.arange(len(mine)) - np.repeat(first, n))
            sequence[mine], offset[mine] = s * STRETCH_IDS + at, place
        return t.drop_columns(["_stretch"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return map_groups(found, ["_stretch"], ["length", "doc_id", "piece", "ids_crc32"], schema, pack)
