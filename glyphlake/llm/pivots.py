"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are a bounded, hash-chosen sample of the distinct vectors, thinned so that no two are within cosine
`SPREAD`: a dense group holds one pivot however large it is, and its members agree on it. A vector is described by its
`NEAREST` nearest pivots in order. Inverted lists hold, for each label and pivot, the vectors that have it in their description; two
vectors of a list that share at least `SHARED` pivots are candidates, and their cosine in double precision
decides. A pair is looked at in the list of the first pivot they share only. Long lists are split into blocks, and
each pair of blocks is a task of its own, so every pair of a list is seen whatever its length.

Equal vectors of a label are one class from the start: classes are linked, members counted.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with null labels, link
with nothing; vectors of different lengths don't link; repeated rows are vectors of their own that link with each other;
ties of a pivot's rank go to the lower pivot; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, map_groups, map_rows, materialize, prepare, spanning

LEAST_COSINE = 0.93
NEAREST, SHARED = 8, 2
#: Pivots: half the square root of the number of classes, between these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 256, 4096
#: No two pivots are this close; sampled vectors for each pivot that is wanted.
SPREAD, SAMPLED = 0.8, 4
#: Vectors in one block of an inverted list.
BLOCK = 512


def _unit(rows: list, dim: int) -> np.ndarray:
    """Unit vectors of the first dim components, zeros where there are fewer."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        v = np.asarray(r[:dim], np.float64)
        out[i, : len(v)] = v
    top = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(top > 0, top, 1)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def _spread(sample: pa.ChunkedArray, dim: int, most: int) -> np.ndarray:
    """Unit vectors of sample in order, leaving out those within SPREAD of an earlier one."""
    chosen = np.zeros((0, dim))
    for i in range(0, len(sample), BLOCK):
        unit = _unit(sample.slice(i, BLOCK).to_pylist(), dim)
        unit = unit[(unit @ chosen.T).max(axis=1, initial=-1) < SPREAD]
        close, kept = unit @ unit.T >= SPREAD, []
        for k in range(len(unit)):
            if not close[k, kept].any():
                kept.append(k)
        chosen = np.concatenate([chosen, unit[kept]])[:most]
        if len(chosen) == most:
            break
    return chosen


def _blocks(table: pa.Table) -> pa.Table:
    """Of whole groups (label, pivot, first block, second block): a, b, others for each class a with verified pairs there.

    others: vectors of the classes that a is paired with; b: the class that all joined ones in the group go to.
    """
    key = np.column_stack([table.column(c).to_numpy() for c in ("label", "size", "pivot", "i", "j")])
    own, cid, n = (table.column(c).to_numpy() for c in ("block", "cid", "n"))
    near = np.array(table.column("near").to_pylist(), np.int64)
    vectors = table.column("embedding").to_pylist()
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    out = [(np.zeros(0, np.int64),) * 3]
    for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
        if e - s < 2:
            continue
        pivot, i, j = key[s, 2:]
        a = s + np.flatnonzero(own[s:e] == i)
        b = a if i == j else s + np.flatnonzero(own[s:e] == j)
        if not len(a) or not len(b):
            continue
        names, local = np.unique(near[s:e], return_inverse=True)
        has = np.zeros((e - s, len(names)), np.float32)
        has[np.repeat(np.arange(e - s), near.shape[1]), local.ravel()] = 1
        one, two = has[a - s], has[b - s]
        shared = one @ two.T >= min(SHARED, near.shape[1])
        lower = names < pivot
        if lower.any():  # a pair that shares a lower pivot is looked at there
            shared &= one[:, lower] @ two[:, lower].T == 0
        unit = _unit([vectors[k] for k in range(s, e)], int(key[s, 1]))
        linked = shared & (unit[a - s] @ unit[b - s].T >= LEAST_COSINE)
        if i == j:
            np.fill_diagonal(linked, False)
        others = np.zeros(e - s, np.int64)
        others[a - s] += linked @ n[b]
        if i != j:
            others[b - s] += linked.T @ n[a]
        x, y = np.nonzero(linked)
        root = spanning(e - s, a[x] - s, b[y] - s)
        some = np.flatnonzero(others)
        out.append((cid[s:e][some], cid[s:e][root[some]], others[some]))
    return pa.table({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("a", "b", "others"))})


def class_links(classes: DataFrame) -> DataFrame:
    """Links at LEAST_COSINE or more of classes(cid, label, embedding, n): rows a, b, others as `_blocks` gives them.

    The others of a class add up to the vectors it is linked with, and the pairs (a, b) join what links join. A block
    has a row for each class, not for each pair.
    """
    spark = classes.sparkSession
    prepare(spark)
    link = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "others")])
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], link)
    n_pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(np.sqrt(n) / 2)))))
    sample = classes.select("embedding", "cid").orderBy(F.xxhash64("embedding"), "cid").limit(SAMPLED * n_pivots).toArrow().column("embedding")
    sizes = Counter(pc.list_value_length(sample).to_pylist())
    dim = max(sizes, key=lambda d: (sizes[d], d))
    pivots = _spread(sample, dim, n_pivots)
    shared = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most
    most = min(NEAREST, len(pivots))

    def described(c):
        close = _unit(c["embedding"], dim) @ shared.value.T
        near = np.argsort(-close, axis=1, kind="stable")[:, :most]
        return {k: c[k] for k in ("cid", "label", "embedding", "n")} | {"size": [len(v) for v in c["embedding"]], "near": near.tolist()}

    kind = classes.schema["embedding"].dataType.simpleString()
    rows = map_rows(classes.select("cid", "label", "embedding", "n"), f"cid long, label long, embedding {kind}, n long, size int, near array<int>", described)
    rows = materialize(rows)
    lists = rows.select("cid", "n", "label", "size", "embedding", "near", F.explode("near").alias("pivot"))
    lengths = rows.select("label", "size", F.explode("near").alias("pivot")).groupBy("label", "size", "pivot").agg(F.count("*").alias("rows"))
    lengths = materialize(lengths.where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows"))
    lists = lists.join(lengths, ["label", "size", "pivot"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    own = F.col("block")
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    lists = lists.withColumn("x", F.explode(ends)).select(F.col("label"), "size", "pivot", F.col("x.i").alias("i"), F.col("x.j").alias("j"), "block", "cid", "n", "near", "embedding")
    return map_groups(lists, ["label", "size", "pivot", "i", "j"], [], link, _blocks)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    good = rows.where("ok").drop("ok")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    links = materialize(class_links(classes))
    partners = links.groupBy(F.col("a").alias("cid")).agg(F.sum("others").alias("others"))
    roots = materialize(connected_components(links.select("a", "b"))).withColumnRenamed("node", "cid")
    least = roots.join(classes.select("cid", "rep"), "cid").groupBy("root").agg(F.min("rep").alias("least"))
    linked = roots.join(least, "root").select("cid", "least").join(partners, "cid")
    owner = classes.join(linked, "cid", "left").select(
        F.col("label"), "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")
    )
    out = good.join(materialize(owner), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
