"""SimHash near-duplicates by a binary trie self-join.

Every document gets a 64-bit fingerprint. Equal fingerprints fall together first, so the join works on distinct ones. The
join walks a binary trie over the fingerprints with itself: a pair of nodes carries the number of bits that differ so
far, and is dropped once that exceeds the budget. Two fingerprints within 2 bits agree on all but two of m runs of bits,
so the walk is done in one trie for each choice of m - 2 runs, whose top levels hold these, and starts below at pairs (node,
itself); these subtries are the cells that tasks work on. With more fingerprints there are more runs: 3 tries below 21 equal bits,
then 6 below 32, then 10 below 38. A cell with too many fingerprints is split by taking the next 8 levels
of the walk as a Spark step, again and again, until every cell is small. Cells give spanning edges, not all pairs;
connected components join them.

Defined cases: null or empty text and text without words have fingerprint zero and are linked like others; fewer than
three words give one shingle of all of them; ties of a bit (exactly half) give 0; repeated rows are documents of
their own with equal fingerprints, and component_id is the smallest doc_id; an empty table gives an empty
result; columns other than doc_id and text are not read. A null doc_id takes part as any document does; its component_id is
the smallest non-null one reachable, null if there is none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import brief_shuffles, connected_components, discard, map_groups, map_rows, materialize, prepare, spanning

BITS, BUDGET, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints of one cell that a task may walk at once, and the levels that a split takes; fingerprints that share the bits
#: of a cell by chance, before tries with longer ones are taken.
CELL_ROWS, SPLIT_BITS, CHANCE_ROWS = 256, 8, 64
#: Rows of one fingerprint that are too many for one key of a join.
HOT_ROWS = 100_000
#: Shingles whose bits are summed at once.
CHUNK = 1 << 14


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), CHUNK):
        part = shingles[i : i + CHUNK]
        h = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in part]), np.uint8).reshape(len(part), 8)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    prepare(docs.sparkSession)

    def run(c):
        return {"doc_id": c["doc_id"], "fp": [_signed(fingerprint(x)) for x in c["text"]]}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", run)


def trie_pairs(values: np.ndarray, pairs: list[np.ndarray], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of values (uint64, sorted within each root range) at budget bits or fewer.

    pairs: arrays a_lo, a_hi, b_lo, b_hi of root node pairs; a pair of a node with itself yields each pair once. A pair of
    nodes that hold one value each is a pair of leaves, whose paths have no more branches: their bits are compared at once.
    """
    a0, a1, b0, b1 = (np.asarray(x, np.int64) for x in pairs)
    diff = np.zeros(len(a0), np.int64)
    left, right = [], []

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        left.append(i[near])
        right.append(j[near])

    for depth in range(BITS + 1):
        some = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        leaves = some & (a1 - a0 == 1) & (b1 - b0 == 1)
        settle(a0[leaves], b0[leaves])
        some &= ~leaves
        a0, a1, b0, b1, diff = a0[some], a1[some], b0[some], b1[some], diff[some]
        if not len(a0) or depth == BITS:
            break
        bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0
        parts = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            (am[other], a1[other], b0[other], bm[other], diff[other] + 1),
        ]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
    for w, x, y, z in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True):  # values that are equal in all bits
        i, j = np.triu_indices(x - w, 1) if w == y else np.indices((x - w, z - y)).reshape(2, -1)
        settle(w + i, y + j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _walk(cells: pa.Table) -> pa.Table:
    """Spanning edges of cells; rows come sorted by cell, side, rotated fingerprint."""
    cell = cells.column("cell").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    side = cells.column("side").to_numpy()
    cross = cells.column("crossed").to_numpy()
    rot, fp = cells.column("rot").to_numpy().view(np.uint64), cells.column("fp").to_numpy()
    # Spark sorts the longs as signed; within a side the walk needs unsigned order.
    order = np.lexsort((rot, side, cell))
    cell, side, cross, rot, fp = cell[order], side[order], cross[order], rot[order], fp[order]
    starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1])]))
    ends = np.append(starts[1:], len(cell))
    second = np.array([s + np.searchsorted(side[s:e], 1) for s, e in zip(starts, ends, strict=True)], np.int64) if len(starts) else np.zeros(0, np.int64)
    crossed = cross[starts]
    one = np.where(crossed, second, ends)
    roots = [starts, one, np.where(crossed, second, starts), ends]
    a, b = trie_pairs(rot, roots, BUDGET)
    root = spanning(len(fp), a, b)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return pa.table({"a": fp[linked], "b": fp[root[linked]]})


def tries_for(n: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each trie the runs (offset from the top, length) in their order, and the number of bits that a cell shares."""
    for m in range(BUDGET + 1, BUDGET + 4):
        ends = [round(k * BITS / m) for k in range(m + 1)]
        runs = [(a, b - a) for a, b in itertools.pairwise(ends)]
        tries = [[*top, *(r for r in runs if r not in top)] for top in itertools.combinations(runs, m - BUDGET)]
        out = [(t, sum(length for _, length in t[: m - BUDGET])) for t in tries]
        if n >> min(d for _, d in out) <= CHANCE_ROWS:
            break
    return out


def _ordered(runs: list[tuple[int, int]]) -> F.Column:
    """The fingerprint with its runs in another order."""
    out, at = F.lit(0).cast("long"), 0
    for offset, length in runs:
        at += length
        run = F.shiftrightunsigned("fp", BITS - offset - length).bitwiseAND(F.lit((1 << length) - 1))
        out = out.bitwiseOR(F.shiftleft(run, BITS - at))
    return out


def _cells(unique: DataFrame) -> DataFrame:
    """The start of the walk: each fingerprint in its cells of equal runs."""
    tries = tries_for(unique.count())
    runs = F.array(*[F.struct(F.lit(i).alias("run"), _ordered(t).alias("rot"), F.lit(d).alias("depth")) for i, (t, d) in enumerate(tries)])
    out = unique.select("fp", F.explode(runs).alias("x")).select("fp", "x.*")
    top = F.expr("shiftrightunsigned(rot, 64 - depth)")
    return out.select(
        F.concat_ws(":", F.col("run").cast("string"), F.hex(top)).alias("cell"), F.lit(0).alias("side"), F.lit(False).alias("crossed"),
        "rot", "fp", "depth", F.lit(BUDGET).alias("budget"),
    )


def _split(cells: DataFrame) -> DataFrame:
    """The next levels of the walk for large cells: to the pairs of child nodes that the budget allows."""
    masks = [m for m in range(1 << SPLIT_BITS) if bin(m).count("1") <= BUDGET]
    options = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(bin(m).count("1")).alias("cost")) for m in masks])
    # The last split of a run may have fewer levels left; those below bit 64 read as zero.
    child = F.expr(f"cast(shiftrightunsigned(shiftleft(rot, depth), {BITS - SPLIT_BITS}) as int)")
    fits = F.filter(options, lambda o: (o["cost"] <= F.col("budget")))
    out = cells.withColumn("child", child).withColumn("o", F.explode(fits))
    other = F.col("child").bitwiseXOR(F.col("o.mask"))
    moved = F.col("o.mask") != 0
    first = F.when(F.col("crossed"), F.when(F.col("side") == 0, F.col("child")).otherwise(other)).otherwise(F.least("child", other))
    second = F.when(F.col("crossed"), F.when(F.col("side") == 0, other).otherwise(F.col("child"))).otherwise(F.greatest("child", other))
    side = F.when(F.col("crossed"), F.col("side")).otherwise((moved & (F.col("child") > other)).cast("int"))
    return out.select(
        F.concat_ws(":", "cell", F.concat_ws(".", first.cast("string"), second.cast("string"))).alias("cell"), side.alias("side"),
        (F.col("crossed") | moved).alias("crossed"), "rot", "fp", (F.col("depth") + SPLIT_BITS).alias("depth"), (F.col("budget") - F.col("o.cost")).alias("budget"),
    )


def links(unique: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of the distinct fingerprints in unique(fp) that are within BUDGET bits."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    cells, found = _cells(unique), None
    while True:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.first("crossed").alias("x"))
        # A crossed cell with an empty side has no pairs.
        sizes = materialize(sizes.where("n > 1 and (not x or lo < hi)").select("cell", (F.col("n") > CELL_ROWS).alias("large")))
        cells = cells.join(sizes, "cell")
        part = map_groups(cells.where("not large").select("cell", "side", "crossed", "rot", "fp"), ["cell"], [], schema, _walk)
        found = part if found is None else found.union(part)
        if sizes.where("large").isEmpty():
            return found
        cells = materialize(_split(cells.where("large")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text)."""
    fps = materialize(fingerprints(docs))
    unique = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    roots = materialize(connected_components(links(unique.select("fp"))))
    least = roots.join(unique, roots.node == unique.fp).groupBy("root").agg(F.min("rep").alias("least"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "least")
    owner = materialize(unique.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")))
    # Frequent fingerprints are fewer than rows / HOT_ROWS, so they may be broadcast; their rows are not shuffled.
    hot = owner.where(F.col("n") > HOT_ROWS).select("fp", F.col("component_id").alias("_id"), F.lit(True).alias("_hot"))
    out = fps.join(F.broadcast(hot), "fp", "left")
    rest = out.where("_hot is null").select("doc_id", "fp").join(owner.where(F.col("n") <= HOT_ROWS).drop("n"), "fp")
    out = out.where("_hot").select("doc_id", "fp", F.col("_id").alias("component_id")).unionByName(rest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The form for whole documents: five-word shingles and a similarity (Jaccard, of distinct shingles) of 0.8 or more.
#
# Two documents of similarity s differ in arccos(2 s / (1 + s)) / pi of their bits, with a deviation that longer fingerprints
# make small: 0.15 of 256 bits at 0.8. The walk starts below runs that are equal in one of many tries, each over an order of
# bits of its own, as no three runs cover so wide a budget.

#: Words of a shingle, least similarity, bits of a fingerprint.
WORDS, SIMILARITY, WIDE = 5, 0.8, 256
#: Bits that may differ before the shingles are compared (0.8 differs in 39, with a deviation of 6), and those below which they needn't be.
WIDE_BUDGET, SURE = 54, 26
#: Share of linked pairs at SIMILARITY that have an equal run in one of the tries; least length of the runs; documents for each run value.
RECALL, LEAST_RUN, RUN_DOCS = 0.97, 12, 256
#: Fingerprints of a cell that a task walks at once (larger cells, of a hot group, are dealt into blocks, and one of each joined
#: group goes on); those whose pairs are listed without looking for a hub; one in so many is counted to find large cells.
WIDE_CELL, PAIRS_AT_ONCE, COUNTED = 1 << 12, 1 << 9, 16
#: Rows of one shingle that are held against each other at once (more are dealt into blocks, and every two blocks meet); shingles of the
#: sets that are; documents of the sample that tells frequent shingles, and shingles of that list.
EXACT_CELL, EXACT_SHINGLES, LISTED_DOCS, LISTED = 1 << 10, 1 << 21, 20_000, 1 << 16


def shingles(text: str | None, words: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of five-word shingles (fewer words: of all of them; none: nothing), sorted."""
    seq = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not seq:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, seq), np.uint64, len(seq))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE bits in words of 64: a bit is 1 if set in over half the hashes; zero if there are none."""
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        drawn = np.empty((len(part), WIDE // 64), np.uint64)
        for k in range(WIDE // 64):
            x = (part + np.uint64(0xD1B54A32D192ED03 * (k + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            drawn[:, k] = x ^ (x >> np.uint64(29))
        ones += np.unpackbits(drawn.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes)).view(np.uint64)


def orders(tries: int, run: int) -> np.ndarray:
    """For each trie, the places of the bits of its run and of the 64 bits below, drawn from a fixed seed."""
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(WIDE)[: run + 64] for _ in range(tries)])


def runs_for(n: int) -> tuple[int, int]:
    """Tries and length of runs for n fingerprints: longer runs for more documents, and then more tries for the same recall."""
    run = max(LEAST_RUN, int(np.ceil(np.log2(max(1, n) / RUN_DOCS))))
    differ = np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi
    equal = (1 - differ - np.sqrt(differ * (1 - differ) / WIDE)) ** run  # of pairs that differ by one deviation more
    return int(np.ceil(np.log(1 - RECALL) / np.log1p(-equal))), run


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), size (shingles), f0 to f3 (the fingerprint), p0 to p3 (the parity), bins (the counts) for every row of docs(doc_id, text)."""
    prepare(docs.sparkSession)
    names = [f"{c}{k}" for c in "fp" for k in range(WIDE // 64)]

    def run(c):
        words = _Words()
        sets = [shingles(x, words) for x in c["text"]]
        found = np.array([np.concatenate([wide_fingerprint(x), parity(x)]) for x in sets]).view(np.int64)
        return {"doc_id": c["doc_id"], "key": c["key"], "size": [len(x) for x in sets], "bins": [counts(x) for x in sets]} | {n: found[:, k].tolist() for k, n in enumerate(names)}

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return map_rows(rows, "doc_id long, key long, size long, bins binary, " + ", ".join(f"{n} long" for n in names), run)


def parity(hashes: np.ndarray) -> np.ndarray:
    """WIDE bits: whether a bin holds an odd number of hashes. Two sets differ in at least as many shingles as their parities do in bits."""
    odd = np.bincount((hashes % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def counts(hashes: np.ndarray) -> bytes:
    """The number of hashes in each of WIDE bins, 255 at most. Two sets differ in at least as many shingles as these do in all, also if they are long."""
    return np.minimum(np.bincount((hashes % np.uint64(WIDE)).astype(np.int64), minlength=WIDE), 255).astype(np.uint8).tobytes()


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Links a-b of n nodes that make a minimum spanning forest, by Boruvka's rounds; ties go to the earlier link."""
    order = np.argsort(weight, kind="stable")
    left, label, chosen = order, np.arange(n), []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.concatenate([np.zeros(0, np.int64), *chosen])
        best = np.full(n, len(left))
        for end in (a, b):
            np.minimum.at(best, label[end[left]], np.arange(len(left)))
        picked = left[np.unique(best[best < len(left)])]
        chosen.append(picked)
        label = spanning(n, label[a[picked]], label[b[picked]])[label]


def _wide_walk(order: np.ndarray, run: int, sure: bool):
    """Links of whole cells (cell, block, id, root, f0 to f3): a, b.

    sure: what SURE links join, each with the first of its group. Else closest links between groups of different root
    that are within WIDE_BUDGET: those of a minimum spanning forest.
    """
    budget = int(np.ceil(WIDE_BUDGET / WIDE * 64 + 3 * np.sqrt(64 * 0.15 * 0.85)))

    def walk(t: pa.Table) -> pa.Table:
        cell, own = t.column("cell").to_numpy(), t.column("id").to_numpy()
        words = np.column_stack([t.column(f"f{k}").to_numpy() for k in range(WIDE // 64)]).view(np.uint64)
        below = np.packbits(np.take_along_axis(_bits(words), order[(cell >> 48).astype(np.int64)][:, run:], axis=1), axis=1).view(">u8")[:, 0].astype(np.uint64)
        place = np.lexsort((below, cell))
        cell, own, words, below = cell[place], own[place], words[place], below[place]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = np.append(starts[1:], len(cell))
        left, right, none = [], [], np.zeros(0, np.int64)
        small = ends - starts <= PAIRS_AT_ONCE
        if small.any():
            i, j = trie_pairs(below, [starts[small], ends[small], starts[small], ends[small]], budget)
            left.append(i)
            right.append(j)
        for s, e in zip(starts[~small], ends[~small], strict=True):
            # A hot group: its members link with the one nearest to their majority; the others are walked against all.
            rest, done = np.arange(s, e), []
            while len(rest) > PAIRS_AT_ONCE:
                majority = np.packbits(_bits(words[rest]).mean(axis=0) > 0.5).view(np.uint64)
                hub = rest[np.bitwise_count(words[rest] ^ majority).sum(axis=1).argmin()]
                near = np.bitwise_count(words[rest] ^ words[hub]).sum(axis=1) <= SURE
                if near.sum() * 16 <= len(rest):
                    break
                done.append(rest[near])
                left.append(np.full(near.sum(), hub))
                right.append(rest[near])
                rest = rest[~near]
            near = np.sort(np.concatenate([none, *done]))
            sub, m, n = np.concatenate([near, rest]), len(near), len(near) + len(rest)
            i, j = trie_pairs(below[sub], [np.array(x) for x in ([0, m], [m, n], [m, m], [n, n])], budget)
            left.append(sub[i])
            right.append(sub[j])
        i, j = np.concatenate([none, *left]), np.concatenate([none, *right])
        far = np.bitwise_count(words[i] ^ words[j]).sum(axis=1).astype(np.int64) if len(i) else none
        if sure:
            near = far <= SURE
            root = spanning(len(own), i[near], j[near])
            joined = np.flatnonzero(root != np.arange(len(own)))
            return pa.table({"a": own[joined], "b": own[root[joined]]})
        group = t.column("root").to_numpy()[place]
        # Groups of each cell apart.
        _, group = np.unique(np.column_stack([np.cumsum(np.isin(np.arange(len(cell)), starts)), group]), axis=0, return_inverse=True)
        group = group.ravel()
        open_ = np.flatnonzero((far <= WIDE_BUDGET) & (group[i] != group[j])) if len(i) else none
        i, j = i[open_], j[open_]
        best = spanning_forest(len(own), group[i], group[j], far[open_])
        return pa.table({"a": own[i[best]], "b": own[j[best]]})

    return walk


def wide_cells(unique: DataFrame, tries: int, run: int) -> DataFrame:
    """cell (trie and run) of every fingerprint (id, root, f0 to f3) in every trie."""
    order = orders(tries, run)
    names = ["id", "root", *(f"f{k}" for k in range(WIDE // 64))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = _bits(np.column_stack([batch.column(k).to_numpy() for k in range(2, len(names))]))
            for t in range(tries):
                top = np.zeros((len(bits), 8), np.uint8)
                packed = np.packbits(bits[:, order[t, :run]], axis=1)
                top[:, : packed.shape[1]] = packed
                cell = (top.view(">u8")[:, 0].astype(np.uint64) >> np.uint64(16)).astype(np.int64) | t << 48
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", *names])

    return unique.select(*names).mapInArrow(deal, "cell long, " + ", ".join(f"{n} long" for n in names))


def wide_links(unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the fingerprints in unique(id, f0 to f3): groups (node, root) that SURE links join, and links (a, b) between groups.

    A cell of more than WIDE_CELL fingerprints (by a count of some of them) is dealt into blocks. One fingerprint of each group that
    they join goes on to be dealt again, until the cell is small or nothing new is joined.
    """
    tries, run = runs_for(unique.count())
    order = orders(tries, run)
    pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def large(rows: DataFrame) -> DataFrame:
        some = wide_cells(rows.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0), tries, run)
        n = some.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") * COUNTED > WIDE_CELL)
        return materialize(n.select("cell", F.ceil(F.col("n") * COUNTED / WIDE_CELL).alias("blocks")))

    def walked(cells: DataFrame, big: DataFrame, sure: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
        cells = cells.join(big, "cell", "left").select("cell", block, *cells.columns[1:])
        return materialize(map_groups(cells, ["cell", "block"], [], pair, _wide_walk(order, run, sure)))

    rows = unique.withColumn("root", F.col("id"))
    big, n, found = large(rows), rows.count(), None
    cells, first = wide_cells(rows, tries, run), big
    while True:
        more = walked(cells, big, True)
        found = more if found is None else found.unionByName(more)
        roots = materialize(connected_components(found))
        if big.isEmpty():
            break
        left = materialize(rows.join(roots.where("node <> root").select(F.col("node").alias("id")), "id", "left_anti"))
        m = left.count()
        if m == n:
            break
        cells = wide_cells(left, tries, run).join(big.select("cell"), "cell", "left_semi")
        n, big = m, large(left)
    rows = materialize(unique.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    between = walked(wide_cells(rows, tries, run), first, False)
    if not first.isEmpty():
        heads = wide_cells(rows.where("id = root"), tries, run).join(first.select("cell"), "cell", "left_semi")
        between = between.unionByName(walked(heads, big, False))
    return roots, between


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, set (the sorted shingles) of nodes(id, doc_id, key), each a row of docs."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"), "text")
    rows = rows.join(nodes, rows["_d"].eqNullSafe(nodes["doc_id"]) & (rows["_k"] == nodes["key"])).select("id", "text")

    def run(c):
        words = _Words()
        return {"id": c["id"], "set": [shingles(x, words).view(np.int64).tolist() for x in c["text"]]}

    return materialize(map_rows(rows, "id long, set array<long>", run).dropDuplicates(["id"]))


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b, ...) whose documents have SIMILARITY or more; nodes: id, doc_id, key of those in pairs, each a row of docs."""
    sets = shingle_sets(docs, nodes)
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("set").alias(f"_{side}")), side)
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.where(both >= SIMILARITY * (F.size("_a") + F.size("_b") - both)).drop("_a", "_b")


def _prefix(h: np.ndarray, listed: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set: unlisted ones by value, then listed ones from the rarest. Sets at SIMILARITY share one of them."""
    n = int((1 - SIMILARITY) * len(h) + 1e-6) + 1
    if not len(listed):
        return h[:n]
    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
    known = listed[at] == h
    last = h[known]
    return np.concatenate([h[~known], last[np.lexsort((last, times[at[known]]))]])[:n]


def _shingle_rows(docs: DataFrame, listed: np.ndarray | None = None, times: np.ndarray | None = None) -> DataFrame:
    """token, key, prev, at for each shingle of different texts (of their prefix, if there is a list); a text may come once a task.

    at: the shingle's place in the order of its text, prev: the shingle before it (0 at place 0).
    """
    names = ["token", "key", "prev", "at"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            words, keys, tokens, prev, at = _Words(), [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    h = shingles(text, words)
                    if len(h):
                        tokens.append(h if listed is None else _prefix(h, listed, times))
                        keys.append(np.full(len(tokens[-1]), key, np.int64))
                        prev.append(np.concatenate([np.zeros(1, np.uint64), tokens[-1][:-1]]))
                        at.append(np.arange(len(tokens[-1]), dtype=np.int32))
            if keys:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(keys), np.concatenate(prev).view(np.int64), np.concatenate(at)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(deal, "token long, key long, prev long, at int")


def _several(t: pa.Table) -> pa.Table:
    """Rows of whole tokens, without repeats, of tokens that two or more texts have."""
    token, key = t.column("token").to_numpy(), t.column("key").to_numpy()
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
    token = token[new]
    same = token[1:] == token[:-1]
    some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return t.take(pa.array(np.flatnonzero(new)[some]))


#: Columns of the rows of cells, after those that name the cell.
MEMBER = {"key": "long", "root": "long", "size": "long", "prev": "long", "at": "int"}


def _open_pairs(t: pa.Table, cell: list[str], gap) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i, j of one cell (its columns, MEMBER) whose texts have different roots and may be at SIMILARITY, and their gap.

    gap(i, j): a number of shingles in which the sets differ at least. Texts that share the shingle before, too, are left to the cell of that one, which
    both are in. So a pair is open where its first shared shingle is: what comes before it in either text isn't shared, and what
    comes after it must hold what SIMILARITY asks for.
    """
    names = np.column_stack([t.column(c).to_numpy() for c in cell])
    root, size, prev, at = (t.column(c).to_numpy() for c in list(MEMBER)[1:])
    ends = np.append(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, len(names))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    i = np.arange(len(names))
    for step in range(1, len(names)):
        i = i[i + step < end[i]]
        if not len(i):
            return
        j = i + step
        shared = (SIMILARITY * (size[i] + size[j]) / (1 + SIMILARITY)) - 1e-6
        may = (root[i] != root[j]) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= shared)
        may &= (np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-6) & ((prev[i] != prev[j]) | (at[i] == 0) | (at[j] == 0))
        x, y = i[may], j[may]
        if len(x):
            far = gap(x, y)
            may = far <= _may_differ(size[x] + size[y])
            yield x[may], y[may], far[may]


def _parity_gap(t: pa.Table):
    odd = np.column_stack([t.column(f"p{k}").to_numpy() for k in range(WIDE // 64)]).view(np.uint64)
    return lambda i, j: np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1).astype(np.int64)


def _count_gap(bins: list[bytes]):
    n = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, WIDE).astype(np.int16)
    return lambda i, j: np.abs(n[i] - n[j]).sum(axis=1, dtype=np.int64)


def _open_rows(t: pa.Table) -> pa.Table:
    """Of whole cells: the rows that parities leave in an open pair. They are no more than there were, however many pairs they make."""
    some, cell = np.zeros(t.num_rows, bool), ["token", "lo", "hi"]
    for i, j, _ in _open_pairs(t, cell, _parity_gap(t)):
        some[i] = some[j] = True
    return t.select([*cell, *MEMBER]).filter(pa.array(some))


def _open_groups(t: pa.Table) -> pa.Table:
    """Of whole cells: group, key, root, size of the texts that pairs which counts leave open join, at most a row for each that there was.

    group is a hash of its texts, so that equal groups of several cells are one (if others fall together, more is compared).
    """
    found = list(_open_pairs(t, ["token", "lo", "hi"], _count_gap(t.column("bins").to_pylist())))
    i, j = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
    label = spanning(t.num_rows, i, j)
    x = t.column("key").to_numpy().astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    group = np.zeros(t.num_rows, np.uint64)
    np.add.at(group, label, x ^ (x >> np.uint64(29)))
    some = np.unique(np.concatenate([i, j]))
    return pa.table({"group": group[label[some]].view(np.int64), **{c: t.column(c).to_numpy()[some] for c in ("key", "root", "size")}})


def _exact_links(t: pa.Table) -> pa.Table:
    """Of whole groups with the sets of their texts: links (a, b) of roots that join all that pairs at SIMILARITY join, without a circle."""
    column = t.column("set").combine_chunks()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    sets = [values[s:e] for s, e in itertools.pairwise(ends)]
    found = list(_open_pairs(t, ["group", "lo", "hi"], _count_gap([counts(x.view(np.uint64)) for x in sets])))
    if not found:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
    root, parent, links = t.column("root").to_pylist(), {}, []

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    for k in np.argsort(far, kind="stable").tolist():
        x, y = sets[i[k]], sets[j[k]]
        a, b = top(root[i[k]]), top(root[j[k]])
        if a != b:
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= SIMILARITY * (len(x) + len(y) - both):
                parent[b] = a
                links.append((root[i[k]], root[j[k]]))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _dealt(rows: DataFrame, cell: str, weight: F.Column, most: int) -> DataFrame:
    """rows of cells with several roots, and the blocks lo and hi that meet: a cell heavier than most is dealt into blocks, and every two blocks meet."""
    heavy = rows.groupBy(cell).agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.ceil(F.sum(weight) / most).cast("int").alias("_blocks")).where("_a < _b")
    rows = rows.join(heavy.drop("_a", "_b"), cell)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("key", F.lit(2)), "_blocks").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}).drop("_own", "_other", "_blocks")


def _may_differ(sizes: np.ndarray) -> np.ndarray:
    """Shingles in which two sets at SIMILARITY may differ, by the sum of their sizes."""
    return (1 - SIMILARITY) / (1 + SIMILARITY) * sizes + 1e-6


def counted(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b, lo, hi) that the counts of texts(key, size, bins) leave open, and far: by how much the counts differ."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("key").alias(side), F.col("size").alias(f"size_{side}"), F.col("bins").alias(f"bins_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                far = _count_gap(batch.column(4).to_pylist() + batch.column(5).to_pylist())(np.arange(n), np.arange(n, 2 * n))
                out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(far)], ["a", "b", "lo", "hi", "far"])
                yield out.filter(pa.array(far <= _may_differ(batch.column(6).to_numpy())))

    pairs = pairs.select("a", "b", "lo", "hi", "bins_a", "bins_b", (F.col("size_a") + F.col("size_b")).alias("sizes"))
    return pairs.mapInArrow(run, "a long, b long, lo long, hi long, far long")


def left_links(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between roots that join every two texts of SIMILARITY or more that have different roots, so that none is left out.

    texts: key, doc_id, root, size, p0 to p3, bins, a row for each different text of docs. Two sets at SIMILARITY share a shingle of
    their prefixes, whatever the order of shingles; frequent ones, by a sample, come last, which only makes cells smaller. A cell keeps the
    texts that have an open pair in it, first by parities, then by counts; the sets of what is left are compared, each group of texts once. A
    step gives no more rows than it takes.
    """
    prepare(docs.sparkSession)
    every = max(1, texts.count() // LISTED_DOCS)
    some = _shingle_rows(docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(every)) == 0)).select("token", "key").distinct().groupBy("token").agg(F.count("*").alias("n"))
    listed = some.where("n > 2").orderBy(F.desc("n"), "token").limit(LISTED).toPandas()
    order = np.argsort(listed["token"].to_numpy(np.int64).view(np.uint64))
    rows = _shingle_rows(docs, listed["token"].to_numpy(np.int64).view(np.uint64)[order], listed["n"].to_numpy(np.int64)[order])
    shared = materialize(map_groups(rows, ["token"], ["key"], "token long, key long, prev long, at int", _several))
    rooted = materialize(shared.join(texts.select("key", "root"), "key"))
    odd, member = [f"p{k}" for k in range(WIDE // 64)], ", ".join(f"{n} {kind}" for n, kind in MEMBER.items())
    cells = _dealt(rooted, "token", F.lit(1), EXACT_CELL).join(texts.select("key", "size", *odd), "key").select("token", "lo", "hi", *MEMBER, *odd)
    near = materialize(map_groups(cells, ["token", "lo", "hi"], [], f"token long, lo int, hi int, {member}", _open_rows))
    discard(shared, rooted)
    cells = near.join(texts.select("key", "bins"), "key").select("token", "lo", "hi", *MEMBER, "bins")
    found = map_groups(cells, ["token", "lo", "hi"], [], "group long, key long, root long, size long", _open_groups)
    open_ = materialize(found.dropDuplicates(["group", "key"]))
    discard(near)
    nodes = texts.join(open_.select("key").distinct(), "key").select(F.col("key").alias("id"), "doc_id", "key")
    sets = shingle_sets(docs, materialize(nodes)).withColumnRenamed("id", "key")
    # Groups hold pairs from anywhere in the prefixes, so all of their pairs are looked at.
    cells = _dealt(open_, "group", F.col("size"), EXACT_SHINGLES).withColumns({"prev": F.lit(0).cast("long"), "at": F.lit(0)}).join(sets, "key")
    return map_groups(cells.select("group", "lo", "hi", *MEMBER, "set"), ["group", "lo", "hi"], [], "a long, b long", _exact_links).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), root_id, root_key for every different (doc_id, text): the first of its group.

    Documents are linked if the distinct five-word shingles of their texts have SIMILARITY or more; groups are what links join.
    """
    fps = materialize(wide_fingerprints(docs))
    names = [f"f{k}" for k in range(WIDE // 64)]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key")))
    unique = materialize(fps.groupBy(*names).agg(first.alias("rep")).withColumn("id", F.monotonically_increasing_id()))
    root, between = wide_links(unique.select("id", *names))
    for side in ("a", "b"):
        between = between.join(root.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    between = between.select("a", "b", F.least("root_a", "root_b").alias("lo"), F.greatest("root_a", "root_b").alias("hi"))
    between = materialize(between.dropDuplicates(["a", "b"]))
    ends = between.select(F.col("a").alias("id")).union(between.select(F.col("b").alias("id"))).distinct()
    nodes = materialize(unique.join(ends, "id").select("id", "rep.doc_id", "rep.key"))
    sized = materialize(nodes.join(fps.select("key", "size", "bins"), "key").dropDuplicates(["id"]).select(F.col("id").alias("key"), "size", "bins"))
    more = similar(docs, nodes, counted(between, sized)).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    root = materialize(connected_components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    owner = materialize(unique.join(root.select(F.col("node").alias("id"), "root"), "id", "left").select(*names, "rep", F.coalesce("root", "id").alias("root")))
    texts = fps.groupBy("key").agg(F.min(F.struct("doc_id", "size", *names, *(f"p{k}" for k in range(WIDE // 64)), "bins")).alias("x")).select("key", "x.*")
    texts = materialize(texts.join(owner.select(*names, "root"), names).drop(*names))
    last = materialize(connected_components(left_links(docs, texts)))
    owner = owner.join(last.select(F.col("node").alias("root"), F.col("root").alias("_last")), "root", "left").select(*names, "rep", F.coalesce("_last", "root").alias("root"))
    best = materialize(owner.groupBy("root").agg(F.min("rep").alias("best")))
    owner = materialize(owner.join(best, "root").select(*names, "best"))
    return fps.join(owner, names).select("doc_id", "key", F.col("best.doc_id").alias("root_id"), F.col("best.key").alias("root_key"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of docs with all columns, one of each group: the first by doc_id (null last), then by a hash of the text.

    A doc_id that is repeated with other texts names other documents. Texts without words are one group; of rows that
    repeat doc_id and text, one stays.
    """
    with brief_shuffles(docs.sparkSession):
        kept = groups(docs).where("doc_id <=> root_id and key = root_key").groupBy("doc_id", "key").agg(F.count("*").alias("_rows"))
        kept = materialize(kept.select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"), F.col("_rows").alias("_kept_rows")))
    names = docs.columns
    rows = docs.withColumns({"_text_key": F.xxhash64("text"), "_no_id": F.col("doc_id").isNull(), "_some_id": F.coalesce("doc_id", F.lit(0))})
    kept = kept.select(F.col("_kept_id").isNull().alias("_no_id"), F.coalesce("_kept_id", F.lit(0)).alias("_some_id"), F.col("_kept_key").alias("_text_key"), "_kept_rows")
    rows = rows.join(kept, ["_no_id", "_some_id", "_text_key"])
    repeated = rows.where("_kept_rows > 1").dropDuplicates(["_no_id", "_some_id", "_text_key"])
    return rows.where("_kept_rows = 1").select(*names).unionByName(repeated.select(*names))
