"""Near-duplicate groups of whole documents against all pairs of shingle sets."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from glyphlake.llm import simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not (a or b) or len(a & b) >= 0.8 * len(a | b)


def roots(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if (len(sets[i]) * 0.8 <= len(sets[j]) <= len(sets[i]) * 1.25 or not sets[i]) and alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(rng, sizes, copies, changes):
    words = ["".join(rng.choices("abcdefghijk", k=rng.randrange(2, 7))) for _ in range(3000)]
    texts = []
    for n in sizes:
        base = rng.choices(words, k=n)
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(max(1, int(n * rng.choice(changes)))):
                copy[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.deduplicated(docs.repartition(4)).collect())


def test_near_copies_fall_together(spark):
    rng = random.Random(7)
    texts = corpus(rng, [rng.randrange(60, 600) for _ in range(120)], 3, [0.003, 0.008, 0.015, 0.02, 0.03, 0.06])
    texts += [t.upper() for t in texts[:10]] + ["", None, " \n", "one two", "One  TWO", "one two three"]
    want = roots(texts)
    got = kept(spark, texts)
    best = sorted(set(want))
    assert set(got) >= set(best)  # nothing is lost: links below the similarity are never made
    missed = len(got) - len(best)
    assert missed <= 0.05 * (len(texts) - len(best)), missed
    assert len(texts) - len(best) > 200


@pytest.mark.parametrize("cell, pairs", [(1 << 12, 1 << 9), (64, 16)])
def test_hot_group(spark, monkeypatch, cell, pairs):
    """A third of the texts are near copies of one, in cells that are dealt into blocks."""
    monkeypatch.setattr(simhash, "WIDE_CELL", cell)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(simhash, "COUNTED", 2)
    rng = random.Random(8)
    texts = corpus(rng, [300], 700, [0.004, 0.008, 0.012]) + corpus(rng, [100] * 1200, 0, [0.01])
    got = kept(spark, texts)
    assert set(got) >= {0, *range(701, len(texts))}
    assert len(got) <= 1201 + 3


def test_recall_of_links_at_the_limit(spark):
    """Pairs just at or above the similarity: most are linked."""
    rng = random.Random(9)
    texts = []
    for _ in range(300):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(450)]
        copy = list(words)
        for at in range(20, 450, 50):  # nine words far apart: 45 of 446 shingles differ, similarity 0.816
            copy[at] = "changed" + copy[at]
        texts += [" ".join(words), " ".join(copy)]
    got = kept(spark, texts)
    assert len(got) - 300 <= 24


@pytest.mark.parametrize("cell, tries", [(1 << 10, None), (2, None), (1 << 10, (1, 40))])
def test_no_link_is_left_out(spark, monkeypatch, cell, tries):
    """All links at the limit, and short texts, whose fingerprints tell little; with cells in blocks, and with hardly any trie."""
    monkeypatch.setattr(simhash, "EXACT_CELL", cell)
    if tries:
        monkeypatch.setattr(simhash, "runs_for", lambda n: tries)
    rng = random.Random(11)
    texts = []
    for k in range(150):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(450)]
        copy = list(words)
        for at in range(20, 450, 50):
            copy[at] = "changed" + copy[at]
        texts += [" ".join(words), " ".join(copy)]
        texts += [" ".join(words[: 8 + k % 9]), " ".join(words[: 9 + k % 9])]
    assert kept(spark, texts) == sorted(set(roots(texts)))


@pytest.mark.parametrize("shingles", [1 << 21, 900])
def test_steps_give_no_more_rows_than_they_take(spark, monkeypatch, shingles):
    """Groups of texts that all link, and hardly any trie: steps over cells give rows of texts or links that join them, not pairs."""
    given, real = [], simhash.map_groups

    def noted(df, keys, order, schema, function):
        df = simhash.materialize(df)
        out = simhash.materialize(real(df, keys, order, schema, function))
        given.append((function.__name__, df.count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "map_groups", noted)
    monkeypatch.setattr(simhash, "runs_for", lambda n: (1, 40))
    monkeypatch.setattr(simhash, "EXACT_SHINGLES", shingles, raising=False)
    rng = random.Random(12)
    texts = []
    for _ in range(2):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(450)]
        for k in range(40):
            copy = list(words)
            for at in rng.sample(range(450), 4):
                copy[at] = f"changed{k}" + copy[at]
            texts.append(" ".join(copy))
    want = sorted(set(roots(texts)))
    assert kept(spark, texts) == want and len(want) < 6
    assert len(given) > 3 and all(out <= n for _, n, out in given), given


def test_frequent_shingles_come_last():
    h = np.arange(1, 21, dtype=np.uint64)
    assert simhash._prefix(h, np.array([1, 2, 40], np.uint64), np.array([5, 3, 9])).tolist() == [3, 4, 5, 6, 7]
    assert simhash._prefix(h[:2], np.array([1, 2], np.uint64), np.array([5, 3])).tolist() == [2]
    assert simhash._prefix(h[:5], h[:0], h[:0]).tolist() == [1, 2]


def test_counts_tell_long_texts_apart(spark):
    """Sets of 2000 of which half are shared go, whose parities leave them open; those at the similarity stay."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 2000, np.uint64)
    sets = [a, *(np.concatenate([a[:n], rng.integers(0, 1 << 63, 2000 - n, np.uint64)]) for n in (1000, 1778, 1999))]
    for b in sets[1:]:
        far = np.abs(np.subtract(*(np.frombuffer(simhash.counts(x), np.uint8).astype(int) for x in (a, b)))).sum()
        assert far <= len(np.setxor1d(a, b))
    assert np.bitwise_count(simhash.parity(a) ^ simhash.parity(sets[1])).sum() <= simhash._may_differ(np.array(4000))
    texts = spark.createDataFrame([(k, len(x), simhash.counts(x)) for k, x in enumerate(sets)], "key long, size long, bins binary")
    pairs = spark.createDataFrame([(0, k, 0, k) for k in (1, 2, 3)], "a long, b long, lo long, hi long")
    assert sorted(r.b for r in simhash.counted(pairs, texts).collect()) == [2, 3]
    full = np.zeros(1000, np.uint64)
    assert max(simhash.counts(full)) == 255 and len(simhash.counts(full[:0])) == simhash.WIDE


def test_shuffle_files_go(spark):
    """What the stage shuffled is removed when each of its queries ends."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    docs = spark.createDataFrame(list(enumerate(corpus(random.Random(5), [60] * 20, 2, [0.02]))), "doc_id long, text string").repartition(4)
    before = found.getAllFiles().size()
    out = simhash.deduplicated(docs)
    for _ in range(40):
        if found.getAllFiles().size() <= before:
            break
        time.sleep(0.25)
    assert found.getAllFiles().size() <= before
    assert out.count() == out.count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_and_columns(spark):
    """Repeated ids with other texts are documents of their own; null ids; extra columns keep their names."""
    rows = [(2, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m"), (7, "n o p q r"), (7, "s t u v w"), (None, "x y z x y"), (None, "a b c d e f g"), (9, "lone words here"), (9, "lone words here")]
    names = ["c", "slot", "place", "block", "_n", "key", "id", "rep", "f0", "a", "b", "far", "root"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, "a b c d e f g"), (5, "h i j k l m"), (7, "n o p q r"), (7, "s t u v w"), (None, "x y z x y"), (9, "lone words here")], key=str)
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_spanning_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = int(rng.integers(1, 30)), int(rng.integers(0, 80))
        a, b, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        got = simhash.spanning_forest(n, a, b, weight)
        label, want = list(range(n)), 0  # Kruskal
        for k in sorted(range(m), key=lambda k: weight[k]):
            x, y = label[a[k]], label[b[k]]
            if x != y:
                want += weight[k]
                label = [x if v == y else v for v in label]
        assert weight[got].sum() == want and len(got) == n - len(set(label)) and len(set(got)) == len(got)


def test_wide_fingerprint_by_hand():
    words = simhash._Words()
    hashes = simhash.shingles("a b c d e f", words)
    assert len(hashes) == 2 and len(simhash.shingles("A b  c d e F a b c d e f", words)) == 6
    assert (simhash.wide_fingerprint(hashes[:1]) & ~simhash.wide_fingerprint(hashes)).any()
    assert not simhash.wide_fingerprint(np.zeros(0, np.uint64)).any()
    tries, run = simhash.runs_for(10**6)
    assert run == 12 and simhash.orders(tries, run).shape == (tries, 76)
    assert simhash.runs_for(10**9)[1] == 22 and simhash.runs_for(10**9)[0] > tries
