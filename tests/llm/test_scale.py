"""Forms that only large inputs take, forced on small ones."""

from __future__ import annotations

import random
import time

from glyphlake.llm import simhash, urlfilter
from glyphlake.llm.common import spanning

import numpy as np
import pytest


@pytest.mark.parametrize("n, runs, tries", [(1000, 3, 3), (10**9, 4, 6), (10**13, 5, 10)])
def test_tries_hold_every_pair(n, runs, tries):
    """Two fingerprints within the budget are in one cell of some trie, and runs cover all bits."""
    got = simhash.tries_for(n)
    assert len(got) == tries and all(sorted(t) == sorted(got[0][0]) and len(t) == runs for t, _ in got)
    assert sum(length for _, length in got[0][0]) == simhash.BITS
    rng = random.Random(1)
    for _ in range(500):
        flipped = rng.sample(range(simhash.BITS), simhash.BUDGET)
        assert any(all(not any(a <= bit < a + length for bit in flipped) for a, length in t[: runs - simhash.BUDGET]) for t, _ in got)


@pytest.mark.parametrize("chance", (64, 0))
def test_links_in_more_tries(spark, monkeypatch, chance):
    monkeypatch.setattr(simhash, "CHANCE_ROWS", chance)
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    near = x[rng.integers(0, 200, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.concatenate([x, near]))
    a, b = np.nonzero(np.bitwise_count(np.bitwise_xor.outer(values, values)) <= simhash.BUDGET)
    want = spanning(len(values), a, b)
    rows = simhash.links(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")).toPandas()
    place = {v: k for k, v in enumerate(values.view(np.int64).tolist())}
    got = spanning(len(values), np.array([place[v] for v in rows.a]), np.array([place[v] for v in rows.b]))
    assert (got == want).all()


def test_frequent_fingerprints(spark, monkeypatch):
    """Rows of hot fingerprints, null ids among them, come back like others."""
    monkeypatch.setattr(simhash, "HOT_ROWS", 2)
    rows = [(i, "a b c d") for i in range(5)] + [(None, "only null ids here")] * 4 + [(9, "x y z")] + [(None, "a b c d")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(str(x) for x in [(i, 0) for i in range(5)] + [(None, None)] * 4 + [(9, 9), (None, 0)])


@pytest.mark.parametrize("most", (100_000, 1))
def test_hosts_of_many_labels(spark, monkeypatch, most):
    """Time doesn't grow with the square of a host's labels; long lists are joined by shuffle."""
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", most)
    long = ".".join(["x"] * 8000)
    urls = [f"http://{long}.com/en/x", "http://com/en/", "http://a..com/en/1", "http://xcom/en/", f"http://{long}.net/fr", "http://q.example.com/en/77", None, "no", "http://", "http://b.example.com/en/6"]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert time.time() - began < 10
    assert got == {0: ("com/en/", "block"), 1: ("com/en/", "block"), 2: ("com/en/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("example.com/en/7", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("com/en/", "block")}
