"""Schedules against their target weights, slot by slot, and places of documents against plain running sums."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import pandas as pd
import pytest

from glyphlake.llm import mixing
from glyphlake.llm.queries import queries

from .test_operators import ODD, SCHEMA, SF, SF1


def naive(weights, blocks, slots):
    """Slot by slot, of all released blocks the one that is due first."""
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    done, out = dict.fromkeys(weights, 0), []
    for slot in range(slots):
        ready = [(-(-(done[s] + 1) // w), s is None, s or "", s) for s, w in share.items() if done[s] < blocks[s] and done[s] // w <= slot]
        if ready:
            *_, s = min(ready)
            out.append((s, done[s], slot))
            done[s] += 1
    return out


def test_schedule_is_the_naive_one():
    for weights in ({"a": 1}, {"a": 5, "b": 3, None: 2}, {"a": 1 / 3, "b": 2 / 3}, {str(i): i + 0.3 for i in range(9)}, {"a": 0.001, "b": 1.7, "c": 1}):
        blocks = {s: 5 + 3 * i for i, s in enumerate(weights)}
        got = mixing.schedule(weights, blocks)
        assert len(got) == sum(blocks.values())
        last = min(got[-1][2] + 1, 3000)
        assert [x for x in got if x[2] < last] == naive(weights, blocks, last)


@pytest.mark.parametrize("weights, slots", [({"a": Fraction(1, 3), "b": Fraction(2, 3)}, 1_200_000), ({"big": 1000} | {str(i): 1 for i in range(700)}, 100_000), ({str(i): 0.1 + i**0.5 for i in range(40)}, 100_000)])
def test_every_prefix_is_within_a_block_of_the_target(weights, slots):
    """Measured against the given weights, not the schedule's own numbers; each source has blocks for all slots."""
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    blocks = {s: int(w * slots) + 2 for s, w in share.items()}
    done, at = dict.fromkeys(weights, 0), 0
    rate = {s: (w.numerator, w.denominator) for s, w in share.items()}
    for source, i, slot in mixing.schedule(weights, blocks):
        if slot >= slots:
            break
        assert slot == at and done[source] == i
        at += 1
        # A source is furthest behind before one of its blocks, furthest ahead after it.
        n, d = rate[source]
        assert -d < i * d - slot * n and (i + 1) * d - (slot + 1) * n < d
        done[source] += 1
    assert at == slots
    assert all(abs(done[s] - slots * w) < 1 for s, w in share.items())


def test_sources_without_weight_follow():
    got = mixing.schedule({"a": 2, "b": 0, "c": 1, None: 0}, {"a": 4, "b": 2, "c": 1, None: 2})
    assert [s for s, _, _ in got] == ["a", "a", "c", "a", "a", "b", None, "b", None]
    assert mixing.schedule({"a": 0.0}, {"a": 1}) == [("a", 0, 0)]
    assert mixing.shares({"a": 0, "b": -1}) == {"a": 1, "b": 1}


def check(rows, docs, weights, block_size):
    sizes = dict(zip(zip(docs.doc_id, docs.source, strict=True), docs.text.str.len().fillna(0).astype(int) + 1, strict=True))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    totals = {s: sum(sizes[r["doc_id"], s] for r in x) for s, x in by.items()}
    weights = {s: weights.get(s, 0) if weights else n**mixing.ALPHA for s, n in totals.items()}
    slot = {(s, i): k for s, i, k in mixing.schedule(weights, {s: -(-n // block_size) for s, n in totals.items()})}
    for s, x in by.items():
        at = 0
        for r in sorted(x, key=lambda r: (r["block"], r["place"])):
            assert (r["block"], r["place"]) == divmod(at, block_size)
            assert r["slot"] == slot[s, r["block"]]
            at += sizes[r["doc_id"], s]


def test_mixing_query(spark):
    docs = pd.read_parquet(f"{SF1}/documents.parquet")
    got = [r.asDict() for r in queries()["op2_mixing"](spark, SF1).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(docs.doc_id)
    check(got, docs, None, mixing.BLOCK_SIZE)


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    weights = {s: i + 1 for i, s in enumerate(sorted(set(docs.source))[1:])}
    got = [r.asDict() for r in mixing.mixed(spark.createDataFrame(docs), weights, 100).collect()]
    total = int((docs.text.str.len() + 1).sum())
    check(got, docs, weights, -(-total // 50))
    assert len({(r["source"], r["block"]) for r in got}) <= 50 + docs.source.nunique()


def test_order_of_files_is_the_schedule(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "FILE_SIZE", 30_000)
    rows = [(i, "x" * (200 + i % 700), "ab"[i % 3 == 0], i, i, i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long, place long, block long")
    orders = []
    for weights in ({"a": 1, "b": 1}, {"a": 5, "b": 1}):
        path = str(tmp_path / str(weights["a"]))
        mixing.mixed_order(docs, weights, 4096).write.parquet(path)
        got = [r for f in sorted((tmp_path / str(weights["a"])).glob("*.parquet")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert sorted(got) == sorted(docs.collect())
        place = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(docs, weights, 4096).collect()}
        assert [place[r.doc_id] for r in got] == sorted(place.values())
        orders.append([r.doc_id for r in got])
        head = got[: len(got) // 4]
        share = sum(len(r.text) for r in head if r.source == "a") / sum(len(r.text) for r in head)
        assert abs(share - weights["a"] / (weights["a"] + 1)) < 0.08
    assert orders[0] != orders[1]


def test_mixing_odd(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    out = mixing.mixed_order(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, ODD))
    assert mixing.mixed_order(odd.limit(0)).count() == 0
    assert mixing.mixed(odd.limit(0)).columns == ["doc_id", "source", "block", "slot", "place"]
    assert mixing.mixed(odd, {"s": 1.0, "unknown": 3.0}).count() == len(ODD)
