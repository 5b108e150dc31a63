"""Functions over texts against their definitions."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from glyphlake.functions import arrays, normal, reveal


def naive_lz76(text):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text.find(text[i : i + k], 0, i + k - 1) >= 0:
            k += 1
        n, i = n + 1, i + k
    return n


def test_lz76_is_the_naive_parsing():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices("ab\U0001f600c"[: rng.randrange(1, 5)], k=rng.randrange(0, 60)))
        assert normal.lz76_of(text) == naive_lz76(text), text
    for text in ("", "a", "aaaa", "0001101001000101", "the quick brown fox " * 40):
        assert normal.lz76_of(text) == naive_lz76(text)


def test_lz76_of_long_texts():
    """Repetitive and random texts of 200,000 characters take seconds, not the square."""
    rng = random.Random(2)
    began = time.time()
    assert normal.lz76_of("a" * 200_000) == 2
    assert normal.lz76_of("ab" * 100_000) == 3
    assert normal.lz76_of("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200_000))) > 20_000
    assert time.time() - began < 30


def test_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(100):
        x = rng.integers(0, 3, int(rng.integers(1, 40))).astype(np.uint32)
        assert normal.suffixes(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_running_values(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 8, 9, 10, 101)] + [(None,)]
    df = spark.createDataFrame(rows, "x array<long>")
    sums = arrays.before(F.col("x"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    tops = arrays.before(F.col("x"), F.lit(5).cast("bigint"), lambda a, v: F.greatest(a, v))
    for r in df.select("x", sums.alias("s"), tops.alias("t")).collect():
        if r.x:
            assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]
            assert r.t == [max([5, *r.x[:i]]) for i in range(len(r.x))]


def test_reveal(spark):
    texts = {"a\u200bb": "a[ZWSP]b", "\ufe0f": "[VS16]", "\U000e0100": "[VS17]", "\U000e0041\U000e007f": "[TAG:A][TAG:CANCEL]", "\x00\x01\t": "[NUL][CTL:0x01]\t", "\u2420\ufdd1": "[PIC:SP][NON:01]", "plain": "plain", "": ""}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.out for r in df.select("text", reveal.revealed().alias("out")).collect()} == texts
    assert len(reveal.marks()) > 500
