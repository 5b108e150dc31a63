"""The randomness battery and its thresholds against plain Python."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

from glyphlake.llm import secrets


def normal_cdf(z):
    return 1 / (1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))


def chi_z(x, k):
    v = 2 / (9 * k)
    return ((max(x, 0.0) / k) ** (1 / 3) - (1 - v)) / math.sqrt(v)


def battery(token):
    """Kind and p by the definitions of the three tests."""
    import re

    if not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return None
    body = token.rstrip("=")
    for name, pattern, alphabet in secrets.ALPHABETS:
        if re.fullmatch(pattern[1:-1], token):
            break
    else:
        return None
    if len(body) < 2:
        return None
    x, m, n = [alphabet.index(c) for c in body], len(alphabet), len(body)
    expected = n / m
    chi = chi_z(sum((Counter(x)[k] - expected) ** 2 / expected for k in range(m)), m - 1)
    high = [2 * v >= m for v in x]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 2 * sum(high) * (n - sum(high)) / n + 1
    run_z = (runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 0.05))
    average = sum(x) / n
    variance = max(sum((v - average) ** 2 for v in x), 1e-9)
    serial = sum((a - average) * (b - average) for a, b in zip(x, x[1:], strict=False)) / variance * math.sqrt(n)
    total = max(chi, 0) ** 2 + run_z**2 + serial**2
    return f"{name}:{math.floor(math.log2(n) * 2)}", 1 - normal_cdf(max(min(chi_z(total, 3), 8), -8))


def tokens(rng, n):
    sets = [a for _, _, a in secrets.ALPHABETS]
    words = ["Section", "chapter", "value", "THE", "of", "item", "2024", "x1"]
    for _ in range(n):
        if rng.random() < 0.5:
            yield "".join(rng.choices(rng.choice(sets), k=rng.randrange(20, 90)))
        else:
            yield "".join(rng.choices(words, k=rng.randrange(6, 12))) + str(rng.randrange(10))


def test_battery_and_thresholds(spark):
    rng = random.Random(4)
    texts = [" ".join(tokens(rng, rng.randrange(1, 6))) for _ in range(500)]
    rows = secrets._scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id").cache()
    found = {}
    for r in rows.collect():
        for c in r._secret_c:
            token = texts[r.doc_id][c.start : c.end]
            kind, p = battery(token)
            assert c.kind == kind and abs(c.p - p) < 1e-9, token
            found[token] = c.kind, c.p
    assert len(found) > 800
    bins, size = defaultdict(Counter), Counter()
    for kind, p in found.values():
        for name in (kind, kind.split(":")[0], "all"):
            bins[name][min(int(p * 20), 19)] += 1
            size[name] += 1
    want = {}
    for kind in {k for k, _ in found.values()}:
        name = kind if size[kind] >= 40 else kind.split(":")[0] if size[kind.split(":")[0]] >= 40 else "all"
        b = bins[name]
        fine = []
        for k in range(1, 20):
            above, ideal = sum(b[j] for j in range(k, 20)), 2 * sum(b[j] for j in range(10, 20))
            if b[k] and ideal and 20 * above - ideal * (20 - k) <= above:  # a share of 1 / 20
                fine.append(k / 20)
        if fine:
            want[kind] = min(fine)
    assert secrets.thresholds(rows) == want
    got = {r.doc_id: r.spans for r in secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for r in rows.collect():
        spans = [f"random:{c.start}:{c.end}" for c in r._secret_c if c.p >= want.get(c.kind, 2)]
        assert set(spans) <= set(got[r.doc_id].split(","))


def test_copies_of_a_token_do_not_move_the_limit(spark):
    rng = random.Random(6)
    letters = secrets.ALPHABETS[4][2]
    keys = ["".join(rng.choices(letters, k=39)) + "a1" for _ in range(120)]
    texts = [f"see {k} here" for k in keys]
    once = secrets.thresholds(secrets._scan(spark.createDataFrame([(t,) for t in texts], "text string"), "text"))
    often = secrets.thresholds(secrets._scan(spark.createDataFrame([(t,) for t in texts + texts[:1] * 300], "text string"), "text"))
    assert once == often


def test_many_matches_in_one_text(spark):
    """Time grows little more than the number of matches; positions and redaction hold."""
    rng = random.Random(7)
    letters = secrets.ALPHABETS[4][2]
    keys = ["".join(rng.choices(letters, k=29)) + "a1" for _ in range(8000)]
    text = " ".join(f"token={k}" if i % 4 == 0 else k for i, k in enumerate(keys))
    docs = spark.createDataFrame([(1, text, 1, 2, 3)], "doc_id long, text string, c long, _secret long, at long")
    began = time.time()
    r = secrets.scanned(docs).collect()[0]
    assert r.n_assign == 2000
    assert r.spans.count("random") > 5000
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    left = out.collect()[0]
    assert time.time() - began < 40
    assert (left.c, left._secret, left.at) == (1, 2, 3)
    spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in r.spans.split(",")))
    want, at = [], 0
    for a, b in spans:
        if a >= at:
            want.append(text[at:a] + "[secret]")
        at = max(at, b)
    assert left.text == "".join(want) + text[at:]
