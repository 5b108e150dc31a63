"""Scalar Arrow functions over texts where Spark has no built-in: normal forms, casefold, exact graphemes, complexity."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Enclosed digits that NFKC leaves, and the one-to-one confusables of Latin letters.
ENCLOSED = {chr(0x24F5 + i): str(i + 1) for i in range(9)}
CONFUSABLES = dict(zip("аеорсхуіѕј", "aeopcxyisj", strict=True))


def nfkc_of(text: str) -> str:
    return unicodedata.normalize("NFKC", "".join(ENCLOSED.get(c, c) for c in text))


def skeleton_of(text: str) -> str:
    """Confusables mapped, default ignorables dropped, over the casefolded compatibility form."""
    return "".join(CONFUSABLES.get(c, c) for c in nfkc_of(text).casefold() if unicodedata.category(c) != "Cf")


def _column(function, kind: T.DataType = T.StringType()):  # noqa: B008
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(function, na_action="ignore")

    return run


nfc = _column(lambda t: unicodedata.normalize("NFC", t))
nfd = _column(lambda t: unicodedata.normalize("NFD", t))
nfkc = _column(nfkc_of)
nfkc_casefold = _column(lambda t: nfkc_of(t).casefold())
skeleton = _column(skeleton_of)


def suffixes(codes: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling the length that is compared."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


def _common(codes: np.ndarray, a: int, b: int) -> int:
    """Length of the common start of the suffixes at a and b (a before b)."""
    at, step, n = 0, 16, len(codes)
    while b + at < n:
        m = min(step, n - b - at)
        differ = codes[a + at : a + at + m] != codes[b + at : b + at + m]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + m, 4 * step
    return at


def lz76_of(text: str) -> int:
    """Number of phrases of the Lempel-Ziv 1976 parsing: each is the longest part that began before, and one character.

    The longest earlier part of a place is one of its two neighbours in suffix order that lie before it, so the parsing takes
    a sort of the suffixes and then linear time.
    """
    if not text:
        return 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    before, after, stack = [-1] * n, [-1] * n, []
    for i in suffixes(codes).tolist():
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    phrases = at = 0
    while at < n:
        phrases += 1
        at += 1 + max((_common(codes, j, at) for j in (before[at], after[at]) if j >= 0), default=0)
    return phrases


lz_complexity = _column(lz76_of, T.LongType())


def punycode_of(token: str) -> str | None:
    try:
        return ".".join(p[4:].encode().decode("punycode") if p.startswith("xn--") else p for p in token.split("."))
    except (UnicodeError, ValueError):
        return None


punycode = _column(punycode_of)


@F.pandas_udf(T.DoubleType())
def containment(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of b that matches a in order (0 to 100); null if either is null."""
    return pd.Series([None if x is None or y is None else 100.0 * sum(m.size for m in difflib.SequenceMatcher(None, x, y, False).get_matching_blocks()) / max(1, len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def register(spark) -> None:
    """The functions by name, for SQL."""
    for name in ("nfc", "nfd", "nfkc", "nfkc_casefold", "skeleton", "lz_complexity", "punycode", "containment"):
        spark.udf.register(name, globals()[name])
