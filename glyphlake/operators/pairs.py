"""Pairwise verification: pairs(suspect, reference), and candidate pairs by equal skeletons."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import normal


def compare_states(pairs: DataFrame) -> DataFrame:
    """Equality of the raw, NFC, NFKC and skeleton states, containment and whitespace differences, beside the pair."""
    out = pairs
    for name, f in (("raw", lambda c: F.col(c)), ("nfc", normal.nfc), ("nfkc", normal.nfkc), ("skeleton", normal.skeleton)):
        out = out.withColumn(f"same_{name}", F.coalesce(f("suspect") == f("reference"), F.lit(False)))
    out = out.withColumn("containment", normal.containment("reference", "suspect"))
    verdict = F.when(F.col("containment") >= 100, "target lock").when(F.col("containment") > 0, "partial").otherwise("distinct")
    return out.withColumn("verdict", verdict).withColumn("inflation", F.length(normal.nfkc("suspect")) / F.greatest(F.length("suspect"), F.lit(1)))


#: Order of risk of a text's alphabet.
_ALPHABETS = (("mixed", r"(?s)(?=.*\p{IsLatin})(?=.*[\p{IsCyrillic}\p{IsGreek}]).*"), ("beyond", r"(?s).*[^\x{0000}-\x{007F}].*"))
_HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{E0000}-\x{E007F}]"


def _risk(c: str) -> F.Column:
    return F.when(F.rlike(F.col(c), F.lit(_ALPHABETS[0][1])), 2).when(F.rlike(F.col(c), F.lit(_ALPHABETS[1][1])), 1).otherwise(0)


def audit(pairs: DataFrame) -> DataFrame:
    """The longest part that the skeletons share, what lies around it, and audits of numbers, spaces, alphabets and the reference itself."""

    @F.pandas_udf("hot_zone string, before long, after long")
    def zone(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            x, y = x or "", y or ""
            m = difflib.SequenceMatcher(None, x, y, False).find_longest_match()
            rows.append((x[m.a : m.a + m.size], m.a, len(x) - m.a - m.size))
        return pd.DataFrame(rows, columns=["hot_zone", "before", "after"])

    numbers = lambda c: F.aggregate(F.regexp_extract_all(F.col(c), F.lit(r"([0-9])"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    spaces = lambda c: F.regexp_count(F.col(c), F.lit(r"\x{00A0}"))
    out = pairs.withColumn("zone", zone(normal.skeleton("suspect"), normal.skeleton("reference"))).select(*pairs.columns, "zone.*")
    return (
        out.withColumn("numbers_differ", numbers("suspect") != numbers("reference")).withColumn("spaces_differ", spaces("suspect") != spaces("reference"))
        .withColumn("residual_hidden", F.regexp_count("suspect", F.lit(_HIDDEN)).cast("long")).withColumn("profile_lock", _risk("suspect") > _risk("reference"))
        .withColumn("reference_poisoned", F.coalesce(F.rlike(F.col("reference"), F.lit(_HIDDEN)), F.lit(False)))
    )


def skeleton_collisions(tokens: DataFrame) -> DataFrame:
    """skeleton, forms: distinct tokens(token) with one skeleton; the skeleton is computed once for each distinct token."""
    once = tokens.select("token").distinct().withColumn("skeleton", normal.skeleton("token"))
    return once.groupBy("skeleton").agg(F.array_sort(F.collect_set("token")).alias("forms")).where(F.size("forms") > 1)
