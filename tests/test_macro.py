"""Macrostructure on literal texts."""

from __future__ import annotations

import regex
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import chars
from glyphlake.operators import catalog, macro

FAMILY = "\U0001f468\u200d\U0001f469\u200d\U0001f467\u200d\U0001f466"


def of(spark, text, f):
    rows = f(macro.metrics(macro.segments(spark.createDataFrame([(1, text)], "doc_id long, text string"))))
    return rows.orderBy("seg").collect()


def plain_threats(text, flags):
    """For each segment the distinct code points of flags between its first and last grapheme."""
    g = regex.findall(r"\X", text)
    n = min(10, len(g))
    classes = [regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: regex.escape(chr(int(m[1], 16))), chars.FLAGS[k][1])) for k in flags]
    return [sum(any(p.fullmatch(c) for p in classes) for c in "".join(g[i * len(g) // n : (i + 1) * len(g) // n])) for i in range(n)]


@pytest.mark.parametrize("text", ["a" * 5 + FAMILY + "b" * 30, "\u202e", "x(y) [z]\u00a0\u00ad" * 9, "e\u0301\u200b" * 25 + "\U000e0041", "\x00\ufffd\u2028" * 4 + "ok"])
def test_threats_are_places_of_flags(spark, text):
    rows = of(spark, text, lambda m: m)
    assert [r.threats_all for r in rows] == plain_threats(text, macro.THREATS)
    assert [r.threats_critical for r in rows] == plain_threats(text, macro.CRITICAL)
    assert sum(r.volume for r in rows) == len(regex.findall(r"\X", text))


def test_critical_inside_a_cluster(spark):
    rows = of(spark, "a" * 40 + FAMILY + "b" * 59, macro.anomalies)
    assert [r.heatmap for r in rows].count("heatmap-critical") == 1
    assert of(spark, "\u202e", macro.anomalies)[0].heatmap == "heatmap-critical"


def test_small_texts_by_all_graphemes(spark):
    """Below 100 graphemes nothing is unusual; blanks count too."""
    short, long = "a" * 50 + " " * 49, "a" * 60 + " " * 60
    assert {r.heatmap for r in of(spark, short, macro.anomalies)} == {"heatmap-normal"}
    assert {r.heatmap for r in of(spark, long, macro.anomalies)} != {"heatmap-normal"}
    assert of(spark, long, lambda m: m)[0].volume == 12


def test_heat_is_of_the_tables_columns(spark):
    rows = of(spark, "aaa bb\n" * 20 + "c" * 60, macro.heat)
    assert {r.max_line_breaks for r in rows} == {3.0}
    assert rows[-1].opacity_line_breaks is None and rows[-1].opacity_vol_16 == pytest.approx(0.5)
    assert rows[0].max_vol_16 == pytest.approx(100.0)


def test_empty_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a")], "doc_id long, text string")
    assert {r.doc_id: r.error for r in macro.errors(df).collect()} == {1: "No graphemes to analyze.", 2: "No graphemes to analyze.", 3: None}
    assert macro.segments(df).count() == 1


def test_token_fracture(spark):
    texts = {"sens\U0001f60eitive": True, "sys\u200btem": True, "print\U0001f680data": True, "b\U0001f525omb": True, "file.txt": False, "a b": False, "ok \U0001f60e fine": False, "a\U000e0041b": True}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.hit for r in df.select("text", F.col("text").rlike(catalog.FRACTURE).alias("hit")).collect()} == texts
