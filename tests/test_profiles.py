"""Operators on clusters, snapshots, exports and data files, on literal texts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from glyphlake.operators import dimensions, profiles
from glyphlake.sources import snapshot, ucd


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_partition():
    assert profiles.partition_of("a + b = \U0001f680 ™ ™️ 1️⃣ \U0001f1fa\U0001f1f8") == (2, 1, 4)
    assert profiles.partition_of("") == (0, 0, 0)


def test_stacks_and_components(spark):
    docs = texts(spark, "é\U0001f600", None, "", "é")
    got = {r.g: (r.n, r.scalars, r.utf16, r.utf8) for r in profiles.encoding_stacks(docs).collect()}
    assert got == {"é": (2, "U+0065 U+0301", "00650301", "65CC81"), "\U0001f600": (1, "U+1F600", "D83DDE00", "F09F9880")}
    assert [(r.k, r.cp, r.category, r.ccc) for r in profiles.components(docs).orderBy("k").collect()] == [(0, "U+0065", "Ll", 0), (1, "U+0301", "Mn", 230)]


def test_snapshots(spark, tmp_path):
    rows = [
        {"doc_id": 1, "grapheme_list": list("abcdefghijkl"), "grapheme_lengths_codepoints": [2] + [1] * 11, "forensic_flags": {"Bidi Control (UAX #9)": {"count": 2, "positions": ["#1", "#12 note"]}, "Prop: Dash": {"count": 1, "positions": ["#3"]}, "Other": {"count": 3, "positions": ["#1", "x", "4"]}, "None": {"count": 0, "positions": ["#5"]}}},
        {"doc_id": 2, "grapheme_list": [], "grapheme_lengths_codepoints": []},
        {"doc_id": 3, "grapheme_list": ["a"], "grapheme_lengths_codepoints": [1]},
    ]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    snaps = snapshot.read_snapshots(spark, str(tmp_path / "s.json"))
    assert {(r.flag, r.place) for r in snapshot.flag_places(snaps).collect()} == {("Bidi Control (UAX #9)", 1), ("Bidi Control (UAX #9)", 12), ("Other", 1), ("Other", 4)}
    got = {(r.doc_id, r.seg): (r.cp_start, r.cp_end, r.threats_all, r.threats_critical) for r in snapshot.segment_threats(snaps).collect()}
    assert len(got) == 11 and got[3, 0] == (0, 1, 0, 0)
    assert got[1, 0] == (0, 2, 1, 1) and got[1, 9] == (11, 13, 1, 1)
    assert sum(v[2] for k, v in got.items() if k[0] == 1) == 3


def test_exports(spark, tmp_path):
    lines = spark.createDataFrame([(1, "shape", 2, "two"), (1, "shape", 1, "one"), (1, "stats", 3, "three")], "doc_id long, section string, line_no int, line string")
    snapshot.write_report(lines, str(tmp_path / "all"))
    snapshot.write_report(lines, str(tmp_path / "one"), "shape")
    read = lambda n: "\n".join(p.read_text() for p in sorted((tmp_path / n).glob("part-*.txt")) if p.read_text()).strip()
    assert read("all") == "one\ntwo\nthree" and read("one") == "one\ntwo"
    inverse = spark.createDataFrame([(97, ["U+0430"]), (1072, ["U+0061"])], "cp int, others array<string>")
    snapshot.write_confusable_maps(inverse, spark.createDataFrame([(98,), (97,), (97,)], "cp int"), str(tmp_path / "maps"))
    assert json.loads(read("maps/inverse_confusables")) == {"97": ["U+0430"], "1072": ["U+0061"]}
    assert json.loads(read("maps/ascii_confusables")) == [97, 98]
    snapshot.write_json(lines, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def file(tmp_path, text):
    path = tmp_path / "f.txt"
    path.write_text("# comment\n\n" + text)
    return str(path)


def test_readers(spark, tmp_path):
    got = ucd.read_confusables(spark, file(tmp_path, "0430 ; 0061 ; MA # x\n1D400 ; 0041 0042 ; ML\nbad line\n")).collect()
    assert [tuple(r) for r in got] == [("а", "a", "MA"), ("\U0001d400", "AB", "ML")]
    got = ucd.read_standardized_variants(spark, file(tmp_path, "0030 FE00; short diagonal stroke form; # zero\n")).collect()
    assert [tuple(r) for r in got] == [("0︀", "short diagonal stroke form")]
    got = ucd.read_format(spark, file(tmp_path, "00DF ; deviation ; 0073 0073 # ss\n2F00..2FD5 ; valid ; ; NV8\n"), "idna").collect()
    assert [(r.lo, r.hi, r.status, r.extra) for r in got] == [(0xDF, 0xDF, "deviation", None), (0x2F00, 0x2FD5, "valid", "NV8")]


def test_ages_runs_and_identifiers(spark, tmp_path):
    ages = ucd.read_format(spark, file(tmp_path, "0000..007F ; 1.1\n1F600 ; 6.1\n1FAE8 ; 15.0\n200D ; 1.1\n"), "ages")
    docs = texts(spark, "ab\U0001fae8", "\U0001f600‍\U0001fae8", "б", None)
    got = {(r.doc_id, r.age): (r.n, r.anomaly) for r in profiles.age_profile(docs, ages).collect()}
    assert got == {(0, "1.1"): (2, False), (0, "15.0"): (1, True), (1, "6.1"): (1, False), (1, "1.1"): (1, False), (1, "15.0"): (1, True), (2, "unassigned"): (1, False)}
    assert [(r.doc_id, round(r.gradient, 6)) for r in profiles.emoji_age_gradient(docs, ages).collect()] == [(1, 13.9)]
    vo = ucd.read_format(spark, file(tmp_path, "0061..0062 ; R\n4E00..9FFF ; U\n"), "vertical_orientation")
    got = {r.vo: (r.runs, r.longest) for r in dimensions.runs_by(texts(spark, "ab一丁a"), vo, "vo", "R").collect()}
    assert got == {"R": (2, 2), "U": (1, 2)}
    allowed = ucd.read_format(spark, file(tmp_path, "0061..007A ; Allowed\n"), "identifier_status")
    assert [(r.ch, r.n) for r in dimensions.restricted(texts(spark, "aаа"), allowed).collect()] == [("а", 2)]
    names = spark.createDataFrame([(97,), (98,)], "cp int")
    table = spark.createDataFrame([(97, 97, "from the table")], "lo int, hi int, name string")
    got = dimensions.with_fallback(names, table, "name", lambda c: F.concat(F.lit("runtime "), c))
    assert {r.cp: r.name for r in got.collect()} == {97: "from the table", 98: "runtime b"}


def test_unlisted_sequences(spark):
    docs = texts(spark, "0︀x︀", "葛\U000e0100", "\U0001f468‍\U0001f469 \U0001f468‍\U0001f680")
    variants = spark.createDataFrame([("0︀",)], "seq string")
    assert [r.seq for r in profiles.unlisted(docs, profiles.SELECTED, variants).collect()] == ["x︀"]
    assert profiles.unlisted(docs, profiles.IDEOGRAPHIC, variants.limit(0)).count() == 1
    known = spark.createDataFrame([("\U0001f468‍\U0001f680",)], "seq string")
    assert [r.seq for r in profiles.unlisted(docs, profiles.JOINED, known).collect()] == ["\U0001f468‍\U0001f469"]


def test_idna_verdicts(spark, tmp_path):
    idna = ucd.read_format(spark, file(tmp_path, "00DF ; deviation ; 0073\n00AD ; ignored\n2F00..2FD5 ; valid ; ; NV8\n00E0..00FF ; valid\n"), "idna")
    labels = spark.createDataFrame([("fuß",), ("a­b",), ("⼀",), ("café",), ("plain-1",), ("͸",), ("fuß͸",)], "label string")
    assert {r.label: r.verdict for r in profiles.idna_verdicts(labels, idna).collect()} == {"fuß": "AMBIGUITY", "a­b": "GHOST", "⼀": "COMPAT", "café": "VALID", "plain-1": "VALID", "͸": "INVALID", "fuß͸": "INVALID"}


def test_lookalikes(spark):
    inverse = spark.createDataFrame([(97, ["U+0430"])], "cp int, others array<string>")
    assert [tuple(r) for r in profiles.lookalikes(texts(spark, "banana", "x"), inverse).collect()] == [(0, "a", 3, ["U+0430"])]
