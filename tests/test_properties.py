"""Properties of characters against literal vectors, and every rows-only query on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from glyphlake.functions import props
from glyphlake.operators import atoms, ordered, properties, structure
from glyphlake.operators.pairs import audit
from glyphlake.plans import registry

SF = "/root/testdata/sf0.001"


def test_runs_of_a_property():
    assert properties.runs_of("don't", "major") == {"L": (2, 3, 4), "P": (1, 1, 1)}
    assert properties.runs_of("don't a1", "linebreak") == {"AL": (3, 3, 5), "QU": (1, 1, 1), "SP": (1, 1, 1), "NU": (1, 1, 1)}
    assert properties.runs_of("", "bidi") == {}


def test_flags_and_effects():
    assert "bidi_mirrored" in props.flags_of("(")
    assert "unassigned" in props.flags_of("͸")
    assert {"compatibility_decomposition", "changes_on_nfkc_casefold"} <= set(props.flags_of("ﬁ"))
    assert "composition_excluded" in props.flags_of("क़")
    assert {"case_expansion", "case_to_ascii"} <= set(props.effects_of("ß"))
    assert "syntax_predator" in props.effects_of("＇")
    assert "bomb" in props.effects_of("ﷺ")
    assert "ascii_compression" in props.effects_of("㏅")


def test_marks():
    assert properties.marks_of("x" + "̀" * 31)[:3] == (1, 30, 30)
    assert properties.marks_of("x" + "̀" * 30)[0] == 0
    assert properties.marks_of("éa") == (0, 0, 0, 1)
    assert properties.marks_of("plain") == (0, 0, 0, 0)


def test_numbers():
    assert properties.numeric_of("12½٣") == (6.5, 3, 2)
    assert properties.numeric_of("") == (0.0, 0, 0)


def test_emoji():
    family, lone, key = properties.emoji_of("a\U0001f468‍\U0001f469 \U0001f1fa x⃣")
    assert (family["kind"], family["parts"], family["qualification"]) == ("sequence", "BASE + ZWJ + BASE", "fully")
    assert (lone["diagnosis"], lone["kind"]) == ("fragment", "component")
    assert key["parts"] == "BASE + KEYCAP"
    assert properties.emoji_of("plain 1") == []


def test_identifiers_and_scripts():
    assert [properties.identifier_of(t) for t in ("abc", "аbc", "中文a", "1a")] == ["allowed", "restricted", "allowed", "restricted"]
    assert properties.script_of_text("xा") == (1, 0, 0, 0)
    assert properties.script_of_text("क् ") == (0, 1, 0, 0)


def test_frames_with_nulls(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="á("), Row(doc_id=2, text=None), Row(doc_id=3, text="")])
    assert {(r.doc_id, r.value) for r in properties.property_runs(docs, ("minor",)).collect()} == {(1, "Ll"), (1, "Mn"), (1, "Ps")}
    assert {(r.flag, r.n) for r in properties.property_flags(docs).collect()} >= {("bidi_mirrored", 1)}
    assert {(r.ch, r.category, r.n) for r in properties.atlas(docs).collect()} == {("a", "Ll", 1), ("́", "Mn", 1), ("(", "Ps", 1)}
    assert properties.mark_structure(docs).count() == 3
    assert properties.emoji(docs).count() == 0
    for operator, _ in ordered.ORDERED.values():
        operator(docs).collect()


def test_escapes_and_payload(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="a'‮\U0001f4a9" + "\U000e0068\U000e0069")])
    assert ordered.escape_js(docs).first().literal == "a\\'\\u202E\\u{1F4A9}\\u{E0068}\\u{E0069}"
    assert eval(f"'{ordered.escape_python(docs).first().literal}'") == docs.first().text
    assert ordered.tag_payload(docs).first().payload == "hi"


def test_entropy_jump(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="a" * 256 + "".join(chr(33 + i % 90) for i in range(256)))])
    assert [r.transition for r in ordered.entropy_windows(docs).orderBy("win").collect()] == [False, True]
    assert ordered.entropy_zoom(docs).count() == 4


def test_pair_audit(spark):
    pairs = spark.createDataFrame([Row(suspect="p\u0430ypal\u200b 12", reference="paypal 21"), Row(suspect=None, reference="a")])
    bad = audit(pairs).where("suspect is not null").first()
    assert (bad.hot_zone, bad.numbers_differ, bad.residual_hidden, bad.profile_lock, bad.reference_poisoned) == ("paypal ", False, 1, True, False)


def test_drift_encodings_bytes(spark):
    text = "\n".join(["a,1"] * 19 + ["b,x"])
    assert structure.drifts_of(text) == [{"col": 1, "type": "number", "exceptions": 1}]
    docs = spark.createDataFrame([Row(doc_id=1, text="abc"), Row(doc_id=2, text="a\u1E9E\U0001F468"), Row(doc_id=3, text=None)])
    rows = {r.doc_id: r for r in atoms.encoding_evidence(docs).collect()}
    assert rows[1].pure_ascii and rows[1].nowhere == 0 and not rows[2].pure_ascii and set(rows) == {1, 2}
    blobs = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xed\xa0\x80"))], "id long, raw binary")
    assert {(r.id, r.utf8, r.surrogates) for r in atoms.valid_bytes(blobs).collect()} == {(1, True, 0), (2, False, 1)}


@pytest.mark.parametrize("name", sorted(registry.PROPERTIES))
def test_property_queries(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
