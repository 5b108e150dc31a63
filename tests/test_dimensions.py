"""Operators on tables of Unicode data, with small files in the public formats."""

from __future__ import annotations

from pyspark.sql import Row

from glyphlake.operators import dimensions
from glyphlake.sources import ucd


def test_dimensions(spark, tmp_path):
    blocks, mirrors, names = tmp_path / "blocks", tmp_path / "mirrors", tmp_path / "names"
    blocks.write_text("# blocks\n0000..007F; Basic Latin\n0400..04FF; Cyrillic\n")
    mirrors.write_text("0028; 0029 # LEFT\n0029; 0028 # RIGHT\n")
    names.write_text("# names\nKEYCAP NUMBER SIGN;0023 FE0F 20E3\n")
    docs = spark.createDataFrame([Row(doc_id=1, text="a(аа #️⃣"), Row(doc_id=2, text=None), Row(doc_id=3, text="")])

    found = dimensions.counts_by(docs, ucd.read_format(spark, str(blocks), "blocks"), "block", "No_Block")
    assert {(r.doc_id, r.block, r.n) for r in found.collect()} == {(1, "Basic Latin", 4), (1, "Cyrillic", 2), (1, "No_Block", 2)}

    found = dimensions.mirrored(docs, ucd.read_format(spark, str(mirrors), "bidi_mirroring"))
    assert [tuple(r) for r in found.collect()] == [(1, "(", ")", 1)]

    found = dimensions.sequences(docs, ucd.read_sequences(spark, str(names)))
    assert [tuple(r) for r in found.collect()] == [(1, "KEYCAP NUMBER SIGN", 1)]

    found = dimensions.members(docs, spark.createDataFrame([(0x430,), (0x430,), (0x41,)], "cp int"))
    assert [tuple(r) for r in found.collect()] == [(1, "а", 2)]
    assert dimensions.members(docs.limit(0), spark.createDataFrame([], "cp int")).count() == 0
