import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import normal
from glyphlake.operators import macro, pairs, structure
from glyphlake.sources import ucd
from glyphlake.streaming import stream

SF = "/root/testdata/sf0.001"


def test_vectors():
    assert normal.nfkc_of("⓼") == "8" and normal.nfkc_of("＇") == "'"
    assert len(normal.nfkc_of("ﷺ")) == 18
    assert normal.skeleton_of("pаypal") == "paypal" and normal.skeleton_of("ẞ") == "ss"
    assert structure.bidi_of("⁦abc‬") == (0, 1, 1, 0, 0)
    assert structure.bidi_of("([)]") == (0, 0, 0, 0, 2)
    assert structure.decoded_of("%2522") == ('"', ["url", "url"])
    assert structure.decoded_of("a \\141\\u0062 CHAR(99) d") == ("a ab c d", ["escape", "octal", "call"])
    assert structure.decoded_of("see aGVsbG8gd29ybGQhISE= now") == ("see hello world!!! now", ["base64"])
    assert structure.decoded_of("%41" * 40)[0] == "A" * 40 and structure.decoded_of("\\ud800 chr(55296)") == ("\\ud800 chr(55296)", [])
    assert structure.decoded_of("%25" * 1 + "25" * 20 + "41")[1] == ["url"] * 22
    assert structure.bidi_of("\u3010a\u3011 \u2045b\u2046 \u300c\u300f") == (0, 0, 0, 0, 2)
    assert normal.lz76_of("") == 0 and normal.lz76_of("aaaa") == 2
    assert normal.punycode_of("xn--mnchen-3ya.de") == "münchen.de"


def test_hidden_html(spark):
    markup = '<div style="display: none">a<b>b</b><br>c</div><p>d</p><span class="sr-only" style="opacity:0">e</span><i style="opacity:0.5">f</i>'
    rows = structure.html_hidden(spark.createDataFrame([(1, markup), (2, None), (3, "<br>")], "page_id long, html string")).collect()
    assert [(r.vector, r.lineage, r.text) for r in rows] == [("layout", "div", "a"), ("layout", "div > b", "b"), ("layout", "div", "c")]
    assert structure.fis_score(structure.html_hidden(spark.createDataFrame([(1, markup)], "page_id long, html string"))).first().fis == 9


LONG_PAGE = "<p>" + "word & more &amp; words<br> " * 6000 + '</p></b><p style="display:none">x</p>'


def test_severity_of_a_long_page(spark):
    """What lies beyond 100,000 characters counts; the query adds its hidden text at the end of a page."""
    pages = spark.createDataFrame([(1, LONG_PAGE)], "page_id long, html string")
    assert [tuple(r) for r in structure.fis_score(structure.html_hidden(pages)).collect()] == [(1, 3)]


def test_ghosts_of_a_long_page(spark):
    pages = spark.createDataFrame([(1, LONG_PAGE)], "page_id long, html string")
    assert [tuple(r) for r in structure.ghost_text(structure.html_hidden(pages)).collect()] == [(1, "[layout: p] x", 1)]


@pytest.mark.parametrize("filler", ["<b>" * 40_000 + "</i>" * 40_000 + "</b>" * 40_000, "a" * 300_000, "<p>a</p>" * 50_000, "<!-- a -->" * 20_000])
def test_hidden_text_behind_long_markup(filler):
    assert structure.hidden_of(filler + '<p style="display:none">x</p>') == [("layout", "p", "x")]


def test_words_are_no_layer():
    for word in ("demereinheitlich", "Teerheitkeitlich", "eineinvereinlich", "einstacheinstach"):
        assert structure.decoded_of(f"in {word} den") == (f"in {word} den", [])
    assert structure.decoded_of("MTAwJSBzdXJlIGFib3V0IGl0") == ("100% sure about it", ["base64"])
    assert structure.decoded_of("YQlixaDwn5Go4oCN8J+RqSBjIGQgZSBm") == ("a\tb\u0160\U0001f468\u200d\U0001f469 c d e f", ["base64"])
    assert structure.decoded_of("10%deutsch %c3%a4%DF%41") == ("10%deutsch \u00e4%DFA", ["url"])


def test_numbers_are_no_layer():
    for run in ("2604566437487767", "7729240707442781", "2585452746673613"):
        assert structure.decoded_of(f"card {run}, paid") == (f"card {run}, paid", [])


def test_layers_of_odd_documents_are_the_oracle(spark, tmp_path):
    import duckdb
    from glyphlake.plans import registry

    texts = [None, "", "Thtion.", "12 bytes a\nb", "13 bytes a\nbc", "\u00c9aux.", "tab\there and\r\nthere", "zero\u200bwidth joiner\u00a0", "ein demereinheitlich Wort", "10%deutsch", "100% &amp;"]
    rows = [(i, t) for k, t in enumerate(texts) for i in (None, -1, -4, *range(4 * k, 4 * k + 4))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["sequential_deobfuscate"](spark, str(tmp_path)).select("doc_id", "plain", "layers")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(f"SELECT doc_id, plain, layers FROM ({registry.oracle_sql()['sequential_deobfuscate']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())


def test_topology():
    assert structure.topology_of('a,b;x\n"1,2",3\n=c,d,e') == {"delimiter": ",", "columns": 2, "ragged": 1, "injections": 1}
    assert structure.topology_of("plain")["delimiter"] is None


def test_bidi_and_layers_over_documents(spark):
    df = spark.createDataFrame([(1, "‮abc"), (2, None)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in structure.bidi_structure(df).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    assert structure.recursive_deobfuscate(df).count() == 2 and structure.topology(df).count() == 2


def test_pairs(spark):
    df = spark.createDataFrame([("pаypal", "paypal"), ("x", None), ("é", "é")], "suspect string, reference string")
    rows = pairs.compare_states(df).collect()
    assert (rows[0].same_raw, rows[0].same_skeleton) == (False, True)
    assert not rows[1].same_raw and rows[2].same_nfc
    got = pairs.skeleton_collisions(spark.createDataFrame([("pаy",), ("pay",), ("pay",), ("z",)], "token string")).collect()
    assert [(r.skeleton, len(r.forms)) for r in got] == [("pay", 2)]


def plain_segments(graphemes, n=10):
    t = len(graphemes)
    n = max(1, min(n, t))
    return [(i * t // n, (i + 1) * t // n) for i in range(n)] if t else []


@pytest.mark.parametrize("size", [0, 1, 3, 9, 10, 11, 17, 99, 100, 1001])
def test_segments(spark, size):
    df = spark.createDataFrame([(1, "a" * size)], "doc_id long, text string")
    rows = macro.segments(df).orderBy("seg").collect()
    assert [(r.start, r.end) for r in rows] == plain_segments("a" * size)


def test_runs(spark):
    df = spark.createDataFrame([(1, "aaa bb ccc dd"), (2, "a\r\nb"), (3, None)], "doc_id long, text string")
    whole = df.select("doc_id", macro.class_string().alias("cls"), F.lit(0).alias("seg"), F.lit(1).alias("n_seg"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("text").alias("part"))
    a, b = macro.metrics(whole.where("cls is not null")).orderBy("doc_id").collect()
    assert (a.mean_run, a.std_dev, a.median_run, a.mode_run, a.entropy) == (2.5, 0.5, 2.5, 3, 1.0)
    assert (b.volume, b.line_breaks, b.run_count) == (3, 1, 2)


def test_range_files(spark, tmp_path):
    p = tmp_path / "blocks.txt"
    p.write_text("# comment\n\n0000..007F; Basic Latin\n0080..00FF; Latin-1 Supplement # x\nbad; y\n")
    blocks = ucd.read_format(spark, str(p), "blocks")
    assert [tuple(r) for r in blocks.orderBy("lo").collect()] == [(0, 127, "Basic Latin"), (128, 255, "Latin-1 Supplement")]
    points = spark.createDataFrame([(65,), (200,), (300,)], "cp int")
    assert [r.block for r in ucd.lookup(points, blocks, "block", "none").orderBy("cp").collect()] == ["Basic Latin", "Latin-1 Supplement", "none"]
    p = tmp_path / "pairs.txt"
    p.write_text("0028; 0029; o # (\n003C; 003E; o\n")
    assert [tuple(r) for r in ucd.read_format(spark, str(p), "bidi_brackets").orderBy("lo").collect()] == [(40, 40, 41, "o"), (60, 60, 62, "o")]
    p = tmp_path / "seq.txt"
    p.write_text("KEYCAP; 0023 FE0F 20E3\n")
    assert ucd.read_sequences(spark, str(p)).first().seq == "#️⃣"
    p = tmp_path / "tab.txt"
    p.write_text("U+58F9\tkAccountingNumeric\t1\n")
    assert tuple(ucd.read_tabbed(spark, str(p)).first()) == (0x58F9, "kAccountingNumeric", "1")
    p = tmp_path / "list.json"
    p.write_text("[32, 33]")
    assert [r.cp for r in ucd.read_code_list(spark, str(p)).collect()] == [32, 33]


def test_confusables(spark):
    lines = ["# one", "(a) 0061 LATIN", "(а) 0430 CYRILLIC", "", "(b) 0062 LATIN", "(c) 0063 LATIN"]
    clusters = ucd.confusable_clusters(spark.createDataFrame(list(enumerate(lines)), "n int, value string"))
    assert {r.cp: r.others for r in ucd.inverse_confusables(clusters).collect()} == {97: ["U+0430"], 0x430: ["U+0061"], 98: ["U+0063"], 99: ["U+0062"]}
    assert [r.cp for r in ucd.ascii_risk_set(clusters).collect()] == [97]
    assert ucd.symmetric(spark.createDataFrame([(1, 2)], "a int, b int")).count() == 2


def test_stream_is_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "events")
    events.write.parquet(path)
    for name, f in (("tumbling", stream.tumbling), ("sliding", stream.sliding)):
        got = stream.run_available(spark, path, events.schema, lambda d, f=f: f(d, late="10000 days"), f"t_{name}", str(tmp_path / name), "complete")
        key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
        assert sorted(map(key, got.collect())) == sorted(map(key, f(events).collect()))
    assert stream.debounced(events).count() <= events.count()
    twice = stream.run_available(spark, path, events.schema, lambda d: stream.once_each(d.union(d), ["event_id"]), "t_once", str(tmp_path / "once"))
    assert twice.count() == events.count()


def test_functions_are_registered(spark):
    normal.register(spark)
    assert spark.sql("select nfkc('⓼') a, skeleton('pаy') b").first() == ("8", "pay")
    assert pd.isna(spark.sql("select nfkc(cast(null as string))").first()[0])


def test_atoms(spark):
    from glyphlake.operators import atoms

    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    df = spark.createDataFrame([(1, "a" + family + "e\u0301\r\nz"), (2, None), (3, "")], "doc_id long, text string")
    rows = atoms.graphemes(df).orderBy("g_idx").collect()
    assert [(r.n_cp, r.cp_start, r.unit_start) for r in rows] == [(1, 0, 0), (5, 1, 1), (2, 6, 9), (2, 8, 11), (1, 10, 13)]
    assert tuple(atoms.grapheme_profile(df.where("doc_id = 1")).first()) == (1, 5, 2, 3, 1, 1, 0.2)
    got = {r.encoding: r for r in atoms.encoding_coverage(spark.createDataFrame([(1, "a\u0430")], "doc_id long, text string")).collect()}
    assert (got["cp1251"].all_share, got["cp1252"].all_share, got["cp1252"].signal_share) == (1.0, 0.5, 0.0)
    assert len(got) == len(atoms.ENCODINGS)


def test_rows_only_queries(spark):
    from glyphlake.plans import registry

    for name, query in registry.ROWS_ONLY.items():
        assert query(spark, SF).count() > 0, name


def test_entry_without_the_llm_folder(tmp_path):
    """The rest imports when the subpackage is taken away."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/glyphlake", tmp_path / "glyphlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


def test_stream_of_versions(spark, tmp_path):
    path = str(tmp_path / "in")
    kind = "doc_id long, text string"
    for second in (None, "z"):
        spark.createDataFrame([(1, "x"), (2, second)], kind).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time
    got = stream.run_available(spark, path, kind, stream.changed, "versions", str(tmp_path / "state"), files=1)
    assert {(r.doc_id, r.version) for r in got.collect()} == {(1, 1), (2, 1), (2, 2)}
