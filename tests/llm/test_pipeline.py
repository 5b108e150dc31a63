"""The pipeline's stages one after another, each against a plain version on what it was given, and on odd tables."""

from __future__ import annotations

import corpus_pipeline
from glyphlake.llm import mixing, packing, secrets, toxicity

from .test_dedup import roots
from .test_operators import ODD, SCHEMA, SF, check_packing


def stages(spark, docs, sf_dir, path):
    """What each stage is given and gives, written and read as the pipeline does."""
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{path}/{name}")
        out = spark.read.parquet(f"{path}/{name}")
        yield name, docs, out
        docs = out


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "FILE_SIZE", 1 << 17)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, given, out in stages(spark, docs, SF, str(tmp_path)):
        found[name] = given, out
        if name != "packing":
            assert out.columns == docs.columns
    assert list(found) == ["toxicity", "simhash_dedup", "secret_scan", "mixing", "packing"]

    given, out = found["toxicity"]
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in given.collect() if toxicity.score(r.text, model) < 0.5}
    assert {r.doc_id for r in out.collect()} == want

    given, out = found["simhash_dedup"]
    rows = sorted(given.collect(), key=lambda r: r.doc_id)
    best = {rows[k].doc_id for k in set(roots([r.text for r in rows]))}
    kept = {r.doc_id for r in out.collect()}
    assert best <= kept and len(kept - best) <= 1

    given, out = found["secret_scan"]
    texts = {r.doc_id: r.text for r in given.collect()}
    new = {r.doc_id: r.text for r in out.collect()}
    assert set(new) == set(texts)
    for r in secrets.scanned(given).collect():
        text, at, want = texts[r.doc_id], 0, []
        for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in filter(None, r.spans.split(",")))):
            if a >= at:
                want.append(text[at:a] + "[secret]")
            at = max(at, b)
        assert new[r.doc_id] == "".join(want) + text[at:]

    given, out = found["mixing"]
    assert sorted(map(str, given.collect())) == sorted(map(str, out.collect()))
    files = sorted((tmp_path / "mixing").glob("*.parquet"))
    assert len(files) > 3
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(given).collect()}
    order = [[place[r.doc_id] for r in spark.read.parquet(str(f)).coalesce(1).collect()] for f in files]
    assert sum(order, []) == sorted(place.values())

    given, out = found["packing"]
    rows = [r.asDict() for r in out.collect()]
    check_packing(rows, {r.doc_id: r.text for r in given.collect()})
    # Sequences hold documents of one file, and their ids follow the files.
    number = {p: k for k, part in enumerate(order) for p in part}
    runs = {}
    for r in rows:
        runs.setdefault(r["sequence_id"] // packing.STRETCH_IDS, set()).add(number[place[r["doc_id"]]])
    assert all(len(x) == 1 for x in runs.values()) and [min(runs[k]) for k in sorted(runs)] == sorted(min(x) for x in runs.values())


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in rows}) > 100
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) == max(a + n for a, n in parts) <= packing.CAPACITY for parts in whole.values())


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    names = ["slot", "place", "block", "_n", "c", "key", "root", "_stretch", "sequence_id"]
    odd = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *(f"{k} AS `{n}`" for k, n in enumerate(names) if n != "_stretch"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, toxic int")
    for docs, folder in ((odd, "odd"), (odd.limit(0), "none")):
        sf = str(tmp_path / folder)
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for name, given, out in stages(spark, docs, sf, f"{sf}/out"):
            if name != "packing":
                assert out.columns == docs.columns, name
            elif folder == "none":
                assert out.count() == 0
            else:
                # Three texts without words are one group, as are the three equal ones; every other document is there.
                assert sorted({r.doc_id for r in out.collect()}, key=str) == sorted({1, 4, 5, 7, None}, key=str)
