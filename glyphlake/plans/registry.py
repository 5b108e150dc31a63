"""Names, queries and oracles of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from glyphlake.functions import normal, reveal
from glyphlake.operators import atoms, catalog, macro, measures, ordered, pairs, profiles, properties, structure
from glyphlake.plans import oracles
from glyphlake.plans.template import oracle, spark_query
from glyphlake.sources import snapshot
from glyphlake.sources.tables import PERTURBED, perturbed, read
from glyphlake.streaming import stream

CATALOG, TABLES = catalog.CATALOG | measures.MEASURES, catalog.TABLES | measures.TABLES


def pdocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturbed(spark, sf_dir).select("doc_id", "text")


def macro_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.metrics(macro.segments(pdocs(spark, sf_dir))).drop("runs", "vals", "counts")


def macro_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.densities(macro.metrics(macro.segments(pdocs(spark, sf_dir))))


def macro_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.bins(macro.metrics(macro.segments(pdocs(spark, sf_dir))))


def macro_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.anomalies(macro.metrics(macro.segments(pdocs(spark, sf_dir))))


def _of_metrics(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(macro.metrics(macro.segments(pdocs(spark, sf_dir))))


def macro_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.slices(pdocs(spark, sf_dir))


MACRO = {f.__name__: f for f in (macro_segments, macro_densities, macro_bins, macro_anomalies, macro_slices)}
MACRO |= {
    "macro_global_stats": _of_metrics(macro.whole_runs), "macro_bin_shares": _of_metrics(macro.shares), "macro_global_bins": _of_metrics(macro.whole_bins),
    "macro_errors": lambda spark, sf_dir: macro.errors(pdocs(spark, sf_dir)), "macro_heat": _of_metrics(macro.heat), "macro_sparklines": _of_metrics(macro.sparklines), "macro_labels": _of_metrics(macro.labels),
}
_BINS = ", ".join(f"CAST(len(list_filter(runs, lambda v: least(v, 16) = {i})) AS BIGINT) AS {n}, CAST(coalesce(list_sum(list_filter(runs, lambda v: least(v, 16) = {i})), 0) AS BIGINT) AS {n.replace('bin', 'vol')}" for i, n in enumerate(macro.BIN_NAMES, 1))
_SQUARES = " + ".join(f"CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN pow(({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w, 2) ELSE 0 END" for c in macro.SCORED)
MACRO_SQL = {
    "macro_segments": f"WITH {macro.SQL_METRICS} SELECT * EXCLUDE (runs) FROM m",
    "macro_densities": f"WITH {macro.SQL_METRICS} SELECT * FROM d",
    "macro_bins": f"WITH {macro.SQL_METRICS} SELECT doc_id, seg, {_BINS} FROM m",
    "macro_anomalies": f"""WITH {macro.SQL_METRICS},
 a AS (SELECT doc_id, seg, threats_critical, sum(volume) OVER w AS total, sqrt({_SQUARES}) AS score FROM m JOIN (SELECT doc_id, seg, content_density_pct, gap_density_pct FROM d) USING (doc_id, seg) WINDOW w AS (PARTITION BY doc_id))
 SELECT doc_id, seg, score, 'heatmap-' || CASE WHEN threats_critical > 0 THEN 'critical' WHEN total < 100 THEN 'normal' WHEN score > 3 THEN 'high' WHEN score > 1.5 THEN 'low' ELSE 'normal' END AS heatmap FROM a""",
}

_HEAT = "WITH {m}, b AS (SELECT doc_id, seg, content_volume, space_runs, line_breaks, avg_space_length, {bins} FROM m), h AS (SELECT doc_id, seg, {c} FROM b JOIN d USING (doc_id, seg)), z AS (SELECT *, {x} FROM h WINDOW w AS (PARTITION BY doc_id)) SELECT doc_id, seg, {n}, {o} FROM z".format(
    m=macro.SQL_METRICS, bins=_BINS, c=", ".join(f"{c} / (content_volume + 1e-9) * 100 AS {c}" if c.startswith("vol") else c for c in macro.HEATED), x=", ".join(f"CAST(max({c}) OVER w AS DOUBLE) AS max_{c}" for c in macro.HEATED), n=", ".join(f"max_{c}" for c in macro.HEATED),
    o=", ".join(f"CASE WHEN {c} <> 0 THEN CAST(0.05 AS DOUBLE) + CAST(0.45 AS DOUBLE) * {c} / max_{c} END AS opacity_{c}" for c in macro.HEATED),
)
MACRO_SQL |= {
    "macro_slices": f"""WITH {macro.SQL_SEGMENTS} SELECT doc_id, ((i + 1) * least(10, t) - 1) // t AS seg, string_agg(g, '' ORDER BY i) AS part FROM x GROUP BY ALL""",
    "macro_global_stats": f"""WITH {macro.SQL_METRICS}, u AS (SELECT doc_id, seg, unnest(runs) AS v, generate_subscripts(runs, 1) AS i FROM m),
 o AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY seg, i) AS place FROM u), c AS (SELECT doc_id, v, count(*) AS k, min(place) AS place FROM o GROUP BY ALL),
 f AS (SELECT doc_id, v AS mode_run FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, place) = 1),
 a AS (SELECT doc_id, count(*) AS run_count, avg(v) AS mean_run, stddev_pop(v) AS std_dev, median(v) AS median_run, max(v) AS max_run, entropy(v) AS entropy FROM o GROUP BY doc_id)
 SELECT e.doc_id, coalesce(run_count, 0) AS run_count, coalesce(mean_run, 0) AS mean_run, coalesce(std_dev, 0) AS std_dev, coalesce(median_run, 0) AS median_run, coalesce(mode_run, 0) AS mode_run, coalesce(max_run, 0) AS max_run, coalesce(entropy, 0) AS entropy
 FROM (SELECT DISTINCT doc_id FROM m) e LEFT JOIN a USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "macro_bin_shares": f"WITH {macro.SQL_METRICS}, b AS (SELECT doc_id, seg, content_volume, run_count, {_BINS} FROM m) SELECT doc_id, seg, "
    + ", ".join(f"{n} / (run_count + 1e-9) * 100 AS run_{n}, {n.replace('bin', 'vol')} / (content_volume + 1e-9) * 100 AS vol_{n}" for n in macro.BIN_NAMES) + " FROM b",
    "macro_global_bins": f"WITH {macro.SQL_METRICS}, b AS (SELECT doc_id, seg, content_volume, {_BINS} FROM m) SELECT doc_id, CAST(sum(content_volume) AS BIGINT) AS content_volume, "
    + ", ".join(f"sum({n.replace('bin', 'vol')}) / (sum(content_volume) + 1e-9) * 100 AS {n}" for n in macro.BIN_NAMES) + " FROM b GROUP BY doc_id",
    "macro_heat": _HEAT,
    "macro_errors": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'No graphemes to analyze.' END AS error FROM pdocs",
    "macro_sparklines": f"WITH {macro.SQL_METRICS} SELECT doc_id, seg, entropy, content_density_pct AS density, m.threats_all AS threats, CAST(greatest(5, max(m.threats_all) OVER (PARTITION BY doc_id)) AS BIGINT) AS threats_top, m.threats_all > 0 AS \"cross\", n_seg >= 2 AS enough FROM m JOIN d USING (doc_id, seg)",
    "macro_labels": f"WITH {macro.SQL_METRICS} SELECT doc_id, seg, concat(seg + 1, ' / ', n_seg) AS segment_id, concat(start, '-', \"end\" - 1) AS indices FROM m",
}


def sequential_bidi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.bidi_structure(pdocs(spark, sf_dir))


def delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the lines of a delimited text for each customer's orders."""
    rows = spark.sql(oracles.DELIMITED.replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))


def sequential_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.topology(delimited(spark, sf_dir))


def sequential_type_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.type_drift(delimited(spark, sf_dir))


def sequential_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a layer was put on: those that the oracle's SQL names, so no Base64 on texts of 12 bytes or fewer."""
    line, packed = "replace(text, chr(10), ' ')", "replace(base64(encode({}, 'UTF-8')), chr(13) || chr(10), '')"
    last = f"CASE WHEN doc_id % 4 = 3 AND octet_length(text) > 12 THEN {packed.format(line)} WHEN doc_id % 4 = 3 THEN {line} ELSE text END"
    layered = oracles.LAYERED.replace("{b}", last).replace("\\u0065", "\\\\u0065")
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", "replace(text, '&', '+') AS text").selectExpr("doc_id", f"{layered} AS text")
    return structure.recursive_deobfuscate(docs).withColumn("layers", F.array_join("layers", ","))


def emoji_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a form of emoji was added to."""
    return properties.emoji(read(spark, sf_dir, "documents").selectExpr("doc_id", f"{oracles.ADD_EMOJI} AS text"))


def sequential_lz_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each whole text, and their share of n / log2(n)."""
    docs = pdocs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n"), normal.lz_complexity("text").alias("phrases"))
    return docs.withColumn("normalised", F.when(F.col("n") > 1, F.col("phrases") * F.log2("n") / F.col("n")))


def states_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the raw, NFKC, casefolded and skeleton states."""
    docs = pdocs(spark, sf_dir)
    forms = {"raw": F.col("text"), "nfkc": normal.nfkc("text"), "casefold": normal.nfkc_casefold("text"), "skeleton": normal.skeleton("text")}
    return docs.select("doc_id", *[F.sha2(c, 256).alias(f"{k}_sha256") for k, c in forms.items()])


def states_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pdocs(spark, sf_dir)
    return docs.select("doc_id", (F.length(normal.nfkc("text")) / F.greatest(F.length("text"), F.lit(1))).alias("inflation"), (normal.nfc("text") != F.col("text")).alias("not_nfc"))


def states_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = pdocs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1))).alias("token"))
    return pairs.skeleton_collisions(tokens).withColumn("forms", F.array_join("forms", ","))


def pairs_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw benchmark passage against its perturbed form."""
    items = read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return pairs.compare_states(items.selectExpr("doc_id", f"{PERTURBED} AS suspect", "text AS reference")).drop("suspect", "reference")


def html_hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden text of pages, to which three of four pages add some."""
    added = "concat(html, CASE page_id % 4 WHEN 0 THEN '<p style=\"display:none\">x</p>' WHEN 1 THEN '<i style=\"opacity:0\">y</i>' WHEN 2 THEN '<b style=\"font-size:0\">z</b>' ELSE '' END)"
    return structure.html_hidden(read(spark, sf_dir, "pages").selectExpr("page_id", f"{added} AS html"))


def html_fis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.fis_score(html_hidden_text(spark, sf_dir))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(read(spark, sf_dir, "events"))


def remedy_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that emoji, and joiners and selectors outside of them, were added to."""
    return profiles.smart(read(spark, sf_dir, "documents").selectExpr("doc_id", f"{oracles.ADD_LOOSE} AS text"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sliding(read(spark, sf_dir, "events"))


def stream_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.debounced(read(spark, sf_dir, "events"))


def atoms_graphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.grapheme_places(pdocs(spark, sf_dir))


def profile_graphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.grapheme_profile(pdocs(spark, sf_dir))


def profile_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.encoding_coverage(pdocs(spark, sf_dir))


def flag_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.flag_positions(pdocs(spark, sf_dir))


def shape_category_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.category_runs(pdocs(spark, sf_dir))


def flag_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.flag_totals(pdocs(spark, sf_dir))


def _of_pdocs(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(pdocs(spark, sf_dir))


def identifier_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = pdocs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}\p{M}_]+)"), F.lit(1))).alias("token"))
    return properties.identifiers(tokens)


def states_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the four normal forms and what normalisation does to a text."""
    docs = pdocs(spark, sf_dir)
    rows = docs.select("doc_id", "text", normal.nfc("text").alias("nfc"), normal.nfd("text").alias("nfd"), normal.nfkc("text").alias("nfkc"))
    kind = F.when(F.length("nfkc") < F.length("nfc"), "STRIPPED").when(F.col("nfkc") != F.col("nfc"), "MUTATION").when(F.col("nfc") != F.col("text"), "EQUIVALENCE").otherwise("STABLE")
    return rows.select("doc_id", *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("nfc", "nfd", "nfkc")], kind.alias("kind"))


def pairs_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return pairs.audit(items.selectExpr("doc_id", f"{PERTURBED} AS suspect", "text AS reference")).drop("suspect", "reference")


def html_ghost_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.ghost_text(html_hidden_text(spark, sf_dir))


def lens_punycode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages and their decoded form, which is null where the wire form is broken."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)).alias("host")).where("host <> ''")
    hosts = pages.select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("xn--bcher-kva."), "host")).otherwise(F.col("host")).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("n")).withColumn("decoded", normal.punycode("host"))


def snapshots(docs: DataFrame) -> DataFrame:
    """Snapshots of texts: graphemes, their lengths, and the flags that name a problem with their places."""
    named = {"bidi_control": snapshot.CRITICAL[0], "join_control": snapshot.CRITICAL[1]}
    flags = atoms.flag_positions(docs).withColumn("flag", F.coalesce(*[F.when(F.col("flag") == k, v) for k, v in named.items()], F.col("flag")))
    flags = flags.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("flag", F.struct(F.col("n").cast("int").alias("count"), F.split("positions", ",").alias("positions"))))).alias("forensic_flags"))
    g = F.regexp_extract_all("text", F.lit(r"(\X)"), F.lit(1))
    rows = docs.where("text <> ''").select("doc_id", g.alias("grapheme_list")).withColumn("grapheme_lengths_codepoints", F.transform("grapheme_list", lambda x: F.length(x)))
    return rows.join(flags, "doc_id", "left")


def profile_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a form of emoji was added to."""
    return profiles.partition(read(spark, sf_dir, "documents").selectExpr("doc_id", f"{oracles.ADD_EMOJI} AS text"))


PROPERTIES = {f.__name__: f for f in (states_forms, pairs_audit, html_ghost_text, lens_punycode, sequential_type_drift, emoji_forms, profile_partition, remedy_smart)}
PROPERTIES |= {
    "profile_encoding_evidence": _of_pdocs(lambda d: atoms.encoding_evidence(d).withColumn("explained_by", F.array_join("explained_by", ","))),
    "atoms_encoding_stacks": _of_pdocs(profiles.encoding_stacks), "atlas_components": _of_pdocs(profiles.components), "token_payload_entropy": _of_pdocs(profiles.payloads),
    "remedy_strict": _of_pdocs(lambda d: profiles.sanitized(d, oracles.STRICT)), "macro_snapshot_threats": _of_pdocs(lambda d: snapshot.segment_threats(snapshots(d))),
    "report_segments_json": _of_pdocs(lambda d: snapshot.segments_json(macro.metrics(macro.segments(d)))),
    "remedy_reveal": _of_pdocs(lambda d: d.select("doc_id", F.coalesce(reveal.revealed(), F.lit("")).alias("revealed"))),
    "provenance_script_places": _of_pdocs(properties.script_places), "provenance_script_extensions": _of_pdocs(lambda d: properties.script_places(d, True)),
    "atoms_codepoint_counts": _of_pdocs(atoms.codepoint_counts), "stats_char_entropy": _of_pdocs(atoms.char_entropy),
    "shape_property_runs": _of_pdocs(lambda d: properties.property_runs(d, ("linebreak", "bidi", "wordbreak", "sentencebreak", "graphemebreak", "eaw", "script"))),
    "shape_combining_classes": _of_pdocs(lambda d: properties.property_runs(d, ("ccc",)).where("value <> '0'")),
    "flag_properties": _of_pdocs(properties.property_flags), "states_character_effects": _of_pdocs(properties.character_effects), "atlas_characters": _of_pdocs(properties.atlas),
    "integrity_mark_structure": _of_pdocs(properties.mark_structure), "provenance_numeric_mass": _of_pdocs(properties.numeric_mass),
    "lens_identifier_policy": identifier_policies, "shape_script_structure": _of_pdocs(properties.script_structure),
}
PLACED = {f.__name__: f for f in (flag_positions, shape_category_runs, flag_all, stream_tumbling, stream_sliding, stream_debounced)}
PLACED_SQL = {"stream_tumbling": stream.TUMBLING, "atoms_codepoint_counts": atoms.CODEPOINT_COUNTS, "stats_char_entropy": atoms.CHAR_ENTROPY, "stream_sliding": stream.SLIDING, "stream_debounced": stream.DEBOUNCED, "flag_all": atoms.flag_totals_sql(), "flag_positions": atoms.flag_positions_sql(), "shape_category_runs": atoms.category_runs_sql()}

#: Operators with state inside a text. Those without an oracle are held against literal vectors by the tests.
ROWS_ONLY = {f.__name__: f for f in (atoms_graphemes, profile_graphemes, profile_encodings, sequential_bidi, sequential_topology, sequential_deobfuscate, sequential_lz_complexity, states_quad, states_inflation, states_collisions, pairs_states, html_hidden_text, html_fis)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return MACRO | {name: _of_pdocs(f) for name, (f, _) in ordered.ORDERED.items()} | PROPERTIES | PLACED | ROWS_ONLY | {name: spark_query(sql, TABLES.get(name, ())) for name, sql in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in (MACRO_SQL | {name: sql for name, (_, sql) in ordered.ORDERED.items()} | PLACED_SQL | oracles.ORACLES | CATALOG).items()}
