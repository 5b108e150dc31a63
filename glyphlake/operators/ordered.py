"""Measures that depend on order inside a text, as compiled patterns or functions of arrays: no shuffle before an aggregate.

Each operator takes docs(doc_id, text); its oracle's SQL stands beside it. Filters are on the text itself, as one on
an array would be pushed below the projection that builds the array, and build it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators.macro import _GRAPHEME, SQL_SEGMENTS, slices
from glyphlake.operators.measures import TRIGRAMS

_PLACED = "l AS (SELECT doc_id, string_split(text, '') AS a FROM pdocs WHERE text <> ''), p AS (SELECT doc_id, unnest(a) AS c, generate_subscripts(a, 1) - 1 AS i FROM l)"


def autocorrelation(docs: DataFrame) -> DataFrame:
    """Share of characters that equal the one 1 and 4 places on; 0 where there is none."""
    def share(lag: int) -> F.Column:
        same = F.regexp_count("text", F.lit(rf"(?s)(.)(?=.{{{lag - 1}}}\1)"))
        return F.when(F.length("text") > lag, same / (F.length("text") - lag)).otherwise(0.0).alias(f"lag_{lag}")
    return docs.where("text <> ''").select("doc_id", share(1), share(4))


AUTOCORRELATION = f"""WITH {_PLACED}, q AS (SELECT doc_id, i, c, lead(c, 1) OVER w AS c1, lead(c, 4) OVER w AS c4 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i))
 SELECT doc_id, CASE WHEN count(*) > 1 THEN count_if(c = c1) / (count(*) - 1.0) ELSE 0.0 END AS lag_1, CASE WHEN count(*) > 4 THEN count_if(c = c4) / (count(*) - 4.0) ELSE 0.0 END AS lag_4 FROM q GROUP BY doc_id"""


def _grams(n: int) -> F.Column:
    # A match takes a whole code point, so that none begins inside one.
    return F.regexp_extract_all(F.lower("text"), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def pair_repeat(docs: DataFrame) -> DataFrame:
    """Pairs of neighbours, distinct ones, and the share of pairs that occur more than once in their text."""
    rows = docs.where("length(lower(text)) > 1").select("doc_id", F.sort_array(_grams(2)).alias("g"))
    # In order, a pair is single if neither neighbour is the same.
    single = F.expr("size(filter(g, (x, i) -> coalesce(get(g, i - 1) <> x, true) and coalesce(get(g, i + 1) <> x, true)))")
    return rows.select("doc_id", F.size("g").cast("long").alias("pairs"), F.size(F.array_distinct("g")).cast("long").alias("forms"), ((F.size("g") - single) / F.size("g")).alias("repeated"))


PAIR_REPEAT = f"""WITH {_PLACED}, q AS (SELECT doc_id, lower(c) || lead(lower(c)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p), k AS (SELECT doc_id, g, count(*) AS n FROM q WHERE g IS NOT NULL GROUP BY ALL)
 SELECT doc_id, CAST(sum(n) AS BIGINT) AS pairs, count(*) AS forms, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS repeated FROM k GROUP BY doc_id"""


def trigram_overlap(docs: DataFrame) -> DataFrame:
    """How many of the common English trigrams a text holds, and their share."""
    n = sum((F.contains(F.lower("text"), F.lit(t)).cast("long") for t in TRIGRAMS), F.lit(0).cast("long"))
    return docs.where("text <> ''").select("doc_id", n.alias("found")).select("doc_id", "found", (F.col("found") / len(TRIGRAMS)).alias("share"))


TRIGRAM_OVERLAP = f"SELECT doc_id, found, found / {len(TRIGRAMS)}.0 AS share FROM (SELECT doc_id, CAST({' + '.join(f'CAST(contains(lower(text), {t!r}) AS INT)' for t in TRIGRAMS)} AS BIGINT) AS found FROM pdocs WHERE text <> '')"

#: Code points of a coarse and a fine window, and the change of entropy that makes a transition.
COARSE, FINE, JUMP = 256, 64, 1.5


def entropy_windows(docs: DataFrame, size: int = COARSE) -> DataFrame:
    """Entropy of each window of a text, its change from the one before, and whether that is a transition."""
    rows = docs.where("text <> ''").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))).alias("win", "part"))
    rows = rows.withColumn("s", F.sort_array(F.regexp_extract_all("part", F.lit("(?s)(.)"), F.lit(1)))).withColumn("n", F.size("s")).withColumn("d", F.array_distinct("s"))
    rows = rows.withColumn("at", F.expr("transform(d, x -> array_position(s, x))"))
    share = "(coalesce(get(at, i + 1), n + 1L) - x) / n"
    rows = rows.select("doc_id", F.col("win").cast("long"), F.expr(f"0D - aggregate(transform(at, (x, i) -> {share} * log2({share})), 0D, (a, v) -> a + v)").alias("entropy"))
    change = F.round(F.col("entropy") - F.lag("entropy").over(Window.partitionBy("doc_id").orderBy("win")), 9) + 0.0
    return rows.withColumn("change", change).withColumn("transition", F.coalesce(F.abs("change") > JUMP, F.lit(False)))


ENTROPY_WINDOWS = f"""WITH {_PLACED}, e AS (SELECT doc_id, CAST(i // {COARSE} AS BIGINT) AS win, entropy(c) AS entropy FROM p GROUP BY ALL), z AS (SELECT *, round(entropy - lag(entropy) OVER (PARTITION BY doc_id ORDER BY win), 9) + 0.0 AS change FROM e)
 SELECT *, coalesce(abs(change) > {JUMP}, FALSE) AS transition FROM z"""


def entropy_zoom(docs: DataFrame) -> DataFrame:
    """Fine windows of the coarse ones where entropy jumps."""
    jumps = entropy_windows(docs).where("transition").select("doc_id", F.col("win").alias("coarse"))
    fine = entropy_windows(docs, FINE).withColumn("coarse", F.expr(f"win div {COARSE // FINE}"))
    return fine.join(jumps, ["doc_id", "coarse"], "left_semi").select("doc_id", "win", "entropy")


ENTROPY_ZOOM = f"""WITH {_PLACED}, e AS (SELECT doc_id, i // {COARSE} AS win, entropy(c) AS entropy FROM p GROUP BY ALL), z AS (SELECT *, entropy - lag(entropy) OVER (PARTITION BY doc_id ORDER BY win) AS change FROM e)
 SELECT doc_id, CAST(i // {FINE} AS BIGINT) AS win, entropy(c) AS entropy FROM p WHERE (doc_id, i // {COARSE}) IN (SELECT (doc_id, win) FROM z WHERE abs(change) > {JUMP}) GROUP BY doc_id, i // {FINE}"""

_FLICKER = ("Latin", "Cyrillic", "Greek", "Arabic", "Han")


def script_flicker(docs: DataFrame) -> DataFrame:
    """Runs of scripts in order, `Latin (5) > Cyrillic (1)`, over letters of the named scripts alone."""
    named = "".join(rf"\p{{Is{s}}}" for s in _FLICKER)
    kept = F.regexp_replace("text", f"[^{named}]+", "")
    runs = F.regexp_extract_all("kept", F.lit("(" + "|".join(rf"\p{{Is{s}}}+" for s in _FLICKER) + ")"), F.lit(1))
    label = F.transform(runs, lambda r: F.concat(F.coalesce(*[F.when(F.rlike(r, F.lit(rf"^\p{{Is{s}}}")), s) for s in _FLICKER]), F.lit(" ("), F.length(r), F.lit(")")))
    return docs.where(F.col("text").rlike(f"[{named}]")).select("doc_id", kept.alias("kept")).select("doc_id", F.array_join(label, " > ").alias("flicker"))


SCRIPT_FLICKER = f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(k, '{"|".join(rf"\p{{{s}}}+" for s in _FLICKER)}'), lambda r: concat(CASE {" ".join(rf"WHEN regexp_matches(r, '^\p{{{s}}}') THEN '{s}'" for s in _FLICKER)} END, ' (', length(r), ')')), ' > ') AS flicker
 FROM (SELECT doc_id, regexp_replace(text, '[^{"".join(rf"\p{{{s}}}" for s in _FLICKER)}]+', '', 'g') AS k FROM pdocs) WHERE k <> ''"""


def bidi_gravity(docs: DataFrame) -> DataFrame:
    """Deepest nesting of embeddings and isolates (a closing control that closes nothing counts for nothing), and whether it is over five."""
    controls = F.regexp_extract_all("text", F.lit(r"([\x{202A}-\x{202E}\x{2066}-\x{2069}])"), F.lit(1))
    deepest = F.expr("""aggregate(c, struct(0L as d, 0L as m), (s, x) -> if(x in ('‬', '⁩'), struct(greatest(s.d - 1, 0L) as d, s.m as m), struct(s.d + 1 as d, greatest(s.m, s.d + 1) as m)), s -> s.m)""")
    return docs.where(F.col("text").rlike(r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]")).select("doc_id", controls.alias("c")).select("doc_id", deepest.alias("depth")).withColumn("well", F.col("depth") > 5)


BIDI_GRAVITY = """SELECT doc_id, max(d - low) AS depth, max(d - low) > 5 AS well FROM (SELECT doc_id, d, least(0, min(d) OVER (PARTITION BY doc_id ORDER BY i)) AS low FROM (
 SELECT doc_id, i, CAST(sum(CASE WHEN c IN ('‬', '⁩') THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS d FROM (SELECT doc_id, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]') AS a FROM pdocs)))) GROUP BY doc_id"""


def tag_payload(docs: DataFrame) -> DataFrame:
    """What the tag characters of a text spell."""
    tags = F.regexp_extract_all("text", F.lit(r"([\x{E0020}-\x{E007E}])"), F.lit(1))
    return docs.where(F.col("text").rlike(r"[\x{E0020}-\x{E007E}]")).select("doc_id", tags.alias("t")).select("doc_id", F.expr("array_join(transform(t, c -> char(ascii(c) - 917504)), '')").alias("payload"))


TAG_PAYLOAD = r"SELECT doc_id, array_to_string(list_transform(t, lambda c: chr(ord(c) - 917504)), '') AS payload FROM (SELECT doc_id, regexp_extract_all(text, '[\x{E0020}-\x{E007E}]') AS t FROM pdocs) WHERE len(t) > 0"


def mark_repeats(docs: DataFrame) -> DataFrame:
    """Marks that follow an equal one, and invisible sequences that are one cycle."""
    same = F.regexp_count("text", F.lit(r"(\p{M})(?=\1)")).cast("long")
    return docs.where(F.col("text").rlike(r"(\p{M})\1")).select("doc_id", same.alias("repeats"))


MARK_REPEATS = rf"WITH {_PLACED}, q AS (SELECT doc_id, c, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM p) SELECT doc_id, count(*) AS repeats FROM q WHERE c = d AND regexp_matches(c, '\p{{M}}') GROUP BY doc_id"


def _escaped(text: str, near: str, far: str) -> F.Column:
    """Printable ASCII stays, quotes and backslash take one; the rest becomes near (to FFFF) or far."""
    chars = f"regexp_extract_all({text}, '(?s)(.)', 1)"
    return F.expr(f"array_join(transform({chars}, c -> case when c in ('\"', '\\'', '\\\\') then concat('\\\\', c) when ascii(c) between 32 and 126 then c when ascii(c) < 65536 then {near} else {far} end), '')")


def escape_js(docs: DataFrame) -> DataFrame:
    """The text as the inside of a JavaScript string literal."""
    return docs.select("doc_id", _escaped("text", "concat('\\\\u', lpad(hex(ascii(c)), 4, '0'))", "concat('\\\\u{', hex(ascii(c)), '}')").alias("literal"))


def escape_python(docs: DataFrame) -> DataFrame:
    """The text as the inside of a Python string literal."""
    return docs.select("doc_id", _escaped("text", "concat('\\\\u', lpad(hex(ascii(c)), 4, '0'))", "concat('\\\\U', lpad(hex(ascii(c)), 8, '0'))").alias("literal"))


def _escape_sql(far: str) -> str:
    return f"""SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c IN ('"', '''', '\\') THEN '\\' || c WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN '\\u' || printf('%04X', ord(c)) ELSE {far} END), '') AS literal FROM pdocs"""


ESCAPE_JS, ESCAPE_PYTHON = _escape_sql("'\\u{' || printf('%X', ord(c)) || '}'"), _escape_sql("'\\U' || printf('%08X', ord(c))")


def atomic_density(docs: DataFrame) -> DataFrame:
    """UTF-8 bytes of a grapheme, and whether there are more than eight."""
    graphemes = F.length(F.regexp_replace("text", r"\X", "C"))
    rows = docs.where("text <> ''").select("doc_id", graphemes.cast("long").alias("graphemes"), F.octet_length("text").cast("long").alias("bytes"))
    return rows.withColumn("density", F.col("bytes") / F.col("graphemes")).withColumn("defect", F.col("bytes") > 8 * F.col("graphemes"))


ATOMIC_DENSITY = f"SELECT *, bytes / graphemes AS density, bytes > 8 * graphemes AS defect FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '{_GRAPHEME}')) AS BIGINT) AS graphemes, CAST(strlen(text) AS BIGINT) AS bytes FROM pdocs WHERE text <> '')"


def evidence(docs: DataFrame) -> DataFrame:
    """A JSON record of each text with the digest of its bytes (the sink adds the time)."""
    return docs.select("doc_id", F.to_json(F.struct("doc_id", F.length("text").alias("codepoints"), F.sha2("text", 256).alias("sha256"))).alias("evidence"))


EVIDENCE = "SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'codepoints': length(text), 'sha256': sha256(text)}) AS VARCHAR) AS evidence FROM pdocs"

#: Section of a report -> (line's label, pattern whose matches it counts).
SECTIONS = {
    "shape": (("letter runs", r"\p{L}+"), ("number runs", r"\p{N}+"), ("separator runs", r"\p{Z}+")),
    "integrity": (("controls", r"[\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}]"), ("replacement", r"\x{FFFD}"), ("private use", r"[\x{E000}-\x{F8FF}]")),
    "threat": (("bidi controls", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"), ("joiners", r"[\x{200B}-\x{200D}]"), ("tags", r"[\x{E0000}-\x{E007F}]")),
}


def report_lines(docs: DataFrame) -> DataFrame:
    """doc_id, section, line: the report of a text, a row of each line; `report` joins them."""
    lines = [F.struct(F.lit(s).alias("section"), F.concat(F.lit(f"{label}: "), F.regexp_count("text", F.lit(p))).alias("line")) for s, rows in SECTIONS.items() for label, p in rows]
    return docs.select("doc_id", F.explode(F.array(*lines)).alias("r")).select("doc_id", "r.*")


REPORT_LINES = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS section, concat('{label}: ', len(regexp_extract_all(text, '{p}'))) AS line FROM pdocs" for s, rows in SECTIONS.items() for label, p in rows)


def report(docs: DataFrame) -> DataFrame:
    """The report of a text as one string, sections under their names."""
    parts = [F.concat_ws("\n", F.lit(f"[{s}]"), *[F.concat(F.lit(f"{label}: "), F.regexp_count("text", F.lit(p))) for label, p in rows]) for s, rows in SECTIONS.items()]
    return docs.select("doc_id", F.concat_ws("\n", *parts).alias("report"))


REPORT = "SELECT doc_id, concat_ws(chr(10), " + ", ".join(f"'[{s}]', " + ", ".join(f"concat('{label}: ', len(regexp_extract_all(text, '{p}')))" for label, p in rows) for s, rows in SECTIONS.items()) + ") AS report FROM pdocs"

def dispersion(docs: DataFrame) -> DataFrame:
    """Entropy of the patterns of three neighbours, where a character is low (to 63), middle (to 126) or high."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[\x{0040}-\x{007E}]", "a"), r"[\x{0000}-\x{003F}]", "0"), r"[\x{007F}-\x{10FFFF}]", "~")
    rows = docs.where("length(text) > 2").select("doc_id", F.sort_array(F.regexp_extract_all(kinds, F.lit("(?=(...))."), F.lit(1))).alias("g"))
    rows = rows.withColumn("n", F.size("g")).withColumn("at", F.expr("transform(array_distinct(g), x -> array_position(g, x))"))
    share = "(coalesce(get(at, i + 1), n + 1L) - x) / n"
    return rows.select("doc_id", F.expr(f"0D - aggregate(transform(at, (x, i) -> {share} * log2({share})), 0D, (a, v) -> a + v)").alias("entropy"), F.size("at").cast("long").alias("patterns"))


DISPERSION = f"""WITH {_PLACED}, k AS (SELECT doc_id, i, CASE WHEN ord(c) < 64 THEN '0' WHEN ord(c) < 127 THEN 'a' ELSE '~' END AS k FROM p),
 q AS (SELECT doc_id, k || lead(k, 1) OVER w || lead(k, 2) OVER w AS g FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, entropy(g) AS entropy, count(DISTINCT g) AS patterns FROM q WHERE g IS NOT NULL GROUP BY doc_id"""


def unit_ranges(docs: DataFrame) -> DataFrame:
    """Places of each segment in UTF-16 units, end exclusive (at most ten rows of one document meet)."""
    units = F.length("part") + F.regexp_count("part", F.lit(r"[\x{10000}-\x{10FFFF}]"))
    rows = slices(docs).select("doc_id", "seg", units.cast("long").alias("units"))
    w = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "seg", (F.sum("units").over(w) - F.col("units")).alias("unit_start"), F.sum("units").over(w).alias("unit_end"))


UNIT_RANGES = f"""WITH {SQL_SEGMENTS}, u AS (SELECT doc_id, ((i + 1) * least(10, t) - 1) // t AS seg, sum(length(g) + len(regexp_extract_all(g, '[\\x{{10000}}-\\x{{10FFFF}}]'))) AS units FROM x GROUP BY ALL)
 SELECT doc_id, seg, CAST(sum(units) OVER w - units AS BIGINT) AS unit_start, CAST(sum(units) OVER w AS BIGINT) AS unit_end FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY seg)"""

#: Query -> (operator, oracle's SQL).
ORDERED = {
    "stats_autocorrelation": (autocorrelation, AUTOCORRELATION), "stats_pair_repeat": (pair_repeat, PAIR_REPEAT), "stats_trigram_overlap": (trigram_overlap, TRIGRAM_OVERLAP),
    "stats_entropy_windows": (entropy_windows, ENTROPY_WINDOWS), "stats_entropy_zoom": (entropy_zoom, ENTROPY_ZOOM), "provenance_script_flicker": (script_flicker, SCRIPT_FLICKER),
    "integrity_bidi_gravity": (bidi_gravity, BIDI_GRAVITY), "integrity_mark_repeats": (mark_repeats, MARK_REPEATS), "token_tag_payload": (tag_payload, TAG_PAYLOAD),
    "remedy_escape_js": (escape_js, ESCAPE_JS), "remedy_escape_python": (escape_python, ESCAPE_PYTHON), "profile_atomic_density": (atomic_density, ATOMIC_DENSITY),
    "stats_dispersion_entropy": (dispersion, DISPERSION), "macro_unit_ranges": (unit_ranges, UNIT_RANGES), "report_evidence": (evidence, EVIDENCE), "report_lines": (report_lines, REPORT_LINES), "report_text": (report, REPORT),
}
