"""Macrostructure: segments of graphemes, runs inside them, and how unusual a segment is.

A document's graphemes become a string of class letters, so that segments are substrings and runs are matches: no
shuffle, and one row of each segment. Statistics over segments of a document are windows on its at most ten rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import chars

SEGMENTS, EPSILON, SMALL = 10, 1e-9, 100

#: Class letter of a grapheme by its first code point c, in order of priority.
CLASSES = """CASE WHEN c = 1564 OR c IN (8206, 8207) OR c BETWEEN 8234 AND 8238 OR c BETWEEN 8294 AND 8297 THEN 'B'
 WHEN c IN (8204, 8205) THEN 'J'
 WHEN c IN (173, 847, 4447, 4448, 6068, 6069, 8203, 12644, 65279, 65440) OR c BETWEEN 6155 AND 6159 OR c BETWEEN 8288 AND 8293 OR c BETWEEN 8298 AND 8303 OR c BETWEEN 65024 AND 65039 OR c BETWEEN 917504 AND 921599 THEN 'O'
 WHEN c IN (10, 11, 12, 13, 133, 8232, 8233) THEN 'N'
 WHEN c IN (9, 32, 160, 5760, 8239, 8287, 12288) OR c BETWEEN 8192 AND 8202 THEN 'S'
 ELSE 'C' END"""
# The same classes for Spark: patterns of the first code point, in order of priority; what is left is content.
_FIRST = {
    "B": r"\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}",
    "J": r"\x{200C}\x{200D}",
    "O": r"\x{00AD}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{200B}\x{3164}\x{FEFF}\x{FFA0}\x{180B}-\x{180F}\x{2060}-\x{2065}\x{206A}-\x{206F}\x{FE00}-\x{FE0F}\x{E0000}-\x{E0FFF}",
    "N": r"\x{000A}-\x{000D}\x{0085}\x{2028}\x{2029}",
    "S": r"\x{0009}\x{0020}\x{00A0}\x{1680}\x{202F}\x{205F}\x{3000}\x{2000}-\x{200A}",
}


def class_string(text: str = "text") -> F.Column:
    """A letter for each grapheme: each becomes C, after its first code point if that is of another class; the two then become one letter.

    Only compiled replacements over the whole text, no lambda for each grapheme.
    """
    out = F.regexp_replace(text, rf"(?=([{''.join(_FIRST.values())}])?)\X", "$1C")
    for letter, points in _FIRST.items():
        out = F.regexp_replace(out, f"[{points}]C", letter)
    return out


#: Flags whose places count as threats: those that name a problem, not a property. The critical ones come first.
CRITICAL = ("bidi_control", "join_control")
THREATS = (*CRITICAL, *(k for k, (severity, _) in chars.FLAGS.items() if k not in CRITICAL and (severity != "info" or k == "bidi_paired_bracket")))


def any_of(flags: tuple[str, ...]) -> str:
    """One class of the code points of flags."""
    return "[" + "".join(chars.FLAGS[k][1].strip("[]") for k in flags) + "]"


#: Printable ASCII but for brackets, which no flag of THREATS names; most of a text.
PLAIN = r"[\x{0009}\x{000A}\x{000D}\x{0020}-\x{0027}\x{002A}-\x{005A}\x{005C}\x{005E}-\x{007A}\x{007C}\x{007E}]+"


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg, n_seg, start, end, cls (class letters), part (its text) of docs(doc_id, text).

    A text without graphemes has none; `errors` gives its record. Parts are cut before the segments become rows, so that
    no row carries the whole text.
    """
    # The filter is on the text itself: one on the class string would be pushed below it and build it twice.
    rows = docs.where("text <> ''").select("doc_id", "text", class_string().alias("all")).withColumn("t", F.length("all").cast("long"))
    rows = rows.withColumn("n_seg", F.least(F.lit(SEGMENTS), "t").cast("long"))
    # Places of graphemes are those of code points unless some have several.
    rows = rows.withColumn("g", F.when(F.length("text") != F.col("t"), F.regexp_extract_all("text", F.lit(r"(\X)"), F.lit(1))))

    def cut(seg):
        start, end = F.floor(seg * F.col("t") / F.col("n_seg")), F.floor((seg + 1) * F.col("t") / F.col("n_seg"))
        at, n = (start + 1).cast("int"), (end - start).cast("int")
        part = F.when(F.col("g").isNull(), F.substring("text", at, n)).otherwise(F.array_join(F.slice("g", at, n), ""))
        return F.struct(seg.alias("seg"), start.alias("start"), end.alias("end"), F.substring("all", at, n).alias("cls"), part.alias("part"))

    cuts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_seg") - 1), cut)
    return rows.select("doc_id", "n_seg", F.explode(cuts).alias("s")).select("doc_id", "s.seg", "n_seg", "s.start", "s.end", "s.cls", "s.part")


def errors(docs: DataFrame) -> DataFrame:
    """The error of each text without graphemes, which has no segments; null for the others."""
    return docs.select("doc_id", F.when(F.coalesce("text", F.lit("")) == "", "No graphemes to analyze.").alias("error"))


#: Lengths of the runs in order, their distinct values ascending, and how many runs have each.
_RUNS = "transform(regexp_extract_all(cls, '(C+)', 1), r -> cast(length(r) as bigint))"
_COUNTS = "transform(vals, (v, i) -> coalesce(array_position(ordered, get(vals, i + 1)), n + 1L) - array_position(ordered, v))"


def _over_values(e: str) -> str:
    """Sum of e over the distinct lengths v, of which there are k."""
    return f"aggregate(zip_with(vals, counts, (v, k) -> cast({e} as double)), cast(0 as double), (s, x) -> s + x)"


def _letters_of(letter: str) -> F.Column:
    return F.expr(f"cast(length(cls) - length(replace(cls, '{letter}', '')) as bigint)")


def histogram(rows: DataFrame) -> DataFrame:
    """rows(runs, ...) with the runs in order, their number, their distinct lengths and how many have each."""
    rows = rows.withColumn("ordered", F.sort_array("runs")).withColumn("n", F.size("runs").cast("long"))
    return rows.withColumn("vals", F.array_distinct("ordered")).withColumn("counts", F.expr(_COUNTS))


def statistics() -> list[F.Column]:
    """Statistics from the histogram of run lengths (few distinct values, however long the text) and their content_volume."""
    # The most frequent length; the first seen of those.
    mode = "array_min(transform(filter(vals, (v, i) -> counts[i] = array_max(counts)), v -> struct(array_position(runs, v) as at, v as v))).v"
    some = lambda e: F.expr(f"if(n > 0, {e}, 0D)")
    return [
        some("content_volume / n").alias("mean_run"),
        some(f"sqrt({_over_values('k * (v - content_volume / n) * (v - content_volume / n)')} / n)").alias("std_dev"),
        some("(ordered[cast((n - 1) div 2 as int)] + ordered[cast(n div 2 as int)]) / 2D").alias("median_run"),
        F.expr(f"coalesce({mode}, 0)").alias("mode_run"), F.expr("coalesce(array_max(vals), 0)").alias("max_run"),
        some(f"0D - {_over_values('k / n * log2(k / n)')}").alias("entropy"),
    ]


def metrics(segs: DataFrame) -> DataFrame:
    """Run statistics of each segment."""
    rows = histogram(segs.withColumn("runs", F.expr(_RUNS)))
    rows = rows.withColumn("rest", F.regexp_replace("part", PLAIN, ""))
    rows = rows.withColumn("content_volume", _letters_of("C")).withColumn("gap_volume", _letters_of("S")).withColumn("gaps", F.regexp_count("cls", F.lit("S+")).cast("long"))
    return rows.select(
        "doc_id", "seg", "n_seg", "start", "end", F.expr("length(cls)").cast("long").alias("volume"), "content_volume", F.col("n").alias("run_count"), *statistics(),
        F.col("gaps").alias("space_runs"),
        F.expr("if(gaps > 0, gap_volume / gaps, 0D)").alias("avg_space_length"),
        *[_letters_of(c).alias(k) for c, k in (("N", "line_breaks"), ("B", "bidi_atoms"), ("J", "join_atoms"), ("O", "other_invisibles"))],
        *[F.regexp_count("rest", F.lit(any_of(flags))).cast("long").alias(k) for k, flags in (("threats_all", THREATS), ("threats_critical", CRITICAL))],
        "gap_volume", "runs", "vals", "counts",
    )


def density_columns() -> dict[str, F.Column]:
    total = F.col("volume") + EPSILON
    return {
        "content_density_pct": F.col("content_volume") / total * 100, "gap_density_pct": (F.col("gap_volume") + F.col("line_breaks")) / total * 100,
        "threats_all": F.col("threats_all"), "threats_critical": F.col("threats_critical"), "threat_density": F.col("threats_all") / total * 100,
    }


def densities(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "seg", *[c.alias(k) for k, c in density_columns().items()])


BIN_NAMES = [f"bin_{i:02d}" for i in range(1, 17)]


def bin_columns() -> list[F.Column]:
    def one(i: int, e: str) -> F.Column:
        return F.expr(f"cast({_over_values(f'if(least(v, 16L) = {i}, {e}, 0L)')} as bigint)")
    return [*[one(i, "k").alias(n) for i, n in enumerate(BIN_NAMES, 1)], *[one(i, "k * v").alias(n.replace("bin", "vol")) for i, n in enumerate(BIN_NAMES, 1)]]


def bins(rows: DataFrame) -> DataFrame:
    """Runs of each length (16: and longer) and their volume."""
    return rows.select("doc_id", "seg", *bin_columns())


SCORED = ("content_density_pct", "gap_density_pct", "mean_run", "entropy")


def anomalies(rows: DataFrame) -> DataFrame:
    """Root of the summed squared z-scores of a segment among its document's, and its class.

    Threat density takes no part in the score; critical threats decide first, then the document's graphemes.
    """
    own = density_columns()
    joined = rows.select("doc_id", "seg", "volume", "mean_run", "entropy", *[own[k].alias(k) for k in ("content_density_pct", "gap_density_pct", "threats_critical")])
    w = Window.partitionBy("doc_id")
    squares = F.lit(0.0)
    for c in SCORED:
        mean, deviation = F.avg(c).over(w), F.stddev_pop(c).over(w)
        squares = squares + F.when(deviation > 1e-12, F.pow((F.col(c) - mean) / deviation, F.lit(2.0))).otherwise(0.0)
    out = joined.select("doc_id", "seg", "threats_critical", F.sum("volume").over(w).alias("total"), F.sqrt(squares).alias("score"))
    kind = F.when(F.col("threats_critical") > 0, "critical").when(F.col("total") < SMALL, "normal").when(F.col("score") > 3, "high").when(F.col("score") > 1.5, "low").otherwise("normal")
    return out.select("doc_id", "seg", "score", F.concat(F.lit("heatmap-"), kind).alias("heatmap"))


def whole_runs(rows: DataFrame) -> DataFrame:
    """Run statistics over all content runs of a document, in the order of its segments (at most ten rows of one document meet)."""
    parts = F.array_sort(F.collect_list(F.struct("seg", "runs")))
    docs = rows.groupBy("doc_id").agg(F.flatten(F.transform(parts, lambda x: x["runs"])).alias("runs"), F.sum("content_volume").alias("content_volume"))
    return histogram(docs).select("doc_id", F.col("n").alias("run_count"), *statistics())


def shares(rows: DataFrame) -> DataFrame:
    """Share of each bin in a segment's runs and in their volume, in percent."""
    per = lambda c, t: F.col(c) / (F.col(t) + EPSILON) * 100
    own = rows.select("doc_id", "seg", "content_volume", "run_count", *bin_columns())
    return own.select(
        "doc_id", "seg", *[per(n, "run_count").alias(f"run_{n}") for n in BIN_NAMES], *[per(n.replace("bin", "vol"), "content_volume").alias(f"vol_{n}") for n in BIN_NAMES]
    )


def whole_bins(rows: DataFrame) -> DataFrame:
    """Share of each bin's volume in that of all segments of a document."""
    sums = rows.select("doc_id", "content_volume", *bin_columns()).groupBy("doc_id").agg(F.sum("content_volume").alias("content_volume"), *[F.sum(n.replace("bin", "vol")).alias(n) for n in BIN_NAMES])
    return sums.select("doc_id", "content_volume", *[(F.col(n) / (F.col("content_volume") + EPSILON) * 100).alias(n) for n in BIN_NAMES])


HEATED = ("content_density_pct", "gap_density_pct", "space_runs", "line_breaks", "avg_space_length", *(n.replace("bin", "vol") for n in BIN_NAMES))


def heat(rows: DataFrame) -> DataFrame:
    """Largest value of each heated column in a document, and the opacity of a segment's cell (null where there is nothing).

    Bins are heated by their share of the content, in percent.
    """
    own = density_columns()
    rows = rows.select("*", *bin_columns())
    share = {n: F.col(n) / (F.col("content_volume") + EPSILON) * 100 for n in HEATED if n.startswith("vol")}
    rows = rows.select("doc_id", "seg", *[(share | own).get(c, F.col(c)).cast("double").alias(c) for c in HEATED])
    w = Window.partitionBy("doc_id")
    rows = rows.select("*", *[F.max(c).over(w).cast("double").alias(f"max_{c}") for c in HEATED])
    opacity = [F.when((F.col(c) != 0) & (F.col(f"max_{c}") != 0), 0.05 + 0.45 * F.col(c) / F.col(f"max_{c}")).alias(f"opacity_{c}") for c in HEATED]
    return rows.select("doc_id", "seg", *[f"max_{c}" for c in HEATED], *opacity)


def sparklines(rows: DataFrame) -> DataFrame:
    """Points of the three curves of a document: values, the top of each scale, crosses, and whether two points are there."""
    own = density_columns()
    top = F.greatest(F.lit(5), F.max("threats").over(Window.partitionBy("doc_id")))
    out = rows.select("doc_id", "seg", "n_seg", "entropy", own["content_density_pct"].alias("density"), own["threats_all"].alias("threats"))
    return out.select("doc_id", "seg", "entropy", "density", "threats", top.cast("long").alias("threats_top"), (F.col("threats") > 0).alias("cross"), (F.col("n_seg") >= 2).alias("enough"))


def labels(rows: DataFrame) -> DataFrame:
    """The segment's place in words: `i / N`, and its first and last grapheme."""
    return rows.select("doc_id", "seg", F.expr("concat(seg + 1, ' / ', n_seg)").alias("segment_id"), F.expr("concat(start, '-', end - 1)").alias("indices"))


def slices(docs: DataFrame) -> DataFrame:
    """The text of each segment."""
    rows = docs.where("text <> ''").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\X)"), F.lit(1)).alias("g")).withColumn("t", F.size("g").cast("long"))
    rows = rows.withColumn("n_seg", F.least(F.lit(SEGMENTS), "t").cast("long")).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_seg") - 1)))
    return rows.select("doc_id", "seg", F.expr("array_join(slice(g, cast(seg * t div n_seg + 1 as int), cast((seg + 1) * t div n_seg - seg * t div n_seg as int)), '')").alias("part"))


# The oracle: the same quantities from lists of code points joined with their marks.

_GRAPHEME = r"(?s)\r\n|[^\p{M}\x{200C}\x{200D}\x{E0020}-\x{E007F}\r\n\x{200B}\x{202A}-\x{202E}][\p{M}\x{200C}\x{200D}\x{E0020}-\x{E007F}]*|."


def _flagged(flags: tuple[str, ...]) -> str:
    """Code points of a grapheme g that any of flags names; of printable ASCII only brackets can be."""
    brackets = "CAST(g IN ('(', ')', '[', ']', '{', '}') AS BIGINT)" if "bidi_paired_bracket" in flags else "0"
    return f"CASE WHEN len(g) = 1 AND ord(g) BETWEEN 32 AND 126 THEN {brackets} ELSE len(regexp_extract_all(g, '{any_of(flags)}')) END"


SQL_SEGMENTS = f"""
 g AS (SELECT doc_id, regexp_extract_all(text, '{_GRAPHEME}') AS l FROM pdocs),
 x AS (SELECT doc_id, len(l) AS t, unnest(l) AS g, generate_subscripts(l, 1) - 1 AS i FROM g WHERE len(l) > 0),
 k AS (SELECT doc_id, t, i, {CLASSES.replace('c ', 'ord(g) ')} AS k, {_flagged(THREATS)} AS f, {_flagged(CRITICAL)} AS f2 FROM x),
 p AS (SELECT *, least(10, t) AS n_seg, ((i + 1) * least(10, t) - 1) // t AS seg FROM k),
 s AS (SELECT doc_id, seg, any_value(n_seg) AS n_seg, min(i) AS start, max(i) + 1 AS "end", string_agg(k, '' ORDER BY i) AS cls, CAST(sum(f) AS BIGINT) AS threats_all, CAST(sum(f2) AS BIGINT) AS threats_critical FROM p GROUP BY ALL),
 r AS (SELECT *, list_transform(regexp_extract_all(cls, 'C+'), lambda v: len(v)) AS runs, list_transform(regexp_extract_all(cls, 'S+'), lambda v: len(v)) AS gaps FROM s)"""


def _letters(c: str) -> str:
    return f"CAST(len(cls) - len(replace(cls, '{c}', '')) AS BIGINT)"


SQL_METRICS = f"""{SQL_SEGMENTS},
 m AS (SELECT doc_id, seg, n_seg, start, "end", CAST(len(cls) AS BIGINT) AS volume, CAST(coalesce(list_sum(runs), 0) AS BIGINT) AS content_volume, CAST(len(runs) AS BIGINT) AS run_count,
  coalesce(list_avg(runs), 0) AS mean_run, coalesce(list_stddev_pop(runs), 0) AS std_dev, CAST(coalesce(list_median(runs), 0) AS DOUBLE) AS median_run,
  coalesce((SELECT v FROM (SELECT unnest(runs) AS v, generate_subscripts(runs, 1) AS i) GROUP BY v ORDER BY count(*) DESC, min(i) LIMIT 1), 0) AS mode_run,
  coalesce(list_max(runs), 0) AS max_run, coalesce(list_entropy(runs), 0) AS entropy, CAST(len(gaps) AS BIGINT) AS space_runs, coalesce(list_avg(gaps), 0) AS avg_space_length,
  {_letters('N')} AS line_breaks, {_letters('B')} AS bidi_atoms, {_letters('J')} AS join_atoms, {_letters('O')} AS other_invisibles, threats_all, threats_critical, {_letters('S')} AS gap_volume, runs FROM r),
 d AS (SELECT doc_id, seg, content_volume / (volume + 1e-9) * 100 AS content_density_pct, (gap_volume + line_breaks) / (volume + 1e-9) * 100 AS gap_density_pct,
  threats_all, threats_critical, threats_all / (volume + 1e-9) * 100 AS threat_density FROM m)"""
