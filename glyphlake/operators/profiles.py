"""Profiles by grapheme: what a text's clusters are made of, how they are encoded, and which kind of symbol they are.

Each operator takes docs(doc_id, text); its oracle's SQL stands beside it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions import chars, normal
from glyphlake.operators.atoms import distinct_counts
from glyphlake.operators.macro import _GRAPHEME


def _clusters(docs: DataFrame) -> DataFrame:
    """g, n, docs: the distinct graphemes of all texts, counted inside each text first."""
    rows = docs.where("text <> ''").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\X)"), F.lit(1))).alias("g"))
    return rows.groupBy("g").agg(F.count("*").alias("n"))


def encoding_stacks(docs: DataFrame) -> DataFrame:
    """g, n, scalars, utf16, utf8 (in hex) of each distinct grapheme."""
    points = F.transform(F.regexp_extract_all("g", F.lit("(?s)(.)"), F.lit(1)), lambda c: F.concat(F.lit("U+"), F.when(F.ascii(c) < 65536, F.lpad(F.hex(F.ascii(c)), 4, "0")).otherwise(F.hex(F.ascii(c)))))
    return _clusters(docs).select("g", "n", F.array_join(points, " ").alias("scalars"), F.hex(F.encode("g", "UTF-16BE")).alias("utf16"), F.hex(F.encode("g", "UTF-8")).alias("utf8"))


_G = f"g AS (SELECT g, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_GRAPHEME}')) AS g FROM pdocs) GROUP BY g)"
_HIGH = "printf('%04X%04X', 55296 + (ord(c) - 65536) // 1024, 56320 + (ord(c) - 65536) % 1024)"
ENCODING_STACKS = f"""WITH {_G} SELECT g, n, array_to_string(list_transform(string_split(g, ''), lambda c: 'U+' || printf('%04X', ord(c))), ' ') AS scalars,
 array_to_string(list_transform(string_split(g, ''), lambda c: CASE WHEN ord(c) < 65536 THEN printf('%04X', ord(c)) ELSE {_HIGH} END), '') AS utf16, hex(g) AS utf8 FROM g"""


def components(docs: DataFrame) -> DataFrame:
    """g, k, cp, category, ccc, name: the code points of each distinct grapheme that has several."""

    @F.pandas_udf("array<struct<k:int,cp:string,category:string,ccc:int,name:string>>")
    def parts(x: pd.Series) -> pd.Series:
        return pd.Series([[{"k": k, "cp": f"U+{ord(c):04X}", "category": unicodedata.category(c), "ccc": unicodedata.combining(c), "name": unicodedata.name(c, None)} for k, c in enumerate(g)] for g in x])

    several = _clusters(docs).where(F.length("g") > 1)
    return several.select("g", "n", F.explode(parts("g")).alias("p")).select("g", "n", "p.*")


def lookalikes(docs: DataFrame, inverse: DataFrame) -> DataFrame:
    """doc_id, ch, n, others: characters of a text with the look-alikes that inverse(cp, others) gives them."""
    rows = docs.where("text <> ''").select("doc_id", F.explode(distinct_counts()).alias("x")).select("doc_id", F.col("x.c").alias("ch"), "x.n", F.ascii("x.c").alias("cp"))
    return rows.join(inverse, "cp").select("doc_id", "ch", "n", "others")


_EMOJI = regex.compile(r"\p{Emoji_Presentation}|️|‍\p{Extended_Pictographic}|⃣|^\p{Regional_Indicator}{2}$")
_SYMBOL = regex.compile(r"\p{S}")
_HYBRID = regex.compile(r"\p{Extended_Pictographic}")


def partition_of(text: str) -> tuple[int, int, int]:
    """Clusters that are a text symbol, a loose pictograph (hybrid), or emoji: each cluster is one of these at most."""
    symbols = hybrids = emoji = 0
    for g in regex.findall(r"\X", text):
        if _EMOJI.search(g) and not g.isascii():
            emoji += 1
        elif _HYBRID.match(g):
            hybrids += 1
        elif _SYMBOL.match(g):
            symbols += 1
    return symbols, hybrids, emoji


def partition(docs: DataFrame) -> DataFrame:
    names = ["text_symbols", "hybrids", "emoji"]

    @F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in names]))
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([partition_of(t or "") for t in x], columns=names)

    return docs.select("doc_id", run("text").alias("p")).select("doc_id", "p.*")


def payloads(docs: DataFrame) -> DataFrame:
    """doc_id, payload, n, entropy: runs of Base64 or hex characters over 16 long, with the entropy of their characters."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9+/=]{17,})"), F.lit(1))).alias("payload")).groupBy("doc_id", "payload").agg(F.count("*").alias("n"))
    shares = F.transform(distinct_counts("payload"), lambda x: x["n"] / F.length("payload"))
    return runs.withColumn("entropy", -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


PAYLOADS = """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=]{17,}')) AS payload FROM pdocs), d AS (SELECT doc_id, payload, count(*) AS n FROM r GROUP BY ALL),
 c AS (SELECT doc_id, payload, unnest(string_split(payload, '')) AS c FROM d) SELECT doc_id, payload, any_value(n) AS n, entropy(c) AS entropy FROM c JOIN d USING (doc_id, payload) GROUP BY doc_id, payload"""


def sanitized(docs: DataFrame, dropped: str) -> DataFrame:
    """A strict cleaning: what the pattern names goes (invisible and private characters, odd spaces), the rest is brought into NFC."""
    return docs.select("doc_id", normal.nfc(F.regexp_replace("text", dropped, "")).alias("clean"))


def smart(docs: DataFrame) -> DataFrame:
    """doc_id, clean: texts without invisible characters, but for joiners between pictographs and selectors after what takes them.

    Those that stay are marked by characters that have just been taken out, while the others go.
    """
    text = F.regexp_replace("text", "[" + chars.BIDI + chars.TAGS + chars.IGNORABLE + r"\x{200C}\x{FE00}-\x{FE0E}\x{E0100}-\x{E01EF}]", "")
    text = F.regexp_replace(text, "([" + chars.PICTOGRAPHS + chars.SKIN + r"\x{FE0F}])\x{200D}(?=[" + chars.PICTOGRAPHS + "])", "$1\u200c")
    text = F.regexp_replace(text, r"\x{200D}", "")
    text = F.regexp_replace(text, "([" + chars.PICTOGRAPHS + r"0-9#*\x{00A9}\x{00AE}])\x{FE0F}", "$1\ufe00")
    text = F.regexp_replace(text, r"\x{FE0F}", "")
    return docs.select("doc_id", F.translate(text, "\u200c\ufe00", "\u200d\ufe0f").alias("clean"))


SMART = r"""WITH s AS (SELECT doc_id, regexp_replace({text}, '[""" + chars.BIDI + chars.TAGS + chars.IGNORABLE + r"""\x{{200C}}\x{{FE00}}-\x{{FE0E}}\x{{E0100}}-\x{{E01EF}}]', '', 'g') AS t FROM documents),
 p AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM s),
 q AS (SELECT doc_id, c, i, coalesce(lag(c) OVER w, '') AS b, coalesce(lead(c) OVER w, '') AS a FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 k AS (SELECT * FROM q WHERE NOT (ord(c) = 8205 AND NOT (regexp_matches(b, '[""" + chars.PICTOGRAPHS + chars.SKIN + r"""\x{{FE0F}}]') AND regexp_matches(a, '[""" + chars.PICTOGRAPHS + r"""]')))),
 l AS (SELECT doc_id, c, i, coalesce(lag(c) OVER w, '') AS b FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i))
 SELECT doc_id, string_agg(c, '' ORDER BY i) AS clean FROM l WHERE NOT (ord(c) = 65039 AND NOT regexp_matches(b, '[""" + chars.PICTOGRAPHS + r"""0-9#*\x{{00A9}}\x{{00AE}}]')) GROUP BY doc_id"""


def age_profile(docs: DataFrame, ages: DataFrame, newest: float = 13.0) -> DataFrame:
    """doc_id, age, n, anomaly: characters of a text by the version that assigned them, from ages(lo, hi, age); later ones than `newest` are anomalies."""
    from glyphlake.operators.dimensions import counts_by

    return counts_by(docs, ages, "age", "unassigned").withColumn("anomaly", F.coalesce(F.col("age").try_cast("double") > newest, F.lit(False)))


def emoji_age_gradient(docs: DataFrame, ages: DataFrame) -> DataFrame:
    """doc_id, seq, gradient: the difference of versions inside each grapheme of several code points that holds a pictograph."""
    from glyphlake.sources import ucd

    g = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\X)"), F.lit(1)))).alias("seq")).where(F.length("seq") > 1)
    points = g.where(F.col("seq").rlike(r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]")).select("doc_id", "seq", F.explode(F.regexp_extract_all("seq", F.lit("(?s)(.)"), F.lit(1))).alias("c")).withColumn("cp", F.ascii("c"))
    aged = ucd.lookup(points, ages, "age").withColumn("age", F.col("age").try_cast("double"))
    return aged.groupBy("doc_id", "seq").agg((F.max("age") - F.min("age")).alias("gradient"))


def unlisted(docs: DataFrame, pattern: str, listed: DataFrame) -> DataFrame:
    """doc_id, seq, n: matches of pattern in a text that a list(seq) doesn't hold: selectors on bases without a variant, unregistered ideographic
    sequences, joined sequences that are no recommended emoji. With an empty list all are."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("seq")).groupBy("doc_id", "seq").agg(F.count("*").alias("n"))
    return found.join(listed.select("seq").distinct(), "seq", "left_anti").select("doc_id", "seq", "n")


#: Patterns for `unlisted`.
SELECTED, IDEOGRAPHIC, JOINED = r"(?s).[\x{FE00}-\x{FE0F}]", r"(?s).[\x{E0100}-\x{E01EF}]", r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}][\x{FE0F}\x{1F3FB}-\x{1F3FF}]*(?:\x{200D}[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}][\x{FE0F}\x{1F3FB}-\x{1F3FF}]*)+"


def idna_verdicts(labels: DataFrame, idna: DataFrame) -> DataFrame:
    """label, verdict of labels(label) by idna(lo, hi, status, mapping, extra): ASCII letters, digits, hyphens and dots pass; of the others the worst decides."""
    from glyphlake.sources import ucd

    points = labels.select("label").distinct().select("label", F.explode(F.regexp_extract_all("label", F.lit("(?s)([^A-Za-z0-9.-])"), F.lit(1))).alias("c")).withColumn("cp", F.ascii("c"))
    status = ucd.lookup(points, idna.withColumn("status", F.concat_ws(" ", "status", "extra")), "status", "disallowed")
    s = F.col("status")
    rank = F.when(s.startswith("disallowed"), 4).when(s.startswith("deviation"), 3).when(s.startswith("ignored"), 2).when(s.rlike("NV8|XV8"), 1).otherwise(0)
    worst = status.groupBy("label").agg(F.max(rank).alias("worst"))
    names = F.array(*[F.lit(x) for x in ("VALID", "COMPAT", "GHOST", "AMBIGUITY", "INVALID")])
    return labels.select("label").distinct().join(worst, "label", "left").select("label", F.get(names, F.coalesce("worst", F.lit(0))).alias("verdict"))
