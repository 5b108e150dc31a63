"""Operators on the properties of characters: runs, flags, the atlas of the characters in use, marks, emoji, escapes.

What depends on a character alone is computed once for each distinct character (a table that Unicode's size bounds)
or looked up from a cache that the same size bounds; what depends on order is computed inside one text, without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import props
from glyphlake.operators.atoms import distinct_counts


def runs_of(text: str, name: str) -> dict[str, tuple[int, int, int]]:
    """Value -> runs, longest run, characters."""
    of, out = props.PROPERTIES[name], {}
    for value, run in groupby(map(of, text)):
        n = sum(1 for _ in run)
        k, longest, whole = out.get(value, (0, 0, 0))
        out[value] = (k + 1, max(longest, n), whole + n)
    return out


def property_runs(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """doc_id, property, value, runs, longest, chars of docs(doc_id, text); a null or empty text has no rows."""

    @F.pandas_udf("array<struct<property:string,value:string,runs:long,longest:long,chars:long>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([[{"property": p, "value": v, "runs": a, "longest": b, "chars": c} for p in names for v, (a, b, c) in sorted(runs_of(t or "", p).items())] for t in x])

    return docs.select("doc_id", F.explode(run("text")).alias("r")).select("doc_id", "r.*")


def _counts(docs: DataFrame) -> DataFrame:
    """doc_id, ch, n, counted inside each text."""
    return docs.where("text <> ''").select("doc_id", F.explode(distinct_counts()).alias("x")).select("doc_id", F.col("x.c").alias("ch"), "x.n")


def _labels(of, column: str):
    """The labels that hold for a character, which a worker looks up once each."""

    @F.pandas_udf("array<string>")
    def label(x: pd.Series) -> pd.Series:
        return x.map(lambda c: list(of(c)))

    return F.explode(label(column))


def property_flags(docs: DataFrame) -> DataFrame:
    """doc_id, flag, n: the characters of a text that have a property."""
    return _counts(docs).select("doc_id", _labels(props.flags_of, "ch").alias("flag"), "n").groupBy("doc_id", "flag").agg(F.sum("n").alias("n"))


def character_effects(docs: DataFrame) -> DataFrame:
    """effect, ch, n, docs: characters that case or compatibility mappings change."""
    counts = _counts(docs).groupBy("ch").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    return counts.select(_labels(props.effects_of, "ch").alias("effect"), "ch", "n", "docs")


def script_places(docs: DataFrame, extended: bool = False) -> DataFrame:
    """doc_id, script, n, first: characters of each script and the place of the first; extended: of each script that uses them."""
    of = props.extensions_of if extended else lambda c: (props.script_of(c),)
    rows = docs.where("text <> ''").select("doc_id", "text", F.explode(distinct_counts()).alias("x"))
    rows = rows.select("doc_id", F.col("x.c").alias("ch"), "x.n", (F.instr("text", F.col("x.c")) - 1).cast("long").alias("first"))
    rows = rows.select("doc_id", _labels(of, "ch").alias("script"), "n", "first")
    return rows.groupBy("doc_id", "script").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


ATLAS = "cp long, ch string, n long, docs long, name string, category string, bidi string, ccc int, width string, script string, mirrored boolean, decomposition string, numeric double, nfkc string, utf8 string, escape string"


def atlas(docs: DataFrame) -> DataFrame:
    """One row of each character in use, with its counts and properties; a character without a name has null."""

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (ord(c), c, n, d, unicodedata.name(c, None), unicodedata.category(c), unicodedata.bidirectional(c), unicodedata.combining(c), unicodedata.east_asian_width(c), props.script_of(c), bool(unicodedata.mirrored(c)), unicodedata.decomposition(c) or None, unicodedata.numeric(c, None), unicodedata.normalize("NFKC", c), c.encode().hex(), f"\\u{{{ord(c):X}}}")
                for c, n, d in zip(f.ch, f.n, f.docs, strict=True)
            ]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ATLAS.split(", ")])

    return _counts(docs).groupBy("ch").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).mapInPandas(describe, ATLAS)


_MARKS = regex.compile(r"\P{ccc=0}{2,}")


def marks_of(text: str) -> tuple[int, int, int, int]:
    """Runs of more than thirty marks, neighbours of one class, repeated marks, and graphemes that aren't their own NFC."""
    if text.isascii():
        return 0, 0, 0, 0
    runs = _MARKS.findall(unicodedata.normalize("NFD", text))
    near = [(x, y) for r in runs for x, y in zip(r, r[1:], strict=False)]
    equal = sum(unicodedata.combining(x) == unicodedata.combining(y) for x, y in near)
    changed = [] if unicodedata.is_normalized("NFC", text) else regex.findall(r"\X", text)
    unstable = sum(unicodedata.normalize("NFC", g) != g for g in changed if not g.isascii())
    return sum(len(r) > 30 for r in runs), equal, sum(x == y for x, y in near), unstable


def mark_structure(docs: DataFrame) -> DataFrame:
    kind = "stream_unsafe long, equal_class long, repeated long, unstable_graphemes long"

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marks_of(t or "") for t in x], columns=[c.split()[0] for c in kind.split(", ")])

    return docs.select("doc_id", run("text").alias("m")).select("doc_id", "m.*")


def numeric_of(text: str) -> tuple[float, int, int]:
    """Sum of all numeric values, sum of the ASCII digits, and decimal digit systems."""
    found = [c for c in text if unicodedata.numeric(c, None) is not None]
    systems = {ord(c) - unicodedata.decimal(c) for c in found if unicodedata.decimal(c, None) is not None}
    return float(sum(unicodedata.numeric(c) for c in found)), sum(int(c) for c in found if c.isascii()), len(systems)


def numeric_mass(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("total double, ascii long, systems long")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([numeric_of(t or "") for t in x], columns=["total", "ascii", "systems"])

    return docs.select("doc_id", run("text").alias("m")).select("doc_id", "m.total", "m.ascii", "m.systems", (F.col("m.total") - F.col("m.ascii")).alias("divergence"))


_EMOJI = regex.compile(r"\p{Extended_Pictographic}|\p{Regional_Indicator}|\p{Emoji_Modifier}|⃣")
#: A skin tone after something that takes none.
_LONE = regex.compile(r"(?<![\p{Emoji_Modifier_Base}️])\p{Emoji_Modifier}")
_PART = {0x200D: "ZWJ", 0xFE0F: "VS16", 0xFE0E: "VS15", 0x20E3: "KEYCAP", 0xE007F: "CANCEL"}


def _part(c: str) -> str:
    if regex.match(r"\p{Regional_Indicator}", c):
        return "RI"
    return "TONE" if regex.match(r"\p{Emoji_Modifier}", c) else "TAG" if 0xE0020 <= ord(c) <= 0xE007E else _PART.get(ord(c), "BASE")


def emoji_of(text: str) -> list[dict]:
    """Graphemes that hold emoji: kind, parts, qualification by their selectors, and what is broken about them."""
    out = []
    for g in regex.findall(r"\X", text) if not text.isascii() else []:
        if not _EMOJI.search(g):
            continue
        parts = [_part(c) for c in g]
        presents = bool(regex.match(r"\p{Emoji_Presentation}", g))
        broken = "fragment" if g[-1] == "‍" or parts.count("RI") == 1 else "orphan" if parts[0] in ("TONE", "KEYCAP", "ZWJ") or _LONE.search(g) else "shattered" if "TAG" in parts and parts[-1] != "CANCEL" else None
        qualified = "component" if parts[0] in ("TONE",) else "fully" if presents or "VS16" in parts else "unqualified"
        out.append({"seq": g, "kind": "component" if len(g) == 1 and parts[0] != "BASE" else "atomic" if len(g) == 1 else "sequence", "parts": " + ".join(parts), "points": len(g), "bytes": len(g.encode()), "qualification": qualified, "diagnosis": broken, "forced_text": presents and "VS15" in parts})
    return out


def emoji(docs: DataFrame) -> DataFrame:
    """One row of each emoji form in a text, with its number."""

    @F.pandas_udf("array<struct<seq:string,kind:string,parts:string,points:long,bytes:long,qualification:string,diagnosis:string,forced_text:boolean>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([emoji_of(t or "") for t in x])

    return docs.select("doc_id", F.explode(run("text")).alias("e")).select("doc_id", "e.*").groupBy("doc_id", "seq", "kind", "parts", "points", "bytes", "qualification", "diagnosis", "forced_text").agg(F.count("*").alias("n"))


def identifier_of(token: str) -> str:
    """Policy of an identifier: allowed, uncommon (ideographs have a pardon) or restricted."""
    if not token.isidentifier() or unicodedata.normalize("NFKC", token) != token:
        return "restricted"
    scripts = {props.script_of(c) for c in token} - {"Common", "Inherited"}
    if scripts & {"Han", "Hiragana", "Katakana", "Hangul"} and scripts <= {"Latin", "Han", "Hiragana", "Katakana", "Hangul"}:
        return "allowed"
    return "restricted" if len(scripts) > 1 else "uncommon" if scripts & {"Other", "Syriac", "Mongolian", "Nushu"} else "allowed"


def identifiers(tokens: DataFrame) -> DataFrame:
    """Policy and number of each distinct token of tokens(token)."""

    @F.pandas_udf("string")
    def policy(x: pd.Series) -> pd.Series:
        return x.map(identifier_of)

    return tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("policy", policy("token"))


_SYLLABLES = regex.compile(r"(?<!\p{InSC=Consonant}\p{InSC=Nukta}?)\p{InSC=Vowel_Dependent}")
_CONJUNCT = regex.compile(r"\p{InSC=Consonant}\p{InSC=Virama}(?=[\s‌]|$)")
_FRACTURE = regex.compile(r"\p{jt=D}\p{jt=U}(?=\p{jt=D})")
_FORCED = regex.compile("‍(?=[\\p{jt=U}\\s]|$)|(?<=\\p{jt=U}|\\s|^)‍")


def script_of_text(text: str) -> tuple[int, int, int, int]:
    """Vowel signs without a consonant, dead conjuncts, broken joins, joins that are forced."""
    return (0, 0, 0, 0) if text.isascii() else tuple(len(p.findall(text)) for p in (_SYLLABLES, _CONJUNCT, _FRACTURE, _FORCED))


def script_structure(docs: DataFrame) -> DataFrame:
    names = ["indic_structure", "indic_conjunct", "cursive_fracture", "cursive_flux"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([script_of_text(t or "") for t in x], columns=names)

    return docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")
