"""One text for Spark SQL and for the oracle, where both engines share the semantics.

@count{p}: matches of p in text; @has{p}: whether p matches; @all{p}: array of matches; @rx{p}: the pattern as a literal;
@lines: array of lines, empty ones too; @outer{a}: an array's elements as rows, null if there are none; @graphemes: clusters; @bytes: UTF-8 length; @pairs: its bytes in hex; @chars: array of code points; @pos{a}: i, c of an array's elements; @del{p}: text without matches. Patterns hold no quotes (\\x27).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphlake.sources.tables import PERTURBED, perturbed, read

#: Grapheme clusters of the texts at hand, for an engine without \\X.
GRAPHEME = r"(?s)\r\n|[^\p{M}\x{200C}\x{200D}\x{E0020}-\x{E007F}\r\n\x{200B}\x{202A}-\x{202E}][\p{M}\x{200C}\x{200D}\x{E0020}-\x{E007F}]*|."

_FORMS = {
    "count": ("cast(regexp_count(text, r'{p}') as bigint)", "cast(len(regexp_extract_all(text, '{p}')) as bigint)"),
    "has": ("text rlike r'{p}'", "regexp_matches(text, '{p}')"),
    "all": ("regexp_extract_all(text, r'({p})', 1)", "regexp_extract_all(text, '{p}')"),
    "del": ("regexp_replace(text, r'{p}', '')", "regexp_replace(text, '{p}', '', 'g')"),
    "rx": ("r'{p}'", "'{p}'"),
    "outer": ("explode_outer({p})", "unnest(CASE WHEN len({p}) > 0 THEN {p} ELSE [NULL] END)"),
    "pos": ("(SELECT doc_id, posexplode({p}) AS (i, c) FROM pdocs)", "(SELECT doc_id, unnest({p}) AS c, generate_subscripts({p}, 1) - 1 AS i FROM pdocs)"),
}
_BARE = {
    "@bytes": ("cast(octet_length(text) as bigint)", "cast(strlen(text) as bigint)"),
    "@lines": (r"split(text, r'\x{000D}\x{000A}|[\x{000A}\x{000D}]', -1)", r"regexp_split_to_array(text, '\x{000D}\x{000A}|[\x{000A}\x{000D}]')"),
    "@graphemes": (r"cast(regexp_count(text, r'\X') as bigint)", f"cast(len(regexp_extract_all(text, '{GRAPHEME}')) as bigint)"),
    "@chars": ("regexp_extract_all(text, r'(?s)(.)', 1)", "string_split(text, '')"),
    "@pairs": ("regexp_extract_all(hex(encode(text, 'UTF-8')), '(..)', 1)", "regexp_extract_all(hex(text), '..')"),
    "@array(": ("array(", "list_value("),
    "percentile(": ("percentile(", "quantile_cont("),
    "@sha": ("sha2(text, 256)", "sha256(text)"),
    "explode(": ("explode(", "unnest("),
    "sequence(": ("sequence(", "generate_series("),
    "regexp_like(": ("regexp_like(", "regexp_matches("),
}


def expand(sql: str, engine: int) -> str:
    """engine 0: Spark, 1: the oracle."""
    out, at = [], 0
    for m in re.finditer(r"@(count|has|all|del|rx|pos|outer)\{", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"{": 1, "}": -1}.get(sql[end], 0)
            end += 1
        inner = sql[m.end() : end - 1]
        out += [sql[at : m.start()], _FORMS[m[1]][engine].replace("{p}", expand(inner, engine) if m[1] in ("pos", "outer") else inner)]
        at = end
    whole = "".join(out) + sql[at:]
    for k, v in _BARE.items():
        whole = whole.replace(k, v[engine])
    # Java names scripts with Is; the oracle has no suffix for doubles.
    return re.sub(r"\\p\{(Latin|Cyrillic|Greek|Han|Arabic|Hebrew)\}", r"\\p{Is\1}", whole) if engine == 0 else re.sub(r"(\d\.\d+)D\b", r"\1", whole)


def spark_query(sql: str, tables: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    """A query over pdocs (the perturbed documents) and other tables by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = expand(sql, 0)
        frames = {"pdocs": perturbed(spark, sf_dir)} if "pdocs" in text else {}
        frames |= {t: read(spark, sf_dir, t) for t in tables}
        for name in frames:
            text = re.sub(rf"\b{name}\b(?!\.)", "{" + name + "}", text) if name == "pdocs" else re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return spark.sql(_escaped(text, frames), **frames)

    return run


def _escaped(text: str, frames: dict) -> str:
    """Braces of patterns are kept from the formatter; those of frames aren't."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return text


def oracle(sql: str) -> str:
    text = expand(sql, 1)
    if "pdocs" not in text:
        return text
    view = f"pdocs AS (SELECT doc_id, lang, source, {PERTURBED} AS text FROM documents)"
    return re.sub(r"^\s*WITH\s", f"WITH {view}, ", text) if re.match(r"\s*WITH\s", text) else f"WITH {view} {text}"
