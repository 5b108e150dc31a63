"""Operators with state inside one text: bidi stacks, hidden markup, delimited rows, layered decoding."""

from __future__ import annotations

import base64
import html
import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser
from statistics import pvariance
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _brackets() -> dict[str, str]:
    """Opening bracket -> closing one: the ASCII pairs, and mirrored openings that their closing follows."""
    out = {"[": "]", "{": "}"}
    for p in range(0x10000):
        c, d = chr(p), chr(p + 1)
        if unicodedata.category(c) == "Ps" and unicodedata.category(d) == "Pe" and unicodedata.mirrored(c) and unicodedata.mirrored(d):
            out[c] = d
    return out


PAIRED = _brackets()
CLOSING = set(PAIRED.values())


def bidi_of(text: str) -> tuple[int, int, int, int, int]:
    """Unclosed embeddings, unclosed isolates, unmatched PDF, unmatched PDI, unbalanced brackets: three stacks of their own."""
    deep = isolates = pdf = pdi = bad = 0
    stack: list[str] = []
    for c in text:
        if c in "‪‫‭‮":
            deep += 1
        elif c == "‬":
            pdf, deep = (pdf, deep - 1) if deep else (pdf + 1, 0)
        elif c in "⁦⁧⁨":
            isolates += 1
        elif c == "⁩":
            pdi, isolates = (pdi, isolates - 1) if isolates else (pdi + 1, 0)
        elif c in PAIRED:
            stack.append(PAIRED[c])
        elif c in CLOSING:
            if stack and stack[-1] == c:
                stack.pop()
            else:
                bad += 1
    return deep, isolates, pdf, pdi, bad + len(stack)


def bidi_structure(docs: DataFrame) -> DataFrame:
    """doc_id and the five counts of docs(doc_id, text)."""
    kind = "unclosed_embeddings long, unclosed_isolates long, unmatched_pdf long, unmatched_pdi long, unbalanced_brackets long"

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bidi_of(t or "") for t in x], columns=[c.split()[0] for c in kind.split(", ")])

    return docs.select("doc_id", run("text").alias("b")).select("doc_id", "b.*")


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDING = (
    ("layout", re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")),
    ("photometric", re.compile(r"opacity\s*:\s*0(?:\.0+)?(?![.0-9])|color\s*:\s*transparent")),
    ("geometric", re.compile(r"font-size\s*:\s*0|clip\s*:\s*rect\(\s*0")),
    ("displacement", re.compile(r"(?:left|top|text-indent)\s*:\s*-\d{3,}")),
)


class _Hidden(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.path: list[tuple[str, str | None]] = []
        self.open: Counter[str] = Counter()
        self.found: list[tuple[str, str, str]] = []
        self.endless: set[str] = set()

    def _closed(self, kind, i, parse):
        """What parse gives at i; when one of a kind has no end in the markup, later ones aren't searched for theirs."""
        k = -1 if kind in self.endless else parse(i)
        if k < 0:
            self.endless.add(kind)
        return k

    def parse_comment(self, i, report=True):
        return self._closed("comment", i, super().parse_comment)

    def parse_pi(self, i):
        return self._closed("pi", i, super().parse_pi)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        given = dict(attrs)
        style = (given.get("style") or "").lower()
        vector = next((k for k, p in _HIDING if p.search(style)), None)
        if "sr-only" in (given.get("class") or ""):
            vector = None
        above = self.path[-1][1] if self.path else None
        self.path.append((tag, vector or above))
        self.open[tag] += 1

    def handle_endtag(self, tag):
        closed = None if self.open[tag] else tag  # an end without a start closes nothing
        while closed != tag:
            closed = self.path.pop()[0]
            self.open[closed] -= 1

    def handle_data(self, data):
        if self.path and self.path[-1][1] and data.strip():
            self.found.append((self.path[-1][1], " > ".join(t for t, _ in self.path), data.strip()))


def hidden_of(markup: str | None) -> list[tuple[str, str, str]]:
    """(vector, lineage, text) of text that a reader doesn't see; hiding is inherited."""
    p = _Hidden()
    p.feed(markup or "")
    p.close()
    return p.found


def html_hidden(pages: DataFrame) -> DataFrame:
    """page_id, vector, lineage, text of hidden text in pages(page_id, html)."""

    @F.pandas_udf("array<struct<vector:string,lineage:string,text:string>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([[{"vector": a, "lineage": b, "text": c} for a, b, c in hidden_of(t)] for t in x])

    return pages.select("page_id", F.explode(run("html")).alias("h")).select("page_id", "h.*")


def ghost_text(hidden: DataFrame) -> DataFrame:
    """The hidden text of a page in one line of marks, by its lineage (one page's rows meet)."""
    marks = F.array_sort(F.collect_list(F.concat(F.lit("["), "vector", F.lit(": "), "lineage", F.lit("] "), "text")))
    return hidden.groupBy("page_id").agg(F.array_join(marks, " ").alias("ghosts"), F.count("*").alias("n"))


def fis_score(hidden: DataFrame) -> DataFrame:
    """Severity times the diversity of vectors, by page."""
    weight = F.when(F.col("vector") == "layout", 3).when(F.col("vector") == "photometric", 2).otherwise(1)
    return hidden.groupBy("page_id").agg((F.sum(weight) * F.countDistinct("vector")).cast("long").alias("fis"))


_QUOTED = re.compile(r'"[^"]*"')


def topology_of(text: str) -> dict:
    """Delimiter by least variance of its count on sampled lines, modal columns, ragged rows, cells that start a formula."""
    lines = [x for x in text.splitlines() if x]
    if len(lines) > 1000:
        half = len(lines) // 2
        lines = lines[:400] + lines[half - 100 : half + 100] + lines[-400:]
    bare = [_QUOTED.sub("", x) for x in lines]
    counts = {d: [x.count(d) for x in bare] for d in ",\t|;"}
    best = min((d for d in counts if any(counts[d])), key=lambda d: (pvariance(counts[d]), -sum(counts[d])), default=None)
    if best is None:
        return {"delimiter": None, "columns": 1, "ragged": 0, "injections": 0}
    columns = Counter(n + 1 for n in counts[best])
    mode = max(columns, key=lambda n: (columns[n], n))
    cells = [c.strip() for x in bare for c in x.split(best)]
    return {"delimiter": best, "columns": mode, "ragged": len(lines) - columns[mode], "injections": sum(c[:1] in ("=", "@", "+", "-") for c in cells if c)}


def topology(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("delimiter string, columns long, ragged long, injections long")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([topology_of(t or "") for t in x])

    return docs.select("doc_id", run("text").alias("t")).select("doc_id", "t.*")


def _kind(cell: str) -> str:
    try:
        float(cell)
    except ValueError:
        return "text" if cell else "empty"
    return "number"


#: Share of a column's cells that its main type must have for the others to be a drift.
MAIN_TYPE = 0.9


def drifts_of(text: str) -> list[dict]:
    """Columns of a delimited text that hold one type with exceptions: column, type, exceptions."""
    best = topology_of(text)["delimiter"]
    if best is None:
        return []
    columns: dict[int, Counter] = {}
    for line in text.splitlines():
        for i, cell in enumerate(_QUOTED.sub("q", line).split(best)):
            columns.setdefault(i, Counter())[_kind(cell.strip())] += 1
    out = []
    for i, kinds in columns.items():
        kind, n = kinds.most_common(1)[0]
        if MAIN_TYPE * kinds.total() <= n < kinds.total():
            out.append({"col": i, "type": kind, "exceptions": kinds.total() - n})
    return out


def type_drift(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("array<struct<col:long,type:string,exceptions:long>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([drifts_of(t or "") for t in x])

    return docs.select("doc_id", F.explode(run("text")).alias("d")).select("doc_id", "d.*")


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_OCTAL = re.compile(r"\\([0-3][0-7]{2})")
_CALL = re.compile(r"(?i)\b(?:char|chr)\(\s*(\d{1,7})\s*\)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=])")
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[0-9]+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _unquoted_run(m: re.Match) -> str:
    out = unquote(m[0], errors="surrogateescape")
    out = re.sub("[\udc80-\udcff]", lambda c: f"%{ord(c[0]) - 0xDC00:02X}", out)
    return out if len(out) < len(m[0]) else m[0]


def _unquoted(text: str) -> str:
    """Bytes that are no UTF-8 stay as they are, as in '10%deutsch'."""
    try:
        return unquote(text, errors="strict")
    except UnicodeDecodeError:
        return _PERCENT.sub(_unquoted_run, text)


def _called(m: re.Match) -> str:
    return chr(int(m[1])) if int(m[1]) < 0x110000 and not 0xD800 <= int(m[1]) < 0xE000 else m[0]


def _unescaped(m: re.Match) -> str:
    point = int(m[1] or m[2], 16)
    return m[0] if 0xD800 <= point < 0xE000 else chr(point)


def _unpacked(m: re.Match) -> str:
    """A run that reads as a word or a number stays unless it holds ASCII: long ones happen to be Base64 of rare characters."""
    try:
        out = base64.b64decode(m[0], validate=True).decode()
    except ValueError:
        return m[0]
    if _WORD.fullmatch(m[0]) and not out.isascii():
        return m[0]
    return out if out.isprintable() or all(c.isprintable() or c.isspace() or unicodedata.category(c) == "Cf" for c in out) else m[0]


#: Layers in the order in which they are tried. Each makes a text shorter, so taking them off ends.
STEPS = (
    ("url", lambda t: _unquoted(t) if "%" in t else t),
    ("html", lambda t: html.unescape(t) if "&" in t else t),
    ("escape", lambda t: _ESCAPE.sub(_unescaped, t)),
    ("octal", lambda t: _OCTAL.sub(lambda m: chr(int(m[1], 8)), t)),
    ("call", lambda t: _CALL.sub(_called, t)),
    ("base64", lambda t: _BASE64.sub(_unpacked, t)),
)


def decoded_of(text: str) -> tuple[str, list[str]]:
    """The text after its layers are taken off (URL, entities, escapes, octal, character calls, runs of Base64), and their names."""
    names: list[str] = []
    while True:
        for name, step in STEPS:
            new = step(text)
            if new != text:
                shorter, text = len(new) < len(text), new
                names.append(name)
                break
        else:
            return text, names
        if not shorter:
            return text, names


def recursive_deobfuscate(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("plain string, layers array<string>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, []) if t is None else decoded_of(t) for t in x], columns=["plain", "layers"])

    return docs.select("doc_id", run("text").alias("d")).select("doc_id", "d.*")


def normalization_bomb_of(text: str) -> float:
    return len(unicodedata.normalize("NFKC", text)) / len(text) if text else 1.0
