"""Personal data by bootstrapped contextual extraction.

Base patterns give seed entities. The two words before an entity and its shape (digits, address-like, mixed) are a lexical
pattern. Patterns and instances (identifier-like tokens) form a graph, which Spark scores in turns: a pattern's
confidence in a kind is the mean confidence of its distinct instances, smoothed; an instance that no base pattern
found gets the noisy-or of its patterns. Patterns with enough distinct seeds and a high confidence then mark the
unseen identifiers that stand in their place; these are seeds of the next round, until no new pattern is confident.

Defined cases: null and empty texts hold nothing; base matches that fail their condition are dropped and still take
their place; an identifier that touches a base span is no candidate; repeated rows are read each; an empty table gives an
empty result; other columns are not read; ties of start go by the order of kinds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, prepare

KINDS = ("email", "ip", "card", "phone")
#: Turns of the scoring; distinct seeds that a pattern needs; least confidence; weight of the smoothing.
TURNS, LEAST_SEEDS, LEAST_CONFIDENCE, SMOOTH = 2, 3, 0.8, 0.5
#: Words and identifiers over this length are known by their digest in the graph.
NAMED = 64

# Possessive and anchored forms of the given patterns: the same matches in linear time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the part before an @ reaches back as far as its class or the last match allows."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _AT.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if not _MARK.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _named(x: str) -> str:
    return x if len(x) <= NAMED else "#" + hashlib.sha1(x.encode("utf-8", "surrogatepass")).hexdigest()


def pattern(words: list[str], entity: str) -> str:
    """The two words before an entity, digits as 0, and its shape; words that are missing before it are empty."""
    shape = "@" if "@" in entity else "a" if any(map(str.isalpha, entity)) else "0"
    return " ".join(_named(re.sub(r"[0-9]", "0", w.lower())) for w in words) + "|" + shape


def candidates(words: list[tuple[int, int]], text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words that hold a digit or an @, without marks around them, that touch no base span."""
    at = reach = 0
    for s, e in words:
        if not _MARK.search(text, s, e):
            continue
        while s < e and not (text[s].isalnum() or text[s] in "+@"):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        while at < len(spans) and spans[at][0] < e:
            reach = max(reach, spans[at][2])
            at += 1
        if s < e and reach <= s:
            yield s, e


def read(text: str | None) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans, and entities and candidates with their pattern (kind: null for a candidate).

    Words are parted by blanks, and by entities inside them: time is linear in the text however long its words are.
    """
    text = text or ""
    spans = base(text)
    if not _MARK.search(text):
        return spans, []
    words = [m.span() for m in _WORD.finditer(text)]
    marks = sorted([(s, e, KINDS[k]) for s, k, e in spans] + [(s, e, None) for s, e in candidates(words, text, spans)], key=lambda x: x[:2])
    seen, at, done = [], 0, 0
    for s, e, kind in marks:
        while at < len(words) and words[at][1] <= s:
            at += 1
        before = [text[a:b] for a, b in words[max(0, at - 2) : at]]
        if at < len(words) and max(words[at][0], done) < s:
            before.append(text[max(words[at][0], done) : s])
        before = ["", "", *before][-2:]
        done = max(done, e)
        seen.append({"start": s, "end": e, "kind": kind, "pattern": pattern(before, text[s:e]), "instance": _named(text[s:e].lower())})
    return spans, seen


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def extracted(docs: DataFrame) -> DataFrame:
    """One row of docs(doc_id, text) each: row, doc_id, spans (base), seen (entities and candidates)."""
    prepare(docs.sparkSession)

    def run(c):
        found = [read(x) for x in c["text"]]
        return {"doc_id": c["doc_id"], "spans": [[{"start": s, "k": k, "end": e} for s, k, e in f[0]] for f in found], "digest": [hashlib.sha256(joined(f[0]).encode()).hexdigest() for f in found], "seen": [f[1] for f in found]}

    schema = "doc_id long, spans array<struct<start:long,k:int,end:long>>, digest string, seen array<struct<start:long,end:long,kind:string,pattern:string,instance:string>>"
    return map_rows(docs.select("doc_id", "text"), schema, run).withColumn("row", F.monotonically_increasing_id())


def _turns(seeds: DataFrame, unknown: DataFrame, n: DataFrame) -> DataFrame:
    """pattern, kind, support, confidence of the patterns with LEAST_SEEDS seeds or more."""
    enough = seeds.groupBy("pattern").agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS)
    sizes = materialize(n.join(enough.select("pattern"), "pattern"))
    seeds, unknown = (materialize(x.join(sizes.select("pattern"), "pattern")) for x in (seeds, unknown))
    held = seeds
    for turn in range(TURNS):
        score = held.groupBy("pattern", "kind").agg(F.sum("c").alias("c"), F.count("*").alias("support")).join(sizes, "pattern")
        score = materialize(score.select("pattern", "kind", "support", (F.col("c") / (F.col("n") + SMOOTH)).alias("confidence")))
        if turn + 1 < TURNS:
            # Noisy-or over the patterns of an instance. Accepted instances are seeds already.
            guess = unknown.join(score, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("c"))
            free = unknown.join(seeds.select("pattern", "instance"), ["pattern", "instance"], "left_anti")
            held = seeds.unionByName(free.join(materialize(guess), "instance").select("pattern", "instance", "kind", "c"))
    return score


def confident_patterns(seen: DataFrame) -> DataFrame:
    """pattern, kind, confidence of the patterns that seen(pattern, instance, kind) supports.

    Instances that confident patterns mark are seeds of the next round, weighted by the noisy-or of those patterns. Rounds
    end when no new pattern is confident, so there are at most as many as patterns.
    """
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    n = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    first = edges.where("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("c"))
    unknown = edges.where("kind is null").select("pattern", "instance")
    seeds, good, known = first, None, 0
    while True:
        score = _turns(seeds, unknown, n)
        new = score.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("support") >= LEAST_SEEDS)).select("pattern", "kind", "confidence")
        if good is not None:
            new = good.union(new).groupBy("pattern", "kind").agg(F.max("confidence").alias("confidence"))
        good = materialize(new)
        count = good.count()
        if count == known:
            return good
        known = count
        accepted = unknown.join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("c"))
        seeds = first.unionByName(unknown.join(materialize(accepted), "instance").select("pattern", "instance", "kind", "c"))


def _is(i: int):
    return lambda k: k == i


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs(doc_id, text)."""
    rows = materialize(extracted(docs))
    seen = rows.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    good = materialize(confident_patterns(seen))
    # Of several kinds the most confident; every instance of a pattern stays.
    good = good.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("found"))
    new = seen.where("kind is null").drop("kind").join(materialize(good), "pattern")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("found")).cast("int") - 1
    new = new.groupBy("row").agg(F.collect_list(F.struct(F.col("start"), number.alias("k"), F.col("end"))).alias("new"))
    rows = rows.join(new, "row", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    everything = F.array_sort(F.concat("spans", F.coalesce("new", F.array().cast("array<struct<start:long,k:int,end:long>>"))))
    text = F.array_join(F.transform(everything, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["k"]), _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.col("digest").alias("base_sha256"), text.alias("spans"))
