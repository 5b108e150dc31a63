"""Secret scans, with DataFrame operations only.

Base kinds are found by their patterns, with positions: the parts that a pattern splits a text into and its matches give
every start. Other tokens that could be keys go through a randomness battery: per inferred encoding, a chi-squared test of
uniformity over the alphabet, a runs test about the alphabet's middle and a test of serial correlation give one
p-value for "drawn at random from its alphabet". A token ends at an = that is not
padding, and of one that fits no single alphabet the longest parts that fit one are tested. Random tokens have uniform p-values and ordinary ones gather near
zero, so in each class of encoding and length the share of ordinary tokens above a threshold is known from the
histogram of the distinct tokens; the threshold of a class is the lowest that keeps this false-discovery share below `FDR`. Classes of
fewer than `LEAST_TOKENS` take the threshold of their encoding's lengths together, or of all classes.

Defined cases: null and empty texts hold nothing; a match that fails its kind's condition is dropped and still takes
its place; repeated rows are scanned each; an empty table gives an empty result; other columns are kept by `redacted`, whatever
their names, and not read by `scanned`; ties of start go by the order of kinds.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import arrays

from .common import materialize

KINDS = ("assign", "access", "hex", "random")
#: Java patterns; group 1 of assign is the value. The others hold their least length, as a longer match can't fail it.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Tokens end at an =, which is a part only as padding at the end; the second form has padding within its least length.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?|(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]++=++(?![A-Za-z0-9+/_-]))"
#: What is tested of a token that fits no single alphabet: its longest parts in either form of base64.
MIXED, PARTS = r"[+/].*[_-]|[_-].*[+/]", (r"[A-Za-z0-9+/]{20,}+=*", r"[A-Za-z0-9_-]{20,}+=*")
LEAST_VALUE = 6
FDR, BINS, LEAST_TOKENS = 0.05, 20, 40
#: Alphabets in order: the first whose pattern fits a token is its encoding. Characters are indexed by their place.
ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


def _matches(text, pattern: str, group: int) -> F.Column:
    """array<struct<start, end, value>> of all matches, in code points."""
    q = F.lit(pattern)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    whole, value, parts = F.regexp_extract_all(text, q, F.lit(0)), F.regexp_extract_all(text, q, F.lit(group)), F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(F.slice(parts, 1, F.size(whole)), lambda x: F.length(x).cast("bigint")).alias("p"), F.transform(whole, lambda x: F.length(x).cast("bigint")).alias("m"), value.alias("v"))

    def placed(x):  # bound as a value, so that it is made once
        sums = arrays.before(F.transform(x, lambda r: r["p"] + r["m"]), F.lit(0).cast("bigint"), lambda a, v: a + v)
        return F.zip_with(x, sums, lambda r, at: F.struct((at + r["p"]).alias("start"), (at + r["p"] + r["m"]).alias("end"), r["v"].alias("value")))

    return F.when(text.rlike(pattern), arrays.bound(rows, placed)).otherwise(empty)


def _normal_cdf(z) -> F.Column:
    """Logistic form of the normal distribution function (error below 2e-4)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _chi_z(x, k) -> F.Column:
    """Wilson and Hilferty's normal score of a chi-squared value with k degrees of freedom."""
    v = 2.0 / (9.0 * k)
    return (F.pow(F.greatest(x, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)


def battery(token) -> F.Column:
    """struct<kind, p>: the class of encoding and length, and the p-value for randomness; null if the token isn't tested.

    A token is tested if it has both letters and digits and fits an alphabet.
    """
    body = F.rtrim(token, F.lit("="))
    encoding, order, size = F.lit(None).cast("string"), F.lit(""), F.lit(1)
    for name, pattern, alphabet in reversed(ALPHABETS):
        fits = token.rlike(pattern)
        encoding, order, size = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(alphabet)).otherwise(order), F.when(fits, F.lit(len(alphabet))).otherwise(size)
    chars = F.regexp_extract_all(body, F.lit("(.)"), F.lit(1))
    codes = F.transform(chars, lambda c: (F.position(c, order) - 1).cast("double"))
    # The squares of the counts of distinct characters add up to the counts of each character in its places.
    squares = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.length(body) - F.length(F.replace(body, c, F.lit(""))))
    row = F.struct(encoding.alias("encoding"), codes.alias("codes"), size.cast("double").alias("m"), squares.alias("squares"))
    names = ("last", "sum", "sum2", "cross", "up", "runs")

    def summed(x):
        def step(a, v):
            high, was = v * 2 >= x["m"], a["last"] * 2 >= x["m"]
            new = (v, a["sum"] + v, a["sum2"] + v * v, a["cross"] + F.when(a["last"] < 0, 0.0).otherwise(a["last"] * v), a["up"] + high.cast("double"), a["runs"] + ((a["last"] < 0) | (high != was)).cast("double"))
            return F.struct(*[c.alias(n) for c, n in zip(new, names, strict=True)])

        sums = F.aggregate(x["codes"], F.struct(*[F.lit(-1.0 if n == "last" else 0.0).alias(n) for n in names]), step)
        return F.struct(x["encoding"].alias("encoding"), x["m"].alias("m"), x["squares"].alias("squares"), F.size(x["codes"]).cast("double").alias("n"), F.get(x["codes"], F.lit(0)).alias("first"), sums.alias("s"))

    def tested(x):
        m, n, s = x["m"], x["n"], x["s"]
        # Chi-squared = m / n * sum of squared counts - n.
        chi = _chi_z(x["squares"] * m / n - n, m - 1)
        mean = 2 * s["up"] * (n - s["up"]) / n + 1
        run_z = (s["runs"] - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.05)))
        average = s["sum"] / n
        variance = F.greatest(s["sum2"] - n * average * average, F.lit(1e-9))
        together = s["cross"] - average * (2 * s["sum"] - x["first"] - s["last"]) + (n - 1) * average * average
        serial = together / variance * F.sqrt(n)
        return F.struct(x["encoding"].alias("encoding"), n.alias("n"), chi.alias("chi"), run_z.alias("run_z"), serial.alias("serial"))

    def joined(x):
        high = F.greatest(x["chi"], F.lit(0.0))
        total = high * high + x["run_z"] * x["run_z"] + x["serial"] * x["serial"]
        p = 1 - _normal_cdf(F.greatest(F.least(_chi_z(total, F.lit(3.0)), F.lit(8.0)), F.lit(-8.0)))
        return F.struct(F.concat(x["encoding"], F.lit(":"), F.floor(F.log2(x["n"]) * 2).cast("string")).alias("kind"), p.alias("p"))

    usable = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    found = F.array(row)
    for f in (summed, tested, joined):  # each value is bound once
        found = F.transform(found, f)
    return F.when(usable & encoding.isNotNull() & (F.length(body) > 1), F.get(found, F.lit(0)))


def found(text) -> tuple[F.Column, F.Column]:
    """Base spans array<struct<start, k, end>> (k: index in KINDS), and candidates array<struct<start, end, kind, p, h>> (h: of the token)."""
    text = F.coalesce(text, F.lit(""))

    def spans(pattern: str, group: int, k: int, least: int) -> F.Column:
        kept = F.filter(_matches(text, pattern, group), lambda x: F.length(x["value"]) >= least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))

    base = F.array_sort(F.concat(spans(ASSIGN, 1, 0, LEAST_VALUE), spans(ACCESS, 0, 1, 0), spans(HEX, 0, 2, 0)))
    return base, _matches(text, TOKEN, 0)


def _parts(t) -> F.Column:
    """The token itself, or its parts (which may overlap) if it fits no single alphabet."""
    inside = F.array_distinct(F.concat(*[_matches(t["value"], p, 0) for p in PARTS]))
    moved = F.transform(inside, lambda x: F.struct((t["start"] + x["start"]).alias("start"), (t["start"] + x["end"]).alias("end"), x["value"].alias("value")))
    return F.when(t["value"].rlike(MIXED), moved).otherwise(F.array(t))


def candidates(base, tokens) -> F.Column:
    """The tested tokens and parts of tokens that touch no base span."""
    free = F.filter(F.flatten(F.transform(tokens, _parts)), lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def one(t):
        return F.transform(F.array(battery(t["value"])), lambda b: F.struct(t["start"].alias("start"), t["end"].alias("end"), b["kind"].alias("kind"), b["p"].alias("p"), F.xxhash64(t["value"]).alias("h")))

    return F.filter(F.flatten(F.transform(free, one)), lambda x: x["kind"].isNotNull())


def lowest(bins: list[int]) -> float | None:
    """The lowest of the bins of p that keeps the share of ordinary tokens at it or above below FDR."""
    random = 2 * sum(bins[BINS // 2 :])
    for k in range(1, BINS):
        above = sum(bins[k:])
        if random and bins[k] and above * BINS - random * (BINS - k) <= FDR * BINS * above:
            return k / BINS
    return None


def thresholds(cands: DataFrame) -> dict[str, float]:
    """The lowest p of each class that is reported; cands(_secret_c: array of candidates).

    A row of each class and bin comes to the driver: the encodings, times twice the binary logarithm of a token's length.
    """
    x = F.col("x")
    distinct = cands.select(F.explode("_secret_c").alias("x")).groupBy(x["kind"].alias("kind"), x["h"].alias("h")).agg(F.max(x["p"]).alias("p"))
    rows = distinct.groupBy("kind", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    counts: dict[str, list[int]] = defaultdict(lambda: [0] * BINS)
    for r in rows:
        for name in (r.kind, r.kind.split(":")[0], ""):
            counts[name][max(0, r.bin)] += r.n
    out = {}
    for kind in sorted({r.kind for r in rows}):
        pool = next((k for k in (kind, kind.split(":")[0]) if sum(counts[k]) >= LEAST_TOKENS), "")
        if (t := lowest(counts[pool])) is not None:
            out[kind] = t
    return out


def _accepted(cands, limits: dict[str, float]) -> F.Column:
    empty = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    if not limits:
        return empty
    limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    kept = F.filter(cands, lambda x: F.coalesce(x["p"] >= F.element_at(limit, x["kind"]), F.lit(False)))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("k"), x["end"].alias("end")))


def _joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scan(docs: DataFrame, *columns: str) -> DataFrame:
    base, tokens = found(F.col("text"))
    rows = docs.select(*columns, base.alias("_secret_base"), tokens.alias("_secret_tokens"))
    cands = F.when(F.size("_secret_tokens") > 0, candidates(F.col("_secret_base"), F.col("_secret_tokens"))).otherwise(F.array())
    return rows.select(*columns, "_secret_base", cands.alias("_secret_c"))


def _is(k: int):
    return lambda s: s["k"] == k


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs(doc_id, text)."""
    rows = materialize(_scan(docs.select("doc_id", "text"), "doc_id"))
    base = F.col("_secret_base")
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    everything = F.array_sort(F.concat(base, _accepted(F.col("_secret_c"), thresholds(rows))))
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(everything).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with all columns, every secret span replaced by mark; spans that touch are one. n_chars follows, if present.

    The texts are scanned once, and written with what was found.
    """
    names = docs.columns
    rows = materialize(_scan(docs, *names))
    spans = F.array_sort(F.concat("_secret_base", _accepted(F.col("_secret_c"), thresholds(rows))))
    text, end = F.col("text"), F.lit(0).cast("bigint")

    def pieces(x):
        reach = arrays.before(F.transform(x, lambda s: s["end"]), end, lambda a, v: F.greatest(a, v))
        return F.zip_with(x, reach, lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), F.lit(mark))).otherwise(F.lit("")))

    def whole(x):
        rest = F.substring(text, (F.array_max(F.transform(x, lambda s: s["end"])) + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(pieces(x), ""), rest)

    some = (F.size("_secret_base") > 0) | (F.size("_secret_c") > 0)
    new = F.when(some, F.get(F.transform(F.filter(F.array(spans), lambda x: F.size(x) > 0), whole), F.lit(0)))
    out = rows.withColumn("_secret_new", new)
    changed = {"text": F.coalesce("_secret_new", "text")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("_secret_new").isNotNull(), F.length("_secret_new").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*names)
