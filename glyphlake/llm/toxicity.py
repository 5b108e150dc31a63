"""Toxic passages by maximum-scoring segments of token log-odds.

Learning: on a bounded sample of labelled documents, tokens get log-odds between toxic and other documents, with a
Dirichlet prior proportional to their overall counts (Monroe et al. 2008). Tokens whose share of toxic documents is
significantly above or below the usual one keep their own log-odds, for or against; all others share the log-odds of being one
of them, which is slightly negative.

Scoring: one pass over a document's tokens (Ruzzo and Tompa 1999, over the tokens that have their own log-odds) gives every
maximal scoring segment. Scores of segments in clean text have an extreme-value tail, K * length * exp(-lambda * score)
expected by chance (Karlin and Altschul 1990): lambda solves sum of p * exp(lambda * score) = 1 over the tokens of clean sample
documents (with the prior's share of each token), and log K is the median over the upper half of the segments that those have. Significant segments are toxic
passages; a document's evidence sums its significant segments over chance, and a logistic curve fitted on the sample turns the
evidence into a score.

Defined cases: null or empty text scores as a text with no evidence; documents without a label take no part in learning;
of several labels of one doc_id the largest counts; with no toxic or no clean label in the sample every score is 0;
an empty table gives an empty result; other columns are not read (kept by `clean`); repeated rows are scored alike.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, map_rows, materialize, prepare

#: Bounds of the model: labelled documents that it learns from, tokens with log-odds of their own. Significance alone
#: chooses tokens; their number only bounds the driver.
SAMPLE_DOCS, LEXICON = 20_000, 100_000
#: Strength of the prior in tokens for each token of the smaller class; least z-score of a lexicon token's share of toxic
#: documents, either way; least documents that have it, and least different words before it in toxic ones (by a hash of 32 values;
#: copies of one document have one).
PRIOR, LEAST_Z, LEAST_DOCS = 0.05, 4.0, 4
#: Segment scores are counted in steps of this size to find K.
STEP = 0.05
#: Expected chance segments below which a segment counts as significant.
LEAST_E = 0.05
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¿¡«»…“”‘’"


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    decay: float = 1.0  # lambda
    log_k: float = 0.0
    a: float = 0.0
    b: float = -math.inf


def tokens(text: str | None) -> list[str]:
    return [w.strip(EDGE) for w in (text or "").lower().split()]


def segments(positions: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score): linear time over the scored tokens.

    Tokens that are not in positions score `other` (below zero) each.
    """
    # first, last, sum before it, sum after it, the last candidate before it whose sum before is lower
    found: list[tuple[int, int, float, float, int]] = []
    total, done = 0.0, -1
    for at, s in zip(positions, scores, strict=True):
        total += other * (at - done - 1)
        done = at
        if s <= 0:
            total += s
            continue
        first, before = at, total
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
        found.append((first, at, before, total, j))
    return [(x[0], x[1], x[3] - x[2]) for x in found]


def scored(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    words = tokens(text)
    get = model.scores.get
    hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    return len(words), segments([i for i, _ in hits], [s for _, s in hits], model.other) if hits else []


def evidence(n: int, parts: list[tuple[int, int, float]], model: Model) -> float:
    """Sum over segments of what they have above the chance level of a text of n tokens; 0 at least."""
    chance = model.log_k + math.log(n + 1) - math.log(LEAST_E)
    return sum(max(0.0, model.decay * s - chance) for _, _, s in parts)


def decay_of(scores: list[float], weights: list[float]) -> float:
    """The lambda above 0 at which the weighted mean of exp(lambda * score) is 1; 1 if no score is above 0 or the mean isn't below."""
    total = sum(weights)
    if max(scores) <= 0 or sum(s * w for s, w in zip(scores, weights, strict=True)) >= 0:
        return 1.0

    def above(x: float) -> bool:
        return sum(w * math.exp(min(700.0, x * s)) for s, w in zip(scores, weights, strict=True)) > total

    high = 1.0
    while not above(high) and high < 1e3:
        high *= 2
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return (low + high) / 2


def log_k_of(counts: list[tuple[float, int]], length: int, decay: float) -> float:
    """Median of log((segments at s or above) / length) + lambda * s over the upper half of the segments (score, how many)."""
    left, rows, above = -(-sum(n for _, n in counts) // 2), [], 0
    for s, n in sorted(counts, reverse=True):
        if left <= 0:
            break
        above += n
        rows.append((math.log(above / length) + decay * s, min(n, left)))
        left -= n
    rows.sort()
    half = sum(n for _, n in rows) / 2
    for x, n in rows:
        half -= n
        if half <= 0:
            return x
    return -math.log(length)


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def passages(text: str | None, model: Model) -> list[tuple[int, int, float]]:
    """Significant toxic passages: first token, last token, score."""
    n, parts = scored(text, model)
    return [p for p in parts if evidence(n, [p], model) > 0]


def score(text: str | None, model: Model) -> float:
    n, parts = scored(text, model)
    return logistic(model.a * math.log1p(evidence(n, parts, model)) + model.b)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and intercept by Newton steps with a small ridge."""
    w = np.zeros(2)
    X = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-2 * np.eye(2), g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From documents that are not held out; docs(doc_id, text), labels(doc_id, toxic)."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)  # SAMPLE_DOCS rows of 12 bytes are broadcast
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(materialize(known)), "doc_id"))

    def counted(c):
        out = defaultdict(lambda: [0, 0, 0, 0, 0])
        for text, toxic in zip(c["text"], c["toxic"], strict=True):
            words = tokens(text)
            before = ""
            for w in words:
                row = out[w]
                row[toxic] += 1
                if toxic:
                    row[4] |= 1 << (zlib.crc32(before.encode("utf-8", "surrogatepass")) & 31)
                before = w
            for w in set(words):
                out[w][2 + toxic] += 1
        return {"word": list(out)} | {k: [v[i] for v in out.values()] for i, k in enumerate(fields)}

    fields = ("clean", "bad", "clean_docs", "bad_docs", "contexts")
    words = map_rows(sample.select("text", "toxic"), "word string, " + ", ".join(f"{k} long" for k in fields), counted)
    words = materialize(words.groupBy("word").agg(*(F.sum(k).alias(k) for k in fields[:4]), F.bit_count(F.bit_or("contexts")).alias("contexts")))
    n_clean, n_bad = words.agg(F.sum("clean"), F.sum("bad")).first()
    if not n_clean or not n_bad:
        return Model()
    docs_of = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = docs_of[1] / (docs_of[0] + docs_of[1])
    n = n_clean + n_bad
    prior = PRIOR * min(n_clean, n_bad)
    alpha = (F.col("clean") + F.col("bad")) * (prior / n)
    bad, clean = F.col("bad") + alpha, F.col("clean") + alpha
    odds = F.log(bad / (n_bad + prior - bad)) - F.log(clean / (n_clean + prior - clean))
    having = F.col("bad_docs") + F.col("clean_docs")
    z = (F.col("bad_docs") - having * base) / F.sqrt(having * (base * (1 - base)))
    # Spread over documents and contexts: a long document or copies of one that repeat a word are no evidence.
    chosen = words.withColumn("odds", odds).withColumn("z", z).withColumn("weight", clean).where(F.length("word") > 0)
    bad_word = (F.col("bad_docs") >= LEAST_DOCS) & (F.col("contexts") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & (F.col("odds") > 0)
    clean_word = (F.col("clean_docs") >= LEAST_DOCS) & (F.col("z") <= -LEAST_Z) & (F.col("odds") < 0)
    lexicon = chosen.where(bad_word | clean_word).orderBy(F.desc(F.abs("z")), "word").limit(LEXICON).collect()
    if not any(r.odds > 0 for r in lexicon):
        return Model()
    share = [min(0.9, sum(r[k] for r in lexicon) / m) for k, m in (("bad", n_bad), ("clean", n_clean))]
    model = Model({r.word: r.odds for r in lexicon}, min(-1e-3, math.log1p(-share[0]) - math.log1p(-share[1])))
    model.decay = decay_of([*(r.odds for r in lexicon), model.other], [*(r.weight for r in lexicon), max(0.0, n_clean + prior - sum(r.weight for r in lexicon))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def listed(c):
        found = [scored(x, shared.value) for x in c["text"]]
        steps = [round(s / STEP) for _, p in found for _, _, s in p]
        return {"step": [*steps, None], "n": [*([1] * len(steps)), sum(n for n, _ in found)]}

    counts = map_rows(sample.where("toxic = 0").select("text"), "step long, n long", listed).groupBy("step").agg(F.sum("n").alias("n")).collect()
    length = sum(r.n for r in counts if r.step is None) + 1
    model.log_k = log_k_of([(r.step * STEP, r.n) for r in counts if r.step is not None], length, model.decay)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(c):
        found = [scored(x, shared.value) for x in c["text"]]
        return {"x": [math.log1p(evidence(n, p, shared.value)) for n, p in found], "toxic": c["toxic"]}

    rows = map_rows(sample.select("text", "toxic"), "x double, toxic int", measured).collect()  # two numbers of SAMPLE_DOCS at most
    model.a, model.b = fit_logistic(np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows]))
    return model


def scores(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c):
        return {"doc_id": c["doc_id"], "score": [score(x, shared.value) for x in c["text"]]}

    out = map_rows(docs.select("doc_id", "text"), "doc_id long, score double", run)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs, with all their columns, that are not predicted toxic."""
    from collections.abc import Iterator

    import pyarrow as pa

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([score(x, shared.value) < 0.5 for x in batch.column(at).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
