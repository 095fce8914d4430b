"""Toxic passages as maximum-scoring segments of word log-odds.

Token scores are log-odds ratios of word frequencies in toxic and other labelled texts under a Dirichlet prior in
proportion to the pooled frequencies (Monroe et al.); the lower bound of a significantly positive ratio counts if
that of the numbers of texts with the word is as well (as words repeat within a text); other words cost a small fixed
drift. Ruzzo and Tompa's scan finds every maximal segment in linear time.

Scores follow an extreme-value law (Karlin and Altschul): lambda solves sum p e^(lambda s) = 1 over the words of the other
texts, K is the most likely value for the best segments of these texts. A segment's normalised score is x = lambda s -
log(K n), the expected number of such by chance e^-x; it is significant if that is small. A document's segments are
aggregated by the law's sums: the r best sum up to t with probability e^-t t^(r-1) / (r! (r-1)!) by chance, and the
least of these over all r, each weighted by 2^-r, is the document's evidence. Its score is the probability of the label by a
logistic curve over the evidence, fitted on training rows.

The fit takes about 3,000 toxic and 6,000 other labelled texts (parameters). Null and empty texts have no segment and
get the share of toxic texts among those without; rows with null labels teach nothing; of several labels of a
document the largest counts; repeated rows are scored each; of segments with equal scores the first ones come first;
without labels all scores are 0; further columns are ignored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Known, Words, blocks, documents, remainder, sampled, schema_with, text_of, written
from .op10_langid import RUNS

TOXIC, OTHER = 3000, 6000
#: Words cost DRIFT; a term's score is its log-odds less Z standard deviations, and counts from LEAST on. The prior
#: weighs PRIOR of all counts.
DRIFT, Z, LEAST, PRIOR = 0.15, 2.5, 1.5, 0.02
SIGNIFICANT = 0.05


def term(word: str) -> str:
    return "".join(RUNS(word.lower()))


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a text with these positive words; all others cost drift.

    ``found`` has the segments so far as (first, end, sum before it, sum at its end, the nearest earlier one with a smaller
    sum before it). What lies between a segment and that one has no smaller sum before it than the segment, so a search
    goes from one to the next by these links: each is followed once, and all takes linear time."""
    found: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for p, s in zip(places, scores):
        total -= drift * (p - at)
        first, before = p, total
        total, at = total + s, p + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, at, before, total, j))
                break
            first, _, before, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)
    without: float = 0.0

    def evidence(self, score, n):
        """-log of the number of segments with this score that n background words give by chance."""
        return self.lam * score - self.log_k - np.log(np.maximum(n, 1))

    def aggregate(self, scores: list[float], n: int) -> float:
        """Evidence of a text of n words with these segments: of the r best together, for the best r."""
        best, t, logs = -math.inf, 0.0, 0.0
        for r, x in enumerate(sorted((float(self.evidence(s, n)) for s in scores), reverse=True), 1):
            t += x
            if r > 1 and (x <= 0 or t <= 0):
                break
            logs += math.log(r) + (math.log(r - 1) if r > 1 else 0.0)  # of r! (r - 1)!
            own = t if r == 1 else t - (r - 1) * math.log(t) + logs
            best = max(best, own - r * math.log(2))
        return best

    def probability(self, x):
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * x, -30, 30)))


class Scanner:
    def __init__(self, model: Model):
        self.model, self.known, self.value = model, Known(), np.zeros(0)

    def segments(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Words of each text, and its segments."""
        words = Words(column)
        if self.known.n > self.known.most:
            self.known.clear()
            self.value = self.value[:0]

        def learn(places: np.ndarray) -> None:
            data, get = words.buf.tobytes(), self.model.scores.get
            new = [get(term(data[a:b].decode()), 0.0) for a, b in zip(words.starts[places].tolist(), words.ends[places].tolist())]
            self.value = np.concatenate([self.value, new])

        slots = self.known.slots_for(words.hashes(), learn)
        value = self.value[slots]
        hot = np.flatnonzero(value > 0)
        cuts = np.searchsorted(hot, words.first)
        out = []
        for i in range(len(column)):
            some = hot[cuts[i] : cuts[i + 1]]
            out.append(segments((some - words.first[i]).tolist(), value[some].tolist(), self.model.drift) if len(some) else [])
        return np.diff(words.first), out


def frequencies(texts: DataFrame) -> DataFrame:
    """(term, toxic, n, texts): how often each term is there, and in how many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, where = Counter(), Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                own = Counter((t, toxic) for t in map(term, text.split()) if t)
                found.update(own)
                where.update(own.keys())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64()), pa.array([where[k] for k in found], pa.int64())], ["term", "toxic", "n", "texts"])

    return texts.select("toxic", "text").mapInArrow(run, "term string, toxic int, n long, texts long").groupBy("term", "toxic").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def log_odds(freq: DataFrame, prior: float = PRIOR, z: float = Z) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of the terms that are significantly commoner in toxic texts, and their background shares."""
    wide = freq.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"), *(F.sum(F.when(F.col("toxic") == k, F.col("texts")).otherwise(0)).alias(x) for k, x in ((1, "ta"), (0, "tb"))))
    wide = written(wide, "op8-terms")
    def bound(toxic: str, other: str) -> tuple[Column, Column]:
        """Lower bound of the log-odds ratio for these counts, and the share among the other ones."""
        na, nb = (float(x or 0) for x in wide.agg(F.sum(toxic), F.sum(other)).first())
        weight = prior * (na + nb)
        alpha = F.lit(prior) * (F.col(toxic) + F.col(other))
        part = lambda y, n: F.log((F.col(y) + alpha) / (n + weight - F.col(y) - alpha))
        sigma = F.sqrt(1 / (F.col(toxic) + alpha) + 1 / (F.col(other) + alpha))
        return part(toxic, na) - part(other, nb) - z * sigma, (F.col(other) + alpha) / (nb + weight)

    if not all(wide.agg(F.sum("a"), F.sum("b")).first()):
        return {}, {}
    (d, share), (by_text, _) = bound("a", "b"), bound("ta", "tb")
    chosen = wide.select("term", d.alias("d"), share.alias("share"), by_text.alias("t")).where((F.col("d") >= LEAST) & (F.col("t") >= LEAST))
    rows = chosen.collect()  # significant terms of a bounded sample
    return {r.term: r.d for r in rows}, {r.term: r.share for r in rows}


def root(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum p e^(lambda s) = 1."""
    rest = max(1 - shares.sum(), 1e-9)
    f = lambda x: float((shares * np.exp(x * scores)).sum() + rest * math.exp(-x * drift) - 1)
    lo, hi = 1e-6, 1e-6
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, 2 * hi
    if hi <= 2e-6:
        return 1e-3  # no negative drift: scores count for little
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    mean, spread = float(np.average(x, weights=w)), float(x.std()) or 1.0
    X, beta = np.stack([np.ones(len(x)), (x - mean) / spread], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        g = X.T @ (w * (y - p)) - ridge * beta
        h = (X * (w * p * (1 - p))[:, None]).T @ X + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] - beta[1] * mean / spread), float(beta[1] / spread)


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, other: int = OTHER) -> Model:
    """From (doc_id, text) and (doc_id, toxic): on a bounded sample of labelled rows (parameters)."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = written(sampled(one.where("toxic = 1"), "toxic", toxic).union(sampled(one.where("toxic = 0"), "toxic", other)), "op8-sample")
    natural = {r[0]: r[1] for r in one.groupBy("toxic").count().collect()}
    # The sample's size is bounded by its parameters, whatever the tables hold.
    texts = written(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id"), "op8-texts")
    scores, shares = log_odds(frequencies(texts.dropDuplicates(["text", "toxic"])))
    model = Model(scores)
    if not scores:
        return model
    terms = list(scores)
    model.lam = root(np.array([scores[t] for t in terms]), np.array([shares[t] for t in terms]), model.drift)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            for part in blocks(batch):
                n, each = scanner.segments(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(n), pa.array([[s for *_, s in x] for x in each], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    rows = texts.mapInArrow(found, "toxic int, n long, scores array<double>").collect()  # bounded by the parameters
    y = np.array([r.toxic for r in rows])
    weight = np.array([natural.get(k, 0) / max((y == k).sum(), 1) for k in (0, 1)])[y]
    # The most likely K for the other texts' best segments; those without one count as a score of 0 that was not reached.
    chance = [(max(r.scores, default=0.0), max(r.n, 1)) for r in rows if r.toxic == 0]
    hits = sum(s > 0 for s, _ in chance)
    model.log_k = math.log(max(hits, 0.5) / max(sum(n * math.exp(-model.lam * s) for s, n in chance), 1e-9))
    some = np.array([bool(r.scores) for r in rows])
    model.without = float((weight * y)[~some].sum() / max(weight[~some].sum(), 1e-9))
    if some.any():
        model.curve = logistic(np.array([model.aggregate(r.scores, r.n) for r in rows if r.scores]), y[some].astype(float), weight[some])
    return model


def passages(docs: DataFrame, model: Model, significant: float = SIGNIFICANT) -> DataFrame:
    """All columns of docs but text, then n_words, score and passages: significant segments (first word, end, score, expected)."""
    own = ("text", "n_words", "score", "passages")
    kept = [f for f in docs.schema.fields if f.name not in own]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
    schema = schema_with(docs.drop(*own), ("n_words", "long"), ("score", "double"), ("passages", "array<struct<first:bigint,end:bigint,score:double,expected:double>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            for some in blocks(batch):
                n, found = scanner.segments(some.column("text"))
                scores, out = np.full(len(n), model.without), []
                for i, x in enumerate(found):
                    each = [(a, b, s, float(np.exp(-model.evidence(s, n[i])))) for a, b, s in x]
                    if each:
                        scores[i] = model.probability(model.aggregate([s for *_, s in x], n[i]))
                    out.append([dict(zip(("first", "end", "score", "expected"), e)) for e in each if e[3] <= significant])
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in kept), pa.array(n), pa.array(scores), pa.array(out, kind)], [*(f.name for f in kept), "n_words", "score", "passages"])

    return docs.select(*(f.name for f in kept), text_of().alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    scored = passages(docs, fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_words", F.size("passages").cast("long").alias("n_passages"))
