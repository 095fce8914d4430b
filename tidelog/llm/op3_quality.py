"""Quality rules judged by an isolation forest on rule statistics.

A text's statistics (counts of words, symbols, repeated lines and repeated word windows, and shares made of them) go
through a forest of random splits; a short mean path means an anomaly. Half of all labelled texts that pass the fixed
rules train the forest: each tree draws ``psi`` of them for its splits, as isolation forests do, and what a leaf is worth
comes from how many of them all fall there. The threshold on the score is the one that rejects at most ``SPARE`` of all
the other half's good texts and, subject to that, as many bad ones as can be. Neither the counts of leaves nor the scores
are ever on one machine. Without labels of both kinds in both halves only the fixed rules decide.

A null text has no words and fails the fixed rule on them; repeated rows are judged each; of several labels of a
document the smallest counts; null labels teach nothing; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, distinct, documents, mix, remainder, text_of, written

SPARE, BINS = 0.005, 1 << 16
TREES, PSI, SEED, MIXED = 100, 256, 7, 0.015
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_signs", "n_digits", "n_distinct"]

_CLASS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "sign", "digit")}
_CLASS["symbol"][list(b"#*$%&|<>")] = True
_CLASS["upper"][65:91] = True
_CLASS["digit"][48:58] = True
_CLASS["sign"][[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The BASE and MORE counts of every text, in vectorised steps over all of them."""
    words = Words(column)
    n, rows, bounds = len(column), words.rows, words.bounds
    raw = words.raw
    out = {"n_words": np.diff(words.first)}
    begins = (raw & 0xC0) != 0x80  # bytes that begin a code point
    solid = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(begins, out=solid[1:])
    chars = solid[words.ends] - solid[words.starts]
    out["word_chars"] = np.bincount(rows, chars, n).astype(np.int64)

    def per_text(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.diff(np.searchsorted(at, bounds))

    out["n_symbols"] = per_text(_CLASS["symbol"][raw])
    h = words.hashes()
    # Lines: a line's hash goes over its bytes; lines without a word don't count.
    breaks = np.flatnonzero(raw == 0x0A)
    cut_at = np.unique(np.concatenate([bounds, breaks, breaks + 1])) if len(raw) else np.zeros(1, np.int64)
    starts, ends = cut_at[:-1], cut_at[1:]
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[worded], ends[worded]
    line_row = np.searchsorted(bounds, starts, "right") - 1
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = _later_copies(_line_hashes(words.buf, starts, ends), line_row, n)
    out["n_repeat_words"] = _repeat_words(h, rows, words.first, n)
    for name, kind in (("n_upper", "upper"), ("n_signs", "sign"), ("n_digits", "digit")):
        out[name] = per_text(_CLASS[kind][raw])
    _, one, _ = distinct(mix(h ^ mix(rows.astype(np.uint64) + np.uint64(1))))
    out["n_distinct"] = np.bincount(rows[one], minlength=n)
    return out


def _line_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data = buf.tobytes()
    return np.fromiter((hash(data[a:b]) & 0xFFFFFFFFFFFFFFFF for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _later_copies(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    _, one, _ = distinct(mix(h ^ mix(row.astype(np.uint64) + np.uint64(1))))
    return np.bincount(row, minlength=n) - np.bincount(row[one], minlength=n)


def _repeat_words(h: np.ndarray, rows: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    if len(h) < 3:
        return np.zeros(n, np.int64)
    same = rows[2:] == rows[:-2]
    three = mix(h[:-2] ^ mix(h[1:-1] * np.uint64(3) ^ mix(h[2:] * np.uint64(5) ^ mix(rows[2:].astype(np.uint64) + np.uint64(9)))))
    at = np.flatnonzero(same)
    _, _, index = distinct(three[at])
    often = at[np.bincount(index)[index] > 1] if len(at) else at
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[often + k] = True
    return np.bincount(rows[covered], minlength=n)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(s["n_words"], 1)
    lines = np.maximum(s["n_lines"], 1)
    chars = np.maximum(s["word_chars"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_signs"] / words, s["n_digits"] / words, s["n_distinct"] / words**0.8, words / lines], axis=1)


def _mean_path(n) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Random splits of subsamples; trees are complete to a fixed depth and kept as arrays. No row is drawn by two trees
    where there are rows enough."""

    def __init__(self, x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(x))
        self.depth = max(1, math.ceil(math.log2(max(self.psi, 2))))
        size = (2 << self.depth) - 1
        self.feature, self.cut, self.path = np.zeros((trees, size), np.int64), np.full((trees, size), np.inf), np.zeros((trees, size))
        self.steps = np.zeros((trees, size), np.int64)
        dealt = rng.permutation(len(x))[: trees * self.psi].reshape(trees, -1) if len(x) >= trees * self.psi else None
        for t in range(trees):
            some = x[rng.choice(len(x), self.psi, replace=False) if dealt is None else dealt[t]]
            stack = [(0, 0, some)]
            while stack:
                node, depth, part = stack.pop()
                lo, hi = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(x.shape[1]),) * 2
                choice = np.flatnonzero(hi > lo)
                if depth == self.depth or len(part) <= 1 or not len(choice):
                    self._leaf(t, node, depth, depth + _mean_path(len(part)))
                    continue
                f = int(rng.choice(choice))
                c = rng.uniform(lo[f], hi[f])
                self.feature[t, node], self.cut[t, node] = f, c
                left = part[:, f] < c
                stack += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]

    def _leaf(self, t: int, node: int, depth: int, path: float) -> None:
        """A leaf's path also stands below it, so that every row takes the same steps."""
        steps = depth
        while depth < self.depth:
            node, depth = 2 * node + 1, depth + 1  # the infinite cut leads left
        self.path[t, node], self.steps[t, node] = path, steps

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the nodes where the rows end."""
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] >= self.cut[t, node])
            yield node

    def weigh(self, mass: np.ndarray) -> None:
        """mass: how many of all training rows end in each node of each tree. A leaf is then worth its share of ``psi`` rows."""
        n = mass * self.psi / mass.sum(axis=1, keepdims=True)
        self.path = self.steps + np.interp(n, np.arange(self.psi + 1), [_mean_path(k) for k in range(self.psi + 1)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(x))
        for t, node in enumerate(self.leaves(x)):
            total += self.path[t, node]
        return 2 ** (-total / len(self.feature) / max(_mean_path(self.psi), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, spare: float = SPARE, rank: int | None = None) -> float:
    """The least score that at most ``spare`` of the good ones reach; infinite if no bad one does. ``rank``: the place from the
    top of the good one that sets it, where not all are given."""
    own = np.sort(scores[good])[::-1]
    over = own[min(int(spare * len(own)), len(own) - 1) if rank is None else rank]
    bad = scores[~good]
    reached = bad[bad > over]
    return float((over + reached.min()) / 2) if len(reached) else math.inf


_LONGS = BASE + MORE


def _failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def counted(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` and the counts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch):
                s = statistics(some.column("text"))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in kept), *(pa.array(s[k].astype(np.int64)) for k in _LONGS)], [*kept, *_LONGS])

    rows = docs.select(*kept, text_of().alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return rows.mapInArrow(run, kinds + "".join(f", {k} long" for k in _LONGS))


def _matrix(rows) -> np.ndarray:
    return features({k: np.asarray(rows.column(k)) for k in _LONGS})


def _masses(rows: DataFrame, forest: Forest, bad: float) -> np.ndarray:
    """How many rows of (good, counts) end in each node of each tree; one that is not good counts as ``bad``."""
    trees, size = forest.cut.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, trees, size), np.int64)
        for batch in batches:
            good = np.asarray(batch.column("good"))
            for t, node in enumerate(forest.leaves(_matrix(batch))):
                for k in (0, 1):
                    found[k, t] += np.bincount(node[good == k], minlength=size)
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x.ravel()[at]) for x in found)], ["node", "bad", "good"])

    sums = rows.mapInArrow(run, "node long, bad long, good long").groupBy("node").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # a row for each leaf
    out = np.zeros(trees * size)
    out[np.asarray(sums.column("node"))] = np.asarray(sums.column("good")) + bad * np.asarray(sums.column("bad"))
    return out.reshape(trees, size)


def _calibrated(scores: DataFrame, spare: float = SPARE) -> float:
    """``threshold`` of all rows of (good, anomaly): bins of scores are counted, and only the one where it lies is looked into."""
    binned = scores.withColumn("bin", F.floor(F.col("anomaly") * BINS))
    lowest = F.min(F.when(~F.col("good"), F.col("anomaly")))
    bins = binned.groupBy("bin").agg(F.count_if("good").alias("good"), lowest.alias("bad")).collect()  # at most BINS and one
    n = sum(r.good for r in bins)
    rank, least = min(int(spare * n), n - 1), []
    for r in sorted(bins, key=lambda r: -r.bin):
        if rank < r.good:
            break
        rank -= r.good
        least = least if r.bad is None else [r.bad]  # of the bins above
    there = binned.where(F.col("bin") == r.bin).groupBy("good", "anomaly").count().toArrow()  # equal scores are one row
    score, good, each = (np.asarray(there.column(k)) for k in ("anomaly", "good", "count"))
    order = np.argsort(-score[good])
    rank = int(np.searchsorted(np.cumsum(each[good][order]), rank, "right"))
    return threshold(np.append(score, least), np.append(good, np.zeros(len(least), bool)), spare, rank)


def _drawn(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """``most`` of the n rows (all, if fewer), chosen and ordered by a hash."""
    share = min(1.0, (1.1 * most + 100) / n)  # some more, as the number under a bound of the hash is binomial
    hashed = rows.withColumn("hash", F.xxhash64("doc_id", *_LONGS, F.lit(SEED)))
    some = (hashed if share == 1 else hashed.where(F.col("hash") < int((share - 0.5) * 2**64))).toArrow()
    return _matrix(some)[np.argsort(np.asarray(some.column("hash")), kind="stable")[:most]]


def learned(rows: DataFrame, labels: DataFrame, trees: int = TREES, psi: int = PSI) -> tuple[Forest, float] | None:
    """From (doc_id, counts) and (doc_id, quality), all rows that have a label and pass the fixed rules."""
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality").cast("int") != 0).alias("good"))
    passed = rows.where(~_failed()).join(one, "doc_id").withColumn("grows", remainder("doc_id", 2) == 0)
    table = written(passed.select("doc_id", *_LONGS, "good", "grows"), "op3-labelled")
    n = {(r.good, r.grows): r["count"] for r in table.groupBy("good", "grows").count().collect()}
    if not n.get((True, True)) or not n.get((True, False)) or not n.get((False, True)):
        return None
    grows = table.where("grows")
    # Many rows of one bad kind would be a cluster, not anomalies: bad rows weigh no more than MIXED of the good ones.
    good, bad = n[True, True], n[False, True]
    mixed = min(bad, max(1, round(good * MIXED)))
    share = min(1.0, trees * psi / (good + mixed))
    few = max(1, round(mixed * share))
    many = min(good, trees * psi - few)
    forest = Forest(np.concatenate([_drawn(grows.where("good"), good, many), _drawn(grows.where("not good"), bad, few)]), trees, psi)
    forest.weigh(_masses(grows.select("good", *_LONGS), forest, mixed / bad))
    apart = table.where("not grows").select("good", *_LONGS)
    return forest, _calibrated(written(scored(apart, forest).select("good", "anomaly"), "op3-scores"))


def fit(docs: DataFrame, labels: DataFrame, trees: int = TREES, psi: int = PSI) -> tuple[Forest, float] | None:
    """From (doc_id, text) and (doc_id, quality), all rows that have a label."""
    return learned(counted(docs, ["doc_id"]), labels, trees, psi)


def scored(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows and their anomaly, 0 without a forest."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(_matrix(batch)) if forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "anomaly"])

    return rows.mapInArrow(run, kinds + ", anomaly double")


def verdicts(rows: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    """The rows of counts, base_failed, anomaly and kept."""
    forest, least = model or (None, math.inf)
    return scored(rows.withColumn("base_failed", _failed()), forest).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < least))


def judged(docs: DataFrame, model: tuple[Forest, float] | None, kept: list[str]) -> DataFrame:
    """The columns ``kept``, the counts, base_failed, anomaly and kept."""
    return verdicts(counted(docs, kept), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(counted(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"]), "op3-counts")
    model = learned(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return verdicts(rows, model).select("doc_id", *BASE, "base_failed", "anomaly", "kept")
