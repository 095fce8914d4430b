"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Every document is cut into passages, windows of WINDOW words that overlap by half, and every passage is a query to an
inverted index of the test items. A term's posting list has its items in order, with the term's impact there, and is cut
into blocks of BLOCK items with the largest impact of each block. All passages of a batch go through it at once:

1. A term's largest impact bounds what it adds. Terms are taken from the least bound up as long as their sum stays below
   the least threshold of any item: an item needs a term beyond that pivot. Passages without a pivot are done.
2. The lists of the terms beyond the pivot give candidate blocks; all others are skipped. A candidate block is bounded by
   the sum of the passage's block maxima there, and dropped below the least threshold of its items.
3. Only the postings within the blocks left are read, and their impacts summed for each item.

An item is retrieved if its score reaches SHARE of its score for as much of its own text as a window surely holds. A
retrieved item counts as leaked if at least OVERLAP of the distinct five-word shingles of its question, and of its
answer, are in the document; the answer is the item's last sentence, the question all before it (an item of one
sentence is its own question and answer; parts of less than five words are one shingle).

Document frequencies and the mean length are those of all items, counted first. The index is broadcast in parts of about
PART_BYTES, and documents are read once for each part: once, for benchmarks of some hundred thousand items. What a task
holds is bounded so, and no result depends on the parts. Words are runs without white space and ASCII signs, A-Z in
lower case.

Null texts and items count as empty; items without a word match nothing; repeated items are told apart by their ids
and repeated rows are matched each; empty tables give no row; further columns are ignored. The result has a row for
each document and leaked item."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN, Words, aside, blocks, distinct, documents, expand, mix, text_of

WINDOW, BLOCK = 64, 32
#: Bytes of an index part, and what an item takes for each of its words: postings and two shingles.
PART_BYTES, WORD_BYTES = 48 << 20, 48
K1, B = 1.2, 0.75
SHARE, OVERLAP, SHINGLE = 0.6, 0.8, 5
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of k word hashes."""
    if len(h) < k or not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(3) ^ h[j : len(h) - k + 1 + j])
    return out


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text], pa.string()), PLAIN).hashes()


def _parts(text: str) -> list[tuple[int, np.ndarray]]:
    """(words of a shingle, distinct shingles) of the question and of the answer."""
    s = _SENTENCE.split(text.strip())
    out = []
    for x in (" ".join(s[:-1]), s[-1]) if len(s) > 1 else (text, text):
        h = _hashes(x)
        k = min(SHINGLE, len(h))
        out.append((k, np.unique(shingles(h, k))))
    return out


def frequencies(items: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, df) of the items (item_id, text), how many there are and their mean number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch):
                words = Words(some.column("text"), PLAIN)
                key, one, _ = distinct(mix(words.hashes() ^ mix(words.rows.astype(np.uint64) + np.uint64(1))))
                term, df = np.unique(words.hashes()[one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df.astype(np.int64)), pa.array([len(words)] + [0] * (len(term) - 1) if len(term) else [], pa.int64())], ["term", "df", "words"])

    each = items.select(text_of().alias("text")).mapInArrow(run, "term long, df long, words long")
    n, words = items.count(), each.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    return each.groupBy("term").agg(F.sum("df").alias("df")), n, words / max(n, 1)


def parts(items: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[Index]:
    """Index parts of about ``part_bytes``, one at a time on the driver."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    df, n, mean = frequencies(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"), PLAIN)
            h = words.hashes().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.split(h, words.first[1:-1]) if batch.num_rows else [], pa.list_(pa.int64()))], ["row", "terms"])

    # Items in the order of their first words, so that like ones share blocks.
    rows = items.withColumn("row", F.struct(F.substring("text", 1, 40).alias("a"), F.col("item_id").alias("b"), F.xxhash64("text").alias("c")))
    terms = rows.select("row", "text").mapInArrow(run, "row struct<a:string,b:bigint,c:bigint>, terms array<bigint>").select("row", F.explode(F.array_distinct("terms")).alias("term"))
    known = terms.join(df, "term").groupBy("row").agg(F.collect_list(F.struct("term", "df")).alias("dfs"))  # as long as the item
    held: list[tuple] = []
    size = 0
    for r in rows.dropDuplicates(["row"]).join(known, "row").join(rows.groupBy("row").agg(F.count("*").alias("copies")), "row").orderBy("row").toLocalIterator():
        for _ in range(r.copies):
            held.append((r.item_id, r.text, r.dfs))
            size += WORD_BYTES * len(r.text.split()) + len(r.text)
        if size >= part_bytes:
            yield Index(held, n, mean)
            held, size = [], 0
    if held:
        yield Index(held, n, mean)


class Index:
    """Posting lists of a part of the items with BM25 impacts, block maxima, thresholds, and the shingles of questions and
    answers; items are (id, text, [(term, df)]), n and mean are of all items."""

    def __init__(self, items: list[tuple[int, str, list[tuple[int, int]]]], n: int, mean: float):
        self.ids = np.array([-(1 << 63) if i is None else i for i, *_ in items], np.int64)
        found = []
        self.least = np.full(len(items), np.inf)
        self.parts = []
        for i, (_, text, dfs) in enumerate(items):
            h = _hashes(text)
            term, count = np.unique(h, return_counts=True)
            known = {t & 0xFFFFFFFFFFFFFFFF: d for t, d in dfs}
            df = np.array([known[t] for t in term.tolist()], float)
            impact = np.log1p((n - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * len(h) / max(mean, 1e-9)))
            found.append((term, np.full(len(term), i), impact.astype(np.float32)))
            if len(h):
                # So many words of an item some window holds, wherever the item begins.
                surely = len(h) if len(h) <= WINDOW / 2 else min(WINDOW / 4 + len(h) / 2, WINDOW)
                self.least[i] = SHARE * float(found[-1][2].sum(dtype=np.float64)) * surely / len(h)
            self.parts.append(_parts(text))
        term, item, impact = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, np.float32)))
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order].astype(np.float64)
        self.terms, first = np.unique(term, return_index=True)
        # Blocks of the lists: a new one at each term, and where the item's block changes.
        block = self.item // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.block, self.block_first = block[at], np.append(at, len(term))  # postings of a block: first .. next first
        self.block_most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.list_first = np.append(np.searchsorted(at, first), len(at))  # blocks of a term
        self.most = np.append(np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0), 0.0)  # of no term: nothing
        pad = np.append(self.least, np.full(-len(self.least) % BLOCK, np.inf)).reshape(-1, BLOCK)
        self.block_least = pad.min(axis=1) if len(items) else np.zeros(0)

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the terms; that of a word in no item is one more than the last."""
        if not len(self.terms):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, len(self.terms))

    def retrieve(self, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score): best score of each retrieved item in a passage of each row."""
        none, floor = len(self.terms), self.least.min(initial=np.inf)
        step = WINDOW // 2
        per_row = np.maximum(1, -(-np.maximum(np.diff(first) - WINDOW, 0) // step) + 1)
        row = np.repeat(np.arange(len(per_row)), per_row)
        start = first[:-1][row] + step * (np.arange(len(row)) - (np.cumsum(per_row) - per_row)[row])
        end = np.minimum(start + WINDOW, first[1:][row])
        sums = np.concatenate([[0.0], np.cumsum(self.most[term])])
        some = np.flatnonzero(sums[end] - sums[start] >= floor - 1e-6)
        found: list[tuple[np.ndarray, ...]] = []
        for k in range(0, len(some), 2048):
            w = some[k : k + 2048]
            at = start[w][:, None] + np.arange(WINDOW)
            window = np.where(at < end[w][:, None], term[np.minimum(at, len(term) - 1)], none)
            window.sort(axis=1)  # a term counts once
            window[:, 1:][window[:, 1:] == window[:, :-1]] = none
            found.append(self._scored(row[w], window, floor))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        r, i, s = (np.concatenate(x) for x in zip(*found))
        key, at = np.unique(r * len(self.least) + i, return_inverse=True)
        best = np.zeros(len(key))
        np.maximum.at(best, at, s)
        return key // len(self.least), key % len(self.least), best

    def _scored(self, row: np.ndarray, window: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) of the items that reach their thresholds, for passages of distinct terms."""
        bound = self.most[window]
        order = np.argsort(bound, axis=1)
        window = np.take_along_axis(window, order, axis=1)
        upto = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
        beyond = (upto >= floor - 1e-6) & (window < len(self.terms))  # from the pivot on
        q, j = np.nonzero(beyond)
        t = window[q, j]
        count = self.list_first[t + 1] - self.list_first[t]
        blocks_ = int(self.block.max(initial=-1)) + 1
        candidates = np.unique(np.repeat(q, count) * blocks_ + self.block[expand(self.list_first[t], count)])
        # The block maxima of all of a candidate's terms: those below the pivot are looked up, not gone through.
        q, j = np.nonzero(window < len(self.terms))
        some = np.isin(q, candidates // max(blocks_, 1))
        q, j = q[some], j[some]
        t = window[q, j]
        count = self.list_first[t + 1] - self.list_first[t]
        place = expand(self.list_first[t], count)
        owner = np.repeat(q, count)
        at = np.searchsorted(candidates, key := owner * blocks_ + self.block[place])
        hit = at < len(candidates)
        hit[hit] = candidates[at[hit]] == key[hit]
        at, place = at[hit], place[hit]
        total = np.bincount(at, self.block_most[place], len(candidates))
        good = total >= self.block_least[candidates % max(blocks_, 1)] - 1e-6
        keep = good[at]
        at, place = at[keep], place[keep]
        count = self.block_first[place + 1] - self.block_first[place]
        posting = expand(self.block_first[place], count)
        key = (candidates // max(blocks_, 1))[np.repeat(at, count)] * len(self.least) + self.item[posting]
        key, which = np.unique(key, return_inverse=True)
        score = np.bincount(which, self.impact[posting], len(key))
        q, i = key // len(self.least), key % len(self.least)
        ok = score >= self.least[i] - 1e-6
        return row[q[ok]], i[ok], score[ok]

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of the leaked items of each text."""
        words = Words(column, PLAIN)
        if not len(words) or not len(self.terms):
            return []
        h = words.hashes()
        out, own, at = [], {}, -1
        for r, i, s in zip(*(x.tolist() for x in self.retrieve(self.term_of(h), words.first))):
            if r != at:
                own, at = {}, r
            overlaps = []
            for k, part in self.parts[i]:
                if k not in own:
                    own[k] = distinct(shingles(h[words.first[r] : words.first[r + 1]], k))[0]
                overlaps.append(float(np.isin(part, own[k], assume_unique=True).mean()) if len(part) else 1.0)
            if min(overlaps) >= OVERLAP:
                out.append((r, i, s, *overlaps))
        return out


_KIND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of documents that hold test items."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for index in parts(items, part_bytes):
        one = _matched(rows, index)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.sparkSession.createDataFrame([], _KIND)


def _matched(rows: DataFrame, index: Index) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(index)  # about PART_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            for some in blocks(batch, "text", 1 << 20):
                found = ix.leaks(some.column("text"))
                if found:
                    r, i, s, q, a = zip(*found)
                    ids = ix.ids[list(i)]
                    yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(r)), pa.array(ids, mask=ids == -(1 << 63)), pa.array(s), pa.array(q), pa.array(a)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return rows.mapInArrow(run, _KIND)


def without_leaks(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows, with all their columns, whose text holds no test item."""
    docs, back = aside(docs, ("text",))
    schema = docs.schema
    for index in parts(items, part_bytes):
        docs = _cleaned(docs, index, schema)
    return back(docs)


def _cleaned(docs: DataFrame, index: Index, schema) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, at = batch.schema.get_field_index("text"), 0
            filled = batch.set_column(place, "text", batch.column("text").fill_null(""))
            for some in blocks(filled, "text", 1 << 20):
                keep = np.ones(some.num_rows, bool)
                keep[[x[0] for x in held.value.leaks(some.column("text"))]] = False
                yield batch.slice(at, some.num_rows).filter(pa.array(keep))
                at += some.num_rows

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
