"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within the radius agree on some ``bands - radius`` of ``bands`` bit bands, so comparing the fingerprints
that share such a key finds every link. Within a key, numpy compares tiles of distinct fingerprints, ordered by their
number of set bits, by exclusive or and bit counts, and skips tile pairs whose bit counts differ beyond the radius.
A tile comparison gives a star for each component it sees, never all pairs. A key with many fingerprints is cut into
chunks, and pairs of chunks are dealt to tasks. More fingerprints call for more bands, hence longer keys.
Components of the links then come from joins that contract stars, each round written to the shared folder.

Texts of no word have fingerprint zero and link as others do; null texts count as empty; repeated rows and equal
texts share a fingerprint; null ids belong to their fingerprint's component but never name one; an empty table gives
no row; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, blocks, documents, expand, text_of, written

RADIUS, WORDS, SEED = 4, 4, 42
TILE = 512
CHUNK = 1 << 14
#: Bytes of text and shingles that one step takes.
STEP, SHINGLES = 1 << 20, 1 << 15


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of byte spans, all at once; ``buf`` has eight spare bytes at its end."""
    eights = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    fours = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    size, seed64 = ends - starts, np.uint64(seed)
    h, at = np.full(len(starts), seed64 + _P5), starts.copy()

    def round_(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
        return _turned(acc + lane * _P2, 31) * _P1

    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            acc = [np.full(len(long), x) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            on, place = np.arange(len(long)), at[long]
            while len(on):
                for k in range(4):
                    acc[k][on] = round_(acc[k][on], eights[place[on] + 8 * k])
                place[on] += 32
                on = on[place[on] + 32 <= ends[long[on]]]
            whole = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
            for x in acc:
                whole = (whole ^ round_(np.zeros_like(x), x)) * _P1 + _P4
            h[long], at[long] = whole, place
        h += size.astype(np.uint64)
        on = np.flatnonzero(at + 8 <= ends)
        while len(on):
            h[on] = _turned(h[on] ^ round_(np.zeros(len(on), np.uint64), eights[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            on = on[at[on] + 8 <= ends[on]]
        on = np.flatnonzero(at + 4 <= ends)
        h[on] = _turned(h[on] ^ fours[at[on]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[on] += 4
        on = np.flatnonzero(at < ends)
        while len(on):
            h[on] = _turned(h[on] ^ buf[at[on]].astype(np.uint64) * _P5, 11) * _P1
            at[on] += 1
            on = on[at[on] < ends[on]]
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def fingerprints_of(column: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprints of texts: shingles of their lower-cased words, hashed and counted in steps over all texts."""
    w = Words(column, LOWER)
    n, sizes = len(column), w.ends - w.starts
    # The words again with one space between: a shingle is one span of these.
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    buf = np.full(int(ends[-1]) + 17 if len(ends) else 16, 0x20, np.uint8)
    buf[expand(starts, sizes)] = w.buf[expand(w.starts, sizes)]
    count = np.diff(w.first)
    each = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    first = np.cumsum(each) - each
    begin = expand(w.first[:-1], each)
    last = np.minimum(begin + words, np.repeat(w.first[1:], each)) - 1
    out = np.zeros(n, np.uint64)
    ones = np.zeros((n, 64), np.int64)
    row = np.repeat(np.arange(n), each)
    for k in range(0, len(begin), SHINGLES):
        some = slice(k, k + SHINGLES)
        h = xxh64(buf, starts[begin[some]], ends[last[some]], seed)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[some]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    if n:
        out = np.packbits(2 * ones > each[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch, most=STEP):
                fp = fingerprints_of(some.column("text"), words, seed)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def bands_for(n: int, radius: int = RADIUS) -> int:
    """Bands such that n random fingerprints make keys of some hundreds at most."""
    bands = radius + 1
    while n >> (64 * (bands - radius) // bands) > 500 and bands < 4 * radius:
        bands += 1
    return bands


def _masks(bands: int, radius: int) -> list[int]:
    cuts = [64 * k // bands for k in range(bands + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(parts, bands - radius)]


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its group so far) after joining the groups of places i[k] and j[k]."""
    while True:
        a, b = labels[i], labels[j]
        least = np.minimum(a, b)
        if (a == b).all():
            return labels
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def stars(fp: np.ndarray, side: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius as (member, first of its group). With sides, only pairs across them are compared."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp = fp[order]
    ones = np.bitwise_count(fp).astype(np.int64)
    across = side[order] if side is not None and side.any() and not side.all() else None
    labels = np.arange(len(fp))
    for a in range(0, len(fp), tile):
        x, last = fp[a : a + tile], ones[min(a + tile, len(fp)) - 1]
        for b in range(a, len(fp), tile):
            if ones[b] - last > radius:
                break  # and so do all later tiles
            near = np.bitwise_count(x[:, None] ^ fp[b : b + tile][None, :]) <= radius
            if across is not None:
                near &= across[a : a + tile][:, None] != across[b : b + tile][None, :]
            i, j = np.nonzero(near)
            keep = i + a < j + b
            if keep.any():
                labels = join_labels(labels, i[keep] + a, j[keep] + b)
    member = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[member], fp[labels[member]]


def links(fps: DataFrame, n: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): stars whose components are those of all links between the distinct fingerprints ``fps``."""
    masks = _masks(bands_for(n, radius), radius)
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for k, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    crowded = keyed.groupBy("k", "v").count().where(F.col("count") > chunk).select("k", "v", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    cut = keyed.join(crowded, ["k", "v"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    dealt = cut.withColumn("own", own).withColumn("other", other).select("k", "v", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), (F.col("own") > F.col("other")).alias("side"), "fp")
    group = ["k", "v", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(last: bool) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            columns = [np.asarray(rows.column(x)) for x in group]
            edge = np.zeros(max(rows.num_rows - 1, 0), bool)
            for c in columns:
                edge |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(edge) + 1, [rows.num_rows]])
            if not last:  # the last key may go on
                held.extend(rows.slice(int(cuts[-2])).to_batches())
                cuts = cuts[:-1]
            fp, side = np.asarray(rows.column("fp")).view(np.uint64), np.asarray(rows.column("side"))
            found = [stars(fp[a:b], side[a:b], radius) for a, b in zip(cuts.tolist(), cuts[1:].tolist()) if b - a > 1]
            u, v = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield compare(False)
        if held:
            yield compare(True)

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of the edges (u, v): root is the least node of the component.

    Alternates large and small stars: every node's neighbours link to the least one."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "op4-edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "op4-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    rows = written(fingerprints(docs, words), "op4-fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "op4-distinct")
    roots = components(links(fps.select("fp"), fps.count(), radius, chunk))
    of = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only fingerprints that are linked need another name than their own least id.
    linked = written(of.join(roots.select("root").distinct(), "root").join(named, "root").select("fp", F.col("component_id").alias("linked")), "op4-linked")
    by_fp = fps.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
