"""Shared parts: tables in the folder all executors share, and vectorised words of Arrow text columns."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; only a longer single text exceeds it.
BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: Lower case, and every ASCII sign that is neither letter nor digit becomes a space.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where that is unset (tests)."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        context.setCheckpointDir(there)
    return there.rstrip("/")


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The path is deleted as the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(table: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing reads any more."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose frames are gone, which else stay until the driver's next collection."""
    for _ in range(2):  # what the first round lets go, the second finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remainder(column: str, by: int):
    """crc32 of the column as text, modulo ``by``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column, as arrays over all rows.

    buf: bytes after the table; starts, ends: byte places; rows: row of each word; first: index of
    each row's first word (one more entry than rows)."""

    def __init__(self, column: pa.Array, table: np.ndarray = SAME):
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        lo, hi = int(bounds[0]), int(bounds[-1])
        raw = np.frombuffer(column.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        self.raw = raw
        self.bounds = bounds - lo
        self.buf = np.zeros(len(raw) + 16, np.uint8)
        self.buf[: len(raw)] = raw if table is SAME else table[raw]
        solid = ~_SPACE[self.buf[: len(raw)]]
        cut = np.zeros(len(raw) + 1, bool)
        cut[self.bounds] = True
        before, after = solid.copy(), solid.copy()
        if len(raw):
            before[1:] &= ~solid[:-1] | cut[1:-1]
            after[:-1] &= ~solid[1:] | cut[1:-1]
        self.starts = np.flatnonzero(before)
        self.ends = np.flatnonzero(after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.rows = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)

    def bytes_at(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; ``buf`` has eight spare bytes at its end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) ^ (lanes[starts] & _MASK[np.minimum(left, 8)]))
    on = np.flatnonzero(left > 8)
    at, left = starts[on] + 8, left[on] - 8
    while len(on):
        h[on] = mix(h[on] * np.uint64(3) ^ (lanes[at] & _MASK[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        on, at, left = on[more], at[more] + 8, left[more] - 8
    return h


def hash_words(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    buf = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    return hash_spans(buf, np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends, ends)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of one occurrence of each, and each entry's index among them."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    index = np.empty(len(h), np.int64)
    index[order] = np.cumsum(new) - 1
    return ordered[new], order[new], index


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + counts[i] - 1 of all i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.repeat(starts - shift, counts) + np.arange(total)


class Known:
    """A growing map from 64-bit hashes to slots 0, 1, ...; emptied by its owner beyond ``most``.

    Two tables of 2^bits entries, one a place, answer nearly all; what finds both places taken is in sorted arrays."""

    def __init__(self, most: int = 400_000, bits: int = 18):
        self.most, self.bits = most, bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.tables = [(np.zeros(size, np.uint64), np.full(size, -1, np.int32)) for _ in range(2)]
        self.keys, self.slots, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def _places(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(k * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the hashes; -1 where there is none."""
        keys, slots = self.tables[0]
        at = self._places(h, 0)
        out = np.where(keys[at] == h, slots[at], -1)
        left = np.flatnonzero(out < 0)
        if len(left) and self.n:
            keys, slots = self.tables[1]
            rest = h[left]
            at = self._places(rest, 1)
            out[left] = np.where(keys[at] == rest, slots[at], -1)
            left = left[out[left] < 0]
            if len(left) and len(self.keys):
                rest = h[left]
                at = np.minimum(np.searchsorted(self.keys, rest), len(self.keys) - 1)
                out[left] = np.where(self.keys[at] == rest, self.slots[at], -1)
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """New slots for distinct hashes that are not there yet."""
        new = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        left, value = h, new
        for k, (keys, slots) in enumerate(self.tables):
            at = self._places(left, k)
            free = np.flatnonzero(slots[at] < 0)
            keys[at[free]], slots[at[free]] = left[free], value[free]  # of several for a place, the last stays
            out = slots[at] != value
            left, value = left[out], value[out]
        if len(left):
            keys, values = np.concatenate([self.keys, left]), np.concatenate([self.slots, value])
            order = np.argsort(keys)
            self.keys, self.slots = keys[order], values[order]
        return new

    def slots_for(self, h: np.ndarray, learn) -> np.ndarray:
        """Slots of all hashes; learn(places) is called with one place of each new hash, and adds its values."""
        slots = self.find(h)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new, one, index = distinct(h[missing])
            learn(missing[one])
            slots[missing] = self.add(new)[index]
        return slots


def sampled(df: DataFrame, by: str, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows (all, if fewer) of each value of ``by``, chosen by a hash of the key.

    Only counts go to the driver, a row for each value; the chosen number is binomial around ``most``."""
    counts = df.groupBy(by).count().where(F.col(by).isNotNull()).collect()
    share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for r in counts:
        keep = keep | ((F.col(by) == r[0]) & (share < most / r[1]))
    return df.where(keep)


def schema_with(df: DataFrame, *columns: tuple[str, str]):
    """The schema with further columns; those of the same names are replaced."""
    from pyspark.sql.types import StructType

    names = {n for n, _ in columns}
    added = StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in columns))
    return StructType([f for f in df.schema.fields if f.name not in names] + added.fields)


def aside(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with all columns but ``own`` under names that nothing else has, and a function that brings all columns, their names and order back."""
    names = [c if c in own else f"_aside_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*(F.col(x).alias(c) for x, c in zip(names, docs.columns)))
