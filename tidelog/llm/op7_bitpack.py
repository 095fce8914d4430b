"""Token ids as fixed-width bit-packed files.

A file image: magic ``TLBP``, then little-endian u32 width, u32 ids a block, u64 ids, u64 documents; the
documents' keys (i64; a null is -2^63), their id counts (u32, padded to 8 bytes), block offsets (u64, one
more than blocks), then the blocks. A block holds its ids' low ``width`` bits, least significant first, and
begins on a byte, so any id is found from its block's offset alone. ``width`` is what the vocabulary needs.

Tasks write files of about FILE_IDS ids into a folder that executors and driver share, through Arrow's file systems
(local and mounted folders, HDFS, S3, GCS). A file gets its final name by a move, once it is whole; the name is its
place in key order, so a task that runs again writes the same file. They are read back by Spark's binary reader.

Nulls and empty texts give the end id alone; a null key comes first; rows of one key keep apart, ordered by
text; an empty table gives no row; further columns are left out of the files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, documents, gone_at_exit, shared_dir, text_of, written
from .tokens import STEP_BYTES, encoder

MAGIC = b"TLBP"
BLOCK_IDS, FILE_IDS = 4096, 2 << 20
_HEAD = struct.Struct("<4sIIQQ")
_NO_KEY = -(1 << 63)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").view(np.uint8)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little")


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data[: n * width // 8].tobytes(), f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def image(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int, block: int = BLOCK_IDS) -> bytes:
    """The file image of documents with these keys and id counts."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit into {width} bits")
    packed = [pack_bits(ids[k : k + block], width).tobytes() for k in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype("<u8")
    head = _HEAD.pack(MAGIC, width, block, len(ids), len(keys))
    table = keys.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + bytes(-4 * len(keys) % 8)
    return head + table + offsets.tobytes() + b"".join(packed)


class Image:
    """Reads a file image: keys, counts, and any range of ids by its blocks alone."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, self.n, docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("this is no packed token file")
        at = _HEAD.size
        self.keys = np.frombuffer(data, "<i8", docs, at)
        self.counts = np.frombuffer(data, "<u4", docs, at + 8 * docs).astype(np.int64)
        at += 12 * docs + -4 * docs % 8
        n_blocks = -(-self.n // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8, offset=at + 8 * (n_blocks + 1))
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, start: int, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block, -(-(start + n) // self.block)):
            size = min(self.block, self.n - b * self.block)
            out.append(unpack_bits(self.data[self.offsets[b] : self.offsets[b + 1]], size, self.width))
        skip = start % self.block
        return np.concatenate(out)[skip : skip + n]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))


def _put(folder: str, name: str, data: bytes) -> None:
    """The file under its name, whole or not at all."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def encode_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files <part>-<seq>.tlbp into a new ``folder`` (a URI), in key order: part is the key range, seq the file
    within it. Returns (part, seq, n_ids, n_docs) of each, a written table."""
    from pyarrow import fs

    width = width_of(vocabulary)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seq = encoder(tokenizer, spaced=True), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            keys, counts, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            _put(folder, f"{part:06d}-{seq:06d}.tlbp", image(keys, counts, ids, width))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(keys)], pa.int64())], ["part", "seq", "n_ids", "n_docs"])

        for batch in batches:
            for some in blocks(batch, most=STEP_BYTES):
                ids, first = ids_of.ids(some.column("text"))
                counts = np.diff(first) + 1
                out = np.full(len(ids) + some.num_rows, end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(counts) - 1] = False
                out[keep] = ids
                held.append((np.asarray(some.column("key").fill_null(_NO_KEY)), counts, out))
                if sum(len(x[2]) for x in held) >= file_ids:
                    yield close()
                    seq += 1
        if held:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return written(ordered.mapInArrow(encode, "part int, seq int, n_ids long, n_docs long"), "op7-names")


def decode_files(files: DataFrame, folder: str, per_document: Callable[[np.ndarray], int] | None = None, key: str = "doc_id") -> DataFrame:
    """Rows of the documents in the folder's files: key, start (ids of all before), n_tokens, ids, or ids_crc32 where a
    digest is given. ``files`` is what ``encode_files`` returned."""
    field = pa.field("ids_crc32", pa.int64()) if per_document else pa.field("ids", pa.list_(pa.int32()))
    out = [key, "part", "seq", "at", "n_tokens", field.name]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = Image(batch.column("content")[i].as_buffer())
                part, seq = (int(x) for x in batch.column("name")[i].as_py().split("-"))
                for a in range(0, len(f.keys), 4096):  # some documents at a time, by their blocks
                    starts, counts = f.starts[a : a + 4096], f.counts[a : a + 4096]
                    ids = f.ids(int(starts[0]), int(counts.sum()))
                    each = [ids[x : x + n] for x, n in zip((starts - starts[0]).tolist(), counts.tolist())]
                    value = pa.array([per_document(x) for x in each], pa.int64()) if per_document else pa.array([x.tolist() for x in each], field.type)
                    n, keys = len(each), f.keys[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == _NO_KEY), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(starts), pa.array(counts), value], out)

    kind = "ids_crc32 long" if per_document else "ids array<int>"
    schema = f"{key} long, part int, seq int, at long, n_tokens long, {kind}"
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], schema).select(key, F.col("at").alias("start"), "n_tokens", field.name)
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.tlbp").load(folder)
    rows = there.select(F.regexp_extract("path", r"([0-9]+-[0-9]+)\.tlbp$", 1).alias("name"), "content").mapInArrow(decode, schema)
    # One row a key range is all that the only unpartitioned window sees.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    in_part = files.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("before"))
    starts = in_part.join(before_part, "part").select("part", "seq", (F.col("before") + F.col("before_part")).alias("before"))
    return rows.join(starts, ["part", "seq"]).select(key, (F.col("before") + F.col("at")).alias("start"), "n_tokens", field.name)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/op7-files-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    files = encode_files(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), 2, 50257)
    return decode_files(files, folder, crc)
