"""Best-fit packing by minimum bin slack.

The input of the plan is how many pieces there are of each length, a table of at most ``capacity`` rows however
large the corpus. The plan fills bin after bin: the longest piece left opens one, then a subset-sum dynamic
program over the lengths left, a bitset in one integer, finds the fullest feasible combination, which is removed.
A combination is repeated as often as its lengths last, so the number of distinct bins is near the number of
lengths. Pieces are then dealt to bins by their rank among those of their length.

Null and empty texts hold the end id alone; repeated rows are packed each; an empty table gives no row; further
columns are ignored (or carried along, see ``assign``)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, documents, schema_with, text_of, written
from .tokens import STEP_BYTES, encoder

CAPACITY = 4096


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination with the largest sum within the capacity, long lengths first."""
    if not counts or capacity <= 0:
        return []
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            n = min(k, left)
            steps.append((length, n, reach))
            reach |= (reach << n * length) & full
            left, k = left - n, 2 * k
        if reach >> capacity:
            break
    at, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= n * length
            used[length] = used.get(length, 0) + n
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces in each)]) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    if left and max(left) > capacity:
        raise ValueError("a piece is longer than the capacity")
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        if not rest[seed]:
            del rest[seed]
        use = dict(fullest(rest, capacity - seed))
        use[seed] = use.get(seed, 0) + 1
        bins = min(left[k] // n for k, n in use.items())
        out.append((bins, sorted(use.items(), reverse=True)))
        for k, n in use.items():
            left[k] -= bins * n
            if not left[k]:
                del left[k]
    return out


class Places:
    """Bin and offset of the piece with rank r among those of its length."""

    def __init__(self, bins: list[tuple[int, list[tuple[int, int]]]]):
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for n, use in bins:
            offset = 0
            for length, k in use:
                found.setdefault(length, []).append((ranks.get(length, 0), base, k, offset))
                ranks[length] = ranks.get(length, 0) + n * k
                offset += k * length
            base += n
        self.bins = base
        self.by = {length: np.array(x, np.int64).T for length, x in found.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cut = np.flatnonzero(np.diff(lengths[order])) + 1
        for some in np.split(order, cut) if len(order) else []:
            length = int(lengths[some[0]])
            first, base, k, at = self.by[length]
            i = np.searchsorted(first, ranks[some], "right") - 1
            j = ranks[some] - first[i]
            sequence[some] = base[i] + j // k[i]
            offset[some] = at[i] + j % k[i] * length
        return sequence, offset


def ranked(pieces: DataFrame, counts: dict[int, int], order: list[str], length: str = "length", task_rows: int = 1_000_000) -> DataFrame:
    """Adds rank, gapless from 0 among rows of a length. A common length is dealt to several tasks by a hash of the order:
    none numbers over ``task_rows`` rows, nor much over 1/1024 of all."""
    most = min(task_rows, max(100, sum(counts.values()) // 1024))
    salts = {k: -(-n // most) for k, n in counts.items() if n > most}
    salt = F.lit(0)
    if salts:  # lengths over 1/1024 of all rows, or over task_rows: a row for each at most
        table = pieces.sparkSession.createDataFrame(list(salts.items()), "_length long, _salts long")
        pieces = pieces.join(F.broadcast(table), F.col(length) == F.col("_length"), "left")
        salt = F.pmod(F.xxhash64(*order), F.coalesce("_salts", F.lit(1)))
    salted = pieces.withColumn("_salt", salt).drop("_length", "_salts")
    within = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)).cast("long") - 1
    if not salts:
        return salted.withColumn("rank", within).drop("_salt")
    sizes = salted.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(length).orderBy("_salt")) - F.col("_n")).drop("_n")
    return salted.withColumn("rank", within).join(before, [length, "_salt"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_salt", "_before")


def assign(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to every row of ``pieces``, a written table with a length column of 1..capacity.

    ``order`` names columns that make rows distinct, as far as they can be told apart."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # a row for each length at most
    places = Places(plan(counts, capacity))
    schema = schema_with(pieces, ("sequence_id", "long"), ("offset", "long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(np.asarray(batch.column(length)), np.asarray(batch.column("rank")))
            kept = [i for i, x in enumerate(batch.schema.names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    names = schema.names[:-2]
    return ranked(pieces, counts, order, length).select(*names, "rank").mapInArrow(place, schema)


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, spaced=False)
        for batch in batches:
            for some in blocks(batch, most=STEP_BYTES):
                ids, first = ids_of.ids(some.column("text"))
                doc, piece, start, size, crc, kept = [], [], [], [], [], []
                for i, key in enumerate(some.column("doc_id").to_pylist()):
                    whole = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        doc.append(key), piece.append(p), start.append(at), size.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.tolist())
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens; only longer documents are cut."""
    return assign(written(cut(docs, tokenizer, end_id, capacity, with_ids), "op6-pieces"), ["doc_id", "piece", "ids_crc32"], capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
