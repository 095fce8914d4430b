"""A stored log: generations of sorted, bloom-filtered Parquet; writes append to the newest, maintenance makes the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance as mt
from ..operators import snapshot as sn
from .logs import LOG_SCHEMA, append, read_log


class Store:
    """A folder with ``gen=<n>``; the newest one that was written to its end is the log.

    One job writes at a time. Readers of an older generation keep their files until ``purge``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/gen=*/_SUCCESS")
        return sorted(int(x.getPath().getParent().getName()[4:]) for x in fs.globStatus(at) or [])

    def _at(self, generation: int) -> str:
        return f"{self.path}/gen={generation}"

    def log(self) -> DataFrame:
        """The newest generation's rows; key bounds reach its files."""
        done = self.generations()
        return read_log(self.spark, self._at(done[-1])) if done else self.spark.createDataFrame([], LOG_SCHEMA)

    def _columns(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(f.split()[0] for f in LOG_SCHEMA.split(", ")))

    def put(self, rows: DataFrame) -> None:
        """Appends rows of the log's columns, with their sequence numbers."""
        append(self._columns(rows), self._at((self.generations() or [1])[-1]))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Appends tombstones for live keys (user_key); returns the keys that were not found."""
        log = self.log()
        top = log.agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.max("extent_id"), F.lit(0))).first()
        stones, missing = sn.deletes(log, keys, top[0])
        size = (28 + F.octet_length("user_key")).cast("long")
        none = {"is_vp": F.lit(False), "expires_at": F.lit(0).cast("long"), "value": F.lit(""), "val_len": F.lit(0).cast("long"), "entry_size": size, "extent_id": F.lit(top[1]).cast("long"), "offset": F.lit(0).cast("long"), "end_offset": size}
        self.put(stones.select("user_key", "seq", "is_delete").withColumns(none))
        return missing

    def _next(self, rows: DataFrame) -> None:
        """A new generation of these rows; what a job that was cut short left of it is replaced."""
        n = (self.generations() or [0])[-1] + 1
        at, fs = self._fs(self._at(n))
        fs.delete(at, True)
        append(self._columns(rows), self._at(n))

    def compact(self, now: int, major: bool, start: str = "", end: str = "") -> None:
        """Rewrites the log with the newest versions of the keys in the range."""
        self._next(mt.compact(self.log(), now, major, start, end))

    def gc(self, now: int, wanted: list[int] | None = None, tenths: int = 4) -> list[int]:
        """Rewrites the log without the large values of some extents, the current ones moved to a new extent; of the wanted
        extents, or of those that a compaction leaves mostly to discard. Returns the extents, MOST_EXTENTS at most."""
        log = self.log()
        sizes = log.groupBy("extent_id").agg(F.sum("entry_size").alias("size"))
        if wanted is None:
            lost = mt.merge_discards(mt.flush_discard(log), mt.compaction_discard(log, now, False))
            chosen = [r[0] for r in mt.gc_candidates(lost, sizes, tenths=tenths).collect()]
        else:
            asked = self.spark.createDataFrame(list(enumerate(wanted)), "pos long, extent_id long")
            chosen = [r.extent_id for r in mt.forced_candidates(asked, sizes).collect()]
        if chosen:
            new = log.agg(F.max("extent_id")).first()[0] + 1
            there = F.col("extent_id").isin(chosen)
            self._next(mt.collected(log, mt.gc_moves(log, there, now), there, new))
        return chosen

    def purge(self) -> None:
        """Deletes all generations but the newest."""
        for n in self.generations()[:-1]:
            at, fs = self._fs(self._at(n))
            fs.delete(at, True)
