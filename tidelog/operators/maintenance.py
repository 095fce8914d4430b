"""Compaction, discard accounting and value-log garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import dead, in_range
from ..sources.numbering import numbered
from .snapshot import latest

MOST_EXTENTS = 3


def compact(log: DataFrame, now: int, major: bool, start: str = "", end: str = "") -> DataFrame:
    """Newest versions within the range; a major one drops the dead, a minor one keeps tombstones and expired rows."""
    out = latest(log.where(in_range(F.col("user_key"), start, end)))
    return out.where(~dead(now)) if major else out


def output_bucket(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Adds bucket: output files of about ``most_bytes``, in key order within a partition of the key space."""
    total = F.sum("entry_size").over(Window.partitionBy("extent_id").orderBy("user_key"))
    return rows.withColumn("bucket", F.floor((total - F.col("entry_size")) / most_bytes))


def flush_discard(log: DataFrame) -> DataFrame:
    """Per extent: bytes of inline entries, which a flush copies."""
    return log.groupBy("extent_id").agg(F.sum(F.when(~F.col("is_vp"), F.col("entry_size")).otherwise(0)).alias("discard"))


def compaction_discard(log: DataFrame, now: int, major: bool) -> DataFrame:
    """Per extent: value bytes of pointers that newer versions shadow (a major compaction adds dropped dead rows)."""
    rn = F.row_number().over(Window.partitionBy("user_key").orderBy(F.desc("seq")))
    lost = F.col("is_vp") & ((F.col("_rn") > 1) | dead(now) if major else F.col("_rn") > 1)
    ranked = log.select("user_key", "seq", "is_vp", "is_delete", "expires_at", "val_len", "extent_id").withColumn("_rn", rn)
    return ranked.groupBy("extent_id").agg(F.sum(F.when(lost, F.col("val_len")).otherwise(0)).alias("discard"))


def merge_discards(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("extent_id").agg(F.sum("discard").alias("discard"))


def discard_map(discards: DataFrame) -> DataFrame:
    """One map of a manifest's few extents."""
    return discards.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extent_id", "discard")))).alias("discards"))


def gc_candidates(discards: DataFrame, sizes: DataFrame, most: int = MOST_EXTENTS, tenths: int = 4) -> DataFrame:
    """The largest discards but for the last extent, then those over ``tenths`` tenths of the sealed size."""
    last = sizes.agg(F.max("extent_id").alias("last_extent"))
    known = discards.join(sizes, "extent_id").join(F.broadcast(last), F.col("extent_id") != F.col("last_extent"))  # one row
    top = known.where("size > 0").orderBy(F.desc("discard"), "extent_id").limit(most)
    return top.where(F.col("discard") * 10 > F.col("size") * tenths).select("extent_id", "discard", "size")


def forced_candidates(requested: DataFrame, stream: DataFrame, most: int = MOST_EXTENTS) -> DataFrame:
    """The first requested ids (pos, extent_id) that are in the stream (extent_id)."""
    return requested.join(stream.select("extent_id"), "extent_id", "left_semi").orderBy("pos").limit(most)


def gc_moves(log: DataFrame, extents: Column, now: int, start: str = "", end: str = "") -> DataFrame:
    """Current large values in the chosen extents, to be written again with new sequence numbers."""
    top = log.agg(F.max("seq").alias("top"))
    current = latest(log.where(in_range(F.col("user_key"), start, end))).where(extents & F.col("is_vp") & ~dead(now))
    moved = numbered(current, ["seq"], "_n", 1)
    return moved.crossJoin(F.broadcast(top)).withColumn("new_seq", F.col("top") + F.col("_n")).drop("_n", "top")  # one row


def collected(log: DataFrame, moves: DataFrame, extents: Column, extent: int) -> DataFrame:
    """The log without the chosen extents' large entries, and with the moved ones in ``extent``."""
    again = moves.withColumn("seq", F.col("new_seq")).withColumn("extent_id", F.lit(extent).cast("long")).drop("new_seq")
    return log.where(~(extents & F.col("is_vp"))).unionByName(again.select(log.columns))
