"""Mutation logs as DataFrames: builders, appends, replays and block reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import INLINE_BYTES, entry_size

LOG_SCHEMA = "seq long, user_key string, is_delete boolean, is_vp boolean, expires_at long, value string, val_len long, entry_size long, extent_id long, offset long, end_offset long"


def placed(log: DataFrame) -> DataFrame:
    """Adds offset and end_offset: entries follow one another within their extent (a bounded segment)."""
    w = Window.partitionBy("extent_id").orderBy("seq")
    end = F.sum("entry_size").over(w)
    return log.withColumn("end_offset", end).withColumn("offset", F.col("end_offset") - F.col("entry_size"))


def _log(rows: DataFrame) -> DataFrame:
    size = F.octet_length("value").cast("long")
    return rows.select("seq", "user_key", "is_delete", (~F.col("is_delete") & (size > INLINE_BYTES)).alias("is_vp"), "expires_at", "value", size.alias("val_len"), entry_size(F.col("user_key"), F.col("value")).alias("entry_size"), "extent_id")


def wide(number: Column, least: int = 4) -> Column:
    """The number in text with leading zeros, ``least`` digits or more; none is cut off."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(least), F.length(text)), F.lit("0"))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small-value log of the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.coalesce(F.col("event_type") == "error", F.lit(False))
    return _log(e.select((F.col("event_id") + 1).alias("seq"), F.concat(F.lit("u"), wide(F.col("user_id")), F.lit("/"), (F.col("event_id") % 8).cast("string")).alias("user_key"), deleted.alias("is_delete"), F.when(F.col("event_type") == "view", F.col("event_id") + 4001).otherwise(F.lit(0)).cast("long").alias("expires_at"), F.when(deleted, "").otherwise(F.concat("event_type", F.lit(":"), "props")).alias("value"), F.floor(F.col("event_id") / 1000).alias("extent_id")))


def kv_blob_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large-value log of the documents table."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    deleted = F.coalesce(F.col("n_chars") < 40, F.lit(False))
    return _log(d.select((F.col("doc_id") + 1).alias("seq"), F.concat(F.lit("d"), F.lpad((F.col("doc_id") % 397).cast("string"), 4, "0")).alias("user_key"), deleted.alias("is_delete"), F.lit(0).cast("long").alias("expires_at"), F.when(deleted, "").otherwise(F.coalesce("text", F.lit(""))).alias("value"), F.floor(F.col("doc_id") / 100).alias("extent_id")))


def append(log: DataFrame, path: str, codec: str = "zstd", bloom_key: str | None = "user_key") -> None:
    """Appends rows as a segment sorted by key and newest version, with a bloom filter for point reads."""
    out = log.repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seq")).write.mode("append").option("compression", codec)
    if bloom_key:
        out = out.option(f"parquet.bloom.filter.enabled#{bloom_key}", "true")
    out.parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def stamped(writes: DataFrame, last_seq: int, order: list[str]) -> DataFrame:
    """New sequence numbers after ``last_seq`` in the given order."""
    from .numbering import numbered

    return numbered(writes, order, "seq", last_seq + 1)


def replay(log: DataFrame, extent: int, offset: int, start: str = "", end: str = "") -> DataFrame:
    """Entries at or after a place, in the key range; by (extent, offset)."""
    from ..functions.codec import in_range

    after = (F.col("extent_id") > extent) | ((F.col("extent_id") == extent) & (F.col("offset") >= offset))
    return log.where(after & in_range(F.col("user_key"), start, end))


def replay_log(log: DataFrame, extent: int, offset: int, start: str = "", end: str = "") -> DataFrame:
    """Replay of a log without stored offsets: only extents from the place on are numbered through."""
    return replay(placed(log.where(F.col("extent_id") >= extent)), extent, offset, start, end)


def bounded(log: DataFrame, extents: DataFrame, most: int, start_pos: int = 0) -> DataFrame:
    """Entries of at most ``most`` extents of a stream from a position on; extents has (pos, extent_id)."""
    return log.join(extents.where((F.col("pos") >= start_pos) & (F.col("pos") < start_pos + most)).select("extent_id"), "extent_id", "left_semi")


def read_blocks(log: DataFrame, extent: int, offset: int, n: int, most_bytes: int = 32 << 20) -> DataFrame:
    """The next n entries of an extent, up to the one with which ``most_bytes`` are reached."""
    some = log.where((F.col("extent_id") == extent) & (F.col("offset") >= offset)).orderBy("offset").limit(n)
    before = F.sum("entry_size").over(Window.orderBy("offset")) - F.col("entry_size")
    return some.withColumn("_b", before).where(F.col("_b") < most_bytes).drop("_b")


def last_block(log: DataFrame, extents: DataFrame) -> DataFrame:
    """The newest entry of the newest extent that holds any; extents has (pos, extent_id)."""
    at = log.join(extents, "extent_id")
    return at.orderBy(F.desc("pos"), F.desc("offset")).limit(1).drop("pos")


def unsealed_tail(log: DataFrame, ok: Column) -> DataFrame:
    """The longest prefix of each extent in which every entry is valid."""
    bad = F.max((~ok).cast("int")).over(Window.partitionBy("extent_id").orderBy("offset"))
    return log.withColumn("_bad", bad).where("_bad = 0").drop("_bad")


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (user_key, value, val_len)."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.col("path").alias("user_key"), F.col("content").alias("value"), F.col("length").alias("val_len"))
