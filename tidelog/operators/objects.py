"""Chunked objects, secondary indexes and latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 8 << 20


def chunked(objects: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(user_key, name, i, value) chunks ``a:<name>:<i>`` of (name, data) with binary data."""
    n = F.octet_length("data")
    i = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / chunk).cast("int")))
    return objects.select("name", "data", i.alias("i")).select(F.concat(F.lit("a:"), "name", F.lit(":"), F.col("i").cast("string")).alias("user_key"), "name", "i", F.substring("data", F.col("i") * chunk + 1, F.lit(chunk)).alias("value"))


def object_meta(objects: DataFrame) -> DataFrame:
    """``b:<name>`` with the size as four big-endian bytes."""
    return objects.select(F.concat(F.lit("b:"), "name").alias("user_key"), F.unhex(F.lpad(F.hex(F.octet_length("data")), 8, "0")).alias("value"))


def assembled(chunks: DataFrame) -> DataFrame:
    """(name, data) of chunks, in order. An object is one value, so its chunks meet by nature."""
    parts = F.array_sort(F.collect_list(F.struct("i", "value")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["value"]))
    return chunks.groupBy("name").agg(joined.alias("data"))


def ranged(chunks: DataFrame, start: int, length: int, chunk: int = CHUNK) -> DataFrame:
    """Bytes [start, start + length) of each object, from the chunks that hold them alone."""
    first, last = start // chunk, (start + length - 1) // chunk
    some = chunks.where(F.col("i").between(first, last))
    return assembled(some).select("name", F.substring("data", F.lit(start - first * chunk + 1), F.lit(length)).alias("data"))


def put_streams(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """(put_id, value, ok) of streamed puts: chunks (put_id, i, value) against declared (put_id, length)."""
    whole = chunks.groupBy("put_id").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("p"))
    value = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["value"]))
    return whole.select("put_id", value.alias("value")).join(declared, "put_id").select("put_id", "value", (F.octet_length("value") == F.col("length")).alias("ok"))


def index(rows: DataFrame, values: Column, key: str = "user_key") -> DataFrame:
    """(index_value, key) of an index function that gives an array."""
    return rows.select(F.explode(values).alias("index_value"), key).distinct()


def index_keys(ix: DataFrame, value: str, key: str = "user_key") -> DataFrame:
    return ix.where(F.col("index_value") == value).select(key).orderBy(key)


def latency(ops: DataFrame, micros: str = "micros", size: str = "bytes") -> DataFrame:
    """Count, bytes and exact percentiles over all operations."""
    q = lambda p: F.percentile(micros, F.lit(p))
    return ops.agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def cdf(ops: DataFrame, value: str) -> DataFrame:
    """(value, n, upto): cumulative counts by distinct value; only distinct values reach the one window."""
    each = ops.groupBy(value).agg(F.count("*").alias("n"))
    return each.withColumn("upto", F.sum("n").over(Window.orderBy(value)))


def bench_keys(spark, threads: int, each: int) -> DataFrame:
    """(user_key, thread): the write benchmark's keys, dealt to threads in equal parts."""
    i = F.col("id")
    t, j = F.floor(i / each), i % each
    return spark.range(threads * each).select(F.concat(F.lit("test"), i.cast("string"), F.lit("_"), t.cast("string"), F.lit("_"), j.cast("string")).alias("user_key"), t.alias("thread"))


def deleted_objects(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The chunk and meta rows (user_key, name, ...) left after the named objects (name) are deleted."""
    return rows.join(names.select("name").distinct(), "name", "left_anti")


def reindexed(ix: DataFrame, updates: DataFrame, key: str = "user_key") -> DataFrame:
    """An index after updates (key, values array; null values delete): a key's old entries go, its new ones come."""
    kept = ix.join(updates.select(key), key, "left_anti")
    return kept.select("index_value", key).unionByName(updates.select(F.explode("values").alias("index_value"), key)).distinct()


def summary(ops: DataFrame, threads: int, size: int, seconds: float) -> DataFrame:
    """The write benchmark's summary: one row with requests, bytes and throughput in readable units, and latencies."""
    from ..functions.codec import human_size, human_throughput

    one = latency(ops)
    rate = F.round(F.col("n") / F.lit(float(seconds)), 2)
    return one.select(F.lit(threads).alias("threads"), F.lit(size).alias("size"), F.lit(float(seconds)).alias("seconds"), F.col("n").alias("requests"), human_size(F.col("bytes")).alias("transferred"), rate.alias("per_second"), human_throughput(F.col("bytes") / F.lit(float(seconds))).alias("throughput"), "p50", "p95", "p99")
