"""Column expressions for keys, entries and sizes of a mutation log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed bytes of a log entry besides key and value; longest value kept inline.
ENTRY_OVERHEAD, INLINE_BYTES = 28, 4096
#: Fixed mask of the checksum.
CRC_MASK = 0xA282EAD8


def prefix_end(prefix: str | bytes) -> str | bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    raw = raw.rstrip(b"\xff")
    if not raw:
        return None
    end = raw[:-1] + bytes([raw[-1] + 1])
    try:
        return end.decode() if isinstance(prefix, str) else end
    except UnicodeDecodeError:
        return None


def has_prefix(key: Column, prefix: str | bytes) -> Column:
    """startswith, with bounds that reach the Parquet scan for strings and binaries alike."""
    end, cond = prefix_end(prefix), (key >= F.lit(prefix)) & key.startswith(F.lit(prefix))
    return cond & (key < F.lit(end)) if end is not None else cond


def in_range(key: Column, start, end) -> Column:
    """start <= key < end; an empty end is unbounded."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return (key >= start) & ((F.octet_length(end) == 0) | (key < end))


def entry_size(key: Column, value: Column) -> Column:
    return (F.lit(ENTRY_OVERHEAD) + F.octet_length(key) + F.octet_length(F.coalesce(value, F.lit("")))).cast("long")


def dead(now: Column | int) -> Column:
    """Deleted, or expired at ``now``."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.col("is_delete") | ((F.col("expires_at") > 0) & (F.col("expires_at") <= now))


def internal_key(key: Column, seq: Column) -> Column:
    """Key bytes and the inverted version, big-endian, so that newer versions sort first."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(seq)), 16, "0")))


def split_internal_key(internal: Column) -> Column:
    """(user_key, seq) of an internal key."""
    n = F.octet_length(internal)
    high = F.conv(F.hex(F.substring(internal, n - 7, F.lit(8))), 16, -10).cast("long")
    return F.struct(F.substring(internal, F.lit(1), n - 8).alias("user_key"), F.bitwise_not(high).alias("seq"))


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned varint: seven bits each."""
    bits = F.length(F.regexp_replace(F.bin(x), "^0+(?=.)", ""))
    return F.ceil(bits / 7).cast("long")


def align_up(x: Column, to: int) -> Column:
    return (F.floor((x + (to - 1)) / to) * to).cast("long")


def align_down(x: Column, to: int) -> Column:
    return (F.floor(x / to) * to).cast("long")


def _in_units(x: Column, places: int, glue: str) -> Column:
    out = F.lit(None).cast("string")
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB", "EB")):
        value = F.round(x.cast("double") / float(1000**k), places).cast(f"decimal(20,{places})").cast("string")
        out = F.when(x >= F.lit(1000**k), F.concat(value, F.lit(glue + unit))).otherwise(out)
    return out


def human_size(x: Column) -> Column:
    """Base-1000 sizes with one decimal: ``999.0 B``, ``1.5 KB``; ``0B``."""
    return F.when(x == 0, "0B").otherwise(_in_units(x, 1, " "))


def human_throughput(x: Column) -> Column:
    """Base-1000 sizes a second with two decimals: ``1.50KB/sec``; empty for none."""
    return F.coalesce(F.concat(_in_units(x, 2, ""), F.lit("/sec")), F.lit(""))


def encoded_entry(key: Column, seq: Column, expires: Column, meta: Column, value: Column) -> Column:
    """A log entry's bytes, big-endian: key length (4, with the version), internal key, expiry (8), meta (4), value length (4), value."""
    number = lambda x, size: F.unhex(F.lpad(F.hex(x), 2 * size, "0"))
    inner, data = internal_key(key, seq), value.cast("binary")
    return F.concat(number(F.octet_length(inner), 4), inner, number(expires, 8), number(meta, 4), number(F.octet_length(data), 4), data)


def decoded_entry(entry: Column) -> Column:
    """(user_key, seq, expires_at, meta, value) of an entry's bytes."""
    number = lambda at, size: F.conv(F.hex(F.substring(entry, at, F.lit(size))), 16, 10).cast("long")
    n = number(F.lit(1), 4)
    key = split_internal_key(F.substring(entry, F.lit(5), n))
    value = F.substring(entry, n + 21, number(n + 17, 4))
    return F.struct(key["user_key"].alias("user_key"), key["seq"].alias("seq"), number(n + 5, 8).alias("expires_at"), number(n + 13, 4).alias("meta"), value.alias("value"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that both texts begin with."""
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


def replication(text: Column) -> Column:
    """(data, parity) of ``3`` or ``2+1``."""
    parts = F.transform(F.split(text, r"\+"), lambda x: F.trim(x))
    return F.struct(parts[0].cast("int").alias("data"), F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).cast("int")).otherwise(0).alias("parity"))


def shard_bytes(size: Column, data: Column | int) -> Column:
    """Bytes of each data shard of an erasure-coded object of this size: room for its length in four bytes."""
    n = data if isinstance(data, Column) else F.lit(data)
    return F.greatest(F.lit(4), F.floor((size + n + 3) / n)).cast("long")
