"""Version resolution: newest versions, time travel, liveness, merges of prioritised runs, seeks.

Versions are resolved before liveness is judged: a tombstone hides what is older. Only key predicates may go below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import dead, has_prefix, in_range


def latest(log: DataFrame, key: str = "user_key") -> DataFrame:
    """The newest version of each key. Each task keeps one row a key before the exchange, so hot keys don't gather."""
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of(log: DataFrame, version: int) -> DataFrame:
    return latest(log.where(F.col("seq") <= version))


def exact_version(log: DataFrame, version: int) -> DataFrame:
    return log.where(F.col("seq") == version)


def live(log: DataFrame, now: int) -> DataFrame:
    return latest(log).where(~dead(now))


def merge(runs: list[DataFrame], keys: list[str], within: str | None = None, reverse: bool = False) -> DataFrame:
    """Runs in order of priority, merged: of equal keys the earliest run's first row stays (its last one, in reverse)."""
    out = None
    for k, run in enumerate(runs):
        one = run.withColumn("_src", F.lit(k))
        out = one if out is None else out.unionByName(one)
    order = [F.col("_src"), *([F.desc(within) if reverse else F.col(within)] if within else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


def get(log: DataFrame, key: str, honor_ttl: bool = False, now: int = 0) -> DataFrame:
    """The newest version of one key, unless deleted. Expiry counts only where asked for, as in the reference."""
    one = latest(log.where(F.col("user_key") == key))
    return one.where(~dead(now) if honor_ttl else ~F.col("is_delete"))


def overwritten(batches: list[DataFrame]) -> DataFrame:
    """Batches of writes in order: of rows with the same key and sequence number the last batch's stays."""
    return merge(batches[::-1], ["user_key", "seq"])


def head_of(log: DataFrame, key: str, honor_ttl: bool = False, now: int = 0) -> DataFrame:
    """(user_key, val_len) of one key."""
    return head(log.where(F.col("user_key") == key), honor_ttl, now)


def range_walk(log: DataFrame, regions: DataFrame, prefix: str, start: str, limit: int, now: int) -> tuple[DataFrame, DataFrame]:
    """(keys, more): keys from ``start`` on, region by region: the first is the one that may hold the start, and the walk ends
    before a region that doesn't begin with the prefix, or at the limit. more is (n, more), true if the limit was reached."""
    ahead = regions.where((F.col("end_key") == "") | (F.col("end_key") > start)).orderBy("start_key")
    known = [tuple(r) for r in ahead.where(has_prefix(F.col("start_key"), prefix) | (F.col("start_key") <= start)).select("start_key", "end_key").collect()]
    if not known:
        raise ValueError("the start is in no region")
    end = known[0][1]
    for begin, until in known[1:]:
        if begin != end or not begin.startswith(prefix):
            break
        end = until
    keys = scan(log, prefix, start, end, now).select("user_key").orderBy("user_key").limit(limit)
    return keys, truncated(keys, limit).select("n", F.col("truncated").alias("more"))


def head(log: DataFrame, honor_ttl: bool = False, now: int = 0) -> DataFrame:
    """(user_key, val_len) without reading values."""
    top = latest(log.select("user_key", "seq", "is_delete", "expires_at", "val_len"))
    return top.where(~dead(now) if honor_ttl else ~F.col("is_delete")).select("user_key", "val_len")


def scan(log: DataFrame, prefix: str = "", start: str = "", end: str = "", now: int = 0) -> DataFrame:
    """Live rows with the prefix from ``start`` on; an empty start means the prefix. Unordered."""
    if prefix and start and not start.startswith(prefix):
        raise ValueError("start must have the prefix")
    cond = in_range(F.col("user_key"), start or prefix, end)
    return live(log.where(cond & has_prefix(F.col("user_key"), prefix) if prefix else cond), now)


def range_keys(log: DataFrame, prefix: str, start: str, limit: int, now: int) -> DataFrame:
    return scan(log, prefix, start, now=now).select("user_key").orderBy("user_key").limit(limit)


def truncated(page: DataFrame, limit: int) -> DataFrame:
    """(n, truncated): true if the limit was reached, even if nothing is left."""
    return page.agg(F.count("*").alias("n")).select("n", (F.col("n") == limit).alias("truncated"))


def next_page(log: DataFrame, prefix: str, last: str, limit: int, now: int) -> DataFrame:
    """The page that begins with (and repeats) the last key of the one before."""
    return range_keys(log, prefix, last, limit, now)


def seek(log: DataFrame, key: str, forward: bool = True) -> DataFrame:
    """The first key not below, or the last not above."""
    k = F.col("user_key")
    return log.where(k >= key if forward else k <= key).select("user_key").orderBy(k.asc() if forward else k.desc()).limit(1)


def as_of_join(probes: DataFrame, log: DataFrame) -> DataFrame:
    """For probes (user_key, version): the newest version at or before, if not deleted."""
    rest = [c for c in log.columns if c != "user_key"]
    versions = log.select("user_key", F.col("seq").alias("_at"), F.lit(0).alias("_probe"), F.struct(*rest).alias("_row"))
    asked = probes.select("user_key", F.col("version").cast("long").alias("_at"), F.lit(1).alias("_probe"))
    # A key's versions and probes are sorted once together: each probe takes the last version before it.
    w = Window.partitionBy("user_key").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    both = versions.unionByName(asked, allowMissingColumns=True).withColumn("_row", F.last("_row", True).over(w))
    found = both.where("_probe = 1 and _row is not null").select("user_key", F.col("_at").cast(probes.schema["version"].dataType).alias("version"), "_row.*")
    return found.where(~F.col("is_delete"))


def deletes(log: DataFrame, requests: DataFrame, last_seq: int) -> tuple[DataFrame, DataFrame]:
    """(tombstones, not found) for delete requests (user_key)."""
    from ..sources.logs import stamped

    there = latest(log.select("user_key", "seq", "is_delete")).where(~F.col("is_delete"))
    wanted = requests.select("user_key").distinct()
    stones = stamped(wanted.join(there, "user_key", "left_semi"), last_seq, ["user_key"])
    return stones.withColumn("is_delete", F.lit(True)), wanted.join(there, "user_key", "left_anti")


def order_violations(runs: DataFrame) -> DataFrame:
    """Keys whose newest version in a newer run (by last_seq) is older than one in an older run; runs: (last_seq, user_key, seq)."""
    w = Window.partitionBy("user_key").orderBy("last_seq", "seq")
    return runs.withColumn("_before", F.max("seq").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("seq < _before").drop("_before")
