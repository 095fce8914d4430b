"""Shards of near-equal bytes by sampled splitters, with DataFrame functions alone.

Records are ordered by a hash of their text, so equal texts lie together and go to one shard. A sample drawn in
proportion to sizes gives quantile boundaries of that order: fine ranges, many to a shard. One pass sums each range.
An overfull range is subdivided: its groups of equal texts that weigh over a fine range's share become units of their
own, and a group heavier than a shard's share is cut further by a hash of its rows' numbers; what is left of it, if it
still weighs over two shares, is cut at the quantiles of its own rows, again and again. The units, whose number is bounded
by the parameters, are planned on the driver: large groups go to the lightest shard, then ranges fill the shards in
order. Records get gapless places by counting within small pieces of units, never within a whole shard.

Null texts count as empty, with size 1; null and repeated ids are allowed, as rows have numbers of their own; repeated
rows are placed each; an empty table gives no row; further columns are ignored. Law: ``bytes``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, written

SHARDS = 8
#: Fine ranges to a shard; rows in the sample to a range; rows that one task numbers.
RANGES, SAMPLE, PIECE_ROWS = 64, 64, 100_000
#: Times that overfull ranges are cut again.
ROUNDS = 4
_BITS = 12


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of the hash, from a sample in which a row's chance grows with its size."""
    want = ranges * SAMPLE
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(want / max(total, 1)))
    drawn = rows.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) / float(1 << 30) < chance)
    at = drawn.agg(F.percentile_approx("h", F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 20 * ranges)).first()[0]
    return sorted(set(at or []))


def _range_of(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds the number of splitters not above the hash: by a table over the hash's first bits, then the few within."""
    spark = rows.sparkSession
    first = [[] for _ in range(1 << _BITS)]
    half = 1 << (_BITS - 1)
    for c in cuts:
        first[(c >> (64 - _BITS)) + half].append(c)
    table, below = [], 0
    for k, own in enumerate(first):
        table.append((k - half, below, own))
        below += len(own)
    # 2^_BITS rows and at most one entry for each splitter.
    ranges = spark.createDataFrame(table, "prefix long, below int, own array<bigint>")
    found = rows.withColumn("prefix", F.shiftright("h", 64 - _BITS)).join(F.broadcast(ranges), "prefix")
    return found.withColumn("range", F.col("below") + F.size(F.filter("own", lambda x: x <= F.col("h")))).drop("prefix", "below", "own")


def _plan(units: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(range, group, part, shard) for units (range, group, part, bytes); group is null for a whole range."""
    total = sum(u[3] for u in units)
    load, out = [0] * shards, []
    for r, g, p, size in sorted((u for u in units if u[1] is not None), key=lambda u: (-u[3], u)):
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += size
        out.append((r, g, p, s))
    s = 0
    for r, g, p, size in sorted((u for u in units if u[1] is None), key=lambda u: u[0]):
        # On to the next shard where the range would leave this one further above its share than it is below.
        while s < shards - 1 and load[s] + size / 2 > total / shards:
            s += 1
        load[s] += size
        out.append((r, g, p, s))
    return out


def _ranges(rows: DataFrame, total: int, ranges: int) -> tuple[DataFrame, dict[int, int], list[tuple[int, int, int]]]:
    """The rows with their range, each range's bytes, and the groups (range, h, bytes) that weigh over a range's share."""
    share, cuts = max(1, total // ranges), _splitters(rows, total, ranges)
    for left in range(ROUNDS, -1, -1):
        ranged = _range_of(rows, cuts)
        sizes = {r[0]: r[1] for r in ranged.groupBy("range").agg(F.sum("size")).collect()}  # a row for each range
        overfull = [r for r, b in sizes.items() if b > 2 * share]
        if not overfull:
            return ranged, sizes, []
        some = ranged.where(F.col("range").isin(overfull))
        weights = some.groupBy("range", "h").agg(F.sum("size").alias("bytes"))
        groups = [tuple(r) for r in weights.where(F.col("bytes") > share).collect()]  # fewer than there are ranges, by their weight
        rest = {r: sizes[r] - sum(b for x, _, b in groups if x == r) for r in overfull}
        more = {r: -(-b // share) for r, b in rest.items() if b > 2 * share}
        if not more or not left:
            return ranged, sizes, groups
        # Quantiles of the groups that are left, as many as the fullest range needs; no group is over a share.
        at = F.array(*(F.lit(k / max(more.values())) for k in range(1, max(more.values()))))
        light = weights.where((F.col("bytes") <= share) & F.col("range").isin(list(more)))
        found = light.groupBy("range").agg(F.percentile_approx("h", at, 10_000).alias("at")).collect()
        new = sorted({*cuts, *(c for r in found for c in r.at)})
        if new == cuts:
            return ranged, sizes, groups
        cuts = new


def shard(docs: DataFrame, shards: int = SHARDS, ranges_each: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document."""
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "op2-rows")  # which also fixes the rows' numbers
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * ranges_each
    share = max(1, total // ranges)
    ranged, sizes, groups = _ranges(rows, total, ranges)
    parts_of = {(r, h): -(-b // max(1, total // shards)) for r, h, b in groups}
    parts_of = {k: 8 * p if p > 1 else 1 for k, p in parts_of.items()}
    weights = {(r, h): -(-b // share) for r, h, b in groups}  # fine ranges that a group is worth
    big = spark.createDataFrame([(r, h, p, weights[r, h]) for (r, h), p in parts_of.items()], "range int, h long, parts int, weight long")
    unit = ranged.join(F.broadcast(big), ["range", "h"], "left")
    unit = unit.withColumn("group", F.when(F.col("parts").isNotNull(), F.col("h"))).withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    left = dict(sizes)
    units: list[tuple] = []
    cut = {k for k, p in parts_of.items() if p > 1}
    for r, h, b in groups:
        left[r] -= b
        if (r, h) not in cut:
            units.append((r, h, 0, b))
    if cut:
        rest = unit.where(F.col("group").isin([h for _, h in cut])).groupBy("range", "group", "part").agg(F.sum("size"))
        units += [tuple(r) for r in rest.collect()]  # eight to a shard for each cut group
    units += [(r, None, 0, b) for r, b in left.items()]
    planned = spark.createDataFrame([(r, g, p, s) for r, g, p, s in _plan(units, shards)], "u_range int, u_group long, u_part int, shard int")
    same = (F.col("range") == F.col("u_range")) & F.col("group").eqNullSafe(F.col("u_group")) & (F.col("part") == F.col("u_part"))
    placed = unit.join(F.broadcast(planned), same).drop("u_range", "u_group", "u_part")
    pieces = max(1, -(-n // (ranges * PIECE_ROWS // 4)))
    piece = [F.col("shard"), F.col("range"), F.coalesce("group", F.lit(0)).alias("group"), F.col("part"), F.pmod(F.xxhash64("row", F.lit(2)), F.lit(pieces) * F.coalesce("weight", F.lit(1))).alias("piece")]
    placed = placed.select("doc_id", "size", "text_crc32", "h", "row", *piece)
    names = ["shard", "range", "group", "part", "piece"]
    within = F.row_number().over(Window.partitionBy(*names).orderBy("h", "doc_id", "row"))
    counts = placed.groupBy(*names).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("range", "group", "part", "piece")) - F.col("n")).drop("n")
    numbered = placed.withColumn("within", within).join(before, names)
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
