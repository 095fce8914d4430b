"""Regions, streams, extents, nodes: routing, splits, placement and repair as queries over small catalogs."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import in_range
from ..sources.numbering import numbered


#: Ranges that keys are routed in.
ROUTE_RANGES = 64


def hex_splits(spark: SparkSession, n: int) -> DataFrame:
    """(part_id, start_key, end_key): n equal ranges of eight hex digits; the outer bounds are empty."""
    if n < 2:
        raise ValueError("at least two ranges")
    step = 0xFFFFFFFF // n
    bound = lambda k: F.lower(F.lpad(F.hex(k * F.lit(step)), 8, "0"))
    i = F.col("id")
    return spark.range(n).select(i.alias("part_id"), F.when(i == 0, "").otherwise(bound(i)).alias("start_key"), F.when(i == n - 1, "").otherwise(bound(i + 1)).alias("end_key"))


def prefix_splits(prefixes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Every prefix with every suffix range start, stitched to contiguous ranges; both catalogs are small."""
    starts = prefixes.crossJoin(F.broadcast(suffixes)).select(F.concat("prefix", "suffix").alias("start_key")).distinct()
    w = Window.orderBy("start_key")
    return starts.select(F.when(F.row_number().over(w) == 1, "").otherwise(F.col("start_key")).alias("start_key"), F.coalesce(F.lead("start_key").over(w), F.lit("")).alias("end_key"))


def alnum_splits(n: int, alphabet: str = string.digits + string.ascii_letters) -> list[tuple[str, str]]:
    """n contiguous ranges of two-sign prefixes, as equal as integer division makes them."""
    alphabet = "".join(sorted(alphabet))
    base = len(alphabet)
    at = [base * base * k // n for k in range(1, n)]
    cuts = [alphabet[a // base] + alphabet[a % base] for a in at]
    return list(zip(["", *cuts], [*cuts, ""]))


def route(keys: DataFrame, regions: DataFrame, key: str = "user_key") -> DataFrame:
    """Each key with its region, however many there are: distinct keys and starts are sorted together, in ranges cut at some
    of the starts, and each key takes the last start before it. Keys beyond that region's end are in none."""
    starts = regions.select(F.struct(*(F.col(c) for c in regions.columns)).alias("_region"), F.col("start_key").alias("_at"))
    n = regions.count()
    step = max(1, n // ROUTE_RANGES)
    cuts = [r[0] for r in numbered(starts.select("_at").distinct(), ["_at"], "_i").where(F.col("_i") % step == 0).select("_at").orderBy("_at").collect()]  # ROUTE_RANGES at most, and one
    bucket = lambda x: F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= x)) if cuts else F.lit(0)
    wanted = keys.select(F.col(key).alias("_at")).where(F.col("_at").isNotNull()).distinct()
    both = starts.withColumn("_key", F.lit(False)).unionByName(wanted.withColumn("_key", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("_range").orderBy("_at", "_key").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_range", bucket(F.col("_at"))).withColumn("_region", F.last("_region", True).over(w)).where("_key and _region is not null")
    inside = in_range(F.col("_at"), F.col("_region.start_key"), F.col("_region.end_key"))
    return keys.join(found.where(inside).select(F.col("_at").alias(key), "_region.*"), key)


def gaps(regions: DataFrame) -> DataFrame:
    """Regions whose end is not the next one's start."""
    after = F.lead("start_key").over(Window.orderBy("start_key"))
    return regions.withColumn("next_start", F.coalesce(after, F.lit(""))).where("end_key <> next_start")


def overlapping(tables: DataFrame, regions: DataFrame) -> DataFrame:
    """Partitions with a table whose smallest or biggest key is outside the partition's range."""
    j = tables.join(regions, "part_id")
    inside = in_range(F.col("smallest"), F.col("start_key"), F.col("end_key")) & in_range(F.col("biggest"), F.col("start_key"), F.col("end_key"))
    return j.groupBy("part_id").agg(F.max((~inside).cast("int")).cast("boolean").alias("overlap"))


def biggest_table(tables: DataFrame) -> DataFrame:
    """Of each partition, the table with the largest size; on ties the first by location."""
    w = Window.partitionBy("part_id").orderBy(F.desc("estimated_size"), "extent_id")
    return tables.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def split_point(run: DataFrame, blocks: int) -> DataFrame:
    """First key of the middle one of ``blocks`` equal blocks of a sorted run of distinct keys."""
    keys = numbered(run.select("user_key").distinct(), ["user_key"], "place")
    size = keys.agg(F.count("*").alias("n"))  # one row
    half = blocks // 2
    first = half * F.floor(F.col("n") / blocks) + F.least(F.lit(half), F.col("n") % blocks)  # the first blocks take one key more
    return keys.crossJoin(F.broadcast(size)).where(F.col("place") == first).agg(F.min("user_key").alias("mid_key"))


def split_regions(regions: DataFrame, part: int, mid: str, new_part: int) -> DataFrame:
    """The old partition ends at mid, a new one begins there; nothing changes unless start < mid < end."""
    one = (F.col("part_id") == part) & (F.lit(mid) > F.col("start_key")) & ((F.col("end_key") == "") | (F.lit(mid) < F.col("end_key")))
    old = regions.withColumn("end_key", F.when(one, mid).otherwise(F.col("end_key")))
    new = regions.where(one).withColumn("part_id", F.lit(new_part).cast("long")).withColumn("start_key", F.lit(mid))
    return old.unionByName(new)


def expand_streams(streams: DataFrame, extents: DataFrame) -> DataFrame:
    """(stream_id, pos, extent columns) in stream order."""
    return streams.select("stream_id", F.posexplode("extent_ids").alias("pos", "extent_id")).join(extents, "extent_id", "left")


def refcounts(streams: DataFrame) -> DataFrame:
    return streams.select("stream_id", F.explode("extent_ids").alias("extent_id")).groupBy("extent_id").agg(F.countDistinct("stream_id").alias("refs"))


def duplicate_streams(streams: DataFrame, ids: dict[int, int]) -> DataFrame:
    """Streams and their copies under new ids, which share all extents."""
    pairs = F.create_map(*(F.lit(x).cast("long") for kv in ids.items() for x in kv))
    return streams.unionByName(streams.where(F.col("stream_id").isin(list(ids))).withColumn("stream_id", pairs[F.col("stream_id")]))


def punch(streams: DataFrame, holes: list[int]) -> DataFrame:
    """Streams without these extents; the last one of a stream stays."""
    gone = F.array(*(F.lit(h).cast("long") for h in holes)) if holes else F.array().cast("array<bigint>")
    return streams.withColumn("extent_ids", F.filter("extent_ids", lambda x: ~F.array_contains(gone, x) | (x == F.element_at("extent_ids", -1))))


def truncate(streams: DataFrame, stream: int, extent: int) -> DataFrame:
    """The stream from this extent on."""
    at = F.array_position("extent_ids", extent).cast("int")
    cut = F.when((F.col("stream_id") == stream) & (at > 0), F.slice("extent_ids", F.greatest(at, F.lit(1)), F.size("extent_ids"))).otherwise(F.col("extent_ids"))
    return streams.withColumn("extent_ids", cut)


def replica_addresses(extents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(extent_id, slot, node_id, address, available) of data and parity slots in order."""
    slots = extents.select("extent_id", "avali", "sealed_length", F.posexplode(F.concat("replicates", "parity")).alias("slot", "node_id"))
    up = (F.col("avali").bitwiseAND(F.expr("shiftleft(cast(1 as bigint), slot)")) != 0) | (F.col("sealed_length") == 0)
    return slots.join(nodes.select("node_id", "address"), "node_id", "left").select("extent_id", "slot", "node_id", "address", up.alias("available"))


def commit_lengths(replies: DataFrame, data_shards: int = 1) -> DataFrame:
    """Per extent of (extent_id, node_id, length; -1: no reply): the length to seal at, and whether that is needed."""
    good = F.col("length") >= 0
    agg = replies.groupBy("extent_id").agg(F.min(F.when(good, F.col("length"))).alias("commit"), F.max(F.when(good, F.col("length"))).alias("most"), F.count_if(~good).alias("missing"), F.count_if(good).alias("answered"))
    return agg.select("extent_id", "commit", ((F.col("missing") > 0) | (F.col("most") != F.col("commit"))).alias("needs_seal"), (F.col("answered") >= data_shards).alias("can_seal"))


def placement(nodes: DataFrame, n: int) -> DataFrame:
    """Nodes by last echo, then free space, both falling."""
    return nodes.where("alive").orderBy(F.desc("last_echo"), F.desc("free"), "node_id").limit(n).select("node_id")


def disk_free(disks: DataFrame) -> DataFrame:
    return disks.groupBy("node_id").agg(F.sum("total").alias("total"), F.sum("free").alias("free"), F.count_if("online").alias("online"))


def unassigned(parts: DataFrame, regions: DataFrame, servers: DataFrame) -> DataFrame:
    """Partitions without a region, or whose server is gone."""
    held = regions.join(servers.select("ps_id"), "ps_id", "left_semi")
    return parts.join(held.select("part_id"), "part_id", "left_anti")


def assign(parts: DataFrame, servers: DataFrame) -> DataFrame:
    """Partitions dealt to live servers in turn."""
    s = servers.select("ps_id", (F.row_number().over(Window.orderBy("ps_id")) - 1).alias("_k"), F.count("*").over(Window.partitionBy()).alias("_n"))
    p = parts.withColumn("_i", F.row_number().over(Window.orderBy("part_id")) - 1)
    return p.join(s, F.pmod(F.col("_i"), F.col("_n")) == F.col("_k")).drop("_i", "_k", "_n")


def recovery(extents: DataFrame, nodes: DataFrame, disks: DataFrame) -> DataFrame:
    """(extent_id, slot, node_id, target): sealed extents' slots on dead nodes or without an online disk, with the first
    healthy node that holds no slot of the extent."""
    slots = extents.where("sealed_length > 0").select("extent_id", F.concat("replicates", "parity").alias("holders"), F.posexplode(F.concat("replicates", "parity")).alias("slot", "node_id"))
    online = disks.where("online").select("node_id").distinct()
    healthy = nodes.where("alive").join(online, "node_id", "left_semi").select(F.col("node_id").alias("target"))
    broken = slots.join(healthy, F.col("node_id") == F.col("target"), "left_anti")
    # An extent's holders can take no more than that many of the first nodes, so one of so many and one more is free.
    most = slots.agg(F.max(F.size("holders"))).first()[0] or 0
    ids = [r[0] for r in healthy.where("target is not null").distinct().orderBy("target").limit(most + 1).collect()]
    first = F.array(*(F.lit(i).cast("long") for i in ids)) if ids else F.array().cast("array<bigint>")
    free = F.filter(first, lambda x: ~F.array_contains("holders", x))
    return broken.select("extent_id", "slot", "node_id", F.get(free, F.lit(0)).alias("target")).distinct()


def tasks_by_node(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("node_id").agg(F.countDistinct("extent_id").alias("tasks"))


def sealed(extents: DataFrame, extent: int, length: int) -> DataFrame:
    one = F.col("extent_id") == extent
    return extents.withColumn("sealed_length", F.when(one, F.lit(length).cast("long")).otherwise(F.col("sealed_length")))


def fenced(writes: DataFrame) -> DataFrame:
    """Writes whose revision is not below any earlier one of their extent; writes: (extent_id, arrival, revision)."""
    w = Window.partitionBy("extent_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    return writes.withColumn("_top", F.max("revision").over(w)).where("revision >= _top").drop("_top")


def allocate(rows: DataFrame, last: int, order: list[str], name: str = "id") -> DataFrame:
    """Unique ids after ``last``."""
    return numbered(rows, order, name, last + 1)


def manifest(tables: DataFrame, inputs: Column, outputs: DataFrame) -> DataFrame:
    """The table list after a compaction: without its inputs, with its outputs."""
    return tables.where(~inputs).unionByName(outputs)


def repairs(extents: DataFrame, nodes: DataFrame, disks: DataFrame) -> DataFrame:
    """(extent_id, slot, node_id, action) of sealed extents: what the first bad slot needs. A slot out of the availability
    mask is to be made available again; one on a disk that is offline or unknown, or on a dead or unknown node, to be recovered.
    extents: (extent_id, avali, holders, holder_disks) with disks in the order of the nodes."""
    both = F.posexplode(F.arrays_zip(F.col("holders").alias("node_id"), F.col("holder_disks").alias("disk_id")))
    slots = extents.where("avali > 0").select("extent_id", "avali", both.alias("slot", "x")).select("extent_id", "avali", "slot", "x.*")
    known = slots.join(nodes.select("node_id", "alive"), "node_id", "left").join(disks.select("disk_id", "online"), "disk_id", "left")
    there = F.col("avali").bitwiseAND(F.expr("shiftleft(cast(1 as bigint), slot)")) != 0
    bad = ~F.coalesce("online", F.lit(False)) | ~F.coalesce("alive", F.lit(False))
    action = F.when(~there, "available").when(bad, "recover")
    first = known.withColumn("action", action).where("action is not null")
    return first.groupBy("extent_id").agg(F.min(F.struct("slot", "node_id", "action")).alias("x")).select("extent_id", "x.*")


def sealed_by(replies: DataFrame, least: int) -> DataFrame:
    """(extent_id, sealed_length, avali) of replies (extent_id, slot, length; -1: none): the least length, and the mask of the
    slots that answered; only where ``least`` did."""
    good = replies.where("length >= 0").groupBy("extent_id")
    bit = F.expr("shiftleft(cast(1 as bigint), slot)")
    return good.agg(F.min("length").alias("sealed_length"), F.bit_or(bit).alias("avali"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def failover(regions: DataFrame, servers: DataFrame) -> DataFrame:
    """Regions after a change of servers: those whose server is gone are dealt to the live ones in turn, and dropped if there is
    none; the others stay."""
    kept = regions.join(servers.select("ps_id"), "ps_id", "left_semi")
    lost = regions.join(servers.select("ps_id"), "ps_id", "left_anti").drop("ps_id")
    return kept.select(regions.columns).unionByName(assign(lost, servers).select(regions.columns))


def adopted(regions: DataFrame, parts: DataFrame, server: int) -> DataFrame:
    """Regions after a server came: it takes all partitions (part_id, start_key, end_key) without a region."""
    free = parts.join(regions.select("part_id"), "part_id", "left_anti").withColumn("ps_id", F.lit(server).cast("long"))
    return regions.unionByName(free.select(regions.columns))


def catalog_rows(**catalogs: tuple[DataFrame, str]) -> DataFrame:
    """(kind, id, line): every row of catalogs (a frame and its id column) in readable form, its columns in order."""
    out = None
    for kind, (df, key) in catalogs.items():
        rest = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns if c != key]
        one = df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.concat_ws(" ", *rest).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def cluster_info(streams: DataFrame, extents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(stream_id, extents, bytes, nodes_alive): what the streams hold, with the number of nodes that live."""
    alive = nodes.agg(F.count_if("alive").alias("nodes_alive"))  # one row
    held = expand_streams(streams, extents).groupBy("stream_id").agg(F.count("*").alias("extents"), F.sum(F.coalesce("sealed_length", F.lit(0))).cast("long").alias("bytes"))
    return held.crossJoin(F.broadcast(alive))


def allocated(streams: DataFrame, nodes: DataFrame, stream: int, extent: int, replicas: int) -> tuple[DataFrame, DataFrame]:
    """(streams, the new extent): an open extent on the best nodes is added to a stream's end."""
    chosen = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("last_echo")).alias("a"), (-F.col("free")).alias("b"), "node_id"))), lambda x: x["node_id"]), 1, replicas)
    new = placement(nodes, replicas).join(nodes, "node_id").agg(chosen.alias("replicates")).select(F.lit(extent).cast("long").alias("extent_id"), "replicates", F.lit(0).cast("long").alias("sealed_length"))
    more = F.when(F.col("stream_id") == stream, F.concat("extent_ids", F.array(F.lit(extent).cast("long")))).otherwise(F.col("extent_ids"))
    return streams.withColumn("extent_ids", more), new


def registered(nodes: DataFrame, disks: DataFrame, address: str, uuids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node, disks) rows of a node that registers: the ids after the largest, the disks in the order of their uuids."""
    ids = nodes.agg(F.max("node_id").alias("node")).crossJoin(F.broadcast(disks.agg(F.max("disk_id").alias("disk"))))  # one row
    node = ids.select((F.col("node") + 1).alias("node_id"), F.lit(address).alias("address"))
    each = ids.select((F.col("node") + 1).alias("node_id"), F.posexplode(F.array_sort(F.array(*(F.lit(u) for u in uuids)))).alias("i", "uuid"), "disk")
    return node, each.select("node_id", (F.col("disk") + 1 + F.col("i")).cast("long").alias("disk_id"), "uuid")
