"""Further queries: stored logs that are written, read, compacted and collected; planning and repair; codecs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec as C
from .kv_queries import BLOB, CATALOG, KV, NOW, blob, disks, extents, kv, nodes, parts, query, regions, servers, streams
from .operators import catalog as cat
from .operators import objects as ob
from .operators import snapshot as sn
from .plans import picks
from .sources import logs as lg
from .sources.store import Store


def scratch(s: SparkSession) -> str:
    """A new folder that executors and driver share: in spark.checkpoint.dir, or a temporary one on a local master."""
    there = s.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not there:
        if not s.sparkContext.master.startswith("local") or s.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = f"file://{tempfile.gettempdir()}"
    path = f"{there.rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(s: SparkSession, log: DataFrame) -> Store:
    """The log in a new store, as two batches of writes."""
    store = Store(s, scratch(s))
    placed = lg.placed(log)
    store.put(placed.where("seq % 2 = 0"))
    store.put(placed.where("seq % 2 = 1"))
    return store


# Stored logs: put, read back, flush, compact, collect.
query("store_get", f"WITH {KV} SELECT user_key, seq, value FROM top WHERE user_key = 'u0007/3' AND NOT is_delete")(
    lambda s, d: sn.get(stored(s, kv(s, d)).log(), "u0007/3").select("user_key", "seq", "value")
)
query("store_get_honor_ttl", f"WITH {KV} SELECT user_key, seq FROM live WHERE user_key = 'u0012/4'")(
    lambda s, d: sn.get(stored(s, kv(s, d)).log(), "u0012/4", True, NOW).select("user_key", "seq")
)
query("store_head", f"WITH {KV} SELECT user_key, CAST(val_len AS BIGINT) AS val_len FROM top WHERE user_key = 'u0040/1' AND NOT is_delete")(
    lambda s, d: sn.head_of(stored(s, kv(s, d)).log(), "u0040/1")
)
query("store_range", f"WITH {KV} SELECT user_key FROM live WHERE starts_with(user_key, 'u001') ORDER BY user_key LIMIT 50")(
    lambda s, d: sn.range_keys(stored(s, kv(s, d)).log(), "u001", "", 50, NOW)
)


@query("store_compact_minor", f"WITH {KV} SELECT user_key, seq, is_delete, value FROM top")
def _compact_minor(s: SparkSession, d: str) -> DataFrame:
    store = stored(s, kv(s, d))
    store.compact(NOW, False)
    return store.log().select("user_key", "seq", "is_delete", "value")


@query("store_compact_major", f"WITH {KV} SELECT user_key, seq, value FROM live")
def _compact_major(s: SparkSession, d: str) -> DataFrame:
    store = stored(s, kv(s, d))
    store.compact(NOW, True)
    return store.log().select("user_key", "seq", "value")


@query("store_delete", f"WITH {KV} SELECT user_key FROM top WHERE NOT is_delete AND user_key NOT LIKE 'u001%'")
def _store_delete(s: SparkSession, d: str) -> DataFrame:
    store = stored(s, kv(s, d))
    missing = store.delete(store.log().where("user_key like 'u001%'").select("user_key").distinct())
    assert missing.columns == ["user_key"]
    return sn.latest(store.log()).where("not is_delete").select("user_key")


@query("store_gc_forced", f"WITH {BLOB} SELECT user_key, md5(value) AS digest FROM top WHERE NOT is_delete")
def _gc_forced(s: SparkSession, d: str) -> DataFrame:
    store = stored(s, blob(s, d))
    store.gc(NOW, [7, 99999999, 3])
    return sn.latest(store.log()).where("not is_delete").select("user_key", F.md5(F.col("value").cast("binary")).alias("digest"))


@query(
    "store_gc_extents",
    f"WITH {BLOB} SELECT extent_id, count(*) AS n FROM kv WHERE NOT is_vp OR extent_id NOT IN (3, 7) GROUP BY extent_id "
    "UNION ALL SELECT (SELECT max(extent_id) + 1 FROM kv), count(*) FROM kv WHERE seq IN (SELECT seq FROM top WHERE is_vp AND extent_id IN (3, 7)) HAVING count(*) > 0",
)
def _gc_extents(s: SparkSession, d: str) -> DataFrame:
    store = stored(s, blob(s, d))
    store.gc(NOW, [7, 99999999, 3])
    return store.log().groupBy("extent_id").agg(F.count("*").alias("n"))


@query("store_gc_auto", f"WITH {BLOB} SELECT user_key, md5(value) AS digest FROM top WHERE NOT is_delete")
def _gc_auto(s: SparkSession, d: str) -> DataFrame:
    store = stored(s, blob(s, d))
    store.gc(NOW)
    return sn.latest(store.log()).where("not is_delete").select("user_key", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("bench_results", "SELECT event_id AS \"Key\", event_id * 3 AS \"StartTime\", CAST(round(value * 1000) AS BIGINT) AS \"Elapsed\" FROM events")
def _bench_results(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    rows = s.read.parquet(f"{d}/events.parquet")
    rows.select(F.col("event_id").alias("Key"), (F.col("event_id") * 3).alias("StartTime"), F.round(F.col("value") * 1000).cast("long").alias("Elapsed")).write.json(path)
    return s.read.schema("Key long, StartTime long, Elapsed long").json(path)


# Reads across regions, batches that overwrite, merges in reverse.
_WALKED = f"{KV}, w AS (SELECT user_key FROM live WHERE starts_with(user_key, 'u00') AND user_key >= 'u0033' AND user_key < 'u0100' ORDER BY user_key LIMIT 40)"
query("kv_range_walk", f"WITH {_WALKED} SELECT user_key FROM w")(lambda s, d: sn.range_walk(kv(s, d), regions(s), "u00", "u0033", 40, NOW)[0])
query("kv_range_walk_more", f"WITH {_WALKED} SELECT count(*) AS n, count(*) = 40 AS more FROM w")(lambda s, d: sn.range_walk(kv(s, d), regions(s), "u00", "u0033", 40, NOW)[1])
query("overwritten", f"WITH {KV} SELECT user_key, seq, CASE WHEN seq % 10 = 0 THEN 'new' ELSE value END AS value FROM kv")(
    lambda s, d: sn.overwritten([kv(s, d), kv(s, d).where("seq % 10 = 0").withColumn("value", F.lit("new"))]).select("user_key", "seq", "value")
)
query(
    "merge_reverse",
    "WITH u AS (SELECT user_id AS k, event_id AS p, 1 AS src FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, 2 FROM events) "
    "SELECT k, p, src FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, p DESC) = 1",
)(
    lambda s, d: sn.merge(
        [s.read.parquet(f"{d}/events.parquet").where(c).select(F.col("user_id").alias("k"), F.col("event_id").alias("p"), F.lit(i).alias("src")) for i, c in ((1, "event_type = 'view'"), (2, "true"))],
        ["k"], "p", reverse=True,
    ).orderBy(F.desc("k"))
)

# Planning.
_PARTS = f"{KV}, t AS (SELECT extent_id // 4 AS part_id, extent_id, max(seq) AS last_seq, CAST(sum(entry_size) AS BIGINT) AS size FROM kv GROUP BY ALL)"


def _part_tables(s: SparkSession, d: str) -> DataFrame:
    part = F.floor(F.col("extent_id") / 4).alias("part_id")
    return kv(s, d).groupBy(part, "extent_id").agg(F.max("seq").alias("last_seq"), F.sum("entry_size").alias("estimated_size"))


query(
    "compaction_pick",
    f"""WITH {_PARTS}, o AS (SELECT *, count(*) OVER w AS n, sum(size) OVER w AS whole, min(extent_id) OVER w AS f, lead(extent_id) OVER (PARTITION BY part_id ORDER BY last_seq) AS after FROM t WINDOW w AS (PARTITION BY part_id))
 SELECT part_id, last_seq, coalesce(after, 0) AS "truncate" FROM o WHERE n > 1 AND extent_id = f AND size < floor(0.3 * whole + 0.5)""",
)(lambda s, d: picks.head_extent_pick(_part_tables(s, d)))
query(
    "filled_outputs",
    f"""WITH RECURSIVE {KV}, s AS (SELECT extent_id // 4 AS part, user_key, entry_size, row_number() OVER w AS i, sum(entry_size) OVER w AS upto FROM live WINDOW w AS (PARTITION BY extent_id // 4 ORDER BY user_key)),
 f(part, b, i, used) AS (SELECT part, 0, 1, 0::HUGEINT FROM s WHERE i = 1 UNION ALL
  SELECT f.part, f.b + 1, x.i, x.before FROM f, LATERAL (SELECT min(s.i) AS i, min(s.upto - s.entry_size) AS before FROM s WHERE s.part = f.part AND s.i > f.i AND s.upto - f.used > 3000) x WHERE x.i IS NOT NULL)
 SELECT s.part, s.user_key, CAST(max(f.b) AS BIGINT) AS bucket FROM s JOIN f ON s.part = f.part AND f.i <= s.i GROUP BY ALL""",
)(
    lambda s, d: picks.filled_buckets(sn.live(kv(s, d), NOW).withColumn("part", F.floor(F.col("extent_id") / 4)), "part", "user_key", 3000).select("part", "user_key", "bucket")
)

# Repair and failover.
_DISKS = "held AS (SELECT extent_id, avali, slot, node_id, node_id * 2 + extent_id % 2 AS disk_id FROM slots)"


def _held(s: SparkSession, d: str) -> DataFrame:
    all_ = F.concat("replicates", "parity")
    return extents(s, d).select("extent_id", "avali", all_.alias("holders"), F.transform(all_, lambda x: x * 2 + F.col("extent_id") % 2).alias("holder_disks"))


query(
    "repair_actions",
    f"""WITH {CATALOG}, {_DISKS}, j AS (SELECT h.*, n.alive, k."online" FROM held h LEFT JOIN nodes n USING (node_id) LEFT JOIN disks k USING (disk_id) WHERE avali > 0),
 a AS (SELECT extent_id, CAST(slot AS INTEGER) AS slot, node_id, CASE WHEN (avali & (1 << slot)) = 0 THEN 'available' WHEN NOT coalesce("online", false) OR NOT coalesce(alive, false) THEN 'recover' END AS action FROM j)
 SELECT * FROM a WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY extent_id ORDER BY slot) = 1""",
)(lambda s, d: cat.repairs(_held(s, d), nodes(s, d), disks(s, d)))
query(
    "sealed_by_replies",
    f"""WITH {CATALOG}, r AS (SELECT extent_id, slot, CASE WHEN (extent_id + slot) % 4 = 0 THEN -1 ELSE 100 + (extent_id * slot) % 3 END AS length FROM slots)
 SELECT extent_id, CAST(min(length) AS BIGINT) AS sealed_length, CAST(bit_or(1 << slot) AS BIGINT) AS avali FROM r WHERE length >= 0 GROUP BY extent_id HAVING count(*) >= 3""",
)(
    lambda s, d: cat.sealed_by(
        cat.replica_addresses(extents(s, d), nodes(s, d)).select("extent_id", "slot", F.when((F.col("extent_id") + F.col("slot")) % 4 == 0, -1).otherwise(100 + (F.col("extent_id") * F.col("slot")) % 3).cast("long").alias("length")), 3
    )
)
query("sealed_extent", f"WITH {CATALOG} SELECT extent_id, CAST(CASE WHEN extent_id = 7 THEN 123 ELSE sealed_length END AS BIGINT) AS sealed_length FROM extents")(
    lambda s, d: cat.sealed(extents(s, d), 7, 123).select("extent_id", "sealed_length")
)
_GONE = "live AS (SELECT ps_id, row_number() OVER (ORDER BY ps_id) - 1 AS k, count(*) OVER () AS n FROM servers WHERE ps_id <> 2)"
query(
    "failover_regions",
    f"""WITH {CATALOG}, {_GONE}, lost AS (SELECT *, row_number() OVER (ORDER BY part_id) - 1 AS i FROM regions WHERE ps_id NOT IN (SELECT ps_id FROM live))
 SELECT part_id, start_key, end_key, ps_id FROM regions WHERE ps_id IN (SELECT ps_id FROM live)
 UNION ALL SELECT part_id, start_key, end_key, live.ps_id FROM lost JOIN live ON i % n = k""",
)(lambda s, d: cat.failover(regions(s), servers(s).where("ps_id <> 2")))
query("adopted_regions", f"WITH {CATALOG} SELECT part_id, start_key, end_key, ps_id FROM regions UNION ALL SELECT part_id, 'x', '', 3 FROM parts WHERE part_id NOT IN (SELECT part_id FROM regions)")(
    lambda s, d: cat.adopted(regions(s), parts(s).select("part_id", F.lit("x").alias("start_key"), F.lit("").alias("end_key")), 3)
)

# Views of the cluster, and what registers in it.
query(
    "catalog_view",
    f"""WITH {CATALOG} SELECT 'region' AS kind, part_id AS id, concat_ws(' ', 'start_key=' || start_key, 'end_key=' || end_key, 'ps_id=' || ps_id) AS line FROM regions
 UNION ALL SELECT 'server', ps_id, '' FROM servers UNION ALL SELECT 'node', node_id, 'address=' || address || ' alive=' || alive || ' last_echo=' || last_echo || ' free=' || free FROM nodes
 UNION ALL SELECT 'disk', disk_id, 'node_id=' || node_id || ' online=' || "online" || ' total=' || total || ' free=' || free FROM disks""",
)(lambda s, d: cat.catalog_rows(region=(regions(s), "part_id"), server=(servers(s), "ps_id"), node=(nodes(s, d), "node_id"), disk=(disks(s, d), "disk_id")))
query(
    "cluster_info",
    f"WITH {CATALOG} SELECT stream_id, count(*) AS extents, CAST(sum(coalesce(sealed_length, 0)) AS BIGINT) AS bytes, (SELECT count(*) FROM nodes WHERE alive) AS nodes_alive FROM members LEFT JOIN extents USING (extent_id) GROUP BY stream_id",
)(lambda s, d: cat.cluster_info(streams(s, d), extents(s, d), nodes(s, d)))
query("allocated_extent", f"WITH {CATALOG}, m AS (SELECT * FROM members UNION ALL SELECT 3, 9999999) SELECT stream_id, count(*) AS n, max(extent_id) AS last FROM m GROUP BY stream_id")(
    lambda s, d: cat.allocated(streams(s, d), nodes(s, d), 3, 9_999_999, 3)[0].select("stream_id", F.size("extent_ids").cast("long").alias("n"), F.element_at("extent_ids", -1).alias("last"))
)
query("allocated_replicas", f"WITH {CATALOG}, p AS (SELECT node_id, row_number() OVER (ORDER BY last_echo DESC, free DESC, node_id) - 1 AS i FROM nodes WHERE alive) SELECT CAST(i AS INTEGER) AS i, node_id FROM p WHERE i < 3")(
    lambda s, d: cat.allocated(streams(s, d), nodes(s, d), 3, 9_999_999, 3)[1].select(F.posexplode("replicates").alias("i", "node_id"))
)
query(
    "registered_disks",
    f"WITH {CATALOG} SELECT (SELECT max(node_id) FROM nodes) + 1 AS node_id, (SELECT max(disk_id) FROM disks) + 1 + i AS disk_id, uuid FROM (VALUES (0, 'a1'), (1, 'b2'), (2, 'c3')) t(i, uuid)",
)(lambda s, d: cat.registered(nodes(s, d), disks(s, d), "10.0.0.9", ["c3", "a1", "b2"])[1])

# Codecs and objects.
_HEX = "lpad(hex({0}), {1}, '0')"
query(
    "entry_codec",
    f"""WITH {KV} SELECT seq, upper(lpad(hex(strlen(user_key) + 8), 8, '0') || hex(encode(user_key)) || lpad(hex(18446744073709551615::UBIGINT - seq::UBIGINT), 16, '0') || lpad(hex(expires_at), 16, '0')
 || lpad(hex(is_delete::INTEGER), 8, '0') || lpad(hex(strlen(value)), 8, '0') || hex(encode(value))) AS entry FROM kv""",
)(lambda s, d: kv(s, d).select("seq", F.hex(C.encoded_entry(F.col("user_key"), F.col("seq"), F.col("expires_at"), F.col("is_delete").cast("int"), F.col("value"))).alias("entry")))
query("entry_round_trip", f"WITH {KV} SELECT user_key, seq, expires_at, is_delete::BIGINT AS meta, value FROM kv")(
    lambda s, d: kv(s, d)
    .select(C.decoded_entry(C.encoded_entry(F.col("user_key"), F.col("seq"), F.col("expires_at"), F.col("is_delete").cast("int"), F.col("value"))).alias("e"))
    .select(F.col("e.user_key").cast("string").alias("user_key"), "e.seq", "e.expires_at", "e.meta", F.col("e.value").cast("string").alias("value"))
)
query(
    "shared_prefixes",
    f"WITH {KV}, b AS (SELECT *, min(user_key) OVER (PARTITION BY extent_id) AS base FROM kv) SELECT seq, CAST(list_max(list_filter(range(least(length(user_key), length(base)) + 1), lambda i: substr(user_key, 1, i) = substr(base, 1, i))) AS INTEGER) AS n FROM b",
)(
    lambda s, d: kv(s, d).join(kv(s, d).groupBy("extent_id").agg(F.min("user_key").alias("base")), "extent_id").select("seq", C.shared_prefix(F.col("user_key"), F.col("base")).alias("n"))
)
query("erasure_rebuild", "SELECT page_id, md5(encode(html)) AS digest FROM pages WHERE html IS NOT NULL")(lambda s, d: _rebuilt(s, d))


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    from .functions.integrity import rs_decode_udf, rs_encode_udf, rs_rebuild_udf

    p = s.read.parquet(f"{d}/pages.parquet").where("html is not null").select("page_id", rs_encode_udf(6, 3)(F.col("html").cast("binary")).alias("shards"))
    once = p.withColumn("shards", rs_rebuild_udf(6, 3)(F.transform("shards", lambda x, i: F.when(~i.isin(0, 4, 8), x))))
    twice = once.withColumn("shards", F.transform("shards", lambda x, i: F.when(~i.isin(1, 5, 7), x)))  # needs the made ones
    return twice.select("page_id", F.md5(rs_decode_udf(6, 3)("shards")).alias("digest"))


_CHUNKED = "o AS (SELECT page_id, CAST(page_id AS VARCHAR) || '-' || coalesce(url, '') AS name, octet_length(encode(coalesce(html, ''))) AS n FROM pages)"


def _objects(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("page_id").cast("string"), F.lit("-"), F.coalesce("url", F.lit("")))
    return s.read.parquet(f"{d}/pages.parquet").select(name.alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("data"))


query("object_deleted", f"WITH {_CHUNKED} SELECT name, greatest(n - 1, 0) // 4096 + 1 AS chunks FROM o WHERE name NOT LIKE '1%'")(
    lambda s, d: ob.deleted_objects(ob.chunked(_objects(s, d), 4096), _objects(s, d).where("name like '1%'")).groupBy("name").agg(F.count("*").alias("chunks"))
)
query(
    "index_after_update",
    f"WITH {KV} SELECT DISTINCT CASE WHEN seq % 3 = 0 THEN 'changed' ELSE substr(user_key, 1, 5) END AS index_value, user_key FROM top WHERE seq % 3 <> 1",
)(
    lambda s, d: ob.reindexed(
        ob.index(sn.latest(kv(s, d)), F.array(F.substring("user_key", 1, 5))), sn.latest(kv(s, d)).where("seq % 3 <> 2").select("user_key", F.when(F.col("seq") % 3 == 0, F.array(F.lit("changed"))).alias("values"))
    )
)


def _ops(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.round(F.col("value") * 1000).cast("long").alias("micros"), F.lit(1000).alias("bytes"))


query(
    "bench_summary",
    """WITH o AS (SELECT CAST(round(value * 1000) AS BIGINT) AS micros, 1000 AS bytes FROM events), a AS (SELECT count(*) AS n, sum(bytes) AS b, quantile_cont(micros, 0.5) AS p50, quantile_cont(micros, 0.95) AS p95, quantile_cont(micros, 0.99) AS p99 FROM o)
 SELECT 4 AS threads, 1000 AS size, 8.0::DOUBLE AS seconds, n AS requests, CAST(CAST(round(b / CASE WHEN b < 1e9 THEN 1e6 ELSE 1e9 END, 1) AS DECIMAL(20, 1)) AS VARCHAR) || CASE WHEN b < 1e9 THEN ' MB' ELSE ' GB' END AS transferred,
 round(n / 8.0::DOUBLE, 2) AS per_second, CAST(CAST(round(b / 8.0 / CASE WHEN b < 8e6 THEN 1e3 WHEN b < 8e9 THEN 1e6 ELSE 1e9 END, 2) AS DECIMAL(20, 2)) AS VARCHAR) || CASE WHEN b < 8e6 THEN 'KB' WHEN b < 8e9 THEN 'MB' ELSE 'GB' END || '/sec' AS throughput, p50, p95, p99 FROM a""",
)(lambda s, d: ob.summary(_ops(s, d), 4, 1000, 8.0))
