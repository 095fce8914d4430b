"""Named queries over the logs, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec as C
from .operators import catalog as cat
from .operators import maintenance as mt
from .operators import objects as ob
from .operators import snapshot as sn
from .plans import picks
from .sources import logs as lg

NOW = 8000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ENTRY = "28 + strlen(user_key) + strlen(value)"
KV = f"""kv AS (SELECT *, {_ENTRY} AS entry_size, NOT is_delete AND strlen(value) > 4096 AS is_vp, strlen(value) AS val_len FROM (
  SELECT event_id + 1 AS seq, 'u' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(4, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') || '/' || CAST(event_id % 8 AS VARCHAR) AS user_key, event_type = 'error' AS is_delete,
  CASE WHEN event_type = 'view' THEN event_id + 4001 ELSE 0 END AS expires_at, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || props END AS value, event_id // 1000 AS extent_id FROM events)),
 top AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1),
 live AS (SELECT * FROM top WHERE NOT is_delete AND NOT (expires_at > 0 AND expires_at <= {NOW})),
 off AS (SELECT *, sum(entry_size) OVER (PARTITION BY extent_id ORDER BY seq) - entry_size AS "offset" FROM kv)"""
BLOB = f"""kv AS (SELECT *, {_ENTRY} AS entry_size, NOT is_delete AND strlen(value) > 4096 AS is_vp, strlen(value) AS val_len FROM (
  SELECT doc_id + 1 AS seq, 'd' || lpad(CAST(doc_id % 397 AS VARCHAR), 4, '0') AS user_key, coalesce(n_chars < 40, false) AS is_delete, 0 AS expires_at,
  CASE WHEN n_chars < 40 THEN '' ELSE coalesce(text, '') END AS value, doc_id // 100 AS extent_id FROM documents)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM kv),
 top AS (SELECT * FROM ranked WHERE rn = 1)"""
# Catalogs derived from the small tables.
CATALOG = """regions AS (SELECT * FROM (VALUES (1::BIGINT, '', 'u0050', 1::BIGINT), (2, 'u0050', 'u0100', 2), (3, 'u0100', '', 9)) t(part_id, start_key, end_key, ps_id)),
 servers AS (SELECT * FROM (VALUES (1::BIGINT), (2), (3)) t(ps_id)),
 parts AS (SELECT * FROM (VALUES (1::BIGINT), (2), (3), (4)) t(part_id)),
 nodes AS (SELECT s_suppkey AS node_id, s_name AS address, s_suppkey % 7 <> 0 AS alive, s_nationkey AS last_echo, CAST(round(s_acctbal * 100) AS BIGINT) AS free FROM supplier),
 disks AS (SELECT s_suppkey AS node_id, s_suppkey * 2 + k AS disk_id, (s_suppkey + k) % 5 <> 0 AS "online", 1000 + s_suppkey AS total, 500 + k AS free FROM supplier, (VALUES (0), (1)) t(k)),
 extents AS (SELECT p_partkey AS extent_id, p_partkey % (SELECT count(*) FROM supplier) + 1 AS n1, (p_partkey * 7 + 3) % (SELECT count(*) FROM supplier) + 1 AS n2, (p_partkey * 3 + 1) % (SELECT count(*) FROM supplier) + 1 AS n3, p_size % 8 AS avali, CASE WHEN p_size % 2 = 0 THEN p_size * 1000 ELSE 0 END AS sealed_length FROM part),
 slots AS (SELECT extent_id, avali, sealed_length, n1, n2, n3, slot, CASE slot WHEN 0 THEN n1 WHEN 1 THEN n2 ELSE n3 END AS node_id FROM extents, (VALUES (0), (1), (2)) t(slot)),
 members AS (SELECT DISTINCT l_orderkey % 500 AS stream_id, l_partkey AS extent_id FROM lineitem)"""


def query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


kv, blob = lg.kv_log, lg.kv_blob_log


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "", "u0050", 1), (2, "u0050", "u0100", 2), (3, "u0100", "", 9)], "part_id long, start_key string, end_key string, ps_id long")


def servers(spark: SparkSession) -> DataFrame:
    return spark.range(1, 4).toDF("ps_id")


def parts(spark: SparkSession) -> DataFrame:
    return spark.range(1, 5).toDF("part_id")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("address"), (F.col("s_suppkey") % 7 != 0).alias("alive"), F.col("s_nationkey").alias("last_echo"), F.round(F.col("s_acctbal") * 100).cast("long").alias("free"))


def disks(spark: SparkSession, d: str) -> DataFrame:
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", k.alias("k")).select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") * 2 + F.col("k")).alias("disk_id"), ((F.col("s_suppkey") + F.col("k")) % 5 != 0).alias("online"), (1000 + F.col("s_suppkey")).alias("total"), (500 + F.col("k")).cast("long").alias("free"))


def extents(spark: SparkSession, d: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").agg(F.count("*").alias("suppliers"))  # one row
    p, n = F.col("p_partkey"), F.col("suppliers")
    return spark.read.parquet(f"{d}/part.parquet").crossJoin(F.broadcast(suppliers)).select(p.alias("extent_id"), F.array(p % n + 1, (p * 7 + 3) % n + 1).alias("replicates"), F.array((p * 3 + 1) % n + 1).alias("parity"), (F.col("p_size") % 8).cast("long").alias("avali"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 1000).otherwise(0).cast("long").alias("sealed_length"))


def streams(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 500).alias("stream_id"), F.col("l_partkey").alias("extent_id")).distinct()
    return m.groupBy("stream_id").agg(F.array_sort(F.collect_list("extent_id")).alias("extent_ids"))


# Point reads, scans and paging.
query("kv_get", f"WITH {KV} SELECT user_key, seq, value FROM top WHERE user_key = 'u0007/3' AND NOT is_delete")(lambda s, d: sn.get(kv(s, d), "u0007/3").select("user_key", "seq", "value"))
query("kv_get_honor_ttl", f"WITH {KV} SELECT user_key, seq FROM live WHERE user_key >= 'u0007/' AND user_key < 'u00070'")(lambda s, d: sn.scan(kv(s, d), "u0007/", now=NOW).select("user_key", "seq"))
query("kv_head", f"WITH {KV} SELECT user_key, CAST(val_len AS BIGINT) AS val_len FROM top WHERE NOT is_delete")(lambda s, d: sn.head(kv(s, d)))
query("kv_range", f"WITH {KV} SELECT user_key FROM live WHERE starts_with(user_key, 'u001') ORDER BY user_key LIMIT 50")(lambda s, d: sn.range_keys(kv(s, d), "u001", "", 50, NOW))
query("kv_range_truncated", f"WITH {KV} SELECT count(*) AS n, count(*) = 50 AS truncated FROM (SELECT user_key FROM live WHERE starts_with(user_key, 'u001') ORDER BY user_key LIMIT 50)")(lambda s, d: sn.truncated(sn.range_keys(kv(s, d), "u001", "", 50, NOW), 50))
query("kv_range_all_regions", f"WITH {KV} SELECT user_key FROM live WHERE starts_with(user_key, 'u0')")(lambda s, d: sn.scan(kv(s, d), "u0", now=NOW).select("user_key"))
query("kv_range_from_start", f"WITH {KV} SELECT user_key FROM live WHERE starts_with(user_key, 'u00') AND user_key >= 'u0033' ORDER BY user_key LIMIT 40")(lambda s, d: sn.range_keys(kv(s, d), "u00", "u0033", 40, NOW))
query("kv_page", f"WITH {KV}, p AS (SELECT max(user_key) AS k FROM (SELECT user_key FROM live WHERE starts_with(user_key, 'u00') ORDER BY user_key LIMIT 25)) SELECT user_key FROM live, p WHERE starts_with(user_key, 'u00') AND user_key >= k ORDER BY user_key LIMIT 25")(lambda s, d: sn.next_page(kv(s, d), "u00", sn.range_keys(kv(s, d), "u00", "", 25, NOW).agg(F.max("user_key")).first()[0] or "u00", 25, NOW))
query("kv_seek_ge", f"WITH {KV} SELECT user_key FROM kv WHERE user_key >= 'u0040/9' ORDER BY user_key LIMIT 1")(lambda s, d: sn.seek(kv(s, d), "u0040/9"))
query("kv_seek_le", f"WITH {KV} SELECT user_key FROM kv WHERE user_key <= 'u0040/9' ORDER BY user_key DESC LIMIT 1")(lambda s, d: sn.seek(kv(s, d), "u0040/9", False))
query("kv_first_last", f"WITH {KV} SELECT min(user_key) AS first_key, max(user_key) AS last_key FROM kv")(lambda s, d: kv(s, d).agg(F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key")))
query("kv_reverse_scan", f"WITH {KV} SELECT user_key FROM live ORDER BY user_key DESC LIMIT 30")(lambda s, d: sn.live(kv(s, d), NOW).select("user_key").orderBy(F.desc("user_key")).limit(30))
query("kv_delete_found", f"WITH {KV}, r AS (SELECT DISTINCT 'u' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || '/' || CAST(c_custkey % 8 AS VARCHAR) AS user_key FROM customer), h AS (SELECT r.user_key FROM r JOIN top USING (user_key) WHERE NOT is_delete) SELECT user_key, (SELECT max(seq) FROM kv) + row_number() OVER (ORDER BY user_key) AS seq FROM h")(lambda s, d: sn.deletes(kv(s, d), _requests(s, d), kv(s, d).agg(F.max("seq")).first()[0])[0].select("user_key", "seq"))
query("kv_delete_missing", f"WITH {KV}, r AS (SELECT DISTINCT 'u' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || '/' || CAST(c_custkey % 8 AS VARCHAR) AS user_key FROM customer) SELECT user_key FROM r WHERE user_key NOT IN (SELECT user_key FROM top WHERE NOT is_delete)")(lambda s, d: sn.deletes(kv(s, d), _requests(s, d), 0)[1])


def _requests(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    wide = F.lpad(c.cast("string"), F.greatest(F.lit(4), F.length(c.cast("string"))), F.lit("0"))
    return s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("u"), wide, F.lit("/"), (c % 8).cast("string")).alias("user_key"))


# Versions.
query("kv_get_at_version", f"WITH {KV} SELECT user_key, seq FROM (SELECT * FROM kv WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1) WHERE NOT is_delete")(lambda s, d: sn.as_of(kv(s, d), 5000).where("not is_delete").select("user_key", "seq"))
query("kv_exact_version", f"WITH {KV} SELECT user_key, seq, value FROM kv WHERE seq = 4321")(lambda s, d: sn.exact_version(kv(s, d), 4321).select("user_key", "seq", "value"))
query("kv_as_of_join", f"WITH {KV}, p AS (SELECT DISTINCT user_key, v AS version FROM kv, (VALUES (2500), (7000)) t(v)) SELECT user_key, version, seq FROM (SELECT p.user_key, version, seq, is_delete FROM p JOIN kv ON p.user_key = kv.user_key AND seq <= version QUALIFY row_number() OVER (PARTITION BY p.user_key, version ORDER BY seq DESC) = 1) WHERE NOT is_delete")(lambda s, d: sn.as_of_join(kv(s, d).select("user_key").distinct().withColumn("version", F.explode(F.array(F.lit(2500), F.lit(7000)))), kv(s, d)).select("user_key", "version", "seq"))
query("kv_small_large", f"WITH {BLOB} SELECT is_vp, count(*) AS n, CAST(sum(val_len) AS BIGINT) AS bytes FROM kv GROUP BY is_vp")(lambda s, d: blob(s, d).groupBy("is_vp").agg(F.count("*").alias("n"), F.sum("val_len").alias("bytes")))
query("kv_deref", f"WITH {BLOB} SELECT t.user_key, t.seq, strlen(k.value) AS bytes FROM top t JOIN kv k ON t.extent_id = k.extent_id AND t.seq = k.seq WHERE t.is_vp AND NOT t.is_delete")(lambda s, d: _deref(s, d))


def _deref(s: SparkSession, d: str) -> DataFrame:
    log = lg.placed(blob(s, d))
    pointers = sn.latest(log.drop("value")).where("is_vp and not is_delete").select("user_key", "seq", "extent_id", "offset")
    return pointers.join(log.select("extent_id", "offset", "value"), ["extent_id", "offset"]).select("user_key", "seq", F.octet_length("value").cast("long").alias("bytes"))


# Merging.
_SRC = "a AS (SELECT user_id AS k, event_id AS p, 1 AS src FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, 2 FROM events WHERE event_type = 'click'), c AS (SELECT user_id, event_id, 3 FROM events)"
query("merge_priority", f"WITH {_SRC}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT k, p, src FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, p) = 1")(lambda s, d: _merged(s, d))


def _merged(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    runs = [e.where(c).select(F.col("user_id").alias("k"), F.col("event_id").alias("p"), F.lit(i).alias("src")) for i, c in enumerate(("event_type = 'view'", "event_type = 'click'", "true"), 1)]
    return sn.merge(runs, ["k"], "p")


query("concat_runs", "SELECT event_id AS p FROM events WHERE event_id < 2000 UNION ALL SELECT event_id FROM events WHERE event_id >= 2000")(lambda s, d: s.read.parquet(f"{d}/events.parquet").where("event_id < 2000").select(F.col("event_id").alias("p")).unionAll(s.read.parquet(f"{d}/events.parquet").where("event_id >= 2000").select("event_id")))

# Replay and block reads.
query("log_replay", f"WITH {KV} SELECT extent_id, seq, user_key FROM off WHERE (extent_id > 7 OR (extent_id = 7 AND \"offset\" >= 20000)) AND user_key >= 'u0050' AND user_key < 'u0100'")(lambda s, d: lg.replay(lg.placed(kv(s, d)), 7, 20000, "u0050", "u0100").select("extent_id", "seq", "user_key"))
query("log_offsets", f"WITH {KV} SELECT seq, extent_id, CAST(\"offset\" AS BIGINT) AS \"offset\", CAST(\"offset\" + entry_size AS BIGINT) AS end_offset FROM off")(lambda s, d: lg.placed(kv(s, d)).select("seq", "extent_id", "offset", "end_offset"))
query("log_bounded", f"WITH {KV} SELECT seq, extent_id FROM kv WHERE extent_id BETWEEN 2 AND 4")(lambda s, d: lg.bounded(kv(s, d), _stream(s, d), 3, 2).select("seq", "extent_id"))
query("log_read_blocks", f"WITH {KV} SELECT seq FROM (SELECT seq, sum(entry_size) OVER (ORDER BY seq) - entry_size AS b FROM (SELECT * FROM off WHERE extent_id = 3 AND \"offset\" >= 5000 ORDER BY seq LIMIT 100)) WHERE b < 3000")(lambda s, d: lg.read_blocks(lg.placed(kv(s, d)), 3, 5000, 100, 3000).select("seq"))
query("log_last_block", f"WITH {KV} SELECT seq, user_key FROM kv ORDER BY extent_id DESC, seq DESC LIMIT 1")(lambda s, d: lg.last_block(lg.placed(kv(s, d)), _stream(s, d)).select("seq", "user_key"))
query("log_valid_prefix", f"WITH {KV} SELECT extent_id, count(*) AS n FROM (SELECT *, max(CASE WHEN seq % 777 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY extent_id ORDER BY seq) AS bad FROM kv) WHERE bad = 0 GROUP BY extent_id")(lambda s, d: lg.unsealed_tail(lg.placed(kv(s, d)), F.col("seq") % 777 != 0).groupBy("extent_id").agg(F.count("*").alias("n")))
query("open_partition", f"WITH {KV}, snap AS (SELECT * FROM kv WHERE seq <= 6000 QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1), u AS (SELECT * FROM snap UNION ALL SELECT * FROM kv WHERE seq > 6000) SELECT user_key, seq FROM u QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1")(lambda s, d: sn.latest(sn.as_of(kv(s, d), 6000).unionByName(kv(s, d).where("seq > 6000"))).select("user_key", "seq"))
query("max_sequence", f"WITH {KV} SELECT extent_id, max(seq) AS last_seq FROM kv GROUP BY extent_id")(lambda s, d: kv(s, d).groupBy("extent_id").agg(F.max("seq").alias("last_seq")))


def _stream(s: SparkSession, d: str) -> DataFrame:
    """(pos, extent_id) of the log's one stream: extents are numbered in order."""
    return kv(s, d).select("extent_id").distinct().withColumn("pos", F.col("extent_id"))


# Compaction and garbage.
query("compact_minor", f"WITH {KV} SELECT user_key, seq, is_delete, value FROM top")(lambda s, d: mt.compact(kv(s, d), NOW, False).select("user_key", "seq", "is_delete", "value"))
query("compact_major", f"WITH {KV} SELECT user_key, seq, value FROM live")(lambda s, d: mt.compact(kv(s, d), NOW, True).select("user_key", "seq", "value"))
query("compact_after_split", f"WITH {KV} SELECT user_key, seq FROM live WHERE user_key >= 'u0050'")(lambda s, d: mt.compact(kv(s, d), NOW, True, "u0050").select("user_key", "seq"))
_DISC = f"""{BLOB}, fl AS (SELECT extent_id, sum(CASE WHEN NOT is_vp THEN entry_size ELSE 0 END) AS f FROM kv GROUP BY 1), cd AS (SELECT extent_id, sum(CASE WHEN is_vp AND rn > 1 THEN val_len ELSE 0 END) AS c FROM ranked GROUP BY 1),
 disc AS (SELECT extent_id, CAST(f + c AS BIGINT) AS discard FROM fl JOIN cd USING (extent_id)), sizes AS (SELECT extent_id, CAST(sum(entry_size) AS BIGINT) AS size FROM kv GROUP BY 1)"""


def _discards(s: SparkSession, d: str) -> DataFrame:
    return mt.merge_discards(mt.flush_discard(blob(s, d)), mt.compaction_discard(blob(s, d), NOW, False))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return blob(s, d).groupBy("extent_id").agg(F.sum("entry_size").alias("size"))


query("flush_discard", f"WITH {_DISC} SELECT extent_id, CAST(f AS BIGINT) AS discard FROM fl")(lambda s, d: mt.flush_discard(blob(s, d)))
query("discards", f"WITH {_DISC} SELECT * FROM disc")(_discards)
query("discards_major", f"WITH {BLOB} SELECT extent_id, CAST(sum(CASE WHEN is_vp AND (rn > 1 OR is_delete) THEN val_len ELSE 0 END) AS BIGINT) AS discard FROM ranked GROUP BY 1")(lambda s, d: mt.compaction_discard(blob(s, d), NOW, True))
query("valid_discards", f"WITH {_DISC} SELECT * FROM disc WHERE extent_id IN (SELECT n_nationkey FROM nation)")(lambda s, d: _discards(s, d).join(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("extent_id")), "extent_id", "left_semi"))
_GC = f"WITH {_DISC}, t AS (SELECT * FROM disc JOIN sizes USING (extent_id) WHERE extent_id <> (SELECT max(extent_id) FROM sizes) AND size > 0 ORDER BY discard DESC, extent_id LIMIT {{n}}) SELECT * FROM t WHERE discard * 10 > size * {{tenths}}"
query("gc_candidates", _GC.format(n=3, tenths=4))(lambda s, d: mt.gc_candidates(_discards(s, d), _sizes(s, d)))
query("gc_candidates_strict", _GC.format(n=8, tenths=6))(lambda s, d: mt.gc_candidates(_discards(s, d), _sizes(s, d), 8, 6))
query("gc_forced", f"WITH {BLOB} SELECT CAST(pos AS BIGINT) AS pos, CAST(extent_id AS BIGINT) AS extent_id FROM (VALUES (0, 7), (1, 99999999), (2, 3), (3, 8), (4, 2)) t(pos, extent_id) WHERE extent_id IN (SELECT extent_id FROM kv) ORDER BY pos LIMIT 3")(lambda s, d: mt.forced_candidates(s.createDataFrame([(0, 7), (1, 99999999), (2, 3), (3, 8), (4, 2)], "pos long, extent_id long"), _sizes(s, d)))
query("gc_move", f"WITH {BLOB} SELECT user_key, seq, (SELECT max(seq) FROM kv) + row_number() OVER (ORDER BY seq) AS new_seq FROM top WHERE is_vp AND NOT is_delete AND extent_id IN (7, 8)")(lambda s, d: mt.gc_moves(blob(s, d), F.col("extent_id").isin(7, 8), NOW).select("user_key", "seq", "new_seq"))
query("gc_result", f"WITH {BLOB} SELECT user_key, value FROM top WHERE NOT is_delete")(lambda s, d: _gc_result(s, d))


def _gc_result(s: SparkSession, d: str) -> DataFrame:
    log, ext = blob(s, d), F.col("extent_id").isin(7, 8)
    return sn.latest(mt.collected(log, mt.gc_moves(log, ext, NOW), ext, 1_000_000)).where("not is_delete").select("user_key", "value")


query("extent_sizes", f"WITH {KV} SELECT extent_id, CAST(sum(entry_size) AS BIGINT) AS size, CAST(sum(sum(entry_size)) OVER () AS BIGINT) AS total FROM kv GROUP BY extent_id")(lambda s, d: kv(s, d).groupBy("extent_id").agg(F.sum("entry_size").alias("size")).crossJoin(F.broadcast(kv(s, d).agg(F.sum("entry_size").alias("total")))))
query("flush_buckets", f"WITH {KV} SELECT extent_id, CAST(\"offset\" // 16384 AS BIGINT) AS memtable, count(*) AS n FROM off GROUP BY ALL")(lambda s, d: picks.flush_bucket(kv(s, d), 16384).groupBy("extent_id", "memtable").agg(F.count("*").alias("n")))
query("output_buckets", f"WITH {KV} SELECT extent_id, CAST((sum(entry_size) OVER (PARTITION BY extent_id ORDER BY user_key) - entry_size) // 2000 AS BIGINT) AS bucket, user_key FROM live")(lambda s, d: mt.output_bucket(sn.live(kv(s, d), NOW), 2000).select("extent_id", "bucket", "user_key"))
_TABLES = f"{KV}, tables AS (SELECT extent_id // 4 AS part_id, extent_id, max(seq) AS last_seq, CAST(sum(entry_size) AS BIGINT) AS estimated_size, min(user_key) AS smallest, max(user_key) AS biggest FROM kv GROUP BY ALL)"


def _tables(s: SparkSession, d: str) -> DataFrame:
    return kv(s, d).groupBy(F.floor(F.col("extent_id") / 4).alias("part_id"), "extent_id").agg(F.max("seq").alias("last_seq"), F.sum("entry_size").alias("estimated_size"), F.min("user_key").alias("smallest"), F.max("user_key").alias("biggest"))


query("table_key_filter", f"WITH {_TABLES} SELECT extent_id, last_seq FROM tables WHERE smallest <= 'u0001/1' AND biggest >= 'u0001/1' ORDER BY last_seq DESC")(lambda s, d: _tables(s, d).where("smallest <= 'u0001/1' and biggest >= 'u0001/1'").select("extent_id", "last_seq").orderBy(F.desc("last_seq")))
query("biggest_table", f"WITH {_TABLES} SELECT part_id, extent_id, estimated_size FROM tables QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY estimated_size DESC, extent_id) = 1")(lambda s, d: cat.biggest_table(_tables(s, d)).select("part_id", "extent_id", "estimated_size"))
query("manifest_after_compaction", f"WITH {_TABLES} SELECT extent_id, last_seq FROM tables WHERE extent_id NOT IN (1, 2) UNION ALL SELECT 1000, max(last_seq) FROM tables WHERE extent_id IN (1, 2)")(lambda s, d: cat.manifest(_tables(s, d).select("extent_id", "last_seq"), F.col("extent_id").isin(1, 2), _tables(s, d).where("extent_id in (1, 2)").agg(F.max("last_seq").alias("last_seq")).select(F.lit(1000).cast("long").alias("extent_id"), "last_seq")))
_SWAPPED = "CASE extent_id % 3 WHEN 0 THEN extent_id + 1 WHEN 1 THEN extent_id - 1 ELSE extent_id END"
query(
    "order_violations",
    f"WITH {KV}, r AS (SELECT {_SWAPPED} AS last_seq, user_key, seq FROM kv), "
    "o AS (SELECT *, max(seq) OVER (PARTITION BY user_key ORDER BY last_seq, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) SELECT seq, user_key FROM o WHERE seq < b",
)(lambda s, d: sn.order_violations(kv(s, d).select(F.expr(_SWAPPED).alias("last_seq"), "user_key", "seq")).select("seq", "user_key"))
query("order_kept", f"WITH {_TABLES} SELECT seq, user_key FROM kv WHERE false")(
    lambda s, d: sn.order_violations(kv(s, d).join(_tables(s, d).select("extent_id", "last_seq"), "extent_id").select("last_seq", "user_key", "seq")).select("seq", "user_key")
)

# Partitions.
query("hex_presplit", "SELECT i AS part_id, CASE WHEN i = 0 THEN '' ELSE lower(lpad(hex(i * (4294967295 // 7)), 8, '0')) END AS start_key, CASE WHEN i = 6 THEN '' ELSE lower(lpad(hex((i + 1) * (4294967295 // 7)), 8, '0')) END AS end_key FROM range(7) t(i)")(lambda s, d: cat.hex_splits(s, 7))
query("presplit_route", f"WITH {KV}, h AS (SELECT DISTINCT substr(md5(user_key), 1, 8) AS h FROM kv) SELECT CAST(least(3, CAST('0x' || h AS BIGINT) // 1073741823) AS BIGINT) AS part_id, count(*) AS n FROM h GROUP BY 1")(lambda s, d: cat.route(kv(s, d).select(F.substring(F.md5("user_key"), 1, 8).alias("h")).distinct(), cat.hex_splits(s, 4), "h").groupBy("part_id").agg(F.count("*").alias("n")))
query("region_lookup", f"WITH {KV}, {CATALOG} SELECT part_id, count(*) AS n, min(user_key) AS lo, max(user_key) AS hi FROM kv JOIN regions ON user_key >= start_key AND (end_key = '' OR user_key < end_key) GROUP BY part_id")(lambda s, d: cat.route(kv(s, d), regions(s)).groupBy("part_id").agg(F.count("*").alias("n"), F.min("user_key").alias("lo"), F.max("user_key").alias("hi")))
_HOLED = (
    "SELECT n_nationkey AS part_id, CASE WHEN n_nationkey = 0 THEN '' ELSE lpad(CAST(n_nationkey * 10 AS VARCHAR), 4, '0') END AS start_key, "
    "CASE WHEN n_nationkey = 24 THEN '' ELSE lpad(CAST(n_nationkey * 10 + 10 + CASE WHEN n_regionkey = 2 THEN 3 ELSE 0 END AS VARCHAR), 4, '0') END AS end_key FROM nation"
)


def _holed(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    start = F.when(n == 0, "").otherwise(F.lpad((n * 10).cast("string"), 4, "0"))
    end = F.when(n == 24, "").otherwise(F.lpad((n * 10 + 10 + F.when(F.col("n_regionkey") == 2, 3).otherwise(0)).cast("string"), 4, "0"))
    return s.read.parquet(f"{d}/nation.parquet").select(n.alias("part_id"), start.alias("start_key"), end.alias("end_key"))


query(
    "region_gaps",
    f"WITH r AS ({_HOLED}), l AS (SELECT *, coalesce(lead(start_key) OVER (ORDER BY start_key), '') AS next_start FROM r) SELECT part_id, end_key, next_start FROM l WHERE end_key <> next_start",
)(lambda s, d: cat.gaps(_holed(s, d)).select("part_id", "end_key", "next_start"))
query("overlap_detection", f"WITH {_TABLES} SELECT part_id, max(CASE WHEN smallest >= 'u0003' AND biggest >= 'u0003' THEN 0 ELSE 1 END) = 1 AS overlap FROM tables GROUP BY part_id")(lambda s, d: cat.overlapping(_tables(s, d), _tables(s, d).select("part_id", F.lit("u0003").alias("start_key"), F.lit("").alias("end_key")).distinct()))
query("split_point", f"WITH {BLOB}, b AS (SELECT extent_id FROM kv GROUP BY extent_id ORDER BY sum(entry_size) DESC, extent_id LIMIT 1), k AS (SELECT DISTINCT user_key FROM kv JOIN b USING (extent_id)), n AS (SELECT user_key, ntile(8) OVER (ORDER BY user_key) AS t FROM k) SELECT min(user_key) AS mid_key FROM n WHERE t = 5")(lambda s, d: cat.split_point(blob(s, d).join(_sizes(s, d).orderBy(F.desc("size"), "extent_id").limit(1), "extent_id", "left_semi"), 8))
query("split_regions", f"WITH {CATALOG} SELECT part_id, start_key, CASE WHEN part_id = 2 THEN 'u0077' ELSE end_key END AS end_key FROM regions UNION ALL SELECT 4, 'u0077', end_key FROM regions WHERE part_id = 2")(lambda s, d: cat.split_regions(regions(s).drop("ps_id"), 2, "u0077", 4))
query("prefix_presplit", "WITH s AS (SELECT DISTINCT r_name || x AS start_key FROM region, (VALUES ('3'), ('7')) t(x)) SELECT CASE WHEN row_number() OVER (ORDER BY start_key) = 1 THEN '' ELSE start_key END AS start_key, coalesce(lead(start_key) OVER (ORDER BY start_key), '') AS end_key FROM s")(lambda s, d: cat.prefix_splits(s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("prefix")), s.createDataFrame([("3",), ("7",)], "suffix string")))
query("unassigned_parts", f"WITH {CATALOG} SELECT part_id FROM parts WHERE part_id NOT IN (SELECT part_id FROM regions JOIN servers USING (ps_id))")(lambda s, d: cat.unassigned(parts(s), regions(s), servers(s)))
query("assigned_parts", f"WITH {CATALOG} SELECT part_id, CAST((row_number() OVER (ORDER BY part_id) - 1) % 3 + 1 AS BIGINT) AS ps_id FROM parts WHERE part_id NOT IN (SELECT part_id FROM regions JOIN servers USING (ps_id))")(lambda s, d: cat.assign(cat.unassigned(parts(s), regions(s), servers(s)), servers(s)).select("part_id", "ps_id"))

# Streams, extents, nodes.
query("stream_extents", f"WITH {CATALOG} SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY extent_id) - 1 AS INTEGER) AS pos, extent_id, CAST(sealed_length AS BIGINT) AS sealed_length FROM members LEFT JOIN extents USING (extent_id)")(lambda s, d: cat.expand_streams(streams(s, d), extents(s, d)).select("stream_id", "pos", "extent_id", "sealed_length"))
query("refcounts", f"WITH {CATALOG} SELECT extent_id, count(DISTINCT stream_id) AS refs FROM members GROUP BY extent_id")(lambda s, d: cat.refcounts(streams(s, d)))
query("refcounts_after_duplicate", f"WITH {CATALOG}, m AS (SELECT * FROM members UNION ALL SELECT 1000000, extent_id FROM members WHERE stream_id = 1) SELECT extent_id, count(DISTINCT stream_id) AS refs FROM m GROUP BY extent_id")(lambda s, d: cat.refcounts(cat.duplicate_streams(streams(s, d), {1: 1_000_000})))
query("punch_holes", f"WITH {CATALOG}, m AS (SELECT *, max(extent_id) OVER (PARTITION BY stream_id) AS l FROM members) SELECT stream_id, count(*) AS n FROM m WHERE extent_id NOT IN (5, 6, 7, 8) OR extent_id = l GROUP BY stream_id")(lambda s, d: cat.punch(streams(s, d), [5, 6, 7, 8]).select("stream_id", F.size("extent_ids").cast("long").alias("n")))
query("truncate_stream", f"WITH {CATALOG} SELECT stream_id, count(*) AS n FROM members WHERE stream_id <> 3 OR extent_id >= (SELECT max(extent_id) FROM members WHERE stream_id = 3) GROUP BY stream_id")(lambda s, d: cat.truncate(streams(s, d), 3, streams(s, d).where("stream_id = 3").select(F.element_at("extent_ids", -1)).first()[0]).select("stream_id", F.size("extent_ids").cast("long").alias("n")))
query("replica_addresses", f"WITH {CATALOG} SELECT extent_id, slot, node_id, address, (avali & (1 << slot)) <> 0 OR sealed_length = 0 AS available FROM slots LEFT JOIN nodes USING (node_id)")(lambda s, d: cat.replica_addresses(extents(s, d), nodes(s, d)))
query("commit_lengths", f"WITH {CATALOG}, r AS (SELECT extent_id, node_id, CASE WHEN (extent_id + slot) % 9 = 0 THEN -1 ELSE 100 + (extent_id * slot) % 2 END AS length FROM slots) SELECT extent_id, CAST(min(length) FILTER (length >= 0) AS BIGINT) AS \"commit\", count(*) FILTER (length < 0) > 0 OR max(length) FILTER (length >= 0) IS DISTINCT FROM min(length) FILTER (length >= 0) AS needs_seal, count(*) FILTER (length >= 0) >= 2 AS can_seal FROM r GROUP BY extent_id")(lambda s, d: cat.commit_lengths(cat.replica_addresses(extents(s, d), nodes(s, d)).select("extent_id", "node_id", F.when((F.col("extent_id") + F.col("slot")) % 9 == 0, -1).otherwise(100 + (F.col("extent_id") * F.col("slot")) % 2).cast("long").alias("length")), 2))
query("placement", f"WITH {CATALOG} SELECT node_id FROM nodes WHERE alive ORDER BY last_echo DESC, free DESC, node_id LIMIT 5")(lambda s, d: cat.placement(nodes(s, d), 5))
query("disk_free", f"WITH {CATALOG} SELECT node_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(free) AS BIGINT) AS free, count(*) FILTER (\"online\") AS \"online\" FROM disks GROUP BY node_id")(lambda s, d: cat.disk_free(disks(s, d)))
query("recovery_dispatch", f"WITH {CATALOG}, ok AS (SELECT node_id FROM nodes WHERE alive AND node_id IN (SELECT node_id FROM disks WHERE \"online\")), b AS (SELECT * FROM slots WHERE sealed_length > 0 AND node_id NOT IN (SELECT node_id FROM ok)) SELECT extent_id, slot, b.node_id, min(ok.node_id) AS target FROM b LEFT JOIN ok ON ok.node_id NOT IN (n1, n2, n3) GROUP BY ALL")(lambda s, d: cat.recovery(extents(s, d), nodes(s, d), disks(s, d)))
query("tasks_by_node", f"WITH {CATALOG} SELECT node_id, count(DISTINCT extent_id) AS tasks FROM slots GROUP BY node_id")(lambda s, d: cat.tasks_by_node(cat.replica_addresses(extents(s, d), nodes(s, d))))
query("fenced_writes", "SELECT event_id AS arrival FROM (SELECT event_id, user_id % 10 AS e, CAST(floor(event_id / 100) AS BIGINT) - event_id % 3 AS r FROM events) QUALIFY r >= max(r) OVER (PARTITION BY e ORDER BY event_id)")(lambda s, d: cat.fenced(s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 10).alias("extent_id"), F.col("event_id").alias("arrival"), (F.floor(F.col("event_id") / 100) - F.col("event_id") % 3).alias("revision"))).select("arrival"))
query("allocated_ids", "SELECT s_suppkey, 100 + row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier")(lambda s, d: cat.allocate(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey"), 100, ["s_suppkey"]))

# Scalars.
query("internal_keys", f"WITH {KV} SELECT seq, hex(encode(user_key)) || lower(lpad(hex(18446744073709551615::UBIGINT - seq::UBIGINT), 16, '0')) AS k FROM kv")(lambda s, d: kv(s, d).select("seq", F.concat(F.hex("user_key"), F.lower(F.substring(F.hex(C.internal_key(F.col("user_key"), F.col("seq"))), -16, 16))).alias("k")))
query("varint_sizes", "SELECT event_id, CAST(CASE WHEN event_id * event_id * 1000 < 128 THEN 1 WHEN event_id * event_id * 1000 < 16384 THEN 2 WHEN event_id * event_id * 1000 < 2097152 THEN 3 WHEN event_id * event_id * 1000 < 268435456 THEN 4 WHEN event_id * event_id * 1000 < 34359738368 THEN 5 WHEN event_id * event_id * 1000 < 4398046511104 THEN 6 WHEN event_id * event_id * 1000 < 562949953421312 THEN 7 ELSE 8 END AS BIGINT) AS n FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", C.varint_size(F.col("event_id") * F.col("event_id") * 1000).alias("n")))
query("alignment", "SELECT event_id, (event_id + 511) // 512 * 512 AS up, event_id // 512 * 512 AS down FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", C.align_up(F.col("event_id"), 512).alias("up"), C.align_down(F.col("event_id"), 512).alias("down")))
query("replication_parse", "SELECT * FROM (VALUES ('3', 3, 0), ('2+1', 2, 1), (' 6 + 3 ', 6, 3)) t(x, data, parity)")(lambda s, d: s.createDataFrame([("3",), ("2+1",), (" 6 + 3 ",)], "x string").select("x", C.replication(F.col("x")).alias("r")).select("x", "r.*"))
query("shard_geometry", "SELECT doc_id, greatest(4, (coalesce(strlen(text), 0) + 9) // 6) AS per_shard FROM documents")(lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", C.shard_bytes(F.coalesce(F.octet_length("text"), F.lit(0)), 6).alias("per_shard")))
_UNITS = (("EB", 18), ("PB", 15), ("TB", 12), ("GB", 9), ("MB", 6), ("KB", 3), ("B", 0))


def _human_sql(n: str, places: int, glue: str) -> str:
    """The value in the largest unit that it reaches."""
    each = (f"WHEN {n} >= 1e{k} THEN CAST(CAST(round({n} / 1e{k}, {places}) AS DECIMAL(20, {places})) AS VARCHAR) || '{glue}{u}'" for u, k in _UNITS)
    return "CASE " + " ".join(each) + " END"


query(
    "human_sizes",
    f"SELECT p_partkey, coalesce({_human_sql('n', 1, ' ')}, '0B') AS h FROM (SELECT p_partkey, (p_partkey - 1) * p_partkey * p_partkey AS n FROM part)",
)(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", C.human_size((F.col("p_partkey") - 1) * F.col("p_partkey") * F.col("p_partkey")).alias("h")))
query(
    "human_throughputs",
    f"SELECT p_partkey, coalesce({_human_sql('n', 2, '')} || '/sec', '') AS h FROM (SELECT p_partkey, (p_partkey - 1) * 1000003 AS n FROM part)",
)(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", C.human_throughput((F.col("p_partkey") - 1) * 1000003).alias("h")))

# Objects, indexes, summaries.
CHUNK = 4096


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.col("page_id").cast("string"), F.lit("-"), F.coalesce("url", F.lit(""))).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("data"))


_OBJ = "o AS (SELECT CAST(page_id AS VARCHAR) || '-' || coalesce(url, '') AS name, encode(coalesce(html, '')) AS data FROM pages)"
query("object_chunks", f"WITH {_OBJ}, c AS (SELECT name, data, unnest(range(0, greatest(octet_length(data) - 1, 0) // {CHUNK} + 1)) AS i FROM o) SELECT 'a:' || name || ':' || CAST(i AS VARCHAR) AS user_key, CAST(least({CHUNK}, octet_length(data) - i * {CHUNK}) AS BIGINT) AS n FROM c")(lambda s, d: ob.chunked(_pages(s, d), CHUNK).select("user_key", F.octet_length("value").cast("long").alias("n")))
query("object_meta", f"WITH {_OBJ} SELECT 'b:' || name AS user_key, lpad(hex(octet_length(data)), 8, '0') AS size_hex FROM o")(lambda s, d: ob.object_meta(_pages(s, d)).select("user_key", F.hex("value").alias("size_hex")))
query("object_assembled", f"WITH {_OBJ} SELECT name, md5(data) AS digest FROM o")(lambda s, d: ob.assembled(ob.chunked(_pages(s, d), CHUNK)).select("name", F.md5("data").alias("digest")))
query("object_range", f"WITH {_OBJ} SELECT name, md5(data[1001:9000]) AS digest FROM o WHERE octet_length(data) > 0")(lambda s, d: ob.ranged(ob.chunked(_pages(s, d), CHUNK), 1000, 8000, CHUNK).where(F.octet_length("data") >= 0).select("name", F.md5("data").alias("digest")))
query("object_list", f"WITH {_OBJ} SELECT name FROM o WHERE starts_with(name, '1')")(lambda s, d: ob.object_meta(_pages(s, d)).where(C.has_prefix(F.col("user_key"), "b:1")).select(F.substring("user_key", 3, 1 << 30).alias("name")))
query("stream_put", f"WITH {_OBJ} SELECT name AS put_id, name NOT LIKE '%7-%' AS ok FROM o")(lambda s, d: ob.put_streams(ob.chunked(_pages(s, d), CHUNK).withColumnRenamed("name", "put_id"), _pages(s, d).select(F.col("name").alias("put_id"), (F.octet_length("data") + F.col("name").like("%7-%").cast("int")).alias("length"))).select("put_id", "ok"))
query("secondary_index", f"WITH {KV} SELECT substr(user_key, 1, 5) AS index_value, count(DISTINCT user_key) AS n FROM top GROUP BY 1")(lambda s, d: ob.index(sn.latest(kv(s, d)), F.array(F.substring("user_key", 1, 5))).groupBy("index_value").agg(F.count("*").alias("n")))
query("index_lookup", f"WITH {KV} SELECT user_key FROM live WHERE substr(user_key, 1, 5) = 'u0012'")(lambda s, d: ob.index_keys(ob.index(sn.live(kv(s, d), NOW), F.array(F.substring("user_key", 1, 5))), "u0012"))
query("index_values", f"WITH {KV} SELECT DISTINCT split_part(value, ':', 1) AS index_value FROM live")(lambda s, d: ob.index(sn.live(kv(s, d), NOW), F.array(F.split_part("value", F.lit(":"), F.lit(1)))).select("index_value").distinct())
query("key_sets", f"WITH {KV} SELECT user_key FROM (SELECT user_key FROM kv WHERE seq <= 3000 INTERSECT SELECT user_key FROM kv WHERE seq > 3000) EXCEPT SELECT user_key FROM kv WHERE is_delete")(lambda s, d: kv(s, d).where("seq <= 3000").select("user_key").intersect(kv(s, d).where("seq > 3000").select("user_key")).subtract(kv(s, d).where("is_delete").select("user_key")))
query("latency_summary", f"WITH {KV}, o AS (SELECT CAST(round(value * 1000) AS BIGINT) AS micros, 100 AS bytes FROM events) SELECT count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, quantile_cont(micros, 0.5) AS p50, quantile_cont(micros, 0.95) AS p95, quantile_cont(micros, 0.99) AS p99 FROM o")(lambda s, d: ob.latency(_ops(s, d)))
query("latency_cdf", "SELECT ms, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY ms) AS BIGINT) AS upto FROM (SELECT CAST(floor(round(value * 1000) / 1000) AS BIGINT) AS ms FROM events) GROUP BY ms")(lambda s, d: ob.cdf(_ops(s, d).select(F.floor(F.col("micros") / 1000).alias("ms")), "ms"))
query("bench_keys", "SELECT 'test' || CAST(i AS VARCHAR) || '_' || CAST(i // 250 AS VARCHAR) || '_' || CAST(i % 250 AS VARCHAR) AS user_key, i // 250 AS thread FROM range(1000) t(i)")(lambda s, d: ob.bench_keys(s, 4, 250))


def _ops(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.round(F.col("value") * 1000).cast("long").alias("micros"), F.lit(100).alias("bytes"))


# Integrity.
_BYTE = "('0x' || substr(hex(encode(value)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT"


@query(
    "value_checksums",
    f"""WITH RECURSIVE {KV}, bits(b, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT b, k + 1, xor(c >> 1, 2197175160 * (c & 1)) FROM bits WHERE k < 8),
 crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
 sums AS (SELECT seq, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(value)), lambda i: {_BYTE})), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS s FROM kv, crc_table)
 SELECT seq, CAST(((s >> 15) + ((s & 32767) << 17) + 2726488792) & 4294967295 AS BIGINT) AS crc FROM sums""",
)
def _checksums(s: SparkSession, d: str) -> DataFrame:
    from .functions.integrity import masked_crc32c

    return kv(s, d).select("seq", masked_crc32c(F.col("value").cast("binary")).alias("crc"))


@query(
    "record_ends",
    f"""WITH {BLOB}, p AS (SELECT seq, entry_size AS n, sum(entry_size) OVER (PARTITION BY extent_id ORDER BY seq) - entry_size AS o FROM kv),
 a AS (SELECT seq, n, CASE WHEN 131072 - o % 131072 < 9 THEN o + 131072 - o % 131072 ELSE o END AS o FROM p), r AS (SELECT *, 131072 - o % 131072 - 9 AS room FROM a)
 SELECT seq, CAST(CASE WHEN n <= room THEN o + 9 + n ELSE o + 9 + room + (n - room - 1) // 131063 * 131072 + 9 + (n - room - 1) % 131063 + 1 END AS BIGINT) AS record_end FROM r""",
)
def _record_ends(s: SparkSession, d: str) -> DataFrame:
    from .functions.integrity import record_ends

    return lg.placed(blob(s, d)).select("seq", record_ends(F.col("offset"), F.col("entry_size")).alias("record_end"))


query("erasure_round_trip", "SELECT page_id, md5(encode(html)) AS digest FROM pages WHERE html IS NOT NULL")(lambda s, d: _erasure(s, d))


def _erasure(s: SparkSession, d: str) -> DataFrame:
    from .functions.integrity import rs_decode_udf, rs_encode_udf

    p = s.read.parquet(f"{d}/pages.parquet").where("html is not null").select("page_id", rs_encode_udf(6, 3)(F.col("html").cast("binary")).alias("shards"))
    lossy = p.withColumn("shards", F.transform("shards", lambda x, i: F.when(~i.isin(1, 5, 7), x)))
    return lossy.select("page_id", F.md5(rs_decode_udf(6, 3)("shards")).alias("digest"))
