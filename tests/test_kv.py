"""Oracles on every query with SQL, and the literal cases and invariants of the log engine."""

import os

import pytest
from pyspark.sql import functions as F

from tests.oracle import differences
from tidelog import kv_jobs  # noqa: F401
from tidelog import kv_queries as q
from tidelog.functions import codec, integrity
from tidelog.operators import catalog, objects, snapshot
from tidelog.plans import picks
from tidelog.sources import logs
from tidelog.streaming import latest as st

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, name):
    assert differences(spark, SF, q.QUERIES[name], q.ORACLES[name]) == ""


def _log(spark, rows):
    return spark.createDataFrame([(s, k, d, False, e, v, len(v), 28 + len(k) + len(v), 0, 0, 0) for s, k, d, e, v in rows], logs.LOG_SCHEMA)


def test_range_case(spark):
    rows = [(r * 100 + i + 1, f"key{i}", False, 0, "v") for r in range(2) for i in range(100)] + [(300, "key99", True, 0, "")]
    assert [r[0] for r in snapshot.range_keys(_log(spark, rows), "key9", "key9", 100, 0).collect()] == ["key9"] + [f"key9{i}" for i in range(9)]


def test_empty_log(spark):
    assert snapshot.live(_log(spark, []), 5).count() == 0 and snapshot.get(_log(spark, []), "k").count() == 0


def test_prefix_end():
    assert codec.prefix_end(b"a\xff\xff") == b"b" and codec.prefix_end(b"\xff") is None and codec.prefix_end("u001") == "u002"


def test_internal_key_round_trip(spark):
    r = spark.createDataFrame([("k", 5), ("", 1 << 40)], "k string, s long").select("k", "s", codec.split_internal_key(codec.internal_key(F.col("k"), F.col("s"))).alias("x")).collect()
    assert all(bytes(x.x.user_key).decode() == x.k and x.x.seq == x.s for x in r)


def test_checksum_and_code():
    assert integrity.crc32c([b"123456789"])[0] == 0xE3069283
    assert integrity.crc32c([b"x" * k for k in range(20)]).tolist() == [integrity.crc32c([b"x" * k])[0] for k in range(20)]
    for n in (0, 1, 8, 16, 4096, 6144, 8192):
        value = os.urandom(n)
        shards = integrity.rs_encode(value, 6, 3)
        assert integrity.rs_decode([None if i in (1, 5, 7) else s for i, s in enumerate(shards)], 6, 3) == value


def test_record_end():
    assert integrity.record_end(0, 8) == 17
    assert integrity.record_end((128 << 10) - 5, 1) == (128 << 10) + 10


def test_picks():
    assert picks.small_run_pick([(1, 100), (2, 10), (3, 10), (4, 90)], 64) == [(1, 100), (2, 10), (3, 10)]
    assert picks.small_run_pick([(1, 100), (2, 100)], 64) == []
    assert picks.block_starts([10] * 2500, 1 << 20, 1000) == [0, 1001, 2002]


def test_alnum_splits():
    s = catalog.alnum_splits(5)
    assert s[0][0] == s[-1][1] == "" and all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_object_range(spark):
    data = bytes(range(256)) * 40
    chunks = objects.chunked(spark.createDataFrame([("o", bytearray(data))], "name string, data binary"), 1000)
    assert bytes(objects.ranged(chunks, 1500, 2600, 1000).first().data) == data[1500:4100]
    assert bytes(objects.assembled(chunks).first().data) == data


def test_stream_matches_batch(spark, tmp_path):
    log = logs.placed(q.kv(spark, SF)).select([c.split()[0] for c in logs.LOG_SCHEMA.split(", ")])
    for k in range(3):
        logs.append(log.where(F.col("seq") % 3 == k), str(tmp_path / "log"))
        st.maintain(st.log_stream(spark, str(tmp_path / "log")), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    got = st.newest_generation(spark, str(tmp_path / "table")).select("user_key", "seq")
    want = snapshot.latest(log).select("user_key", "seq")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_changes_carry_previous(spark, tmp_path):
    _log(spark, [(1, "a", False, 0, "x"), (2, "a", False, 0, "y"), (3, "a", True, 0, "")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = st.changes(st.log_stream(spark, str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("changes_t").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.seq, r.kind, r.previous) for r in spark.table("changes_t").collect()) == [(1, "PUT", None), (2, "PUT", "x"), (3, "DELETE", "y")]


def test_streams_hold_all_orders(spark, tmp_path):
    rows = [(k, k % 7) for k in (1, 501, 4000, 4001, 4501, 60_000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for k, part in rows:
        want.setdefault(k % 500, set()).add(part)
    assert {r.stream_id: r.extent_ids for r in q.streams(spark, str(tmp_path)).collect()} == {s: sorted(x) for s, x in want.items()}


def test_recovery_takes_the_first_healthy_node(spark):
    extents = spark.createDataFrame([(1, [2, 3], [1], 10), (2, [500, 501], [2], 10), (3, [500, 2], [1], 0)], "extent_id long, replicates array<long>, parity array<long>, sealed_length long")
    nodes = spark.range(150_000, 0, -1).select(F.col("id").alias("node_id"), (F.col("id") != 3).alias("alive"))
    nodes = nodes.where("node_id not in (500, 501)")
    disks = spark.range(1, 150_001).select(F.col("id").alias("node_id"), (F.col("id") != 1).alias("online"))
    got = {(r.extent_id, r.slot, r.node_id, r.target) for r in catalog.recovery(extents, nodes, disks).collect()}
    assert got == {(1, 1, 3, 4), (1, 2, 1, 4), (2, 0, 500, 4), (2, 1, 501, 4)}


def test_requests_hold_all_customers(spark, tmp_path):
    spark.createDataFrame([(5,), (8999,), (9000,), (12345,), (12346,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    assert sorted(r[0] for r in q._requests(spark, str(tmp_path)).collect()) == ["u0005/5", "u12345/1", "u12346/2", "u8999/7", "u9000/0"]


def test_concatenated_runs_meet(spark, tmp_path):
    spark.range(6000).toDF("event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.p for r in q.QUERIES["concat_runs"](spark, str(tmp_path)).collect()) == list(range(6000))


def test_overlap_looks_at_every_part(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in q._tables(spark, sf).collect():
        want[r.part_id] = want.get(r.part_id, False) or r.smallest < "u0003" or r.biggest < "u0003"
    assert len(want) > 1 and {r.part_id: r.overlap for r in q.QUERIES["overlap_detection"](spark, sf).collect()} == want
