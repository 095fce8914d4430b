"""The stored log's literal cases, pushed bounds, and what holds at sizes that the queries' tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, integrity
from tidelog.operators import catalog, maintenance, snapshot
from tidelog.plans import picks
from tidelog.sources import logs
from tidelog.sources.numbering import numbered
from tidelog.sources.store import Store
from tidelog.streaming import latest as st


def _rows(spark, rows, extent=0):
    """(seq, key, value, is_delete) as rows of a log; values over 4 KiB are large ones."""
    made = [(s, k, d, not d and len(v) > 4096, 0, v, len(v), 28 + len(k) + len(v), x, 0, 0) for s, k, v, d, x in ((*r, extent)[:5] if len(r) == 4 else r for r in rows)]
    return spark.createDataFrame(made, logs.LOG_SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/log")


def _value(store, key):
    row = snapshot.get(store.log(), key).first()
    return None if row is None else row.value


def test_write_read_update(spark, store):
    assert store.log().count() == 0
    store.put(_rows(spark, [(i + 1, f"key{i}", f"val{i}", False) for i in range(100)]))
    store.put(_rows(spark, [(i + 101, "key", f"val{i}", False) for i in range(100)]))
    assert all(_value(store, f"key{i}") == f"val{i}" for i in (0, 50, 99)) and _value(store, "key") == "val99"


def test_big_value_and_head(spark, store):
    store.put(_rows(spark, [(1, "key0", "val0", False)]))
    assert snapshot.head_of(store.log(), "key0").first().val_len == 4
    store.put(_rows(spark, [(2, "key0", "x" * (1 << 20), False)]))
    assert snapshot.head_of(store.log(), "key0").first().val_len == 1 << 20 and len(_value(store, "key0")) == 1 << 20


def test_range_after_delete(spark, store):
    store.put(_rows(spark, [(k * 100 + i + 1, f"key{i}", "v", False) for k in range(2) for i in range(100)]))
    missing = store.delete(spark.createDataFrame([("key99",), ("nokey",)], "user_key string"))
    assert [r[0] for r in missing.collect()] == ["nokey"]
    assert [r[0] for r in snapshot.range_keys(store.log(), "key9", "key9", 100, 0).collect()] == ["key9"] + [f"key9{i}" for i in range(9)]
    store.compact(0, True)
    assert store.log().count() == 99 and len(store.generations()) == 2
    store.purge()
    assert store.generations() == [2] and store.log().count() == 99


def test_compaction_keeps_all_keys(spark, store):
    store.put(_rows(spark, [(i + 1, f"{i:04}", "x" * 1000, False) for i in range(5000)]))
    store.put(_rows(spark, [(i + 5001, f"{i:04}", "y" * 1000, False) for i in range(0, 5000, 2)]))
    store.compact(0, False)
    assert [r[0] for r in store.log().select("user_key").orderBy("user_key").collect()] == [f"{i:04}" for i in range(5000)]
    assert store.log().where("value like 'y%'").count() == 2500


BIG = "B" * (1 << 20)
THREE = [(1, "a0", "s", False, 1), (2, "b0", BIG, False, 1), (3, "c0", "s", False, 2), (4, "a1", "s", False, 2), (5, "b1", BIG, False, 2), (6, "c1", "s", False, 3)]


def _order(store):
    return [r.user_key for r in store.log().orderBy("extent_id", "seq").collect()]


def test_gc_of_the_middle_extent(spark, store):
    store.put(_rows(spark, THREE))
    assert store.gc(0, [2]) == [2]
    assert _order(store)[-1] == "b1" and _value(store, "c0") == "s" and len(_value(store, "b1")) == 1 << 20
    assert store.log().where("user_key = 'b1'").first().extent_id == 4


def test_gc_after_a_delete(spark, store):
    store.put(_rows(spark, THREE))
    store.delete(spark.createDataFrame([("a0",)], "user_key string"))
    assert store.gc(0, [1]) == [1]
    assert _value(store, "a0") is None and len(_value(store, "b0")) == 1 << 20
    assert store.log().where("user_key = 'b0'").count() == 1


def test_gc_keeps_the_second_value(spark, store):
    store.put(_rows(spark, [(1, "TEST", BIG, False, 1), (2, "TEST", BIG[:-1] + "2", False, 2)]))
    store.gc(0, [1])
    assert _value(store, "TEST")[-1] == "2" and store.log().count() == 1


def test_auto_gc(spark, store):
    rows = [(i + 1, f"k{i % 3}", BIG[: 200_000], False, i // 5) for i in range(20)] + [(21, "z", "s", False, 4)]
    store.put(_rows(spark, rows))
    store.compact(0, False)  # what shadowed values leave is counted before this; the log now has none
    assert store.log().count() == 4
    again = Store(spark, store.path + "-2")
    again.put(_rows(spark, rows))
    chosen = again.gc(0)
    assert 0 < len(chosen) <= maintenance.MOST_EXTENTS and 4 not in chosen
    assert {k: len(_value(again, k)) for k in ("k0", "k1", "k2")} == dict.fromkeys(("k0", "k1", "k2"), 200_000)


def test_a_generation_cut_short_is_not_read(spark, store, tmp_path):
    store.put(_rows(spark, [(1, "a", "x", False)]))
    (tmp_path / "log" / "gen=2").mkdir()
    (tmp_path / "log" / "gen=2" / "part-0.parquet").write_bytes(b"half")
    assert _value(store, "a") == "x"
    store.compact(0, True)
    assert store.generations() == [1, 2] and _value(store, "a") == "x"


def test_bounds_reach_the_scan(spark, store):
    store.put(_rows(spark, [(i + 1, f"key{i}", "v", False) for i in range(1000)]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_key,key7)" in plan(snapshot.get(store.log(), "key7"))
    ranged = plan(snapshot.range_keys(store.log(), "key7", "", 5, 0))
    assert "GreaterThanOrEqual(user_key,key7)" in ranged and "StringStartsWith(user_key,key7)" in ranged
    head = plan(snapshot.head_of(store.log(), "key7"))
    assert "EqualTo(user_key,key7)" in head and "value" not in head.split("ReadSchema:")[1].split("\n")[0]


def test_numbering_in_ranges(spark):
    for n in (0, 10, 30_000):
        rows = spark.range(n).select(F.concat(F.lit("k"), F.sha2(F.col("id").cast("string"), 256)).alias("k"), "id")
        got = [(r.k, r.no) for r in numbered(rows, ["k"], "no", 5).collect()]
        assert [no for _, no in sorted(got)] == list(range(5, 5 + n))
    same = numbered(spark.range(30_000).select((F.col("id") % 2).alias("k"), "id"), ["k", "id"], "no")
    assert [r.no for r in same.orderBy("k", "id").collect()] == list(range(30_000))


def test_routes_of_many_regions(spark):
    starts = ["", *(f"{i:05}" for i in range(10, 5000, 10))]
    regions = [(i, a, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], ""])) if i % 50 != 7]  # with holes
    keys = [(f"{random.Random(i).randint(0, 5200):05}",) for i in range(3000)] + [("",), (None,)]
    got = catalog.route(spark.createDataFrame(keys, "user_key string"), spark.createDataFrame(regions, "part_id long, start_key string, end_key string")).collect()
    want = sorted((k, next((i for i, a, b in regions if a <= k and (not b or k < b)), None)) for (k,) in keys if k is not None)
    assert sorted((r.user_key, r.part_id) for r in got) == [x for x in want if x[1] is not None]


def test_as_of_join_of_a_hot_key(spark):
    log = spark.range(1, 20_001).select(F.lit("hot").alias("user_key"), F.col("id").alias("seq"), (F.col("id") % 7 == 0).alias("is_delete"))
    probes = spark.range(0, 20_001, 10).select(F.lit("hot").alias("user_key"), F.col("id").alias("version"))
    got = {r.version: r.seq for r in snapshot.as_of_join(probes, log).collect()}
    assert got == {v: v for v in range(10, 20_001, 10) if v % 7}


def test_head_pick_rules():
    assert picks.head_pick([(1, 1, 10)]) == ([], 0)
    assert picks.head_pick([(1, 1, 10), (2, 2, 100), (3, 3, 100)]) == ([1], 2)
    assert picks.head_pick([(1, 1, 40), (2, 2, 30), (3, 3, 30)]) == ([], 0)  # too much in the first extent
    assert picks.head_pick([(1, 1, 1), (2, 1, 1), (3, 2, 100)]) == ([1, 2], 2)
    assert picks.head_pick([(k, 1, 1) for k in range(1, 8)] + [(9, 2, 100)]) == ([1, 2, 3, 4, 5], 0)  # five at most, no cut


def test_small_run_rules():
    pick = lambda sizes: [t[0] for t in picks.small_run_pick(list(enumerate(sizes)), 60)]
    assert pick([1, 100, 100, 100]) == [0, 1]  # a single small one takes its newer neighbour
    assert pick([120, 1, 120, 1, 1]) == [1, 3, 4] and pick([100, 100]) == [] and pick([5]) == []
    assert pick([100, 5, 5, 100]) == [0, 1, 2] and pick([1] * 9) == [0, 1, 2, 3, 4]


def test_filled_outputs():
    assert picks.filled([5, 5, 5, 20, 1, 9], 10) == [0, 0, 1, 2, 3, 3]


def test_human_sizes(spark):
    sizes = {0: "0B", 1: "1.0 B", 999: "999.0 B", 1500: "1.5 KB", 2_000_000: "2.0 MB", 10**18: "1.0 EB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.h for r in df.select("n", codec.human_size(F.col("n")).alias("h")).collect()} == sizes
    rates = {0.0: "", 1.0: "1.00B/sec", 1234.0: "1.23KB/sec"}
    df = spark.createDataFrame([(n,) for n in rates], "n double")
    assert {r.n: r.h for r in df.select("n", codec.human_throughput(F.col("n")).alias("h")).collect()} == rates


def test_merge_cases(spark):
    """(keys; values) of sources in order of priority."""
    more = [("137", "a1 a3 a7"), ("235", "b2 b3 b5"), ("1", "c1"), ("179", "d1 d7 d9")]
    twice = [("1137", "a1 a1-1 a3 a7"), *more[1:]]
    same = [("111", "a1 a3 a7"), ("111", "b2 b3 b5"), ("1", "c1"), ("112", "d1 d7 d9")]

    def run(sources, reverse):
        runs = [spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(zip(keys, values.split()))], "k string, v string, i int") for keys, values in sources]
        rows = snapshot.merge(runs, ["k"], "i", reverse).orderBy(F.desc("k") if reverse else "k").collect()
        return " ".join(r.v for r in rows)

    assert run(more, False) == "a1 b2 a3 b5 a7 d9" and run(more, True) == "d9 a7 b5 a3 b2 a1"
    assert run(twice, False) == "a1 b2 a3 b5 a7 d9" and run(twice, True) == "d9 a7 b5 a3 b2 a1-1"
    assert run(same, False) == "a1 d9" and run(same, True) == "d9 a7"


def test_seeks(spark):
    log = spark.range(10_000).select(F.format_string("k%04d", "id").alias("user_key"))
    first = lambda key, ahead: (lambda r: r and r[0])(snapshot.seek(log, key, ahead).first())
    cases = {"abc": ("k0000", None), "k0100": ("k0100", "k0100"), "k0100b": ("k0101", "k0100"), "k1234b": ("k1235", "k1234"), "k9999": ("k9999", "k9999"), "z": (None, "k9999")}
    assert {k: (first(k, True), first(k, False)) for k in cases} == cases


def test_prefix_without_its_start_is_refused(spark):
    with pytest.raises(ValueError):
        snapshot.scan(_rows(spark, []), "key9", "abc")


def test_record_ends_in_closed_form(spark):
    rng = random.Random(6)
    cases = [(rng.randint(0, 400_000), rng.choice([0, 1, 131_063, 131_064, rng.randint(0, 500_000)])) for _ in range(500)] + [(131_072 - k, 131_063 + j) for k in range(12) for j in (-1, 0, 1)]
    got = spark.createDataFrame(cases, "a long, n long").select(integrity.record_ends(F.col("a"), F.col("n")).alias("e"), "a", "n").collect()
    assert all(r.e == integrity.record_end(r.a, r.n) for r in got)


def test_rebuilt_shards():
    value = random.Random(7).randbytes(5000)
    shards = integrity.rs_encode(value, 6, 3)
    assert integrity.rs_rebuild([None if i in (0, 4, 8) else s for i, s in enumerate(shards)], 6, 3) == shards


def test_checksums_of_unlike_lengths():
    values = [random.Random(k).randbytes(n) for k, n in enumerate([0, 1, 70, 3000, 5000, 9, 9, 9, 100_000])]
    plain = []
    for v in values:
        state = 0xFFFFFFFF
        for b in v:
            state ^= b
            for _ in range(8):
                state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
        plain.append(state ^ 0xFFFFFFFF)
    assert integrity.crc32c(values).tolist() == plain


def test_changes_of_keys_over_many_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(s, "a", f"v{s}", s % 5 == 0) for s in range(1, 21)]
        random.Random(8).shuffle(rows)
        _rows(spark, rows).repartition(4).write.parquet(str(tmp_path / "in"))
        s = st.changes(st.log_stream(spark, str(tmp_path / "in")))
        s.writeStream.format("memory").queryName("changes_many").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.seq, r.previous) for r in spark.table("changes_many").collect())
        assert got == [(s, None if s == 1 or (s - 1) % 5 == 0 else f"v{s - 1}") for s in range(1, 21)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
