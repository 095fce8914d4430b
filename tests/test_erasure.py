"""The erasure code's workers hold a few rows, however many there are."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelog import kv_jobs  # noqa: F401
from tidelog import kv_queries as q


def _peaks(mark: str) -> dict[int, int]:
    """MB that each Python worker with this mark in its environment held at most, by process."""
    out = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if mark.encode() in (p / "environ").read_bytes().split(b"\0"):
                out[int(p.name)] = next(int(x.split()[1]) >> 10 for x in (p / "status").read_text().splitlines() if x.startswith("VmHWM"))
        except OSError:
            pass
    return out


@pytest.mark.parametrize("name", ["erasure_round_trip", "erasure_rebuild"])
def test_workers_hold_a_few_rows(spark, tmp_path, name):
    pages = {k: random.Random(k).randbytes(32 << 10).hex() if k else "" for k in range(1000)} | {1000: None}
    frame = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    for size, most in (("small", 20), ("large", 1001)):
        frame.where(F.col("page_id") < most).coalesce(1).write.parquet(str(tmp_path / size / "pages.parquet"))
    spark.sparkContext.environment["ERASURE_TEST"] = name  # new workers, that ran nothing else
    try:
        peak = []
        for size, most in (("small", 20), ("large", 1001)):
            got = {r.page_id: r.digest for r in q.QUERIES[name](spark, str(tmp_path / size)).collect()}
            assert got == {k: hashlib.md5(v.encode()).hexdigest() for k, v in pages.items() if k < most and v is not None}
            peak.append(max(_peaks(f"ERASURE_TEST={name}").values()))
        assert peak[1] < peak[0] + 100, peak
    finally:
        del spark.sparkContext.environment["ERASURE_TEST"]
