"""Gapless numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are numbered in, rows below which one is enough, and keys that are drawn to cut them.
RANGES, FEW, DRAWN = 64, 20_000, 4096


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Adds ``name``: numbers from ``first`` on in the given order, whose first column cuts the ranges.

    A sample by a hash of that column gives the cuts (a bounded number of keys); ranges are numbered apart, and
    shifted by the rows of those before."""
    key, n = order[0], rows.count()
    cuts: list = []
    if n > FEW:
        share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < 1e6 * min(1.0, DRAWN / n)
        drawn = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(key).where(share).distinct().limit(8 * DRAWN).collect())
        cuts = sorted({drawn[len(drawn) * k // RANGES] for k in range(1, RANGES)}) if drawn else []
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(key)))
    cut = rows.withColumn("_range", bucket)
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # a row for each range
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = cut.withColumn("_within", within).join(F.broadcast(sizes), "_range")
    return placed.withColumn(name, (F.lit(first - 1) + F.col("_within") + F.col("_before")).cast("long")).drop("_range", "_within", "_before")
