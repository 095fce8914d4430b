"""Which tables to compact, when to flush: planning over a partition's small table catalog."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The rules' fixed parameters: most tables at once, share of the first extent, share and multiple of the skiplist size.
MOST_TABLES, HEAD_SHARE, SMALL_SHARE, PAIR = 5, 0.3, 0.5, 2


def head_pick(tables: list[tuple[int, int, int]], most: int = MOST_TABLES, share: float = HEAD_SHARE) -> tuple[list[int], int]:
    """Rule one on a partition's (last_seq, first extent, size): which tables (by last_seq) to compact to free the oldest
    extent, and the extent up to which the stream can be cut then (0: none).

    The oldest tables that begin in the first one's extent are chosen, if that extent's bytes are under ``share`` of all; tables
    between them in age come along, up to ``most`` in all. The cut is the next table's extent, if all chosen ones fit."""
    aged = sorted(tables)
    if len(aged) < 2:
        return [], 0
    first, total = aged[0][1], sum(size for *_, size in aged)
    if sum(size for _, at, size in aged if at == first) >= math.floor(share * total + 0.5):
        return [], 0
    front = list(itertools.takewhile(lambda t: t[1] == first, aged[:most]))
    after = next((t[1] for t in aged[len(front) : most]), 0)
    return [t[0] for t in front], after


def head_extent_pick(tables: DataFrame, part: str = "part_id") -> DataFrame:
    """(part, last_seq, truncate) of the tables that rule one picks in each partition; tables: (part, last_seq, extent_id,
    estimated_size). A partition's catalog is small, so each is planned in one task."""

    def plan(pdf):
        import pandas as pd

        picked, cut = head_pick(list(zip(pdf["last_seq"].tolist(), pdf["extent_id"].tolist(), pdf["estimated_size"].tolist())))
        return pd.DataFrame({part: [pdf[part].iloc[0]] * len(picked), "last_seq": picked, "truncate": [cut] * len(picked)})

    return tables.select(part, "last_seq", "extent_id", "estimated_size").groupBy(part).applyInPandas(plan, f"{part} long, last_seq long, truncate long")


def small_run_pick(tables: list[tuple[int, int]], skiplist: int) -> list[tuple[int, int]]:
    """Rule two on (last_seq, size) of one partition: the first run of small tables in age order, five at most, after its older
    neighbour if the two fit together. A single small table without such a neighbour takes its newer neighbour if these fit;
    else it waits for the next small table, after the one that follows it. None of fewer than two."""
    small, room = math.floor(SMALL_SHARE * skiplist + 0.5), PAIR * skiplist
    aged, run, k = sorted(tables), [], 0
    while k < len(aged):
        while k < len(aged) and aged[k][1] < small and len(run) < MOST_TABLES:
            if not run and k and aged[k - 1][1] + aged[k][1] < room:
                run.append(aged[k - 1])
            run.append(aged[k])
            k += 1
        if len(run) == 1 and k < len(aged) and run[0][1] + aged[k][1] < room:
            run.append(aged[k])
        if len(run) > 1:
            return run
        k += 1
    return []


def filled(sizes: list[int], capacity: int) -> list[int]:
    """Which output each row goes to: a row that would outgrow the output begins the next one (one alone may exceed it)."""
    out, used = [], 0
    for size in sizes:
        if out and used + size > capacity:
            out.append(out[-1] + 1)
            used = 0
        else:
            out.append(out[-1] if out else 0)
        used += size
    return out


def filled_buckets(rows: DataFrame, part: str, order: str, capacity: int, name: str = "bucket") -> DataFrame:
    """Adds ``name``: each partition's rows in order, dealt to outputs by ``filled``; the sums start anew at each output. Only
    keys and sizes of a partition meet."""

    def deal(pdf):
        pdf = pdf.sort_values(order)
        pdf[name] = filled(pdf["entry_size"].tolist(), capacity)
        return pdf

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = rows.select(part, order, "entry_size").groupBy(part).applyInPandas(deal, f"{part} {kinds[part]}, {order} {kinds[order]}, entry_size long, {name} long")
    return rows.join(keys.drop("entry_size"), [part, order])


def flush_bucket(log: DataFrame, skiplist: int) -> DataFrame:
    """Adds memtable: which flush of its extent an entry falls into, by running bytes."""
    total = F.sum("entry_size").over(Window.partitionBy("extent_id").orderBy("seq"))
    return log.withColumn("memtable", F.floor((total - F.col("entry_size")) / skiplist))


def block_starts(sizes: list[int], most_bytes: int = 64 << 10, most_entries: int = 1000) -> list[int]:
    """First entries of a table's blocks: a block ends when it would outgrow the size, or has over ``most_entries``."""
    starts, used, n = [], 0, 0
    for k, size in enumerate(sizes):
        if not starts or used + size > most_bytes or n > most_entries:
            starts.append(k)
            used = n = 0
        used, n = used + size, n + 1
    return starts
