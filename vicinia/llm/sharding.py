"""Sharding by longest-processing-time scheduling.

Groups that must stay together are sorted by size, largest first; each goes to the
least-loaded shard (a heap; ties to the lowest shard). Groups of one size are alike, so
the schedule is fixed by the histogram (size, number of groups): the driver runs the
heap over the distinct sizes only, in bands of ``BAND`` sizes that it fetches and writes
one after the other, and keeps nothing but the loads between them. D distinct sizes need
at least D(D+1)/2 bytes of data, so there are at most sqrt(2 * bytes): 14 million for 100
TB in the worst case, whatever the number of rows. A run of equal groups is dealt at once
by levelling, with the very result of dealing one after the other.

Defined cases: a null text is no bytes and counts as the empty text (size 1); a very long
text is one group, and may be more than a shard's share; equal texts are one group; groups
of one size go by digest, rows of a shard by id, crc32 and size; repeated rows are rows of their own; a null id sorts first; an
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import Workspace, numbered

#: Sizes that the driver holds at once: some 60 MB for 16 shards.
BAND = 250_000


def level_run(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets when each goes to the least-loaded one."""
    k = len(loads)
    if count <= 4 * k:
        heap = [(v, i) for i, v in enumerate(loads)]
        heapq.heapify(heap)
        out = [0] * k
        for _ in range(count):
            v, i = heap[0]
            heapq.heapreplace(heap, (v + size, i))
            out[i] += 1
        return out
    # the groups take the smallest of the levels loads[i] + j * size, ties to the lowest shard
    below = lambda top: [max(0, -(-(top - v) // size)) for v in loads]  # noqa: E731  levels under top
    lo, hi = min(loads), min(loads) + size * (count + 1)
    while lo < hi:  # the largest top with at most count levels under it
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= count else (lo, mid - 1)
    out = below(lo)
    left = count - sum(out)
    for i in range(k):
        if left and loads[i] <= lo and (lo - loads[i]) % size == 0:
            out[i] += 1
            left -= 1
    return out


def schedule(sizes: np.ndarray, counts: np.ndarray, loads: list[int]) -> np.ndarray:
    """For sizes in descending order: the number of groups each shard gets, a row a size. The loads are brought up to date."""
    out = np.zeros((len(sizes), len(loads)), dtype=np.int64)
    for r, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        out[r] = got = level_run(loads, size, count)
        loads[:] = [v + size * n for v, n in zip(loads, got, strict=True)]
    return out


def planned(ws: Workspace, groups: DataFrame, shards: int) -> DataFrame:
    """Return ``weight`` and ``ends``: where each shard's part of the size's run of groups ends, in places of all groups by size."""
    hist, _ = numbered(ws, groups.groupBy("weight").count(), [F.col("weight").desc()], "sizes")
    loads, before, parts, at = [0] * shards, 0, [], 0
    while True:
        band = hist.where((F.col("pos") >= at) & (F.col("pos") < at + BAND)).toArrow().sort_by([("weight", "descending")])  # BAND rows at most
        weight, count = band["weight"].to_numpy(), band["count"].to_numpy()
        ends = (before + count.cumsum() - count)[:, None] + schedule(weight, count, loads).cumsum(axis=1)
        table = pa.table({"weight": weight, "ends": pa.ListArray.from_arrays(np.arange(0, ends.size + 1, shards, dtype=np.int32), pa.array(ends.ravel()))})
        part = ws.spark.createDataFrame(table)
        if band.num_rows < BAND:
            return reduce(DataFrame.union, [*parts, part])
        parts.append(ws.save(part, f"plan-{at}"))
        before, at = before + int(count.sum()), at + BAND


def shard(df: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return id, size, text_crc32, shard and slot (gapless in each shard) of every row."""
    spark = df.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = ws.save(
        df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("digest")),
        "rows",
    )
    groups = ws.save(rows.groupBy("digest").agg(F.sum("size").alias("weight")), "groups")

    plan = planned(ws, groups, shards)
    # the place of a group in the order by size says which part of its size's run it is in
    ranked, _ = numbered(ws, groups, [F.col("weight").desc(), F.col("digest")], "ranked")
    home = ranked.join(plan, "weight").select("digest", F.size(F.filter("ends", lambda e: e <= F.col("pos"))).alias("shard"))
    placed = rows.join(home, "digest").select("id", "size", "crc", "shard")

    ordered, written = numbered(ws, placed, ["shard", "id", "crc", "size"], "placed")
    base = written.groupBy("shard").count().toArrow().sort_by("shard")  # a row for each shard
    n = base["count"].to_numpy()
    starts = spark.createDataFrame(pa.table({"shard": base["shard"], "begin": n.cumsum() - n}))
    return ordered.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("pos") - F.col("begin")).alias("slot")
    )
