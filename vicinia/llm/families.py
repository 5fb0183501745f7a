"""Families of similar sets: what candidates' links join, without all pairs of a key.

Sets come as nodes, each once, with keys that similar ones share (min-wise samples). In
rounds each node is held against one node of each of its keys, which joins large families
in step with their size: first the one with the most company over all its keys (the others
of a family are copies of it), then others by a hash of the round, as long as that links
some. What is left are nodes that share keys with nodes of other families, such as those
around one passage. They are joined by a prefix filter, exactly and without emitting a
key's pairs: in any common order of shingles two similar sets share one of their first
n - least n + 1, in order of frequency those are the texts' own ones, and from the first
shared one on both must have enough left.

Every link is verified by its whole sets. Between rounds families carry labels, which two
steps of the smallest label over the round's links renew (leaders make stars, and two steps
cross a star); labels only save work, since two nodes of one label are linked. The links
that labels don't explain are joined once, at the end, by alternating stars. So the number
of jobs is bounded by the rounds and the driver holds no rows, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import Workspace
from vicinia.llm.simhash import components

#: Rounds in which a node is held against one of each of its keys.
ROUNDS = 6


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``percent`` of 100 or more; never of an empty one."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def banded(signatures: np.ndarray, rows: int) -> np.ndarray:
    """Keys (signed 64 bits) of each ``rows`` neighbouring places of each signature, a row of ``signatures``."""
    parts = signatures.astype("<u8").reshape(len(signatures), -1, rows)
    keys = [[xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(s)] for s in parts]
    return np.array(keys, dtype=np.uint64).view(np.int64).reshape(parts.shape[:2])


def _verified(ws: Workspace, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # sets are read where they lie, and a batch goes before the next comes: a node of many pairs is in each of its rows
            own = zip(*((np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(k)) for k in (2, 3)), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in own], pa.bool_()))
            del b, own
            pa.default_memory_pool().release_unused()

    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "a_grams", "b_grams")
    return ws.save(met.mapInArrow(near, "a long, b long"), f"{name}-links")


def _prefix_pairs(ws: Workspace, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the nodes (node, root, n) of other roots that share a shingle among the rarest that they must share one of."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            again = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(again), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))], ["node", "gram"])

    grams = ws.save(sets.join(nodes.select("node").hint("merge"), "node", "left_semi").mapInArrow(each, "node long, gram long"), "grams")
    held = grams.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")  # the others come first in every order, and meet nothing
    lists = grams.join(held.hint("merge"), "gram").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("grams"))  # bounded by the document
    need = F.size("grams") - F.ceil(F.col("n") * F.lit(percent) / 100 - 1e-9) + 1
    first = nodes.join(lists.hint("merge"), "node").select("node", "root", "n", F.size("grams").alias("size"), F.posexplode(F.slice("grams", F.lit(1), F.greatest(need, F.lit(0)).cast("int"))).alias("at", "x"))
    first = ws.save(first.select("node", "root", "n", F.col("x.gram").alias("gram"), (F.col("size") - F.col("at")).alias("rest")), "prefixes")
    other = first.select(F.col("gram").alias("other_gram"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"), F.col("rest").alias("other_rest"))
    # from their first common shingle on, two similar sets have as many left as they must share
    enough = F.least("rest", "other_rest") >= (F.col("n") + F.col("m")) * F.lit(percent / (100 + percent)) - 1e-9
    return first.join(other.hint("merge"), (F.col("gram") == F.col("other_gram")) & (F.col("node") < F.col("other")) & (F.col("root") != F.col("other_root")) & enough).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links as pairs (a, b) of different labels of their ends."""
    ends = links
    for c in "ab":
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge"), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    return ends.where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()


def _relabelled(ws: Workspace, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The labels (node, root) after two steps of the smallest label over new links."""
    edges = ws.save(_between(links, labels), f"{name}-edges")
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    now = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("root"), F.least("u", "v").alias("low"))
    met = both.join(now.select(F.col("root").alias("v"), "low").hint("merge"), "v").groupBy("u").agg(F.min("low").alias("next"))
    steps = now.join(met.select(F.col("u").alias("root"), "next").hint("merge"), "root").select("root", F.least("low", "next").alias("low"))
    known = labels.select("node", "root").union(both.select("u", "u")).distinct().toDF("node", "root")  # a label's own node is a node as well
    return ws.save(known.join(steps.hint("merge"), "root", "left").select("node", F.coalesce("low", "root").alias("root")).groupBy("node").agg(F.min("root").alias("root")), f"{name}-labels")


def families(ws: Workspace, shared: DataFrame, sets: DataFrame, percent: int, first: DataFrame | None = None) -> DataFrame:
    """Return ``node`` and ``root`` of the nodes that links of similar sets join.

    ``shared``: key, node, n (the size of its set) and many (nodes of the key); ``sets``:
    node and ``grams``, its sorted hashes; ``first``: candidates (a, b) of another source.
    """
    company = shared.groupBy("node").agg(F.sum("many").alias("company"))
    left = ws.save(shared.join(company.hint("merge"), "node").select("key", "node", "n", "company", F.col("node").alias("root")), "open")
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * F.lit(percent)  # sets of other sizes can't be similar
    labels = left.select("node", "root").limit(0)
    found: list[DataFrame] = []

    def opened(left: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """The rows of the keys that nodes of several labels share."""
        rooted = left.drop("root").join(labels.hint("merge"), "node", "left").select("key", "node", "n", "company", F.coalesce("root", "node").alias("root"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return ws.save(rooted.join(apart.hint("merge"), "key", "left_semi"), f"open-{name}")

    if first is not None:
        found.append(_verified(ws, first, sets, percent, "first"))
        labels = _relabelled(ws, labels, found[0], "first")
        left = opened(left, labels, "first")
    for k in range(ROUNDS):
        rank = F.col("company").alias("rank") if not k else F.xxhash64("node", F.lit(k)).alias("rank")
        lead = left.groupBy("key").agg(F.max(F.struct(rank, "node", "n", "root")).alias("lead")).select("key", F.col("lead.node").alias("other"), F.col("lead.n").alias("m"), F.col("lead.root").alias("other_root"))
        met = left.join(lead.hint("merge"), "key").where((F.col("root") != F.col("other_root")) & alike)
        met = ws.save(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), f"round-{k}")
        found.append(_verified(ws, met, sets, percent, f"round-{k}"))
        tried, linked = met.count(), found[-1].count()
        if linked:
            labels = _relabelled(ws, labels, found[-1], f"{k}")
            left = opened(left, labels, f"{k}")
        if linked * 50 <= tried:
            break
    rest = ws.save(_prefix_pairs(ws, ws.save(left.select("node", "root", "n").distinct(), "rest"), sets, percent), "rest-pairs")
    found.append(_verified(ws, rest, sets, percent, "rest"))
    joined = components(ws, ws.save(_between(reduce(DataFrame.union, found), labels), "between"), "families").withColumnRenamed("node", "label").withColumnRenamed("root", "top")
    own = labels.union(joined.select("label", "label")).groupBy("node").agg(F.min("root").alias("root"))
    return own.join(joined.hint("merge"), F.col("root") == F.col("label"), "left").select("node", F.coalesce("top", "root").alias("root"))
