"""Train, validation and test splits that keep linked records together.

Connected components come from a distributed union-find. Every partition of links builds its own forest and hands on
just node-root rows. Forests are merged level by level, several into one task as long as they fit its bound, until one
forest is left. Where the rows stay above the bound, the rest is merged between tasks in rounds: a node with several
roots hooks the larger ones to the smallest, and every node jumps to its parent's parent.

Groups then go to the splits largest first, each to the split furthest below its target. Groups of one size are
interchangeable, so the assignment is planned on the histogram of sizes: n rows have at most sqrt(2 n) different ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import norm_id, require_columns, stored
from ..operators.ranked import numbered, spread_join

_SCHEMA = "node string, root string"


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of the nodes 0..n-1 that the links a-b make."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node-root rows of the forest that this task's link rows make; a root is its tree's smallest id."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids = pc.unique(pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]))
    ids = ids.take(pc.sort_indices(ids))
    a, b = (pc.index_in(table.column(k), ids).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    parent = union_find(a, b, len(ids))
    node = np.flatnonzero(parent != np.arange(len(ids)))
    out = pa.RecordBatch.from_arrays([ids.take(pa.array(node)).cast(pa.string()), ids.take(pa.array(parent[node])).cast(pa.string())], names=["node", "root"])
    for at in range(0, out.num_rows, 20_000):
        yield out.slice(at, 20_000)


def components(links: DataFrame, a: str = "user_id", b: str = "other_id", task_rows: int = 2_000_000) -> DataFrame:
    """node and root for every linked id: root is the smallest id of its component, nodes that are roots included.

    Links with a missing side or to itself say nothing; repeated links and both directions are one; no links, no rows.
    `task_rows` bounds the forest rows that a task merges at once.
    """
    require_columns(links, a, b)
    edges = links.select(norm_id(a).alias("node"), norm_id(b).alias("root")).dropna().filter("node <> root")
    forest = stored(edges.mapInArrow(_forest, _SCHEMA))
    rows, before = forest.count(), None
    while True:
        tasks = -(-rows // task_rows) if rows else 1
        if before is not None and tasks > 1 and rows > 0.7 * before:
            forest = _star_rounds(forest)
            break
        forest = stored(forest.coalesce(tasks).mapInArrow(_forest, _SCHEMA))
        if tasks == 1:
            break
        rows, before = forest.count(), rows
    return forest.unionByName(forest.select(F.col("root").alias("node"), "root").distinct())


def _star_rounds(forest: DataFrame) -> DataFrame:
    """Merge the trees of a forest that is spread over tasks, by hooking and pointer jumping, until all are stars."""
    while True:
        parents = forest.groupBy("node").agg(F.min("root").alias("p"))
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        # a third of all nodes may have one parent
        flat = spread_join(parents, up, "p", "left").select("node", F.coalesce("pp", "p").alias("root"), F.col("pp").isNotNull().alias("moved"))
        hooks = forest.join(parents, "node").filter("root <> p").select(F.col("root").alias("node"), F.col("p").alias("root"), F.lit(True).alias("moved"))
        step = stored(flat.unionByName(hooks).groupBy("node", "root").agg(F.max("moved").alias("moved")))
        forest = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return forest


def linked_pairs(links: DataFrame, decisions: DataFrame, user: str = "user_id", **how) -> DataFrame:
    """user_a < user_b: different accounts that both have decisions and are linked, directly or through others."""
    require_columns(decisions, user)
    active = decisions.select(norm_id(user).alias("node")).filter("node is not null").distinct()
    members = components(links, **how).join(active, "node", "left_semi")
    other = members.select("root", F.col("node").alias("user_b"))
    return members.withColumnRenamed("node", "user_a").join(other, "root").filter("user_a < user_b").select("user_a", "user_b")


def active_members(links: DataFrame, decisions: DataFrame, user: str = "user_id", **how) -> DataFrame:
    """user_id and root of every account with decisions that is linked to another: one row an account, whatever the size of
    its component. root is the component's smallest id, which need not have decisions.
    """
    require_columns(decisions, user)
    active = decisions.select(norm_id(user).alias("node")).filter("node is not null").distinct()
    return components(links, **how).join(active, "node", "left_semi").select(F.col("node").alias("user_id"), "root")


def plan_splits(sizes: Sequence[tuple[int, int]], shares: Sequence[float]) -> dict[int, list[int]]:
    """For (size, groups) pairs: how many groups of each size go to each split, largest first, each group to the split
    that is then furthest below its target (the first such). Equals the group-by-group greedy, in one step a size.
    """
    total = sum(s * c for s, c in sizes)
    below = [total * x / sum(shares) for x in shares]
    plan = {}
    for s, c in sorted(sizes, reverse=True):
        # a split's deficit falls by s with each group: take the c largest values of these falling rows
        take = [0] * len(shares)
        if c > 64:
            low, high = min(below) - s * c - s, max(below)
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(max(0, int((d - mid) // s) + 1) for d in below if d >= mid) > c else (low, mid)
            take = [max(0, int((d - high) // s) - 1) for d in below]
        heap = [(-(d - t * s), i) for i, (d, t) in enumerate(zip(below, take))]
        heapq.heapify(heap)
        for _ in range(c - sum(take)):
            d, i = heapq.heappop(heap)
            take[i] += 1
            heapq.heappush(heap, (d + s, i))
        below = [d - t * s for d, t in zip(below, take)]
        plan[s] = take
    return plan


def linked_splits(
    records: DataFrame, links: DataFrame, record_id: str = "decision_id", user: str = "user_id", shares: dict[str, float] | None = None, **how
) -> DataFrame:
    """record_id, user_id, root and split of every record; all records of linked accounts share a split.

    `shares` are the splits' proportions of the records, 80 : 10 : 10 by default. A record without an account is a group
    of its own, with a null root. Repeated ids are kept as rows; an empty table gives none; other columns are ignored.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    if min(shares.values()) < 0 or sum(shares.values()) <= 0:
        raise ValueError("shares must not be negative, and not all zero")
    require_columns(records, record_id, user)
    names = list(shares)
    rows = records.select(F.col(record_id), norm_id(user).alias("user_id"))
    roots = components(links, **how).withColumnRenamed("node", "user_id")
    rooted = spread_join(rows, roots, "user_id", "left").withColumn("root", F.coalesce("root", "user_id"))
    group = F.coalesce(F.concat(F.lit("u"), "root"), F.concat(F.lit("r"), F.col(record_id).cast("string")), F.lit("r"))
    rooted = stored(rooted.withColumn("_g", group))
    groups = stored(rooted.groupBy("_g").agg(F.count(F.lit(1)).alias("_size")))
    sizes = [(r._size, r.c) for r in groups.groupBy("_size").agg(F.count(F.lit(1)).alias("c")).collect()]  # at most sqrt(2 n) rows
    plan = plan_splits(sizes, [shares[n] for n in names])
    spans = []
    for s, take in plan.items():
        at = 0
        for name, k in zip(names, take):
            if k:
                spans.append((s, at, at + k, name))
                at += k
    spans = records.sparkSession.createDataFrame(spans, "_size bigint, _from bigint, _to bigint, split string")
    placed = numbered(groups, ["_size"], ["_g"], sum(c for _, c in sizes), "_i").join(spans, "_size").filter("_i >= _from and _i < _to").select("_g", "split")
    return spread_join(rooted, placed, "_g").select(record_id, "user_id", "root", "split")
