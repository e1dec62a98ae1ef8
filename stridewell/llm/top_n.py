"""The N highest-scoring items of every group, by bisecting all groups' cutoffs at once.

Score and identifier become one order-preserving integer code. Every group has a bracket around its cutoff; in each
round the rows above the brackets' midpoints are counted for all groups together, and each bracket halves, until just
N rows of the group lie above. That runs on pieces of the partitions as they are read, so that of a group with millions
of rows at most N a partition are shuffled, and again on what is left of each group.

What is left of a group may still be more than a task should hold, with a large N or very many partitions. Such groups'
brackets are refined between tasks, by counting their rows in the brackets' parts, until a bracket holds a task's rows
or a single score. Then the rows from the cutoff on are ranked in sorted ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import stored
from ..operators.items import global_rank

PIECE_ROWS = 400_000
#: Rows of one group that a task may take.
TASK_ROWS = 2_000_000
#: Parts that a bracket is counted in at once.
PARTS = 256


def order_code(score: np.ndarray, ident_rank: np.ndarray) -> np.ndarray:
    """One int64 per row that orders like (score ascending, ident_rank descending)."""
    if score.dtype.kind == "f":
        bits = (score + 0.0).view(np.int64)  # -0.0 and 0.0 are equal
        score = np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits) if len(bits) else bits
    m = int(ident_rank.max()) + 1 if len(ident_rank) else 1
    low, high = (int(score.min()), int(score.max())) if len(score) else (0, 0)
    if (high - low + 1) * m < 2**62:
        place = score - low
    else:
        place = np.unique(score, return_inverse=True)[1].astype(np.int64)
    return place * m + (m - 1 - ident_rank)


def cutoffs(group: np.ndarray, code: np.ndarray, n: int, n_groups: int) -> np.ndarray:
    """Per group, a cutoff with exactly min(n, its rows) codes at or above; codes are distinct within a group."""
    size = np.bincount(group, minlength=n_groups)
    low = np.full(n_groups, np.iinfo(np.int64).max)
    np.minimum.at(low, group, code)
    high = np.full(n_groups, np.iinfo(np.int64).min)
    np.maximum.at(high, group, code)
    cut = low.copy()
    if n == 0:
        return high + 1
    high += 1
    above = np.zeros(n_groups, dtype=np.int64)  # rows at or above `high`
    open_ = size > n
    keep = open_[group]
    group, code = group[keep], code[keep]
    while len(group):
        middle = low + (high - low) // 2
        up = code >= middle[group]
        count = above + np.bincount(group[up], minlength=n_groups)
        hit, more = open_ & (count == n), open_ & (count > n)
        less = open_ & (count < n)
        cut[hit] = middle[hit]
        low[more] = middle[more]
        high[less], above[less] = middle[less], count[less]
        open_ &= ~hit
        keep = open_[group] & np.where(up, more[group], less[group])  # rows outside the bracket are settled
        group, code = group[keep], code[keep]
    return cut


def _distinct(table: pa.Table) -> pa.Table:
    """Rows equal in group, score and ident become one, with the smallest seq."""
    got = table.group_by(["g", "score", "ident"]).aggregate([("seq", "min")])
    return pa.table({"g": got["g"], "score": got["score"], "ident": got["ident"], "seq": got["seq_min"]})


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    groups = table["g"].combine_chunks().dictionary_encode()
    idents = table["ident"].combine_chunks().dictionary_encode()
    rank = np.empty(len(idents.dictionary), dtype=np.int64)
    rank[pc.sort_indices(idents.dictionary).to_numpy()] = np.arange(len(rank))  # UTF-8 bytes order like code points
    group = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return group, order_code(table["score"].to_numpy(), rank[idents.indices.to_numpy(zero_copy_only=False)]), len(groups.dictionary)


def _top(n: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        left: pa.Table | None = None
        rows = 0

        def cut() -> pa.Table:
            table = pa.concat_tables([*([left] if left is not None else []), *([pa.Table.from_batches(held)] if held else [])])
            table = _distinct(table)
            group, code, many = _codes(table)
            return table.filter(pa.array(code >= cutoffs(group, code, n, many)[group]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            # what is kept is looked at again only when as much has come on top, so the work stays in proportion
            if rows >= max(PIECE_ROWS, left.num_rows if left is not None else 0):
                left, held, rows = cut(), [], 0
        if rows or left is not None:
            left = cut()
            if final:
                group, code, _ = _codes(left)
                order = np.lexsort((-code, group))  # at most n rows a group
                g = group[order]
                start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
                pos = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g)))) + 1
                left = left.take(pa.array(order)).append_column("pos", pa.array(pos.astype(np.int64)))
            yield from left.combine_chunks().to_batches()

    return run


def _brackets(rows: DataFrame, n: int, task_rows: int) -> DataFrame:
    """g and lo of each group: at least n rows, or all, have a score of lo or more, and no more than needed to settle the
    rest in a task, unless they tie. `rows` has distinct (g, score, ident).
    """
    br = stored(rows.groupBy("g").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("size")).withColumn("need", F.lit(n).cast("bigint")))
    done = None
    while True:
        settled = (F.col("size") <= F.greatest("need", F.lit(task_rows))) | (F.col("lo") >= F.col("hi"))
        out = br.filter(settled).select("g", "lo")
        done = out if done is None else done.unionByName(out)
        br = br.filter(~settled)
        if br.isEmpty():
            return done
        low, high = F.col("lo").cast("double"), F.col("hi").cast("double")
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("score").cast("double") / 2 - low / 2) / F.greatest(high / 2 - low / 2, F.lit(1e-300)) * PARTS)).cast("int")
        inside = rows.join(br, "g").filter("score >= lo and score <= hi").groupBy("g", "need", "size", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        above = F.sum("c").over(Window.partitionBy("g").orderBy(F.desc("part"))) - F.col("c")
        new = inside.withColumn("above", above).filter("above < need and above + c >= need")
        # a bracket that did not get smaller can't be parted by its scores' double values: it is left to the ranking
        new = new.withColumn("hi", F.when(F.col("c") == F.col("size"), F.col("lo")).otherwise(F.col("hi")))
        br = stored(new.select("g", "lo", "hi", F.col("c").alias("size"), (F.col("need") - F.col("above")).alias("need")))


def _ranked_across_tasks(rows: DataFrame, n: int, task_rows: int) -> DataFrame:
    """g, score, ident, seq, pos of groups of any size."""
    rows = stored(rows.groupBy("g", "score", "ident").agg(F.min("seq").alias("seq")))
    kept = rows.join(_brackets(rows, n, task_rows), "g").filter("score >= lo").drop("lo")
    ranked = global_rank(kept, [F.col("g"), F.desc("score"), F.col("ident")]).drop("rows")
    first = ranked.groupBy("g").agg(F.min("rank").alias("_first"))  # few groups are this large
    return ranked.join(F.broadcast(first), "g").withColumn("pos", F.col("rank") - F.col("_first") + 1).filter(F.col("pos") <= n).select("g", "score", "ident", "seq", "pos")


def top_n(rows: DataFrame, group: Column, score: Column, ident: Column, seq: Column, n: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """group, pos (1..n), score, ident and seq of each group's n highest scores; ties go to the smaller ident (code points).

    Rows equal in group, score and ident are one item, known by its smallest seq. Rows where any of the four is null
    (or the score NaN) take no part; a group with fewer than n items gives what it has; an empty table gives none. Groups
    of which more than `task_rows` rows are left after the partitions' own cuts are cut between tasks.
    """
    if n < 1:
        raise ValueError("n must be positive")
    r = rows.select(group.cast("string").alias("g"), score.alias("score"), ident.cast("string").alias("ident"), seq.cast("bigint").alias("seq"))
    kind = dict(r.dtypes)["score"]
    if kind in ("float", "double") or kind.startswith("decimal"):
        kind, r = "double", r.withColumn("score", F.col("score").cast("double")).filter("not isnan(score)")
    else:
        kind, r = "bigint", r.withColumn("score", F.col("score").cast("bigint"))
    r = r.dropna()
    schema = f"g string, score {kind}, ident string, seq bigint"
    few = r.mapInArrow(_top(n, False), schema)
    within = lambda x: x.repartition("g").mapInArrow(_top(n, True), schema + ", pos bigint")
    if n * r.rdd.getNumPartitions() <= task_rows:  # no group can have more left
        out = within(few)
    else:
        few = stored(few)
        large = stored(few.groupBy("g").count().filter(F.col("count") > task_rows).select("g"))  # at most rows / task_rows
        out = within(few.join(F.broadcast(large), "g", "left_anti"))
        if not large.isEmpty():
            out = out.unionByName(_ranked_across_tasks(few.join(F.broadcast(large), "g", "left_semi"), n, task_rows))
    return out.select(F.col("g").alias("group"), "pos", "score", "ident", "seq")
