"""Counterfactual donors: another user's history in place of one's own."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored
from .features import type_dictionary
from .items import global_rank
from .sampling import hash32

#: Length ratios within which a donor is looked for, narrowest first.
RATIOS = (1.25, 1.5, 2.0, 4.0, float("inf"))


def random_donors(rows: DataFrame, users: DataFrame, row_id: str, user: str = "user_id", seed: int = 0) -> DataFrame:
    """row_id, user, donor: for every row some other user, all equally likely, fixed by the row's hash. None if alone."""
    ranked = global_rank(users.select(F.col(user).alias("donor")).distinct(), ["donor"])
    d = rows.join(ranked.withColumnRenamed("donor", user), user).filter("rows > 1")
    j = F.pmod(hash32(seed, row_id), F.col("rows") - 1)
    d = d.withColumn("rank", j + (j >= F.col("rank")).cast("int")).select(row_id, user, "rank")
    return d.join(ranked.select("rank", "donor"), "rank").select(row_id, user, "donor")


def category_vectors(events: DataFrame) -> DataFrame:
    """user_id, cat, n: sparse counts per category."""
    return events.filter("cat is not null").groupBy("user_id", "cat").agg(F.count(F.lit(1)).alias("n"))


def cosines(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """user_id (of `queries`), donor, cosine for every other user that shares a category with the query user.

    A stated query set against all users: the small side's vectors go to every task only if Spark finds them small.
    """
    vectors = stored(vectors)
    norm = vectors.groupBy("user_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    q = vectors.join(queries.select("user_id"), "user_id", "left_semi").select("user_id", "cat", F.col("n").alias("m"))
    dot = q.join(vectors.select(F.col("user_id").alias("donor"), "cat", "n"), "cat").filter("user_id <> donor").groupBy("user_id", "donor").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    d = dot.join(norm, "user_id").join(norm.select(F.col("user_id").alias("donor"), F.col("norm").alias("norm2")), "donor")
    return d.select("user_id", "donor", (F.col("dot") / (F.col("norm") * F.col("norm2"))).alias("cosine"))


def matched_donors(events: DataFrame, queries: DataFrame) -> DataFrame:
    """user_id, donor, band, cosine, ratio: of the users in the narrowest non-empty band of history lengths, the one with
    the most similar categories; ties by ratio, then id. A user with no category in common counts as cosine 0.
    """
    queries = stored(queries.select("user_id").distinct())
    length = stored(events.groupBy("user_id").agg(F.count(F.lit(1)).alias("len")))
    mine = length.join(queries.select("user_id"), "user_id", "left_semi")
    near = _length_pairs(mine, length)
    r = F.abs(F.log(F.col("len2") / F.col("len")))
    band = F.coalesce(*(F.when(r <= math.log(b) + 1e-12, F.lit(k)) for k, b in enumerate(RATIOS[:-1])), F.lit(len(RATIOS) - 1))
    pairs = near.withColumn("ratio", F.round(r, 12)).withColumn("band", band)
    pairs = pairs.join(cosines(category_vectors(events), queries), ["user_id", "donor"], "left").withColumn("cosine", F.round(F.coalesce("cosine", F.lit(0.0)), 12))
    best = pairs.groupBy("user_id").agg(F.min(F.struct("band", (-F.col("cosine")).alias("c"), "ratio", "donor")).alias("b"))
    return best.select("user_id", "b.donor", "b.band", (-F.col("b.c")).alias("cosine"), "b.ratio")


def _length_pairs(mine: DataFrame, length: DataFrame) -> DataFrame:
    """Query users with the users of their narrowest non-empty band, by an equi-join on the length.

    Lengths are few: the bands are settled on the table of different lengths and their numbers of users.
    """
    sizes = length.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    own = mine.select("len").distinct()
    r = F.abs(F.log(F.col("len2") / F.col("len")))
    band = F.coalesce(*(F.when(r <= math.log(b) + 1e-12, F.lit(k)) for k, b in enumerate(RATIOS[:-1])), F.lit(len(RATIOS) - 1))
    # the query users' lengths, at most one each of the stated query set, beside all different lengths: at most sqrt(2 n)
    grid = sizes.withColumnRenamed("len", "len2").crossJoin(F.broadcast(own)).withColumn("band", band).withColumn("others", F.col("c") - (F.col("len") == F.col("len2")).cast("int")).filter("others > 0")
    narrow = grid.withColumn("b", F.min("band").over(Window.partitionBy("len"))).filter("band = b").select("len", "len2")
    return mine.join(narrow, "len").join(length.select(F.col("user_id").alias("donor"), F.col("len").alias("len2")), "len2").filter("user_id <> donor")


def matched_donors_of_all(events: DataFrame, queries: DataFrame, histories: DataFrame, block: int = 512) -> DataFrame:
    """The rule of `matched_donors` for any number of query users, leaving out donors whose history (`histories`: user_id,
    history) equals the user's own; where that empties a band, the next wider one is searched.

    Users of one length are cut into blocks, and pairs of blocks in the narrowest band are compared as matrices: no pair
    of users becomes a row.
    """
    types = type_dictionary(events)
    index = events.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "cat string, idx int")
    vec = category_vectors(events).join(F.broadcast(index), "cat").groupBy("user_id").agg(F.collect_list(F.struct("idx", F.col("n").cast("int").alias("n"))).alias("v"))
    length = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("len"))
    each = length.join(vec, "user_id", "left").join(histories.select("user_id", F.xxhash64("history").alias("h")), "user_id", "left")
    each = stored(each.select("user_id", "len", "h", F.coalesce("v.idx", F.array().cast("array<int>")).alias("idx"), F.coalesce("v.n", F.array().cast("array<int>")).alias("n")))
    sizes = stored(each.groupBy("len").agg(F.count(F.lit(1)).alias("c")))
    entry = F.struct("user_id", "h", "idx", "n")

    def blocks(users: DataFrame, *keys: str) -> DataFrame:
        parts = users.join(F.broadcast(sizes), "len").withColumn("_part", F.pmod(F.xxhash64("user_id"), F.ceil(F.col("c") / block)))
        return parts.groupBy("len", "_part", *keys).agg(F.array_sort(F.collect_list(entry)).alias("us"))

    theirs = stored(blocks(each).select(F.col("len").alias("len2"), F.col("us").alias("c")))
    r = F.abs(F.log(F.col("len2") / F.col("len")))
    band = F.coalesce(*(F.when(r <= math.log(b) + 1e-12, F.lit(k)) for k, b in enumerate(RATIOS[:-1])), F.lit(len(RATIOS) - 1))
    best_of = _best_in_blocks(len(types))
    waiting, out = stored(each.join(queries.select("user_id").distinct(), "user_id", "left_semi").withColumn("tried", F.lit(-1))), None
    while out is None or not waiting.isEmpty():
        own = waiting.select("len", "tried").distinct()
        # different lengths beside each other, at most sqrt(2 n) of each
        grid = sizes.withColumnRenamed("len", "len2").crossJoin(F.broadcast(own)).withColumn("band", band).filter("band > tried and c > cast(len = len2 as int)")
        grid = stored(grid.withColumn("b", F.min("band").over(Window.partitionBy("len", "tried"))).filter("band = b").select("len", "len2", "tried", "band", F.round(r, 12).alias("ratio")))
        pairs = blocks(waiting, "tried").withColumnRenamed("us", "q").join(F.broadcast(grid), ["len", "tried"]).join(theirs, "len2").select("band", "ratio", "q", "c")
        got = pairs.mapInArrow(best_of, "user_id string, donor string, band int, cosine double, ratio double")
        got = stored(got.groupBy("user_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "ratio", "donor", "band")).alias("b")).select("user_id", "b.donor", "b.band", (-F.col("b.c")).alias("cosine"), "b.ratio"))
        out = got if out is None else out.unionByName(got)
        waiting = waiting.join(got, "user_id", "left_anti").join(F.broadcast(grid.select("len", "tried", "band").distinct()), ["len", "tried"]).withColumn("tried", F.col("band")).drop("band")
        waiting = stored(waiting)
    return out


def _best_in_blocks(width: int):
    def matrix(users: pa.StructArray) -> np.ndarray:
        idx, n = users.field(2), users.field(3)
        m = np.zeros((len(users), width))
        rows = np.repeat(np.arange(len(users)), idx.value_lengths().to_numpy())
        m[rows, idx.flatten().to_numpy()] = n.flatten().to_numpy()
        return m

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                band, ratio = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                q, c = batch.column(2)[k].values, batch.column(3)[k].values
                a, b = matrix(q), matrix(c)
                norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
                cos = np.round(np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0), 12)
                qu, cu = (np.array(x.field(0).to_pylist(), dtype=object) for x in (q, c))
                qh, ch = (np.array([v if v is not None else 0 for v in x.field(1).to_pylist()], dtype=np.int64) for x in (q, c))
                cos[(qh[:, None] == ch[None, :]) & (qh != 0)[:, None]] = -1
                cos[qu[:, None] == cu[None, :]] = -1
                at = cos.argmax(1)  # blocks are in the order of ids: the first of equals
                top = cos[np.arange(len(qu)), at]
                ok = top >= 0
                m = int(ok.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qu[ok], pa.string()), pa.array(cu[at[ok]], pa.string()), pa.array([band] * m, pa.int32()), pa.array(top[ok]), pa.array([ratio] * m, pa.float64())],
                    names=["user_id", "donor", "band", "cosine", "ratio"],
                )

    return best
