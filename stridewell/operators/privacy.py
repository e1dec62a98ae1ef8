"""How few events single a person out, and what redaction leaves."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored
from .items import global_rank
from .sampling import hash32, sample_keys


def random_subsets(pairs: DataFrame, users: DataFrame, value: str, k: int, draws: int, seed: int = 0) -> DataFrame:
    """user_id, draw, value: `draws` random sets of k different values of each of the given users that has at least k."""
    own = pairs.join(users.select("user_id"), "user_id", "left_semi").select("user_id", value).distinct()
    x = own.withColumn("draw", F.explode(F.expr(f"sequence(0, {draws - 1})"))).withColumn("_h", hash32(seed, "draw", "user_id", value))
    place = F.row_number().over(Window.partitionBy("user_id", "draw").orderBy("_h", value))
    x = x.withColumn("_k", place).filter(F.col("_k") <= k)
    full = x.groupBy("user_id", "draw").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == k)
    return x.join(full, ["user_id", "draw"], "left_semi").select("user_id", "draw", value)


def support(sets: DataFrame, pairs: DataFrame, value: str, k: int) -> DataFrame:
    """user_id, draw, n_users: users whose values include the whole set; the owner is one of them.

    A set's rarest value goes first: users are found by an equi-join on it, and the others only thin them out.
    """
    held = pairs.select(F.col("user_id").alias("_u"), value).distinct()
    freq = held.groupBy(value).agg(F.count(F.lit(1)).alias("_f"))
    ranked = sets.join(freq, value).withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "draw").orderBy("_f", value)))
    found = ranked.filter("_r = 1").select("user_id", "draw", value).join(held, value).select("user_id", "draw", "_u")
    for r in range(2, k + 1):
        nth = ranked.filter(F.col("_r") == r).select("user_id", "draw", value)
        found = found.join(nth, ["user_id", "draw"]).join(held, ["_u", value], "left_semi").select("user_id", "draw", "_u")
    return found.groupBy("user_id", "draw").agg(F.count(F.lit(1)).alias("n_users"))


def unicity(pairs: DataFrame, value: str, ks=(1, 2, 3, 4), draws: int = 20, n_users: int = 300, seed: int = 0) -> DataFrame:
    """k, n_sets, unique_share, median_support over random sets of k values of a sample of users."""
    pairs = stored(pairs.select("user_id", value).distinct())
    users = stored(sample_keys(pairs, "user_id", n_users, seed))
    out = None
    for k in ks:
        s = support(stored(random_subsets(pairs, users, value, k, draws, seed)), pairs, value, k)
        one = s.agg(F.count(F.lit(1)).alias("n_sets"), F.round(F.avg((F.col("n_users") == 1).cast("double")), 9).alias("unique_share"), F.percentile("n_users", F.lit(0.5)).alias("median_support")).select(F.lit(k).alias("k"), "n_sets", "unique_share", "median_support")
        out = one if out is None else out.unionByName(one)
    return out


#: The values that most users hold are looked up as bits of their holders: so many at most, each of more than so many users.
HOT_VALUES, HOT_USERS = 1024, 128
#: Holders of one value in one piece of work.
HOLDERS = 65_536


def _hot_values(freq: DataFrame, value: str, hot_users: int) -> DataFrame:
    """value, _hot (0 for the rarest) of the hot values: a few rows."""
    top = freq.filter(F.col("_f") > hot_users).orderBy(F.desc("_f"), value).limit(HOT_VALUES)
    return stored(top.withColumn("_hot", (F.row_number().over(Window.orderBy("_f", value)) - 1).cast("smallint")).select(value, "_hot"))


def _hot_lists(held: DataFrame, hot: DataFrame, value: str) -> DataFrame:
    """_u, _own (at most HOT_VALUES places) of the users that hold a hot value."""
    return held.join(F.broadcast(hot), value).groupBy("_u").agg(F.collect_list("_hot").alias("_own"))


def _hot_support(sets: DataFrame, lists: DataFrame, holders: int = HOLDERS) -> DataFrame:
    """_set, _tag, _at, _c, n_users of sets of hot values (`_set`, ascending places, so the rarest is first).

    A set is looked for among the holders of its rarest value, `holders` of them at a time: their other hot values are bits, and
    a set's bits are and-ed and counted. Rows without a set (null) keep their `_at` as n_users.
    """
    size = lists.select(F.explode("_own").alias("_v")).groupBy("_v").agg(F.ceil(F.count(F.lit(1)) / holders).alias("_parts"))
    size = F.broadcast(stored(size))  # HOT_VALUES rows at most
    one = F.lit(1).cast("bigint")
    # a set's other values come after its first
    theirs = lists.select("_u", F.explode("_own").alias("_v"), "_own").join(size, "_v").select("_v", F.pmod(F.xxhash64("_u"), "_parts").alias("_part"), F.lit(0).alias("_is_set"), F.expr("filter(_own, x -> x >= _v)").alias("_set"), F.lit(0).alias("_tag"), F.lit(0).cast("bigint").alias("_at"), one.alias("_c"))
    mine = sets.withColumn("_v", F.coalesce(F.get("_set", F.lit(0)), F.lit(-1).cast("smallint"))).join(size, "_v", "left")
    mine = mine.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", one) - 1))).select("_v", "_part", F.lit(1).alias("_is_set"), "_set", "_tag", "_at", "_c")
    both = theirs.unionByName(mine).repartition("_v", "_part").sortWithinPartitions("_v", "_part", "_is_set")
    found = both.mapInArrow(_count_hot, "_set array<smallint>, _tag int, _at bigint, _c bigint, n_users bigint")
    return found.groupBy("_set", "_tag", "_at", "_c").agg(F.sum("n_users").alias("n_users"))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and the lists' lengths; null lists are empty."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bits(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of bits for each hot value, a bit for each holder; the last row has all bits."""
    flat, lens = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    flags = np.zeros((HOT_VALUES + 1, -(-len(lens) // 64) * 64), bool)
    flags[flat, np.repeat(np.arange(len(lens)), lens)] = True
    flags[HOT_VALUES, : len(lens)] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def _count_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, parts, bits = None, [], None
    for batch in batches:
        v, part, is_set = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_v", "_part", "_is_set"))
        flat, lens = _lists(batch.column("_set"))
        flat, at = flat.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lens)])
        n_users = np.zeros(len(v), np.int64)
        edges = np.flatnonzero((np.diff(v) != 0) | (np.diff(part) != 0) | (np.diff(is_set) != 0)) + 1
        for lo, hi in pairwise([0, *edges, len(v)]):
            if lo == hi:
                continue
            if key != (v[lo], part[lo]):
                key, parts, bits = (v[lo], part[lo]), [], None
            mine, size = flat[at[lo] : at[hi]], lens[lo:hi]
            if not is_set[lo]:
                parts.append((mine, size))
            elif v[lo] < 0:
                n_users[lo:hi] = batch.column("_at").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            else:
                if bits is None:
                    bits, parts = _bits(parts), []
                ids = np.full((hi - lo, size.max()), HOT_VALUES)
                ids[np.repeat(np.arange(hi - lo), size), np.arange(len(mine)) - np.repeat(at[lo:hi] - at[lo], size)] = mine
                step = max(1, (1 << 17) // max(1, bits.shape[1]))
                for k in range(0, hi - lo, step):
                    some = ids[k : k + step]
                    acc = bits[some[:, 0]]
                    for j in range(1, some.shape[1]):
                        acc &= bits[some[:, j]]
                    n_users[lo + k : lo + k + len(some)] = np.bitwise_count(acc).sum(1)
        out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("_set", "_tag", "_at", "_c")), pa.array(n_users)], names=["_set", "_tag", "_at", "_c", "n_users"])
        yield out.filter(pa.array(is_set == 1))


def set_support(sets: DataFrame, pairs: DataFrame, value: str, hot_users: int = HOT_USERS, holders: int = HOLDERS) -> DataFrame:
    """set_id, n_users: users whose values include the whole set, for sets (set_id, value) of any sizes; the ones with none are left out.

    One value: its users. Hot values alone: bits of holders, once for equal sets. Others: the users of the rarest value, which the
    other values thin out.
    """
    held = stored(pairs.select(F.col("user_id").alias("_u"), value).distinct())
    freq = stored(held.groupBy(value).agg(F.count(F.lit(1)).alias("_f")))
    hot = _hot_values(freq, value, hot_users)
    known = sets.select("set_id", value).distinct().join(freq, value, "left").join(F.broadcast(hot), value, "left")
    # a value that nobody holds comes first, and its set has no user
    each = F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col(value).alias("v"), F.col("_hot").alias("h"))
    ranked = stored(known.groupBy("set_id").agg(F.sort_array(F.collect_list(each)).alias("x")))
    one = ranked.filter("size(x) = 1").select("set_id", F.col("x")[0]["f"].alias("n_users"))
    more = ranked.filter("size(x) > 1")
    all_hot = more.filter("x[0].h is not null").select("set_id", F.array_sort("x.h").alias("_set"))
    distinct = all_hot.select("_set").distinct().select("_set", F.lit(0).alias("_tag"), F.lit(0).cast("bigint").alias("_at"), F.lit(1).cast("bigint").alias("_c"))
    counted = all_hot.join(_hot_support(distinct, _hot_lists(held, hot, value), holders), "_set").select("set_id", "n_users")
    cold = more.filter("x[0].h is null")
    most = cold.agg(F.max(F.size("x"))).first()[0] or 0
    nth = lambda r: cold.filter(F.size("x") > r).select("set_id", F.col("x")[r]["v"].alias(value), (F.size("x") > r + 1).alias("_more"))
    found, done = nth(0).join(held, value).select("set_id", "_u", "_more"), None
    for r in range(1, most):
        found = found.filter("_more").drop("_more").join(nth(r), "set_id").join(held, ["_u", value], "left_semi").select("set_id", "_u", "_more")
        whole = found.filter("not _more").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_users"))
        done = whole if done is None else done.unionByName(whole)
    out = one.unionByName(counted)
    return (out if done is None else out.unionByName(done)).filter("n_users > 0")


def unicity_of_all(shown: DataFrame, held: DataFrame, value: str, ks=(1, 2, 3, 4), draws: int = 20, seed: int = 0, fill: bool = False, hot_users: int = HOT_USERS, holders: int = HOLDERS) -> DataFrame:
    """k, n_sets, users_skipped, unique_share, median_support over `draws` sets of k values of every user in `shown`.

    Sets are drawn from `shown` (user_id, value) and looked for in `held`. A user with fewer than k values is skipped, or
    with `fill` gives all of them. A value that nobody holds has no support; `shown` is meant to be a part of `held`.
    """
    return unicity_of_pools(shown, held, value, {"all": 0}, ks, draws, seed, fill, hot_users, holders).drop("pool")


def unicity_of_pools(shown: DataFrame, held: DataFrame, value: str, pools: dict[str, int], ks=(1, 2, 3, 4), draws: int = 20, seed: int = 0, fill: bool = False, hot_users: int = HOT_USERS, holders: int = HOLDERS) -> DataFrame:
    """The same by pool: a pool has the values that so many users hold, and a user without any of them is skipped.

    A user's sets are all tested at once, on the lists of users that hold the values shown to that user; each user in a list has
    the hot values they hold with them, so that no hot value needs a list. Sets of hot values alone are counted by
    `_hot_support`, once for equal sets.
    """
    held = stored(held.select(F.col("user_id").cast("string").alias("_u"), F.col(value).cast("string").alias(value)).filter(F.col("_u").isNotNull() & F.col(value).isNotNull()).distinct())
    freq = held.groupBy(value).agg(F.count(F.lit(1)).alias("_f"))
    own = shown.select(F.col("user_id").cast("string").alias("user_id"), F.col(value).cast("string").alias(value)).distinct().join(freq, value, "left")
    own = stored(own.select("user_id", value, F.coalesce("_f", F.lit(0)).alias("_f")))
    hot = _hot_values(freq, value, hot_users)
    lists = stored(_hot_lists(held, hot, value))
    wanted = own.filter("_f > 0").select(value).distinct().join(F.broadcast(hot), value, "left_anti")
    with_hot = held.join(wanted, value, "left_semi").join(lists, "_u", "left")
    users_of = with_hot.groupBy(value).agg(F.collect_list(F.struct("_u", "_own")).alias("_users"))
    rows = own.join(F.broadcast(hot), value, "left").join(users_of, value, "left").select("user_id", F.col(value).alias("_value"), "_f", F.coalesce("_hot", F.lit(-1).cast("smallint")).alias("_hot"), "_users")
    tests = _Tests(list(pools.values()), list(ks), draws, seed, fill)
    tested = rows.repartition("user_id").sortWithinPartitions("user_id").mapInArrow(tests, "_set array<smallint>, _tag int, _at bigint, _c bigint")
    counted = _hot_support(tested.groupBy("_set", "_tag", "_at").agg(F.sum("_c").alias("_c")), lists, holders)
    n = counted.groupBy("_tag", "n_users").agg(F.sum("_c").alias("c"))  # one row for each number of users
    users = F.sum(F.when(F.col("n_users") == -1, F.col("c")))
    real = F.col("n_users") >= 0
    total = F.coalesce(F.sum(F.when(real, F.col("c"))), F.lit(0))
    by = n.groupBy("_tag").agg(
        total.alias("n_sets"), F.coalesce(users, F.lit(0)).alias("users"),
        F.round(F.sum(F.when(F.col("n_users") == 1, F.col("c")).when(real, F.lit(0))) / total, 9).alias("unique_share"),
        F.percentile(F.when(real, F.col("n_users")), F.lit(0.5), F.when(real, F.col("c")).otherwise(F.lit(0))).alias("median_support"),
    )
    got = {r["_tag"]: r for r in by.collect()}  # a row for each pool and k
    everyone = got[-1].users if -1 in got else 0
    out = []
    for p, pool in enumerate(pools):
        for j, k in enumerate(ks):
            r = got.get(p * len(ks) + j)
            out.append((pool, k, r.n_sets, everyone - r.users, r.unique_share, r.median_support) if r else (pool, k, 0, everyone, None, None))
    return held.sparkSession.createDataFrame(out, "pool string, k int, n_sets bigint, users_skipped bigint, unique_share double, median_support double")


class _Tests:
    """Rows of users' values (user by user) to counts `_c` of sets: by `_at`, their number of users, or by `_set` where hot values
    alone are in them. Users that gave a set, and with the tag -1 all users, have `_at` -1. The tag is the place of pool and k.
    """

    def __init__(self, pools: list[int], ks: list[int], draws: int, seed: int, fill: bool):
        self.pools, self.ks, self.draws, self.seed, self.fill = pools, ks, draws, seed, fill

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            ids = t.column("user_id").combine_chunks().dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero(np.diff(ids)) + 1
            cut = int(edges[-1]) if len(edges) else 0
            if cut:
                yield self.counts(t.slice(0, cut).combine_chunks(), [0, *edges])
            rest = t.slice(cut)
        if rest is not None and len(rest):
            yield self.counts(rest.combine_chunks(), [0, len(rest)])

    def counts(self, t: pa.Table, edges: list[int]) -> pa.RecordBatch:
        col = lambda n: t.column(n).combine_chunks()
        names, values = col("user_id").to_pylist(), [x.encode() for x in col("_value").to_pylist()]
        f, hot = col("_f").to_numpy(), col("_hot").to_numpy().astype(np.int64)
        users, n_users = _lists(col("_users"))
        who, own = users.flatten()
        who = who.dictionary_encode().indices.to_numpy()
        own, n_own = _lists(own)
        own = own.to_numpy(zero_copy_only=False).astype(np.int64)
        at, own_at = (np.concatenate([[0], np.cumsum(x)]) for x in (n_users, n_own))
        plain, sets = Counter(), Counter()
        for lo, hi in pairwise(edges):
            w, i = np.unique(who[at[lo] : at[hi]], return_inverse=True)
            n = hi - lo
            has = np.zeros((len(w), n + 1), bool)
            has[:, n] = True  # for places without a value
            has[i, np.repeat(np.arange(n), n_users[lo:hi])] = True
            place = np.full(HOT_VALUES, n)
            mine = hot[lo:hi]
            place[mine[mine >= 0]] = np.flatnonzero(mine >= 0)
            a, b = at[lo], at[hi]
            has[np.repeat(i, n_own[a:b]), place[own[own_at[a] : own_at[b]]]] = True
            self.test(has, names[lo], values[lo:hi], f[lo:hi], mine, plain, sets)
        rows = [(None, tag, n, c) for (tag, n), c in plain.items()] + [(list(s), tag, None, c) for (tag, s), c in sets.items()]
        kinds = {"_set": pa.list_(pa.int16()), "_tag": pa.int32(), "_at": pa.int64(), "_c": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds.values())], names=list(kinds))

    def test(self, has, name, values, f, hot, plain, sets) -> None:
        plain[-1, -1] += 1
        n, most = len(values), max(self.ks)
        orders = []
        for draw in range(self.draws):
            start = hashlib.md5(f"{self.seed}|{draw}|{name}|".encode())
            keys = []
            for v in values:
                h = start.copy()
                h.update(v)
                keys.append((h.digest()[:4], v))
            orders.append(sorted(range(n), key=keys.__getitem__))
        f, hot = np.append(f, 1), np.append(hot, 0)
        for p, least in enumerate(self.pools):
            # the set of k values is the beginning of that of more
            drawn = np.full((self.draws, most), n)
            for d, order in enumerate(orders):
                taken = [x for x in order if f[x] >= least][:most]
                drawn[d, : len(taken)] = taken
            if self.fill:
                kept = np.where(f[drawn] > 0, drawn, n)
            else:
                kept = drawn
            hit, cold = np.ones((len(has), self.draws), bool), np.zeros(self.draws, bool)
            for k in range(1, most + 1):
                x = kept[:, k - 1]
                hit &= has[:, x]
                cold |= hot[x] < 0
                if k not in self.ks:
                    continue
                tag = p * len(self.ks) + self.ks.index(k)
                some = kept[:, :k]
                real = (some < n).any(1) if self.fill else ((some < n) & (f[some] > 0)).all(1)
                if real.any():
                    plain[tag, -1] += 1
                size = (some < n).sum(1)
                count = hit.sum(0)
                for d in np.flatnonzero(real):
                    if cold[d]:
                        plain[tag, int(count[d])] += 1
                    elif size[d] == 1:
                        plain[tag, int(f[some[d]][some[d] < n][0])] += 1
                    else:
                        sets[tag, tuple(sorted(hot[some[d]][some[d] < n].tolist()))] += 1


def composite(visits: DataFrame, slots: list[str], least_users: int = 3, attempts: int = 200, seed: int = 0) -> DataFrame:
    """attempt, slot, cat, user_id, item: an example person put together from different users' visits, one for each category
    in `slots`, so that nobody has been to all of these places; the first of so many random attempts that is one, or none.

    `visits` has user_id, item, cat. Places need `least_users` visitors. All attempts are drawn and tested side by side.
    """
    held = stored(visits.select("user_id", "item", "cat").dropna().distinct())
    pairs = held.select("user_id", "item").distinct()
    often = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_users).select("item")
    pool = held.filter(F.col("cat").isin(slots)).join(often, "item", "left_semi")
    ranked = global_rank(pool, ["cat", "user_id", "item"]).select("cat", "user_id", "item", "rank")
    span = ranked.groupBy("cat").agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_c"))
    spark = visits.sparkSession
    tries = spark.range(attempts).select(F.col("id").alias("attempt")).crossJoin(spark.createDataFrame(list(enumerate(slots)), "slot int, cat string"))  # a few hundred rows
    points = tries.join(F.broadcast(span), "cat").withColumn("rank", F.col("_first") + F.pmod(hash32(seed, "attempt", "slot"), F.col("_c")))
    drawn = stored(points.join(ranked.drop("cat"), "rank").select("attempt", "slot", "cat", "user_id", "item"))
    whole = drawn.groupBy("attempt").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("item").alias("i")).filter((F.col("u") == len(slots)) & (F.col("i") == len(slots))).select("attempt")
    someone = drawn.select("attempt", "item").join(pairs.withColumnRenamed("user_id", "_u"), "item").groupBy("attempt", "_u").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(slots)).select("attempt")
    good = whole.join(someone, "attempt", "left_anti").agg(F.min("attempt").alias("attempt"))
    return drawn.join(F.broadcast(good), "attempt")  # one row


def masked(events: DataFrame, private: Column, generic: str = "Private place") -> DataFrame:
    """Events without name and point where `private` holds, under a generic category."""
    p = F.coalesce(private, F.lit(False))
    return events.withColumn("cat", F.when(p, generic).otherwise(F.col("cat"))).withColumn("name", F.when(~p, F.col("name"))).withColumn("lat", F.when(~p, F.col("lat"))).withColumn("lon", F.when(~p, F.col("lon")))


#: What a request log may hold.
LOG_COLUMNS = ("rid", "path", "status", "ms")


def minimal_log(requests: DataFrame, columns: tuple[str, ...] = LOG_COLUMNS) -> DataFrame:
    """One JSON line (column `value`) a request, of the ids and timings in `columns` alone; times in whole milliseconds.
    Whatever else a row has, such as a history or a prompt, is left out.
    """
    kept = [F.round(c).cast("bigint").alias(c) if c == "ms" else F.col(c) for c in columns]
    return requests.select(F.to_json(F.struct(*kept)).alias("value"))
