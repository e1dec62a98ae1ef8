"""Data side of sequence recommenders, and a factor model by alternating least squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stored
from .sampling import hash32


def left_truncated(ids: Column, length: int, pad: int = 0) -> Column:
    """The last `length` ids, padded on the left."""
    n = F.size(ids)
    tail = F.slice(ids, F.greatest(F.lit(1), n - length + 1), F.lit(length))
    return F.concat(F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(0), length - n)), tail)


def instance_ids(prompt: Column, completion: Column, budget: int, least: int = 32, ignore: int = -100) -> Column:
    """(ids, labels) of a training instance: the prompt loses its beginning so that both fit `budget` ids, its places are
    ignored in the labels. Null where fewer than `least` ids of the budget would be left for the prompt.
    """
    room = F.lit(budget) - F.size(completion)
    kept = F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), F.greatest(F.lit(0), room))
    return F.when(room >= least, F.struct(F.concat(kept, completion).alias("ids"), masked_labels(F.size(kept), completion, ignore).alias("labels")))


def masked_labels(n_prompt: Column, completion: Column, ignore: int = -100) -> Column:
    """Labels of a training instance: the prompt's places are ignored, the completion's ids stay."""
    return F.concat(F.array_repeat(F.lit(ignore).cast("bigint"), n_prompt), completion)


def training_pool(users: DataFrame, keep: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """user_id, kept: all of `keep` that are among the users, whatever their number, and others in a seeded order until
    `budget` users are reached.
    """
    mine = stored(users.select("user_id").distinct().join(keep.select("user_id").distinct().withColumn("kept", F.lit(True)), "user_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False))))
    kept = mine.filter("kept")
    others = mine.filter("not kept").orderBy(hash32(seed, "user_id"), "user_id").limit(max(0, budget - kept.count()))
    return kept.unionByName(others)


def fit_factors(events: DataFrame, rank: int = 16, iterations: int = 5, seed: int = 0):
    """Implicit-feedback factor model of (user_id, item) counts: (model, users, items), the tables giving the numbers."""
    from pyspark.ml.recommendation import ALS

    from .items import global_rank

    counts = events.groupBy("user_id", "item").agg(F.count(F.lit(1)).cast("float").alias("n"))
    users = global_rank(counts.select("user_id").distinct(), ["user_id"], rank="u").select("user_id", F.col("u").cast("int").alias("u"))
    items = global_rank(counts.select("item").distinct(), ["item"], rank="i").select("item", F.col("i").cast("int").alias("i"))
    data = counts.join(users, "user_id").join(items, "item")
    als = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="n", seed=seed, coldStartStrategy="nan")
    return als.fit(data), users, items


def factor_scores(model, users: DataFrame, items: DataFrame, options: DataFrame) -> DataFrame:
    """The options with score, the dot product of their user's and item's factors; 0 where either is unknown."""
    u = users.join(model.userFactors.withColumnRenamed("id", "u"), "u").select("user_id", F.col("features").alias("_a"))
    i = items.join(model.itemFactors.withColumnRenamed("id", "i"), "i").select("item", F.col("features").alias("_b"))
    x = options.join(u, "user_id", "left").join(i, "item", "left")
    dot = F.aggregate(F.zip_with("_a", "_b", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda a, v: a + v)
    return x.withColumn("score", F.coalesce(dot, F.lit(0.0))).drop("_a", "_b")


def next_item_scores(options: DataFrame, users: DataFrame, lasts: DataFrame, items: DataFrame) -> DataFrame:
    """The options (user, last, item and others) with score, <user + last, item>.

    The three tables have their key (user, last, item) and a vector v. Without a user's or last item's vector that term is
    0; options whose item has none are scored 0 too.
    """
    x = options.join(users.withColumnRenamed("v", "_u"), "user", "left").join(lasts.withColumnRenamed("v", "_l"), "last", "left").join(items.withColumnRenamed("v", "_i"), "item", "left")
    dot = lambda a: F.coalesce(F.aggregate(F.zip_with(a, "_i", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))
    return x.withColumn("score", dot("_u") + dot("_l")).drop("_u", "_l", "_i")
