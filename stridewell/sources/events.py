"""The event and decision tables in the form the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import epoch_s, norm_id
from .tables import table


def events(spark: SparkSession, folder: str) -> DataFrame:
    """seq, user_id, t (seconds), item, cat, name, lat, lon of the check-ins that have an account, a time and an item.

    Ids are canonical, coordinates that are NaN are null, blank names are null.
    """
    c = table(spark, folder, "checkins")
    return c.select(
        "seq",
        norm_id("user_id").alias("user_id"),
        epoch_s(c, "ts").alias("t"),
        norm_id("item").alias("item"),
        norm_id("cat").alias("cat"),
        F.when(F.btrim("venue_name", F.lit(" \t")) != "", F.btrim("venue_name", F.lit(" \t"))).alias("name"),
        F.nanvl("lat", F.lit(None).cast("double")).alias("lat"),
        F.nanvl("lon", F.lit(None).cast("double")).alias("lon"),
    ).filter("user_id is not null and t is not null and item is not null")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """decision_id, user_id, t, k, true_item, candidates, answer_idx, history with canonical ids; missing elements are null."""
    d = table(spark, folder, "decisions")
    return d.select(
        "decision_id",
        norm_id("user_id").alias("user_id"),
        epoch_s(d, "ts").alias("t"),
        "k",
        norm_id("true_item").alias("true_item"),
        F.transform("candidates", norm_id).alias("candidates"),
        "answer_idx",
        F.transform("history", norm_id).alias("history"),
    )


def options(decided: DataFrame) -> DataFrame:
    """One row per option of each decision with a user: decision_id, user_id, idx (0-based), item, is_true."""
    return (
        decided.filter("user_id is not null")
        .select("decision_id", "user_id", "answer_idx", F.posexplode("candidates").alias("idx", "item"))
        .filter("item is not null")
        .select("decision_id", "user_id", "idx", "item", F.coalesce(F.col("idx") == F.col("answer_idx"), F.lit(False)).alias("is_true"))
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with their decision's account: prediction_id, decision_id, arm, answer_idx, pick, logprobs, user_id."""
    p = table(spark, folder, "predictions")
    d = table(spark, folder, "decisions").select("decision_id", norm_id("user_id").alias("user_id")).filter("user_id is not null")
    return p.filter("answer_idx is not null and logprobs is not null").join(d, "decision_id")
