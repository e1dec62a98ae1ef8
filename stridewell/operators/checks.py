"""Invariants as tables of violations: a check passes when its table is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import stored
from ..sources import events as src
from ..sources.tables import table
from . import timeline


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two tables that should agree but don't, by key: side 'a' or 'b' only, as many copies as are too many."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        raise ValueError("the tables have different columns")
    one = lambda x, y, side: x.select(cols).exceptAll(y.select(cols)).withColumn("side", F.lit(side))
    return one(a, b, "a").unionByName(one(b, a, "b")).select("side", *key, *(c for c in cols if c not in key))


def misaligned(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys that only one of two tables has, or at which one of `columns` differs (nulls are equal)."""
    x = a.select(*key, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("_a"))
    y = b.select(*key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("_b"))
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        bad = bad | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return x.join(y, key, "full").filter(bad).drop("_a", "_b")


def value_differences(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows (key, value as text) of two tables of paths that only one has, or whose values differ: numbers by more than
    `tolerance`, other texts at all.
    """
    x, y = a.select(*key, F.col("value").alias("a_value"), F.lit(True).alias("_a")), b.select(*key, F.col("value").alias("b_value"), F.lit(True).alias("_b"))
    m, n = F.expr("try_cast(a_value as double)"), F.expr("try_cast(b_value as double)")
    same = F.when(m.isNotNull() & n.isNotNull(), F.abs(m - n) <= tolerance).otherwise(F.col("a_value").eqNullSafe(F.col("b_value")))
    return x.join(y, key, "full").filter(F.col("_a").isNull() | F.col("_b").isNull() | ~same).drop("_a", "_b")


def json_paths(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value (as text) of every leaf of the JSON texts, a path being like 'a.b[0].c'; texts that don't parse, and
    empty objects and lists, give no rows. One round a level of nesting.
    """
    spark = rows.sparkSession
    level, out = stored(rows.select(F.col(key).alias("_k"), F.lit("").alias("path"), F.try_parse_json(text).alias("v")).filter("v is not null")), None
    while True:
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaf = level.filter(~nested).select("_k", "path", F.expr("cast(v as string)").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        deeper = level.filter(nested)
        if deeper.isEmpty():
            return out.withColumnRenamed("_k", key)
        step = "case when x.key is null then concat(d.path, '[', x.pos, ']') when d.path = '' then x.key else concat(d.path, '.', x.key) end"
        level = stored(spark.sql(f"select d._k, {step} path, x.value v from {{d}} d, lateral variant_explode(d.v) x", d=deeper))


def agrees(value: Column, stored_value: Column, tolerance: float) -> Column:
    """Whether a recomputed value is the one written down, within a tolerance that is counted in."""
    return F.abs(value - stored_value) < tolerance + 1e-12


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two sets which must be disjoint have in common."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def run_checks(spark: SparkSession, d: str) -> DataFrame:
    """check_name, n_violations over the tables of a folder."""
    parts = timeline.split(timeline.ordered(src.events(spark, d)))
    held = timeline.held_out(parts)
    preds = src.predictions(spark, d)
    decided = table(spark, d, "decisions")
    sums = held.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_novel").alias("a"), F.count_if(~F.col("is_novel")).alias("b"))
    violations = {
        "cut after start": parts.filter("held and rn <= cut"),
        "novel and revisits sum up": sums.filter("a + b <> n"),
        "prediction without decision": table(spark, d, "predictions").join(decided, "decision_id", "left_anti"),
        "answers differ": preds.join(decided.select("decision_id", F.col("answer_idx").alias("own")), "decision_id").filter("answer_idx <> own"),
        "probabilities not five": preds.filter("size(logprobs) <> 5"),
    }
    out = None
    for name, rows in violations.items():
        one = rows.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations")
        out = one if out is None else out.unionByName(one)
    return out
