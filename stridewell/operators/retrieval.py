"""BM25 over many small corpora at once: each decision's history against its options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The usual parameters of the ranking function.
K1, B = 1.2, 0.75


def bm25(docs: DataFrame, queries: DataFrame, corpus: str = "decision_id", k1: float = K1, b: float = B) -> DataFrame:
    """corpus, pos, score for every document. `docs` has corpus, pos, words; `queries` has corpus and words.

    Query words count as often as they occur; the statistics are each corpus's own; a document without words or hits
    scores 0; a corpus without a query scores 0 throughout.
    """
    sized = docs.select(corpus, "pos", "words", F.size("words").alias("dl"))
    stats = sized.groupBy(corpus).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.select(corpus, "pos", "dl", F.explode("words").alias("w")).groupBy(corpus, "pos", "dl", "w").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(corpus, "w").agg(F.count(F.lit(1)).alias("df"))
    q = queries.select(corpus, F.explode("words").alias("w")).groupBy(corpus, "w").agg(F.count(F.lit(1)).alias("qf"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = tf.join(q, [corpus, "w"]).join(df, [corpus, "w"]).join(stats, corpus).groupBy(corpus, "pos").agg(F.sum(part).alias("score"))
    return sized.select(corpus, "pos").join(hits, [corpus, "pos"], "left").select(corpus, "pos", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def best_in_order(scored: DataFrame, k: int, corpus: str = "decision_id") -> DataFrame:
    """Of each corpus the k documents of the highest score, later ones first among equals, with nth in original order."""
    by = Window.partitionBy(corpus).orderBy(F.desc("score"), F.desc("pos"))
    kept = scored.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy(corpus).orderBy("pos")))
