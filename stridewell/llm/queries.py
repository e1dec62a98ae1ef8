"""Problems 1, 2 and 6 to 10 over the tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import epoch_s, norm_id
from ..plans.sql import CHECKINS, norm
from ..sources.tables import table
from . import heavy_hitters, languages, linked_splits, packing, runs, tokens, top_n


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.frequent(table(spark, d, "checkins"), "item", one_in=200).select("item")


def p1_top_items(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent items with bounds of their counts."""
    return heavy_hitters.top_values(table(spark, d, "checkins"), "item", 100)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.linked_pairs(table(spark, d, "user_links"), table(spark, d, "decisions"))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """The person (smallest linked account) of each account with decisions that is linked."""
    return linked_splits.active_members(table(spark, d, "user_links"), table(spark, d, "decisions"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.linked_splits(table(spark, d, "decisions"), table(spark, d, "user_links"))


def _latest(spark: SparkSession, d: str, n: int) -> DataFrame:
    c = table(spark, d, "checkins")
    return top_n.top_n(c, norm_id("user_id"), epoch_s(c, "ts"), norm_id("item"), F.col("seq"), n).withColumnRenamed("group", "user_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d, 5).select("user_id", "pos", "seq")


def p6_latest_20(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d, 20).select("user_id", "pos", F.col("score").alias("t"), F.col("ident").alias("item"), "seq")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(table(spark, d, "checkins"), min_rows=2).select("user_id", "first_seq", "last_seq")


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every run, those of one row included."""
    return runs.runs(table(spark, d, "checkins"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_multilingual_ids(spark: SparkSession, d: str) -> DataFrame:
    """The same by the multilingual rank file of the same pattern."""
    return tokens.token_ids(table(spark, d, "documents"), path=os.path.join(tokens.FOLDER, "byte_bpe_multi_50k.tiktoken"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), 2048)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.label_errors(docs, languages.fit(docs))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.document_languages(docs, languages.fit(docs))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.segments(docs, languages.fit(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_top_items, p2_found, p2_members, p2_splits, p6_found, p6_latest_20, p7_found, p7_collapsed, p8_ids, p8_multilingual_ids, p9_containers, p10_found, p10_languages, p10_segments)}


def _latest_sql(n: int, columns: str) -> str:
    return f"""with {CHECKINS},
visits as (select user_id, t, item, min(seq) seq from checkin_rows where user_id is not null and t is not null and item is not null group by 1, 2, 3),
placed as (select *, row_number() over (partition by user_id order by t desc, item) pos from visits)
select {columns} from placed where pos <= {n}"""


_RUNS = f"""with {CHECKINS},
marked as (select *, case when lag(item) over o = item and t - lag(t) over o <= 1800 then 0 else 1 end fresh
  from checkin_rows where user_id is not null and t is not null and item is not null window o as (partition by user_id order by t, item, seq)),
counted as (select *, sum(fresh) over (partition by user_id order by t, item, seq rows unbounded preceding) k from marked),
runs as (select user_id, min(item) item, arg_min(seq, (t, item, seq)) first_seq, arg_max(seq, (t, item, seq)) last_seq, min(t) start_s, max(t) end_s, max(t) - min(t) duration_s, count(*) n
  from counted group by user_id, k)"""

SQL = {
    "p1_found": f"with {CHECKINS} select item from checkin_rows where item is not null group by item having 200 * count(*) >= (select count(*) from checkin_rows where item is not null)",
    "p2_found": f"""with recursive links as (select {norm('user_id')} a, {norm('other_id')} b from user_links),
edges as (select a, b from links where a is not null and b is not null and a <> b union select b, a from links where a is not null and b is not null and a <> b),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
active as (select distinct {norm('user_id')} u from decisions)
select distinct a user_a, b user_b from reach where a < b and a in (select u from active where u is not null) and b in (select u from active where u is not null)""",
    "p2_members": f"""with recursive links as (select {norm('user_id')} a, {norm('other_id')} b from user_links),
edges as (select a, b from links where a is not null and b is not null and a <> b union select b, a from links where a is not null and b is not null and a <> b),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
active as (select distinct {norm('user_id')} u from decisions)
select a user_id, least(a, min(b)) root from reach where a in (select u from active where u is not null) group by a""",
    "p6_found": _latest_sql(5, "user_id, pos, seq"),
    "p6_latest_20": _latest_sql(20, "user_id, pos, t, item, seq"),
    "p7_found": f"{_RUNS} select user_id, first_seq, last_seq from runs where n >= 2",
    "p7_collapsed": f"{_RUNS} select * from runs",
}
