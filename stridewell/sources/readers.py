"""Readers and writers for check-in releases, JSON lines, score folders, reports and metric pages.

Every reader declares its schema; nothing is inferred. Rows that don't parse are dropped where the format's own readers
skip them, and fail the job where those raise.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "user STRING, ts TIMESTAMP_NTZ, item STRING, cat STRING, lat DOUBLE, lon DOUBLE, name STRING"
_ORDER = ["user", "ts", "item", "cat", "lat", "lon", "name"]


def _blank(c: Column) -> Column:
    return F.when(c != "", c)


def _lines(spark: SparkSession, path: str, sep: str, fields: int) -> DataFrame:
    """Split lines with at least `fields` fields; malformed UTF-8 becomes replacement characters."""
    parts = spark.read.text(path).select(F.split("value", sep, -1).alias("p"))
    return parts.filter(F.size("p") >= fields)


def _event(df: DataFrame, **cols: Column) -> DataFrame:
    kinds = dict(x.split(" ") for x in EVENT.split(", "))
    return df.select(*(cols.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in _ORDER)).filter("ts is not null")


def read_tab8(spark: SparkSession, path: str) -> DataFrame:
    """Eight tab-separated fields: user, venue, category id, category, lat, lon, offset, 'Tue Apr 03 18:00:09 +0000 2012'."""
    p = _lines(spark, path, "\t", 8)
    at = lambda k: F.col("p")[k]
    stamp = F.concat(F.substring(at(7), 5, 15), F.lit(" "), F.substring(at(7), 21, 5), F.lit(" "), F.substring(at(7), 27, 4))
    utc = F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit("MMM dd HH:mm:ss Z yyyy")), F.current_timezone())
    return _event(p, user=at(0), ts=utc, item=at(1), cat=at(3), lat=_blank(at(4)), lon=_blank(at(5)))


def read_tab5(spark: SparkSession, path: str) -> DataFrame:
    """Five tab-separated fields, plain or gzip: user, ISO time with Z, lat, lon, place. A gzip file is one split."""
    p = _lines(spark, path, "\t", 5)
    at = lambda k: F.col("p")[k]
    return _event(p, user=at(0), ts=_naive(at(1)), item=at(4), lat=_blank(at(2)), lon=_blank(at(3)))


def _naive(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.substring(c, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def read_steps_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: user_id, venue_id, latitude, longitude, name, venue_category, timestamp, in any column order."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", enforceSchema=False)
    has = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    return _event(raw, user=F.col("user_id"), ts=_naive(F.col("timestamp")), item=F.col("venue_id"), cat=has("venue_category"), lat=_blank(has("latitude")), lon=_blank(has("longitude")), name=_blank(has("name")))


def read_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header uid, d, t, x, y: day and half-hour slot from 2000-01-01; the item is the cell x_y."""
    raw = spark.read.csv(path, header=True, schema="uid STRING, d INT, t INT, x INT, y INT", mode="DROPMALFORMED")
    ts = F.expr("timestampadd(MINUTE, t * 30, timestampadd(DAY, d, timestamp_ntz'2000-01-01 00:00:00'))")
    return _event(raw, user=F.col("uid"), ts=ts, item=F.concat_ws("_", F.col("x"), F.col("y")))


READERS = {"tab8": read_tab8, "tab5": read_tab5, "steps_csv": read_steps_csv, "grid_csv": read_grid_csv}


def limited(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a fixed order; a limit without one would depend on the tasks."""
    if n < 0:
        raise ValueError("the limit must not be negative")
    return rows.orderBy(*order).limit(n)


def resolve(spark: SparkSession, layout: str, path: str, limit: int | None = None) -> DataFrame:
    """Events in layout `layout`; an unknown layout or a missing path fails here, before any job starts. With `limit`, the
    first so many in the files' order.
    """
    if layout not in READERS:
        raise KeyError(f"unknown layout {layout!r}; there are {', '.join(sorted(READERS))}")
    if "://" not in path and not path.startswith("file:") and not os.path.exists(path):
        raise FileNotFoundError(path)
    rows = READERS[layout](spark, path)
    return rows if limit is None else limited(with_seq(rows), limit, "seq").drop("seq")


def resolve_named(spark: SparkSession, registry: dict[str, tuple[str, str]], name: str, root: str, limit: int | None = None) -> DataFrame:
    """Events of a data set by name: `registry` has its layout and its path under `root`."""
    if name not in registry:
        raise KeyError(f"unknown data set {name!r}; there are {', '.join(sorted(registry))}")
    layout, path = registry[name]
    return resolve(spark, layout, f"{root.rstrip('/')}/{path}", limit)


def checked_json(text: str, kind: type, allowed: set[str] | None = None):
    """A JSON argument that must be of a type, a dict with keys among `allowed`; fails with what is wrong."""
    value = json.loads(text)
    if not isinstance(value, kind):
        raise TypeError(f"expected {kind.__name__}, not {type(value).__name__}")
    if allowed is not None and isinstance(value, dict) and (odd := sorted(set(value) - allowed)):
        raise ValueError(f"unknown keys: {', '.join(odd)}")
    return value


def with_seq(df: DataFrame) -> DataFrame:
    """Add seq, increasing in file order (of one file, or of files in their listing order)."""
    return df.withColumn("seq", F.monotonically_increasing_id())


# Rows of the JSON-lines formats.
QUESTION = "ds STRING, user STRING, k INT, answer_idx INT, prompt STRING, cand_km ARRAY<DOUBLE>"
INSTANCE = "ds STRING, user STRING, prompt STRING, completion STRING, target_item STRING, history_len INT"
PREDICTION = "row INT, user STRING, answer_idx INT, pick INT, logprobs ARRAY<DOUBLE>"
SCORE = "user STRING, answer_idx INT, scores ARRAY<DOUBLE>"
CARD = (
    "settings ARRAY<STRUCT<label STRING, tau DOUBLE, ask_all BOOLEAN, accuracy DOUBLE, accuracy_ci ARRAY<DOUBLE>, ask_rate DOUBLE>>, "
    "reliability ARRAY<STRUCT<lo DOUBLE, hi DOUBLE, n INT, accuracy DOUBLE, mean_conf DOUBLE>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, order: list[str], exclusive: bool = True, one_file: bool = False) -> None:
    """JSON lines ordered by `order`; refuses to overwrite unless told. `one_file` is for small results only."""
    rows = df.orderBy(*order)
    (rows.coalesce(1) if one_file else rows).write.mode("errorifexists" if exclusive else "overwrite").json(path)


def read_object_map(spark: SparkSession, path: str, at_least: int = 1) -> DataFrame:
    """item, score of one JSON object, bare or under "scores"; fails where it has fewer than `at_least` entries."""
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.scores"), F.col("value")).alias("j"))
    rows = raw.select(F.explode(F.from_json("j", "map<string,double>")).alias("item", "score")).filter("score is not null")
    if rows.limit(at_least).count() < at_least:
        raise ValueError(f"{path}: fewer than {at_least} scores")
    return rows


def read_score_folders(spark: SparkSession, root: str) -> DataFrame:
    """Score rows of <root>/<arm>[/<world>]/s<seed>/scores_[<prefix>_]<split>.jsonl, with arm, world, seed and split."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "scores_*.jsonl").schema(SCORE).json(root, mode="FAILFAST")
    raw = raw.withColumn("_path", F.input_file_name())
    pat = r"/([^/]+)(?:/([^/]+))?/s(\d+)/scores_(?:.*_)?([^_/]+)\.jsonl$"
    base = F.expr(f"substring_index(_path, '/{os.path.basename(root.rstrip('/'))}', -1)")
    part = lambda k: F.regexp_extract(base, pat, k)
    return raw.select("user", "answer_idx", "scores", part(1).alias("arm"), _blank(part(2)).alias("world"), part(3).cast("int").alias("seed"), part(4).alias("split"))


def read_summary(spark: SparkSession, path: str, split: str, metric: str = "Hit@1") -> DataFrame:
    """One row with the stored mean of a metric: files[split][metric].mean."""
    return spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.files['{split}']['{metric}'].mean").cast("double").alias("mean"))


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """name, ring (number), points of the (Multi)Polygon outlines of a GeoJSON feature collection."""
    shape = "features ARRAY<STRUCT<properties: MAP<STRING,STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    f = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("features").alias("f"))
    poly = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = f.select(F.col("f.properties")["name"].alias("name"), F.posexplode(F.when(F.col("f.geometry.type") == "Polygon", poly).otherwise(multi)).alias("ring", "points"))
    return rings


def read_metric_lines(lines: DataFrame) -> DataFrame:
    """metric, labels (map), value of the lines (column `value`) of a metrics page; comments and other lines are dropped."""
    name = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)"
    part = lambda k: F.regexp_extract("value", name, k)
    pairs = F.transform(F.regexp_extract_all(part(2), F.lit(r'([A-Za-z_]\w*="[^"]*")'), 1), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, '"([^"]*)"', 1).alias("v")))
    value = F.when(part(3) == "+Inf", F.lit(float("inf"))).otherwise(F.expr(f"try_cast(regexp_extract(value, r'{name}', 3) as double)"))
    others = [F.col(c) for c in lines.columns if c != "value"]
    return lines.filter(F.col("value").rlike(name)).select(*others, part(1).alias("metric"), F.map_from_entries(pairs).alias("labels"), value.alias("value")).filter("value is not null")


def read_log_lines(lines: DataFrame, schema: str = "rid STRING, endpoint STRING, status INT, ms DOUBLE") -> DataFrame:
    """Fields of the lines (column `value`) that are JSON objects with a request id; others are ignored."""
    rows = lines.filter(F.ltrim("value").startswith("{")).select(F.from_json("value", schema).alias("r"))
    return rows.select("r.*").filter("rid is not null")


def write_report(df: DataFrame, path: str) -> None:
    """The one row of `df` as an indented JSON file; a report is small by its nature."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(rows[0]), f, ensure_ascii=False, indent=2)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """The rows of a small result as a markdown table; more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
