"""One row of counts, recency and totals per entity, for hundreds of event types.

Event types become indices of a small dictionary, and an entity's state is a sparse vector of (index, count, total,
latest time) entries. The vectors merge by adding counts and totals and keeping the later time, so partial vectors are
built before the shuffle, and vectors of different days or sources can be merged later. Columns appear at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import epoch_s, norm_id, require_columns

#: A dictionary beyond this is no list of event types; it is refused rather than broadcast.
MAX_TYPES = 4096
OTHER = "(other)"


def type_dictionary(types: DataFrame, column: str = "cat") -> list[str]:
    """Sorted canonical event types of a (small) table of types; position in the list is the index."""
    rows = types.select(norm_id(column).alias("c")).filter("c is not null").distinct().limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return sorted(r.c for r in rows)


def sparse_vectors(
    events: DataFrame,
    types: list[str],
    user: str = "user_id",
    cat: str = "cat",
    ts: str = "ts",
    value: Column | None = None,
    distinct_by: tuple[str, ...] = (),
    between: tuple[int, int] | None = None,
    keep_unidentified: bool = False,
) -> DataFrame:
    """Partial-merge stage: one row per entity, `user_id` and `vec`, an array of (idx, n, total, last_s) sorted by idx.

    Types outside the dictionary are kept under the index len(types). With `distinct_by`, rows that agree in entity,
    type, time and these id columns count once in n, and total is still over all rows. `between` is [from, to) in
    seconds. Rows without entity, type, time or a `distinct_by` id take no part; an empty table gives no rows. With
    `keep_unidentified`, rows that only lack a `distinct_by` id are left out of n but not of total and last_s.
    """
    require_columns(events, user, cat, ts, *distinct_by)
    if len(types) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    keys = [f"_k{i}" for i in range(len(distinct_by))]
    if between and dict(events.dtypes)[ts] in ("timestamp", "timestamp_ntz"):
        # on the column as it is stored, a day wide on both sides for any zone: row groups of other times are not read
        low, high = (F.timestamp_seconds(F.lit(x)).cast(dict(events.dtypes)[ts]) for x in (between[0] - 86_400, between[1] + 86_400))
        events = events.filter((F.col(ts) >= low) & (F.col(ts) < high))
    rows = events.select(
        norm_id(user).alias("user_id"),
        norm_id(cat).alias("_cat"),
        epoch_s(events, ts).alias("_t"),
        (F.lit(1.0) if value is None else F.coalesce(value.cast("double"), F.lit(0.0))).alias("_v"),
        *(norm_id(c).alias(k) for c, k in zip(distinct_by, keys)),
    ).dropna(subset=["user_id", "_cat", "_t", *([] if keep_unidentified else keys)])
    if between:
        rows = rows.filter((F.col("_t") >= between[0]) & (F.col("_t") < between[1]))
    rows = _with_index(rows, types)
    if distinct_by:
        rows = rows.groupBy("user_id", "idx", "_cat", "_t", *keys).agg(F.sum("_v").alias("_v"))
    known = F.count(F.when(F.forall(F.array(*keys), lambda k: k.isNotNull()), 1)) if keys and keep_unidentified else F.count(F.lit(1))
    entries = rows.groupBy("user_id", "idx").agg(known.alias("n"), F.sum("_v").alias("total"), F.max("_t").alias("last_s"))
    return _vectors(entries)


def _with_index(rows: DataFrame, types: list[str]) -> DataFrame:
    spark = rows.sparkSession
    dictionary = spark.createDataFrame([(t, i) for i, t in enumerate(types)], "_cat string, idx int")
    # at most MAX_TYPES short strings, checked above
    return rows.join(F.broadcast(dictionary), "_cat", "left").withColumn("idx", F.coalesce("idx", F.lit(len(types))))


def _vectors(entries: DataFrame) -> DataFrame:
    return entries.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("idx", "n", "total", "last_s"))).alias("vec"))


def merge_vectors(*vectors: DataFrame) -> DataFrame:
    """Merge vectors of the same dictionary, for example of several days: counts and totals add up, the later time stays."""
    rows = vectors[0]
    for v in vectors[1:]:
        rows = rows.unionByName(v)
    entries = rows.select("user_id", F.inline("vec"))
    return _vectors(entries.groupBy("user_id", "idx").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_s").alias("last_s")))


def entries(vectors: DataFrame, types: list[str]) -> DataFrame:
    """Long form: user_id, cat, n, total, last_s."""
    names = F.array(*(F.lit(t) for t in [*types, OTHER]))
    return vectors.select("user_id", F.inline("vec")).select("user_id", F.element_at(names, F.col("idx") + 1).alias("cat"), "n", "total", "last_s")


def column_names(types: list[str]) -> list[str]:
    """Distinct column stems of the types: letters and digits, the index where two would clash."""
    stems = ["".join(x if x.isalnum() else "_" for x in t) for t in [*types, OTHER.strip("()")]]
    return [s if stems.count(s) == 1 else f"{s}_{i}" for i, s in enumerate(stems)]


def expand(vectors: DataFrame, types: list[str]) -> DataFrame:
    """Wide table: user_id, then n_X, total_X and last_s_X for every type X and for other types (0, 0 and null where absent)."""
    stems = column_names(types)
    schema = ", ".join(["user_id string", *(f"`n_{s}` bigint, `total_{s}` double, `last_s_{s}` bigint" for s in stems)])
    width = len(stems)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):  # a few MB of dense columns at once
                batch = whole.slice(at, 2000)
                vec = batch.column(1)
                flat = vec.flatten()
                row = np.repeat(np.arange(batch.num_rows), np.diff(vec.offsets.to_numpy()))
                idx, n, total, last = (flat.field(k).to_numpy() for k in range(4))
                counts = np.zeros((width, batch.num_rows), dtype=np.int64)
                totals = np.zeros((width, batch.num_rows))
                times = np.zeros((width, batch.num_rows), dtype=np.int64)
                there = np.zeros((width, batch.num_rows), dtype=bool)
                counts[idx, row], totals[idx, row], times[idx, row], there[idx, row] = n, total, last, True
                columns = [batch.column(0)]
                for k in range(width):
                    columns += [pa.array(counts[k]), pa.array(totals[k]), pa.array(times[k], mask=~there[k])]
                yield pa.RecordBatch.from_arrays(columns, names=["user_id", *(f"{a}_{s}" for s in stems for a in ("n", "total", "last_s"))])

    return vectors.select("user_id", "vec").mapInArrow(scatter, schema)
