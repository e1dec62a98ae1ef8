"""Small pieces every operator shares: ids, times, stored intermediate results."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t"


def norm_id(c: Column | str) -> Column:
    """Canonical id: spaces and tabs cut at both ends, lower case; null when nothing but blanks is left."""
    c = F.col(c) if isinstance(c, str) else c
    cut = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(F.btrim(cut, F.lit(" \t\r\n\f\u00a0")) != "", cut)


def epoch_s(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 of a time column, whatever the session's time zone (naive times are read as UTC)."""
    kind = dict(df.dtypes)[name]
    q = f"`{name}`"
    if kind == "timestamp_ntz":
        # through decimals, so that times before 1970 are floored like the others
        return F.expr(f"cast(floor(cast(cast({q} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18,6))) as bigint)")
    if kind == "timestamp":
        return F.expr(f"(unix_micros({q}) - pmod(unix_micros({q}), 1000000)) div 1000000")
    if kind == "date":
        return F.expr(f"cast(unix_date({q}) as bigint) * 86400")
    return F.col(name).cast("bigint")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; choose one only on a single machine where none is configured."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "stridewell-checkpoints"))


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
