"""Events as rows with a whole second, and tables of deltas and snapshots."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Events in one of FORMATS; text formats need a schema."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one of a local master. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidegauge-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/tidegauge-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def second_of(df: DataFrame, ts: str) -> Column:
    """The epoch second of a timestamp column, or of a long of milliseconds. A timestamp without zone counts as UTC, whatever the session's zone."""
    kind = dict(df.dtypes)[ts]
    if kind == "timestamp_ntz":
        return F.floor((F.col(ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)")).cast("long")
    if kind == "timestamp":
        return F.unix_seconds(ts)
    if kind in ("bigint", "int"):
        return F.floor(F.col(ts) / 1000).cast("long")
    raise ValueError(f"{ts} is neither a timestamp nor milliseconds")


def between(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    """Rows of seconds from start to before end, by a comparison of the bare column, which reaches the scan."""
    kind = dict(df.dtypes)[ts]
    if kind == "timestamp_ntz":
        lit = lambda s: F.expr(f"timestamp_ntz'{datetime(1970, 1, 1) + timedelta(seconds=s)}'")
    elif kind == "timestamp":
        lit = lambda s: F.timestamp_seconds(F.lit(s))
    else:
        lit = lambda s: F.lit(s * 1000)
    return df.where((F.col(ts) >= lit(start)) & (F.col(ts) < lit(end)))
