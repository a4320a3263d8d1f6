"""What the operators share: cutting lineage, size-checked broadcasts, packed text columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir, which driver and executors share. Where the setting is unset, a local master gets a new temporary folder; a cluster raises, since its executors would write to disks of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="tidegauge-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/tidegauge-{spark.sparkContext.applicationId}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes as a whole when the driver ends."""
    folder = shared_dir(spark)
    fs, p = _hadoop(spark, folder)
    fs.deleteOnExit(p)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freeing(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Inside, Spark deletes an execution's shuffle files at its end instead of when the driver happens to collect its garbage. rows: of an Arrow batch at most, for rows that are large."""
    new = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, lost executors don't recompute it, and its shuffle files go. rows: see freeing()."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with freeing(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*cuts: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for df in cuts:
        spark = df.sparkSession
        folder = shared_dir(spark).removeprefix("file://")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder in path:
                fs, p = _hadoop(spark, path)
                fs.delete(p, True)


def broadcast_up_to(df: DataFrame, rows: int, text: str | None = None, size: int = 32_000_000) -> DataFrame:
    """df with a broadcast hint only if its counted rows are at most `rows`, and the bytes of its column `text`, if it has one, at most `size`; beyond that, as it is, for a shuffled join."""
    n, held = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text)) if text else F.lit(0)).head()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def trim() -> None:
    """Give freed memory back to the system: Python workers live on for later tasks, and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def lower_az(text):
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
