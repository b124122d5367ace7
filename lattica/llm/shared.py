"""Tables that cut a query's lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_TABLES: list[str] = []
_CONF: list = []
#: Functions that empty what a worker keeps from task to task of one stage.
CACHES: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it names none, a folder of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as a table in the shared folder and read from there.

    The table is deleted by ``drop_tables``, or when the driver's Python ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if not _CONF:
        _CONF.append(spark._jsc.hadoopConfiguration())
        atexit.register(_at_exit, spark)
    _TABLES.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The tables that ``written`` made and that still exist, oldest first."""
    return list(_TABLES)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in _TABLES:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(_CONF[0]).delete(p, True)
            _TABLES.remove(path)


def _at_exit(spark: SparkSession) -> None:
    try:
        drop_tables(spark, tables())
    except Exception:  # noqa: BLE001 - the session may have ended; nothing more can be done then
        pass


def fresh(taken, *names: str) -> list[str]:
    """``names`` with underscores put before them until none is taken, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def release(keep_caches: bool = False) -> None:
    """Give memory that a Python worker no longer uses back to the machine: idle workers live on beside later stages."""
    for clear in () if keep_caches else CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
