"""A folder that the driver and all executors share, for files written and read again in one session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders made since each scratch that is open; those that lazy results may read, which go when Python ends.
_open: list[list[tuple[SparkSession, str]]] = []
_left: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own, not there yet, below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves in local mode only: on a cluster others couldn't read it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="ponderlake-io-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_sweep)
    for made in [*_open, _left]:
        made.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: its lineage is cut, and lost executors recompute from there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    """Drops what is left, where the session still runs."""
    for spark, path in _left:
        with suppress(Exception):
            if spark.sparkContext._jsc is not None:
                drop(spark, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Drops all folders named inside when left, also on failure: for work whose results don't read them any more."""
    made: list[tuple[SparkSession, str]] = []
    _open.append(made)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not made]
        for spark, path in made:
            drop(spark, path)
        _left[:] = [x for x in _left if x not in made]
