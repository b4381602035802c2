"""Tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names it on a cluster; a folder of our own is made only
where that is unset (tests in local mode).  A table written there cuts lineage
and survives the loss of executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Lists of tables made since each scratch that is open.
_open: list[list[tuple[SparkSession, str]]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that lazy results of these operators need when they run.

    Small Arrow batches bound the memory of a Python worker on long texts; shuffle files are freed with the query that
    made them.  Both stay set, as the caller runs the result; whatever an operator needs for a moment it sets by ``conf``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


@contextmanager
def conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings under ``spark.sql.execution.arrow`` for jobs run inside; the former ones come back."""
    names = {f"spark.sql.execution.arrow.{k}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own only in local mode, where driver and executors are one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="ponderlake-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # type: ignore[attr-defined]
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops all tables made inside, also on failure, but for those given to the function it yields."""
    made: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._shared_path)  # type: ignore[attr-defined]
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open[:] = [x for x in _open if x is not made]  # by identity: lists of the same tables are equal
        for spark, path in made:
            if path not in kept:
                _delete(spark, path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan, one number."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def buckets(spark: SparkSession, size: int, target: int) -> int:
    """Buckets for ``size`` bytes: of at most about ``target`` each, at least as many as shuffle partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target))


#: Buckets that Spark allows a table.  Beyond that many times a bucket's size, buckets grow.
MOST_BUCKETS = 100_000


@contextmanager
def bucketed(df: DataFrame, key: str, n: int) -> Iterator[DataFrame]:
    """``df`` dealt once into ``n`` buckets by ``key`` in the shared folder: joins on ``key`` inside move only their other side."""
    spark, n = df.sparkSession, min(n, MOST_BUCKETS)
    name, path = f"ponderlake_{uuid.uuid4().hex}", f"{folder(spark)}/bucketed-{uuid.uuid4().hex}"
    try:
        out = df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd")
        out.format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


#: Ids that may be broadcast (about 8 MB in memory); more are joined by a shuffle.
BROADCAST_IDS = 250_000


def checked(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it is found small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't among ``ids`` (one column, ``doc_id``); rows without an id stay."""
    gone = checked(table(ids.select("doc_id").distinct(), "gone"))
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Delete tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_shared_path", None):
            _delete(df.sparkSession, path)
