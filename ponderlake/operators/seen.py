"""Keys seen in earlier runs: a persisted index that new splits probe and extend, instead of a scan of all that was seen.

The index is a folder: ``keys`` (digests, in a directory for each page of hash values) and ``blooms`` (bitmaps of 2 ** 15 bits
for each page and part of it), with a directory for each run below both.  A split's keys meet the bitmaps first: a key whose
bit isn't set is new for certain.  Only the others are looked up, and only their pages are read.  What is new is then written
as a run of its own, so a run that failed is written again as a whole, and one that ended isn't touched.

A bitmap that fills costs reads, never results.  Bitmaps grow with runs and pages, not with rows, and are joined by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import readers

_BITS = 15


class KeyIndex:
    """``path`` is the index's folder; ``pages`` and ``parts`` (bitmaps of a page) are fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, pages: int = 64, parts: int = 16):
        self.spark, self.path, self.pages, self.parts = spark, path.rstrip("/"), pages, parts
        #: Pages that the last probe read.
        self.probed: list[int] = []

    def _placed(self, rows: DataFrame, key: Column) -> DataFrame:
        digest = F.sha2(key.cast("string").cast("binary"), 256)
        h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return rows.select("*", digest.alias("__key"), F.pmod(h, F.lit(self.pages)).cast("int").alias("__page"),
                           F.pmod(F.floor(h / self.pages), F.lit(self.parts)).cast("int").alias("__part"),
                           F.pmod(F.floor(h / (self.pages * self.parts)), F.lit(1 << _BITS)).cast("int").alias("__at"))

    def _table(self, name: str, schema: str) -> DataFrame:
        if not readers.exists(self.spark, f"{self.path}/{name}/run=*"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def runs(self) -> list[int]:
        """Numbers of the runs that ended."""
        return sorted(r.run for r in self._table("blooms", "run int").select("run").distinct().collect())

    def probe(self, rows: DataFrame, key: Column) -> DataFrame:
        """``rows`` with ``seen``: whether their key is in the index.  Rows without a key are as seen as the key null."""
        x = self._placed(rows, F.coalesce(key.cast("string"), F.lit("")))
        blooms = self._table("blooms", "page int, part int, bitmap binary, run int")
        blooms = blooms.groupBy("page", "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        x = x.join(blooms.toDF("__page", "__part", "__bitmap"), ["__page", "__part"], "left")
        byte = "cast(conv(hex(substring(__bitmap, __at div 8 + 1, 1)), 16, 10) as int)"
        x = x.withColumn("__maybe", F.expr(f"coalesce(shiftright({byte}, __at % 8) & 1 = 1, false)"))
        self.probed = sorted(r[0] for r in x.where("__maybe").select("__page").distinct().collect())
        known = self.known(self.probed).select(F.col("key").alias("__key")).distinct().withColumn("__known", F.lit(True))
        x = x.join(known, "__key", "left").withColumn("seen", F.coalesce("__known", F.lit(False)))
        return x.drop("__page", "__part", "__at", "__bitmap", "__maybe", "__known", "__key")

    def known(self, pages: list[int]) -> DataFrame:
        """Keys of some pages; directories of others aren't opened."""
        return self._table("keys", "key string, run int, page int").where(F.col("page").isin(pages))

    def extend(self, rows: DataFrame, key: Column, run: int) -> None:
        """Writes the keys of ``rows`` as a run; the bitmaps come last and make it count."""
        x = self._placed(rows, F.coalesce(key.cast("string"), F.lit("")))
        keys = x.select(F.col("__key").alias("key"), F.col("__page").alias("page")).distinct()
        keys.repartition("page").write.mode("overwrite").partitionBy("page").parquet(f"{self.path}/keys/run={run}")
        blooms = x.groupBy(F.col("__page").alias("page"), F.col("__part").alias("part")).agg(
            F.bitmap_construct_agg("__at").alias("bitmap")
        )
        blooms.write.mode("overwrite").parquet(f"{self.path}/blooms/run={run}")

    def split(self, rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
        """The first row (by ``order``) of each key that no earlier run had; the keys become the index's next run."""
        run = max(self.runs(), default=-1) + 1
        new = self.probe(rows, key).where("NOT seen").drop("seen")
        first = Window.partitionBy(F.coalesce(key.cast("string"), F.lit(""))).orderBy(*order)
        new = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        path = f"{self.path}/splits/run={run}"
        new.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(new.schema).parquet(path)
        self.extend(out, key, run)
        return out
