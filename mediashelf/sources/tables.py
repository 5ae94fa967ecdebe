"""Stored tables: Parquet folders partitioned by a hash bucket of the key that rows are found by.

Spark lists and prunes the partitions; a batch overwrites the buckets it touches with Spark's
dynamic partition overwrite, or appends.  Tables change one after the other, dimensions before
what refers to them.  A batch that is cut off is done again from its documents, and doing it
again gives the same tables, so nothing has to be undone.  One application writes to a store.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashelf.operators.lookups import size_of
from mediashelf.schemas import NAME_TYPES, TABLES

_TURNS: dict[str, threading.RLock] = defaultdict(threading.RLock)


class Store:
    """A folder of tables, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets or spark.read.parquet(f"{self.root}/settings").first().buckets

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 8) -> Store:
        """A new store with the seed name types; ``buckets`` fixes how finely tables are split.

        A batch rewrites whole buckets of the tables it updates, so large tables want
        thousands of buckets.
        """
        store = cls(spark, root, buckets)
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{store.root}/settings")
        seed = [("nametype", i + 1, name) for i, name in enumerate(NAME_TYPES)]
        store.append("name", spark.createDataFrame(seed, TABLES["name"].ddl))
        return store

    def turn(self) -> threading.RLock:
        """Held while a batch is applied: streams of one application take turns."""
        return _TURNS[self.root]

    def _exists(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    # -- reading -------------------------------------------------------------------

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def row_bucket(self, name: str) -> Column:
        """Bucket of a table's row, from its bucketing column in its stored type."""
        table = TABLES[name]
        return self.bucket_of(F.col(table.bucket_by).cast(table.type_of(table.bucket_by)))

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of a table that the keys fall in; at most one number per bucket."""
        return self._distinct(keys, self.row_bucket(name))

    def buckets_with(self, keys: DataFrame, key: str) -> list[int]:
        """Buckets, of any table bucketed on ``key``, that the keys fall in."""
        return self._distinct(keys, self.bucket_of(F.col(key)))

    @staticmethod
    def _distinct(keys: DataFrame, bucket: Column) -> list[int]:
        return [row.bucket for row in keys.select(bucket.alias("bucket")).distinct().collect()]

    def _stored(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        ddl = f"{TABLES[name].ddl}, bucket int"
        if not self._exists(name):
            return self.spark.createDataFrame([], ddl)
        stored = self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")
        if buckets is None or len(buckets) == self.buckets:
            return stored
        return stored.filter(F.col("bucket").isin(buckets))

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or only some of its buckets."""
        table = TABLES[name]
        rows = self._stored(name, buckets).filter(F.col(table.bucket_by).isNotNull())
        return rows.select(*table.columns)

    def rows(self, name: str, buckets: list[int]) -> int:
        """About how many rows the buckets hold, from the files' footers."""
        return self._stored(name, buckets).count()

    def max_id(self, name: str) -> int:
        """The largest surrogate key given out."""
        return self.read(name).agg(F.max(TABLES[name].surrogate)).first()[0] or 0

    # -- writing -------------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        (
            rows.hint("rebalance", "bucket").write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket").parquet(f"{self.root}/{name}")
        )

    def _rows(self, name: str, frame: DataFrame) -> DataFrame:
        return frame.select(*TABLES[name].columns, self.row_bucket(name).alias("bucket"))

    def append(self, name: str, frame: DataFrame) -> None:
        """Adds rows; stored files stay as they are."""
        self._write(name, self._rows(name, frame), "append")

    def replace(self, name: str, frame: DataFrame, buckets: list[int]) -> None:
        """Puts ``frame``, which must not read the table, in place of all rows in ``buckets``.

        Only partitions with rows are overwritten, so every bucket gets a row of nulls as well,
        which empties it if nothing is left; readers leave those rows out.
        """
        held = self.spark.range(self.buckets).filter(F.col("id").isin(buckets))
        held = held.select(F.col("id").cast("int").alias("bucket"))
        self._write(
            name, self._rows(name, frame).unionByName(held, allowMissingColumns=True), "overwrite")

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that was applied to the end, -1 if none."""
        if not self._exists("batches"):
            return -1
        batches = self.spark.read.schema("batch_id bigint, stream string").parquet(f"{self.root}/batches")
        last = batches.filter(F.col("stream") == stream).agg(F.max("batch_id")).first()[0]
        return -1 if last is None else last

    def batch_applied(self, stream: str, batch_id: int) -> None:
        """Notes that all tables hold a batch; one row per stream."""
        row = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(stream).alias("stream"))
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "stream").parquet(f"{self.root}/batches")

    def compact(self, files_per_bucket: int = 16) -> bool:
        """Rewrites buckets that appends have spread over many files; false if there are none."""
        with self.turn():
            batch, found = Batch(self), False
            for name in filter(self._exists, TABLES):
                folders = Counter(
                    re.findall(r"/bucket=(\d+)/", path)[-1] for path in self._stored(name).inputFiles())
                worn = [int(b) for b, files in folders.items() if files > files_per_bucket]
                if worn:
                    self.replace(name, batch.stage(self.read(name, worn), f"worn-{name}"), worn)
                    found = True
            batch.drop_stage()
            return found


class Batch(Store):
    """A store while one batch is applied to it; intermediate results are written beside the tables."""

    def __init__(self, store: Store):
        super().__init__(store.spark, store.root, store.buckets)
        self.folder = f"_stage/{uuid.uuid4().hex}"
        self._sizes: dict[str, int] = {}

    def stage(self, frame: DataFrame, label: str) -> DataFrame:
        """Writes an intermediate result once and reads it back."""
        path = f"{self.root}/{self.folder}/{label}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop_stage(self) -> None:
        """Removes the intermediate results, once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def size(self, name: str) -> int:
        """Bytes of a table; measured again only after it was written to."""
        if name not in self._sizes:
            self._sizes[name] = size_of(self.read(name))
        return self._sizes[name]

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        super()._write(name, rows, mode)
        self._sizes.pop(name, None)
