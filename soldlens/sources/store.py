"""An append-only Parquet store: readings, searches and pages are facts; listings are derived and published as snapshots.

A snapshot is written to a new folder and becomes current when a pointer file is written after it, so a failed publish
changes nothing. All paths go through Spark, and so may lie in any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


class SchemaTooNew(RuntimeError):
    """The store was written by a newer version."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        at = self._pointers("meta")
        version = at.agg(F.max("version")).first()[0] if at is not None else None
        if version is not None and version > SCHEMA_VERSION:
            raise SchemaTooNew(f"store has schema {version}; this version reads up to {SCHEMA_VERSION}")
        if version is None or version < SCHEMA_VERSION:
            spark.range(1).select(F.lit(SCHEMA_VERSION).alias("version"), F.lit("").alias("path"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{self.root}/_meta")

    def _pointers(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.root}/_{name}") if fs.exists(path) else None

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds facts; a table may gain columns, which older rows have as null."""
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def put(self, name: str, rows: DataFrame, part: str) -> None:
        """Adds facts under a part's name (folders `key=value`), in place of what is there: writing them again changes nothing."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}.parts/{part}")

    def facts(self, name: str) -> DataFrame:
        """All facts of a table; LookupError without any."""
        found = []
        for folder in (name, f"{name}.parts"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                found.append(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{folder}"))
        if not found:
            raise LookupError(f"no facts of {name} in {self.root}")
        return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)

    def publish(self, name: str, rows: DataFrame) -> str:
        """Writes a snapshot, then points to it."""
        path = f"{self.root}/snapshots/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        pointer = self.spark.range(1).select(F.lit(SCHEMA_VERSION).alias("version"), F.lit(path).alias("path"), F.current_timestamp().alias("at"))
        pointer.coalesce(1).write.mode("append").parquet(f"{self.root}/_{name}")
        return path

    def current(self, name: str) -> DataFrame:
        pointers = self._pointers(name)
        if pointers is None:
            raise LookupError(f"no snapshot of {name} in {self.root}")
        return self.spark.read.parquet(pointers.agg(F.max_by("path", "at")).first()[0])


def next_id(table: DataFrame, column: str = "id") -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1
