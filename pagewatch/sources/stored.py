"""Stored tables that are changed: insert, insert or ignore, upsert, update and delete, each with its count of affected rows.

A table is cut into hash buckets of its key. A change writes the buckets it touches anew, below the folder of its version,
and then one small manifest file that names the version of every bucket. The manifest appears by one rename, so a reader
sees a change whole or not at all, and what a failed change left behind is never read and replaced by the next one. Earlier
versions stay readable. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.operators import tables

MANIFEST = "version int, action string, affected bigint, held array<int>, counts array<bigint>"


class StoredTable:
    """The table in ``folder`` with a unique ``key``; null keys are equal to each other.

    ``buckets`` is fixed when the table is made: about one for every 128 MB that it is to hold. A change reads and writes
    only the buckets that hold its keys or, for update and delete, rows that meet the condition.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], buckets: int = 16) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), list(key)
        self.schema = spark.createDataFrame([], schema).schema
        if "bucket" in self.schema.names:
            raise ValueError("bucket is the name of the folders")
        self.buckets = buckets

    def history(self) -> DataFrame:
        """A row per version: what was done, rows affected, and per bucket the version that holds it and its rows."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifests")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def _manifest(self, version: int | None = None) -> tuple[int, list[int], list[int]]:
        known = self.history()
        last = known.agg(F.max("version")).first()[0]
        if last is None:
            return -1, [-1] * self.buckets, [0] * self.buckets
        row = known.where(F.col("version") == (last if version is None else version)).first()
        if row is None:
            raise ValueError(f"no version {version} of {self.folder}")
        if len(row["held"]) != self.buckets:
            raise ValueError(f"{self.folder} has {len(row['held'])} buckets")
        return row["version"], row["held"], row["counts"]

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a version."""
        _, held, counts = self._manifest(version)
        return self._read(held, counts, range(self.buckets))

    def _read(self, held: list[int], counts: list[int], buckets: Sequence[int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={held[b]}/bucket={b}" for b in buckets if counts[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> dict[int, int]:
        """Rows per bucket; there are no more of these than buckets."""
        return dict(rows.groupBy(self._bucket().alias("bucket")).agg(F.count(F.lit(1))).collect())

    def _aligned(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema
        ])

    def _commit(self, action: str, changed: DataFrame, touched: Sequence[int], manifest: tuple, affected: int | None) -> int:
        """Write the touched buckets and the manifest. Without ``affected`` it is what the table grew by."""
        version, held, counts = manifest[0] + 1, list(manifest[1]), list(manifest[2])
        if touched:
            data = f"{self.folder}/data/version={version}"
            placed = changed.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(data)
            # Without a column the files are only counted; the folder name tells the bucket. Empty buckets have no folder.
            found = dict(self.spark.read.schema("bucket int").parquet(data).groupBy("bucket").agg(F.count(F.lit(1))).collect())
            for b in touched:
                held[b], counts[b] = version, found.get(b, 0)
        grown = sum(counts) - sum(manifest[2])
        affected = grown if affected is None else affected
        line = self.spark.createDataFrame([(version, action, affected, held, counts)], MANIFEST)
        line.coalesce(1).write.mode("append").json(f"{self.folder}/manifests")
        return affected

    def insert(self, rows: DataFrame) -> int:
        """Add rows; a key that is there already, or twice among the rows, is an error and changes nothing."""
        return self._add("insert", rows, None)

    def insert_or_ignore(self, rows: DataFrame, order: Sequence[str]) -> int:
        """Add the rows whose key is not there yet, of rows with one key the first in ``order``; how many were added."""
        return self._add("insert or ignore", rows, order)

    def _add(self, action: str, rows: DataFrame, order: Sequence[str] | None) -> int:
        manifest, touched = self._manifest(), self._touched(rows)
        base = self._read(manifest[1], manifest[2], sorted(touched))
        first = tables.insert_or_ignore(base, rows, self.key, order or self.key)
        if order is None:
            asked = sum(touched.values())
            fits = first.count() - sum(manifest[2][b] for b in touched)
            if fits != asked:
                raise ValueError(f"{asked - fits} of {asked} rows have a key that is not unique")
        return self._commit(action, self._aligned(first), sorted(touched), manifest, None)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows replace the columns they have, or are added; every row counts. Of rows with one key the last in ``order``
        holds; without it keys must be unique."""
        manifest, touched = self._manifest(), self._touched(rows)
        if order is None and rows.groupBy(*self.key).count().where("count > 1").limit(1).count():
            raise ValueError("several rows of one key and no order")
        base = self._read(manifest[1], manifest[2], sorted(touched))
        changed = tables.upsert(base, rows, self.key, order)
        return self._commit("upsert", self._aligned(changed), sorted(touched), manifest, sum(touched.values()))

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        """Change the rows that meet ``condition``; the key stays as it is."""
        if set(values) & set(self.key):
            raise ValueError("the key is not updated: delete and insert")
        manifest, touched, base = self._hit(condition)
        changed, _ = tables.update_where(base, condition, values)
        return self._commit("update", self._aligned(changed), sorted(touched), manifest, sum(touched.values()))

    def delete(self, condition: Column) -> int:
        manifest, touched, base = self._hit(condition)
        left, _ = tables.delete_where(base, condition)
        return self._commit("delete", left, sorted(touched), manifest, sum(touched.values()))

    def _hit(self, condition: Column) -> tuple[tuple, dict[int, int], DataFrame]:
        manifest = self._manifest()
        touched = self._touched(self._read(manifest[1], manifest[2], range(self.buckets)).where(condition))
        return manifest, touched, self._read(manifest[1], manifest[2], sorted(touched))
