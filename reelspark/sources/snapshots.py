"""A stored table as versions, changed only on the version that the writer has read.

A version is a small file that names a folder of Parquet for each bucket of the key. A writer writes the
buckets it changes anew, refers to the others, and publishes the next number; of two writers on one
version one gets the number, the other a :class:`Conflict`, after which :meth:`VersionedTable.update`
reads again and judges its rows anew. Readers of a version are not disturbed; nothing is ever changed in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelspark.sources.publish import names, opened, publish
from reelspark.sources.shared import cut


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


def forward(last: str, now: Column) -> Column:
    """A stamp that never goes back: ``now``, or the last stamp where that is later."""
    return F.greatest(F.coalesce(F.col(last), now), now)


class VersionedTable:
    """Rows of ``schema`` with a unique ``key`` below ``root``.

    The number of ``buckets`` is fixed for a table; it bounds what a version's file lists, and a change
    rewrites the buckets that it touches. A null in the key is a value like others.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._fs, self._path = opened(self.root)

    def latest(self) -> int:
        """The newest version; -1 before the first."""
        found = names(self._fs, f"{self._path}/versions")
        return int(found[-1].partition(".")[0]) if found else -1

    def _parts(self, version: int) -> dict[str, str]:
        if version < 0:
            return {}
        with self._fs.open_input_stream(f"{self._path}/versions/{version:020d}.json") as file:
            return json.loads(file.read())

    def _load(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{p}" for p in parts))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        return self._load(sorted(self._parts(self.latest() if version is None else version).values()))

    def commit(self, base: int, rows: DataFrame) -> int:
        """Version ``base`` with ``rows`` in place of those of their keys, or added; returns its number.

        Without rows it is ``base`` itself. A key that ``rows`` repeats is a ValueError, as there is no
        telling which row is meant; a published ``base + 1`` is a :class:`Conflict`.
        """
        bucket = F.pmod(F.hash(*self.key), F.lit(self.buckets)).alias("_bucket")
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        changed = cut(rows.select(*columns).select("*", bucket), "change")
        if changed.groupBy(*self.key).count().where("count > 1").limit(1).count():
            raise ValueError("rows repeat a key")
        parts = self._parts(base)
        touched = [str(r[0]) for r in changed.select("_bucket").distinct().collect()]
        if not touched and base >= 0:
            return base
        old = self._load([parts[b] for b in touched if b in parts]).alias("o")
        same = reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key))
        kept = old.join(changed.select(*self.key).alias("n"), same, "left_anti")
        folder = f"data/{uuid.uuid4().hex}"
        both = kept.select("*", bucket).unionByName(changed)
        both.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        parts |= {b: f"{folder}/_bucket={b}" for b in touched}
        if not publish(self._fs, f"{self._path}/versions/{base + 1:020d}.json", json.dumps(parts, sort_keys=True).encode()):
            self._fs.delete_dir(f"{self._path}/{folder}")
            raise Conflict(f"version {base + 1} is another writer's")
        return base + 1

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 8) -> int:
        """Commits ``change`` of the newest version; after a conflict ``change`` sees the version that won,
        so its predicate holds for the rows that it replaces."""
        for left in reversed(range(tries)):
            base = self.latest()
            try:
                return self.commit(base, change(self.read(base)))
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def insert_missing(self, rows: DataFrame) -> int:
        """Adds those ``rows`` whose key is not there, and leaves the others as they are."""

        def fresh(now: DataFrame) -> DataFrame:
            same = reduce(and_, (F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in self.key))
            return rows.alias("r").join(now.select(*self.key).alias("t"), same, "left_anti")

        return self.update(fresh)
