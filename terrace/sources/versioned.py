"""Tables that change by new files and a new manifest.

A table is a folder with ``data``, whose files are never changed, and ``manifest``, with one small Parquet file a version:
the (segment, group) folders that make up the table then. Rows are dealt to ``groups`` by a hash of the key. A write adds a
segment and then a manifest; until that stands, readers see the version before, and after it the new one. Each write has a
token, and one whose token is in the history changes nothing, so a repeated write (a replayed micro-batch, a job run again)
is safe. Deletes and merges write the touched groups again and no others.

One writer at a time: a second one that finds the version taken fails, and may be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "token string, segment string, grp int"


class Versioned:
    """A versioned table of ``schema`` in ``path``, dealt by ``key`` columns."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], groups: int = 64):
        self.spark, self.path, self.schema, self.key, self.groups = spark, path, schema, key, groups

    # --- manifests ---

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_MANIFEST}, version long").parquet(f"{self.path}/manifest")
        except AnalysisException:  # no version yet
            return None

    def version(self) -> int:
        """The current version; 0 for a table that nothing was written to."""
        found = self._manifests()
        return (found.agg(F.max("version").alias("v")).first().v or 0) if found is not None else 0

    def versions(self) -> DataFrame:
        """(version, token): what each version was written for."""
        found = self._manifests()
        return found.select("version", "token").distinct() if found is not None else self.spark.createDataFrame([], "version long, token string")

    def _live(self, version: int) -> list[tuple[str, int]]:
        found = self._manifests()
        rows = found.where((F.col("version") == version) & F.col("segment").isNotNull()).collect() if found is not None else []  # groups of segments
        return [(r.segment, r.grp) for r in rows]

    def _seen(self, token: str) -> bool:
        found = self._manifests()
        return found is not None and found.where(F.col("token") == token).limit(1).count() > 0

    def _commit(self, version: int, token: str, live: list[tuple[str, int]]) -> int:
        rows = [(token, s, g) for s, g in live] or [(token, None, None)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")
        return version

    # --- data ---

    def _grouped(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_group", F.pmod(F.xxhash64(*self.key), F.lit(self.groups)).cast("int"))

    def _segment(self, rows: DataFrame) -> list[tuple[str, int]]:
        """Write rows(*schema, _group) as a new segment; a group of any size over as many files as it needs."""
        name = uuid.uuid4().hex
        rows.select(*self.schema.names, "_group").hint("rebalance", "_group").write.partitionBy("_group").parquet(f"{self.path}/data/{name}")
        try:
            groups = self.spark.read.schema("_group int").parquet(f"{self.path}/data/{name}").select("_group").distinct().collect()  # at most ``groups``
        except AnalysisException:  # no rows
            groups = []
        return [(name, r._group) for r in groups]

    def _rows(self, live: list[tuple[str, int]]) -> DataFrame:
        """The rows of some groups, with ``_group``."""
        out = None
        for segment in dict.fromkeys(s for s, _ in live):
            paths = [f"{self.path}/data/{segment}/_group={g}" for s, g in live if s == segment]
            part = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data/{segment}").parquet(*paths)
            part = part.select(*self.schema.names)
            out = part if out is None else out.unionByName(part)
        return self._grouped(out if out is not None else self.spark.createDataFrame([], self.schema))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the current one."""
        return self._rows(self._live(self.version() if version is None else version)).drop("_group")

    # --- writes ---

    def append(self, rows: DataFrame, token: str) -> int:
        """Add rows; the version that holds them."""
        if self._seen(token):
            return self.version()
        before = self.version()
        return self._commit(before + 1, token, self._live(before) + self._segment(self._grouped(rows.select(*self.schema.names))))

    def _replace(self, touched: DataFrame, token: str, change: Callable[[DataFrame], DataFrame]) -> int:
        before = self.version()
        live, groups = self._live(before), {r._group for r in self._grouped(touched.select(*self.key)).select("_group").distinct().collect()}  # at most ``groups``
        old = [(s, g) for s, g in live if g in groups]
        new = self._segment(self._grouped(change(self._rows(old).drop("_group")).select(*self.schema.names)))
        return self._commit(before + 1, token, [x for x in live if x[1] not in groups] + new)

    def delete(self, doomed: DataFrame, token: str) -> int:
        """Delete the rows that meet ``doomed`` in all its columns: the key, and an owner, say, who alone may delete."""
        if self._seen(token):
            return self.version()
        on = doomed.columns
        doomed = doomed.distinct()
        return self._replace(doomed, token, lambda rows: rows.join(doomed, on, "left_anti"))

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame], token: str) -> int:
        """Put rows in and ``combine`` the touched groups: old and new rows together, back in the table's schema."""
        if self._seen(token):
            return self.version()
        rows = rows.select(*self.schema.names)
        return self._replace(rows, token, lambda old: combine(old.unionByName(rows)))

    def reset(self, token: str) -> int:
        """An empty table; earlier versions can still be read."""
        return self.version() if self._seen(token) else self._commit(self.version() + 1, token, [])

    def compact(self, token: str) -> int:
        """One segment in place of all."""
        if self._seen(token):
            return self.version()
        before = self.version()
        return self._commit(before + 1, token, self._segment(self._rows(self._live(before))))
