"""Numbers of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def numbered(rows: DataFrame, order: Sequence[str], within: str | None = None, name: str = "number") -> DataFrame:
    """``rows`` with a number from 0 in the order of ``order``, each group of ``within`` by itself.

    Rows are sorted by ranges and counted in their tasks, and written; what stands before a range comes from the counts of
    ranges alone. A group of any size is spread over as many ranges as it needs. Rows that are equal in ``order`` are told
    apart by their place in the input.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit("")) if within else F.lit("")
    columns = rows.columns
    keys = ["_group", *order, "_row"]
    ranged = rows.withColumns({"_group": group, "_row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            groups = np.array(b.column("_group").to_pylist(), object)
            starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            at = np.arange(len(groups)) - np.repeat(starts, np.diff([*starts, len(groups)]))
            if groups[0] == last:
                at[: starts[1] if len(starts) > 1 else len(at)] += seen
            last, seen = groups[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(at), part), pa.int64()), pa.array(at, pa.int64())], [*b.schema.names, "_part", "_at"])

    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", _part long, _at long"
    held = store.written(ranged.mapInArrow(count, told), "ranges")
    parts = held.groupBy("_group", "_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_group", "_part", before.alias("_before"))  # a row for each range and group
    return held.join(parts, ["_group", "_part"]).select(*columns, (F.col("_at") + F.col("_before")).alias(name))
