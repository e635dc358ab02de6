"""Places in a global order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.sources.working import kept


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their place in order, from 1, as a long.

    Rows are sorted once by ranges, and written with the range and the position in it; so what is counted is what is
    returned. A place is the rows of the ranges before and those before it in its own. Only the ranges' counts are
    gathered, a row for each. Rows that order leaves tied have places next to each other, in any order.
    """
    part, within, start, n = (_free(rows, c) for c in ("_part", "_within", "_start", "_n"))
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = kept(rows.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(within, position), "ranged")
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))  # a row a partition
    starts = counts.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(start))
    return ranged.join(F.broadcast(starts), part).withColumn(name, F.col(start) + F.col(within) + 1).drop(part, within, start)


def _free(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name
