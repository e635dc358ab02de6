"""A plan of what to capture: a few messages of each list, none twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capture_plan(candidates: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """channel, list, place, id: for each channel and each list of quotas, in their order, the first ids that no list before took.

    candidates: channel, list, rank, id. A list takes its ids by rank, then id, until its quota is full; an id that an
    earlier list took is passed over. Only the lists before can take ids away, so a list needs no more of its ids than all quotas up
    to it; that many of each list of a channel are kept by a window with a limit, which tasks apply before the shuffle, and a
    channel with any share of the rows comes down to a few dozen. Null ids and lists that quotas doesn't name are left out;
    an id that is twice in a list counts at its first place.
    """
    names = list(quotas)
    needed, so_far = {}, 0
    for name, quota in quotas.items():
        so_far += quota
        needed[name] = so_far
    limit = reduce(lambda a, b: F.coalesce(a, b), [F.when(F.col("list") == n, F.lit(k)) for n, k in needed.items()])
    once = candidates.where(F.col("list").isin(names) & F.col("id").isNotNull()).groupBy("channel", "list", "id").agg(F.min("rank").alias("rank"))
    near = once.withColumn("k", F.row_number().over(Window.partitionBy("channel", "list").orderBy("rank", "id"))).where(F.col("k") <= so_far).where(F.col("k") <= limit)
    rows = near.groupBy("channel").agg(*[F.sort_array(F.collect_list(F.when(F.col("list") == n, F.struct("k", "id")))).alias(f"_{k}") for k, n in enumerate(names)])
    for k, name in enumerate(names):
        rows = rows.withColumn(f"picked_{k}", F.slice(_untaken(F.col(f"_{k}"), [F.col(f"picked_{j}") for j in range(k)]), 1, quotas[name]))
    return rows.select("channel", F.inline(F.flatten(F.array(*[_placed(F.col(f"picked_{k}"), name) for k, name in enumerate(names)]))))


def _untaken(found: Column, picked: list[Column]) -> Column:
    if not picked:
        return found
    before = F.transform(F.flatten(F.array(*picked)), lambda t: t["id"])
    return F.filter(found, lambda c: ~F.array_contains(before, c["id"]))


def _placed(picked: Column, name: str) -> Column:
    return F.transform(picked, lambda c, k: F.struct(F.lit(name).alias("list"), (k + 1).alias("place"), c["id"].alias("id")))
