"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from saltmarsh.llm.shared import text_or_empty, written

#: Parts of each arc that are ranked apart, so that a rank never needs a whole arc in one task.
PARTS = 16


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes, and the shard that owns each."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big", signed=True), shard)
        for shard in range(shards)
        for node in range(virtual_nodes)
    )
    return np.array([p for p, _ in nodes], dtype=np.int64), np.array([s for _, s in nodes], dtype=np.int64)


def capacities(total: int, shards: int, epsilon: float) -> list[int]:
    """Most rows each shard takes. epsilon 0: total in all, so counts are at most one apart."""
    if epsilon:
        return [math.ceil((1 + epsilon) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def flow(counts: dict[int, int], owners: list[int], room: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each arc with rows, how many go to which shard, in the order of the rows in the arc.

    In each round, what waits at a node is taken in the ring's order, as far as the node's shard has room;
    the rest moves one node clockwise. Works on counts for the fixed number of arcs, not on rows.
    """
    room, at = list(room), [(arc, arc, n) for arc, n in sorted(counts.items()) if n]
    placed: dict[int, list[tuple[int, int]]] = {arc: [] for arc, _, _ in at}
    while at:
        onward = []
        for node, origin, n in sorted(at):
            shard = owners[node]
            took = min(n, room[shard])
            if took:
                room[shard] -= took
                placed[origin].append((took, shard))
            if n > took:
                onward.append(((node + 1) % len(owners), origin, n - took))
        at = onward
    return placed


def bounded_ring_shards(
    docs: DataFrame,
    shards: int = 40,
    virtual_nodes: int = 64,
    epsilon: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id_col, size, text_crc32, shard, slot, arc for each row of docs.

    A row's key is its id, hashed to a place on the ring; it belongs to the next virtual node clockwise.
    A shard takes (1 + epsilon) times the mean number of rows at most, and rows beyond that continue
    clockwise to the next node with room. With epsilon 0 shard counts differ by one at most; a larger
    epsilon moves fewer rows when the number of shards changes. slot counts a shard's rows from 0.

    Rows are ranked within small parts of the arcs (shards * virtual_nodes * PARTS of them), only the parts' row counts reach the driver,
    and their placement returns as a broadcast table of that bounded size. Texts are read once and not shuffled.

    size is the text's UTF-8 bytes plus 16. Null text: as empty. Null id: one more key. Rows repeated
    in full: placed one by one, like others. Empty table: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    places, owners = ring(shards, virtual_nodes)

    @F.pandas_udf(T.IntegerType())
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(places, place.to_numpy(), side="left") % len(places)).astype("int32"))

    text = text_or_empty(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    rows = rows.withColumns({"arc": arc_of(F.xxhash64("id")), "mix": F.xxhash64("id", "crc", "size", F.lit("part"))})
    rows = written(rows.withColumn("part", F.pmod("mix", F.lit(PARTS)).cast("int")), "ring-rows")
    counted = {(r["arc"], r["part"]): r["count"] for r in rows.groupBy("arc", "part").count().collect()}

    by_arc: dict[int, int] = {}
    for (arc, _), n in counted.items():
        by_arc[arc] = by_arc.get(arc, 0) + n
    placed = flow(by_arc, owners.tolist(), capacities(sum(by_arc.values()), shards, epsilon))
    filled, pieces = [0] * shards, []
    for arc, runs in placed.items():
        runs = list(runs)
        for part in range(PARTS):
            low, left = 0, counted.get((arc, part), 0)
            while left:
                n, shard = runs[0]
                took = min(n, left)
                pieces.append((arc, part, low, low + took, shard, filled[shard]))
                filled[shard] += took
                low, left = low + took, left - took
                runs[0] = (n - took, shard)
                if n == took:
                    runs.pop(0)
    schema = "arc int, part int, low long, high long, shard int, first long"
    plan = spark.createDataFrame(pd.DataFrame(pieces, columns=[c.split()[0] for c in schema.split(", ")]), schema) if pieces else spark.createDataFrame([], schema)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "part").orderBy("mix", "id", "crc", "size")).cast("long") - 1)
    within = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return (
        ranked.join(F.broadcast(plan.withColumnsRenamed({"arc": "of_arc", "part": "of_part"})), (F.col("arc") == F.col("of_arc")) & (F.col("part") == F.col("of_part")) & within)
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"), "arc")
    )
