"""Streams of messages and observations: each new one once, the highest seen, states held over a few misses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from saltmarsh.sources.working import new_path


def new_rows(spark: SparkSession, folder: str, schema: StructType, names: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files in folder that the query's checkpoint has not read yet."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(folder)


def once_each(messages: DataFrame, time: str, keys: list[str], late: str = "14 days") -> DataFrame:
    """Each key once, its first row. State is kept for as long as copies may be late, and then dropped."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def high_water(messages: DataFrame, key: str, number: Column) -> DataFrame:
    """The highest number of each key so far, for update mode; it never falls."""
    return messages.groupBy(key).agg(F.max(number).alias("high"))


def held_states(observations: DataFrame, key: str, time: str, order: str, seen: Column, misses: int = 3) -> DataFrame:
    """key, order, shown, missed for each observation: shown stays true until misses in a row were not seen.

    A key never seen is not shown. State is a flag and a count for each key. The observations of a key within one
    micro-batch are put in order of time and order, so a batch must hold a key's new rows in memory. Null seen: a miss.
    """
    rows = observations.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(order).alias("order"), F.coalesce(seen, F.lit(False)).alias("seen"))

    def step(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown, missed = state.get if state.exists else (False, 0)
        new = pd.concat(list(chunks)).sort_values(["time", "order"], kind="stable")
        out = []
        for was_seen in new["seen"].tolist():
            missed = 0 if was_seen else missed + 1
            shown = bool(was_seen or (shown and missed < misses))
            out.append((shown, missed))
        state.update((shown, missed))
        yield pd.DataFrame({"key": keys[0], "order": new["order"].to_numpy(), "shown": [s for s, _ in out], "missed": [m for _, m in out]})

    held = rows.groupBy("key").applyInPandasWithState(step, "key long, order long, shown boolean, missed long", "shown boolean, missed long", "append", GroupStateTimeout.NoTimeout)
    return held.withColumnsRenamed({"key": key, "order": order})


def caught_up(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that stream gives for the input that is there now, as a table in the shared folder.

    Every micro-batch is written to a folder of its own, so one that is run again replaces its rows. batch_id tells them apart.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{path}/rows").option("recursiveFileLookup", "true").parquet(f"{path}/rows")
