"""Streams that keep time: rests after failures, a quiet first run, and what is forgotten after a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Days of rest after so many failures in a row; the last holds for more (fixed values).
REST_DAYS = (0, 0, 1, 3, 7, 14)


def rests(tries: DataFrame, key: str, time: str, order: str, ok: Column, days: tuple[int, ...] = REST_DAYS) -> DataFrame:
    """key, order, failures, rest_days for each try: failures in a row so far, and the rest that follows.

    State is one count a key. A key's tries within a micro-batch are put in order of time and order, so a batch must
    hold them in memory. Null ok: a failure.
    """
    rows = tries.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(order).alias("order"), F.coalesce(ok, F.lit(False)).alias("ok"))

    def step(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        new = pd.concat(list(chunks)).sort_values(["time", "order"], kind="stable")
        counts = []
        for went_well in new["ok"].tolist():
            failures = 0 if went_well else failures + 1
            counts.append(failures)
        state.update((failures,))
        yield pd.DataFrame({"key": keys[0], "order": new["order"].to_numpy(), "failures": counts, "rest_days": [days[min(n, len(days) - 1)] for n in counts]})

    found = rows.groupBy("key").applyInPandasWithState(step, "key long, order long, failures long, rest_days long", "failures long", "append", GroupStateTimeout.NoTimeout)
    return found.withColumnsRenamed({"key": key, "order": order})


def announced(batch: DataFrame, first_run: bool, most: int = 30) -> DataFrame:
    """What a batch may announce: all its rows; or none on the first run, and none of a batch of over most rows.

    Both are a baseline: so many new rows at once come from a resync after a gap. The rows themselves are all stored.
    """
    if first_run or batch.limit(most + 1).count() > most:
        return batch.limit(0)
    return batch


def fresh(stored: DataFrame, seen: str, now: Column, days: int) -> DataFrame:
    """Rows seen within so many days; a row never seen stays."""
    return stored.where(F.col(seen).isNull() | (F.col(seen) >= now - F.make_dt_interval(F.lit(days))))


def forgetful(messages: DataFrame, time: str, keys: list[str], days: int = 14) -> DataFrame:
    """Each key once within days of event time; its state is dropped by the batch after that, and seen again it counts as new."""
    return messages.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark(keys)


def recent_counts(messages: DataFrame, time: str, by: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """day, by, n: rows of each window of days, a window starting every day. For update or append mode."""
    window = F.window(time, f"{days} days", "1 day")
    return messages.withWatermark(time, late).groupBy(window.alias("_w"), by).agg(F.count("*").alias("n")).select(F.to_date("_w.end").alias("day"), by, "n")


def visits(messages: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """by, began, ended, n: runs of rows less than gap apart."""
    return messages.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("_w"), by).agg(F.count("*").alias("n"), F.min(time).alias("began"), F.max(time).alias("ended")).select(by, "began", "ended", "n")


def catch_up_order(backlog: DataFrame, live: DataFrame, key: str, number: str) -> DataFrame:
    """Rows of a backlog and then live ones, each once, with turn: within a key by number, the backlog's copy first."""
    both = backlog.withColumn("live", F.lit(False)).unionByName(live.withColumn("live", F.lit(True)))
    once = both.withColumn("_copy", F.row_number().over(Window.partitionBy(key, number).orderBy("live"))).where("_copy = 1").drop("_copy")
    return once.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("live", number)))
