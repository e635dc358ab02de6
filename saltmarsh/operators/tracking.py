"""States of claims from what was observed of them over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States (fixed values).
OPEN, GONE, EXTENDED, UNCLEAR, POSTED, UNSEEN = "공개됨", "사라짐", "연장", "불명", "게시 중", "안 보임"
STATES = ("", OPEN, GONE, EXTENDED, UNCLEAR, POSTED, UNSEEN)
#: Rest days after so many failures in a row (fixed values); the last holds for more.
REST_DAYS = (0, 0, 1, 3, 7, 14)


def _latest(value: Column, when: Column, order: Column) -> Column:
    """value at the greatest order among rows for which when holds; combined before the shuffle, unlike a window."""
    return F.max_by(value, F.when(when, order))


def last_states(observations: DataFrame) -> DataFrame:
    """uid, last_origin, last_agg, last_seen: the last state by each kind of observer."""
    order = F.struct("observed_at", "seq")
    return observations.groupBy("uid").agg(
        _latest(F.col("state"), F.col("src") == "origin", order).alias("last_origin"),
        _latest(F.col("state"), F.col("src") == "agg", order).alias("last_agg"),
        F.max("observed_at").alias("last_seen"),
    )


def twice_unseen(observations: DataFrame) -> DataFrame:
    """uid, gone: whether the last two aggregator rows both say unseen."""
    by_time = Window.partitionBy("uid").orderBy(F.desc("observed_at"), F.desc("seq"))
    recent = observations.where("src = 'agg'").withColumn("back", F.row_number().over(by_time)).where("back <= 2")
    return recent.groupBy("uid").agg((F.count_if(F.col("state") == UNSEEN) == 2).alias("gone"))


def last_filled(observations: DataFrame, column: str) -> DataFrame:
    """uid and the latest value of column that isn't blank."""
    order = F.struct("observed_at", "seq")
    filled = F.nullif(F.trim(F.col(column).cast("string")), F.lit("")).isNotNull()
    return observations.groupBy("uid").agg(_latest(F.col(column), filled, order).alias(column))


def classified(observations: DataFrame, now: Column) -> DataFrame:
    """uid, state: one state for each claim; the first rule that holds decides.

    Opened or gone by the origin's last row; gone if the aggregator's last two rows say unseen; extended by
    the origin; unclear by the origin if no expiry is known or it has passed; unclear if the expiry has passed and the origin was not
    observed since; else blank.
    """
    order = F.struct("observed_at", "seq")
    origin, agg = F.col("src") == "origin", F.col("src") == "agg"
    seen = F.struct("observed_at", "seq", "state")
    facts = observations.groupBy("uid").agg(
        _latest(F.col("state"), origin, order).alias("last_origin"),
        _latest(F.col("expiry_est"), F.col("expiry_est").isNotNull(), order).alias("expiry"),
        F.max(F.when(origin, F.col("observed_at"))).alias("origin_at"),
        F.max(F.when(agg, seen)).alias("agg_last"),
    )
    before_last = observations.where(agg).select("uid", F.struct("observed_at", "seq").alias("at"), "state")
    second = (
        before_last.join(facts.select("uid", F.struct("agg_last.observed_at", "agg_last.seq").alias("top")), "uid")
        .where(F.col("at") < F.col("top"))
        .groupBy("uid")
        .agg(F.max_by("state", "at").alias("agg_before"))
    )
    facts = facts.join(second, "uid", "left")
    past = F.col("expiry") < now
    state = (
        F.when(F.col("last_origin") == OPEN, OPEN)
        .when(F.col("last_origin") == GONE, GONE)
        .when((F.col("agg_last.state") == UNSEEN) & (F.col("agg_before") == UNSEEN), GONE)
        .when(F.col("last_origin") == EXTENDED, EXTENDED)
        .when(F.col("last_origin") == UNCLEAR, F.when(F.col("expiry").isNull() | past, UNCLEAR).otherwise(""))
        .when(past & (F.col("origin_at").isNull() | (F.col("origin_at") < F.col("expiry"))), UNCLEAR)
        .otherwise("")
    )
    return facts.select("uid", state.alias("state"))


def numbers(states: DataFrame) -> DataFrame:
    """state, n: how many claims are in each state."""
    return states.groupBy("state").agg(F.count("*").alias("n"))


def aggregator_only(observations: DataFrame) -> DataFrame:
    """state, n: last states of claims that no origin row exists for."""
    return last_states(observations).where("last_origin IS NULL").groupBy(F.col("last_agg").alias("state")).agg(F.count("*").alias("n"))


def pulled(new: DataFrame, known: DataFrame) -> DataFrame:
    """new rows with the reason why they aren't taken: known already, unknown state, or null where they are."""
    key = ["uid", "observed_at", "src"]
    marked = new.join(known.select(*key).distinct().withColumn("_known", F.lit(True)), key, "left")
    reason = F.when(F.col("_known"), "known").when(~F.col("state").isin(*STATES), "state")
    return marked.withColumn("reason", reason).drop("_known")


def next_state(before: Column, seen: Column) -> Column:
    """The aggregator's state machine: seen is posted; unseen once stays open, twice is gone."""
    return F.when(seen, POSTED).when(before.isin(UNSEEN, GONE), GONE).otherwise(UNSEEN)


def push_changes(rows: DataFrame, before: Column, seen: Column, by_human: Column) -> DataFrame:
    """rows with after, and why a row is skipped: observed by a human, or in a state that isn't the aggregator's to change."""
    after = next_state(before, seen)
    skipped = F.when(by_human, "human").when(~F.coalesce(before, F.lit("")).isin("", POSTED, UNSEEN), "final").when(after == before, "same")
    return rows.withColumns({"after": after, "skipped": skipped})


def failure_streaks(tries: DataFrame, key: str, at: str, failed: str) -> DataFrame:
    """key, streak, rest_days, last_at: failures in a row up to the last try, and the days to rest for them.

    A streak is what follows the last success, so two aggregates find it without ordering the tries of a key.
    """
    success = tries.where(~F.col(failed)).groupBy(key).agg(F.max(at).alias("_success"))
    last = tries.groupBy(key).agg(F.max(at).alias("last_at"))
    after = tries.join(success, key, "left").where(F.col(failed) & (F.col("_success").isNull() | (F.col(at) > F.col("_success"))))
    streaks = after.groupBy(key).agg(F.count("*").alias("streak"))
    streak = F.coalesce("streak", F.lit(0)).cast("long")
    days = F.element_at(F.array(*map(F.lit, REST_DAYS)), (F.least(streak, F.lit(len(REST_DAYS) - 1)) + 1).cast("int"))
    return last.join(streaks, key, "left").select(key, streak.alias("streak"), days.alias("rest_days"), "last_at")


def retry_minutes(failures: Column, every: Column) -> Column:
    """Minutes to the next run: every without a failure, else 5 doubled for each more, 60 at most."""
    return F.when(failures <= 0, every).otherwise(F.least(F.lit(60.0), 5 * F.pow(F.lit(2.0), failures - 1)))
