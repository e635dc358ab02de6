"""Review work: judgements held against rows, guarded changes, differences of tables, slices, budgets, and the guide's risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators.order import numbered
from pyspark.sql.window import Window


def reconciled(asked: DataFrame, judged: DataFrame, key: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, status: valid, invalid (a value that isn't allowed), repeated, unknown (not asked) or missing (not judged)."""
    fine = F.lit(True)
    for column, values in allowed.items():
        fine = fine & F.coalesce(F.col(column).isin(*values), F.lit(False))
    each = judged.groupBy(key).agg(F.count("*").alias("_n"), F.min(fine).alias("_fine"))
    both = asked.select(key, F.lit(True).alias("_asked")).distinct().join(each, key, "full")
    status = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col("_fine"), "valid").otherwise("invalid")
    return both.select(key, status.alias("status"))


def guarded_changes(plan: DataFrame, current: DataFrame, key: str, column: str) -> DataFrame:
    """key, status, old, new for each planned change (key, seen, new), applied only where the value is still the one seen.

    status: apply, same (it is new already), changed (someone else wrote) or gone.
    """
    now = current.select(key, F.col(column).alias("old"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "same").when(F.col("old").eqNullSafe(F.col("seen")), "apply").otherwise("changed")
    return plan.join(now, key, "left").select(key, status.alias("status"), "old", "new")


def applied(current: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """current with the changes to be applied."""
    new = changes.where("status = 'apply'").select(key, F.col("new").alias("_new"), F.lit(True).alias("_set"))
    return current.join(new, key, "left").withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_set")


def row_differences(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, what: left or right for rows on one side only, else each column that differs."""
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    what = F.when(F.col("_b").isNull(), F.array(F.lit("left"))).when(F.col("_a").isNull(), F.array(F.lit("right"))).otherwise(differ)
    return a.join(b, key, "full").select(key, F.explode(what).alias("what"))


def conflicting(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, n for keys whose rows differ in any of the columns: n combinations of them."""
    return rows.select(key, *columns).distinct().groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def blanks_filled(rows: DataFrame, found: DataFrame, key: str, columns: list[str], missing: str) -> DataFrame:
    """rows with blanks of columns filled from found (a row a key), and conflicts: columns where both are there and differ.

    A value that begins with missing counts as blank. What is there is never overwritten.
    """
    both = rows.join(found.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    blank = {c: (F.trim(F.coalesce(c, F.lit(""))) == "") | F.startswith(c, F.lit(missing)) for c in columns}
    given = {c: F.coalesce(f"_{c}", F.lit("")) != "" for c in columns}
    clash = F.array_compact(F.array(*[F.when(~blank[c] & given[c] & (F.trim(c) != F.trim(f"_{c}")), F.lit(c)) for c in columns]))
    both = both.withColumn("conflicts", clash)
    return both.withColumns({c: F.when(blank[c] & given[c], F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def unique_place(candidates: DataFrame, key: str, places: DataFrame, name: str, place: str) -> DataFrame:
    """key, place for keys whose candidate names lead to exactly one place, in whatever number of names."""
    met = candidates.select(key, name).distinct().join(places.select(name, place), name)
    return met.groupBy(key).agg(F.min(place).alias(place), F.max(place).alias("_most")).where(F.col(place) == F.col("_most")).drop("_most")


def round_robin(rows: DataFrame, order: str, cursor: int, most: int) -> DataFrame:
    """The next most rows in order, from the cursor on and around the end, with turn from 0.

    Positions come from a global sort and counts of its partitions, without gathering the rows in one task.
    """
    placed = numbered(rows, F.col(order), name="_place").withColumn("_total", F.lit(rows.count()))
    return placed.withColumn("turn", F.pmod(F.col("_place") - 1 - F.lit(cursor).cast("long"), F.col("_total"))).where(F.col("turn") < most).drop("_place", "_total")


def budget_left(spent: DataFrame, day: Column, cost: str, today: Column, limit: float, worst: float) -> DataFrame:
    """spent, allowed: whether the worst case of one more still keeps within today's limit."""
    total = F.coalesce(F.sum(F.when(day == today, F.col(cost))), F.lit(0.0))
    return spent.agg(F.round(total, 6).alias("spent"), (F.round(total, 6) + worst <= limit).alias("allowed"))


def quality_gate(results: DataFrame, ok: Column, minutes: Column, least_share: float, most_minutes: float) -> DataFrame:
    """n, n_ok, passed: whether a run may be taken over."""
    found = results.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.max(minutes).alias("_minutes"))
    passed = (F.col("n") > 0) & (F.col("n_ok") >= least_share * F.col("n")) & (F.col("_minutes") <= most_minutes)
    return found.select("n", "n_ok", F.coalesce(passed, F.lit(False)).alias("passed"))


def risk_levels(leaked: DataFrame, weights: DataFrame) -> DataFrame:
    """case, risk, level (1 to 3) for leaked (case, item) by weights (item, risk, weight): the highest weight of the case's items.

    Name and phone together raise phishing by one; name and resident number set impersonation to three.
    """
    items = leaked.select("case", "item").distinct()
    base = items.join(F.broadcast(weights), "item").groupBy("case", "risk").agg(F.max("weight").alias("level"))  # a weight an item and risk
    has = items.groupBy("case").agg(*[F.bool_or(F.col("item") == i).alias(i) for i in ("name", "phone", "rrn")])
    fixed = has.where("name AND rrn").select("case", F.lit("ident").alias("risk"), F.lit(3).alias("level"))
    raised = base.join(has, "case").withColumn("level", F.when((F.col("risk") == "phish") & F.col("name") & F.col("phone"), F.least(F.col("level") + 1, F.lit(3))).otherwise(F.col("level")))
    return raised.select("case", "risk", "level").unionByName(fixed).groupBy("case", "risk").agg(F.max("level").alias("level")).where("level > 0")


def picked_actions(leaked: DataFrame, levels: DataFrame, actions: DataFrame, priority: DataFrame) -> DataFrame:
    """case, action, place: actions whose risk a case has and one of whose needed items leaked, by urgency, then the stage's order of risks.

    actions: action, risk, urgency (a rank), need (items). priority: case, order (risks).
    """
    needed = actions.select("action", "risk", "urgency", F.explode("need").alias("item"))
    met = leaked.select("case", "item").join(F.broadcast(needed), "item").select("case", "action", "risk", "urgency").distinct()
    rows = met.join(levels.select("case", "risk"), ["case", "risk"], "left_semi").join(priority, "case")
    order = Window.partitionBy("case").orderBy("urgency", F.array_position("order", F.col("risk")), "action")
    return rows.withColumn("place", F.row_number().over(order)).select("case", "action", "place")


def next_actions(picked: DataFrame, marks: DataFrame) -> DataFrame:
    """case, next, total, finished: the first action neither done nor put off, else the first put off; two steps count as done from the start.

    marks: case, action, mark (done or later).
    """
    once = marks.groupBy("case", "action").agg(F.bool_or(F.col("mark") == "done").alias("done"), F.bool_or(F.col("mark") == "later").alias("later"))
    both = picked.join(once, ["case", "action"], "left").fillna(False, ["done", "later"])
    first = F.min_by("action", F.when(~F.col("done"), F.struct("later", "place")))
    return both.groupBy("case").agg(first.alias("next"), (F.count("*") + 2).alias("total"), (F.count_if("done") + 2).alias("finished"))
