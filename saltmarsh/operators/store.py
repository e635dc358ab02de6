"""The item store: keyed upserts that never overwrite what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of an item's key, in order (fixed values).
KEY_PARTS = ("src_id", "venue", "post_url", "actor", "target_org", "title")
#: Values that count as empty (fixed values).
EMPTY = ("", "{}", "[]", "없음")


def uid(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts, each trimmed and in lower case; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts])), 1, 16)


def pair_uid(group: Column, victim: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of two keys, parted by a unit separator."""
    return F.substring(F.sha2(F.concat(F.coalesce(group, F.lit("")), F.lit("\x1f"), F.coalesce(victim, F.lit(""))), 256), 1, 32)


def filled(column: Column) -> Column:
    """column, or null if it counts as empty."""
    return F.when(~F.trim(column).isin(*EMPTY), column)


def upserted(stored: DataFrame, arrivals: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The store after the arrivals: uid, columns, body, body_kind, via, first_seen, last_seen, forgotten.

    stored has one row for each uid; arrivals may have several, taken in order. A column keeps the first value that isn't
    empty, a forgotten row takes none. body and body_kind move together: the first body stays, unless it isn't of a real post and a later
    one is ("post"). via gathers all ways, sorted. last_seen moves always.

    Each column's first value is a minimum over (order, value), so an item with very many arrivals is
    combined before the shuffle.
    """
    zero = F.array().cast("array<string>")
    old = stored.select("uid", *columns, "body", "body_kind", F.coalesce("via", zero).alias("via"), "first_seen", "last_seen", "forgotten", F.lit(0).alias("_age"), *[F.lit(None).cast(arrivals.schema[o].dataType).alias(f"_o_{o}") for o in order])
    new = arrivals.select("uid", *columns, "body", "body_kind", F.array("via").alias("via"), F.col("day").alias("first_seen"), F.col("day").alias("last_seen"), F.lit(False).alias("forgotten"), F.lit(1).alias("_age"), *[F.col(o).alias(f"_o_{o}") for o in order])
    rows = old.unionByName(new)
    place = F.struct("_age", *[f"_o_{o}" for o in order])
    has_body = F.coalesce(F.trim("body"), F.lit("")) != ""
    first = {c: F.min_by(c, F.when(filled(F.col(c)).isNotNull(), place)).alias(c) for c in columns}
    body = F.struct("body", "body_kind")
    gathered = rows.groupBy("uid").agg(
        *first.values(),
        F.min_by(body, F.when(has_body, place)).alias("_first_body"),
        F.min_by(body, F.when(has_body & (F.col("body_kind") == "post"), place)).alias("_post_body"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("via")))).alias("via"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.bool_or(F.col("forgotten")).alias("forgotten"),
    )
    kept = F.coalesce("_post_body", "_first_body")
    blank = lambda c: F.when(F.col("forgotten"), F.lit("")).otherwise(F.coalesce(c, F.lit("")))
    return gathered.select("uid", *[blank(F.col(c)).alias(c) for c in columns], blank(kept.body).alias("body"), blank(kept.body_kind).alias("body_kind"), "via", "first_seen", "last_seen", "forgotten")


def replaced(stored: DataFrame, moves: DataFrame) -> DataFrame:
    """The store with keys changed: moves has old_uid and uid. A row keeps what was observed of it; rows that meet under a key are
    merged: first and last seen widen, and blanks are filled from the other."""
    moved = stored.join(moves.withColumnRenamed("uid", "_new"), stored["uid"] == moves["old_uid"], "left")
    moved = moved.select(F.coalesce("_new", "uid").alias("uid"), F.col("_new").isNotNull().alias("_moved"), *[c for c in stored.columns if c != "uid"])
    values = [c for c in stored.columns if c not in ("uid", "first_seen", "last_seen")]
    return moved.groupBy("uid").agg(
        *[F.min_by(c, F.when(F.trim(F.col(c).cast("string")) != "", F.col("_moved").cast("int"))).alias(c) for c in values],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def acknowledged(stored: DataFrame, uids: Column) -> DataFrame:
    """The store with is_new cleared for rows for which uids holds."""
    return stored.withColumn("is_new", F.col("is_new") & ~uids)


def forgotten_before(stored: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """The store with columns blanked in rows not seen since day; such rows are marked as forgotten."""
    old = F.col("last_seen") < day
    return stored.withColumns({c: F.when(old, "").otherwise(F.col(c)) for c in columns} | {"forgotten": F.col("forgotten") | old})


def upserted_by_score(stored: DataFrame, arrivals: DataFrame, axes: list[str], columns: list[str]) -> DataFrame:
    """One row for each uid of both: for each axis its highest score with the tier and reason that came with it,
    columns filled with the earliest value, sources in a sorted set, and is_first for keys that weren't stored."""
    rows = stored.withColumn("_age", F.lit(0)).unionByName(arrivals.withColumn("_age", F.lit(1)))
    best = [F.max(F.struct(F.col(f"{a}_score").alias("score"), (-F.col("_age")).alias("age"), F.col(f"{a}_tier").alias("tier"))).alias(a) for a in axes]
    first = [F.min_by(c, F.when(F.trim(c) != "", F.struct("_age", c))).alias(c) for c in columns]
    out = rows.groupBy("uid").agg(*best, *first, F.array_sort(F.collect_set("source")).alias("sources"), (F.min("_age") == 1).alias("is_first"))
    return out.select("uid", *[F.col(f"{a}.score").alias(f"{a}_score") for a in axes], *[F.col(f"{a}.tier").alias(f"{a}_tier") for a in axes], *[F.coalesce(c, F.lit("")).alias(c) for c in columns], "sources", "is_first")


def newest_wins(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both by key, the one with the greatest order each; new wins a tie."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = rows.groupBy(key).agg(F.max(F.struct(order, "_new", *[c for c in existing.columns if c not in (key, order)])).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in existing.columns])


def union_sorted(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def union_in_order(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def with_provenance(text: Column, name: Column, sep: str = " · ") -> Column:
    """text with name added, unless it has it."""
    return F.when(F.coalesce(text, F.lit("")) == "", name).when(F.contains(text, name), text).otherwise(F.concat(text, F.lit(sep), name))


def key_diff(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """key, change: keys that are gone, new or changed in column."""
    both = before.select(F.col(key), F.col(column).alias("_a"), F.lit(True).alias("_in_a")).join(after.select(F.col(key), F.col(column).alias("_b"), F.lit(True).alias("_in_b")), key, "full_outer")
    change = F.when(F.col("_in_b").isNull(), "gone").when(F.col("_in_a").isNull(), "new").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def latest_day_series(rows: DataFrame, keys: list[str], day: str, order: str) -> DataFrame:
    """One row for each keys and day: the last written one stays."""
    last = Window.partitionBy(*keys, day).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def precedence_merged(rows: DataFrame, key: str, rank: str, first: list[str], concatenated: list[str], united: list[str], sep: str = " · ") -> DataFrame:
    """One row for each key from several sources: first takes the value of the lowest rank that isn't blank, concatenated joins the
    different values by rank, united gathers arrays by rank. False and zero are values."""
    ordered = F.array_sort(F.collect_list(F.struct(rank, *first, *concatenated, *united)))
    merged = rows.groupBy(key).agg(ordered.alias("r"))
    pick = lambda c: F.get(F.filter(F.transform("r", lambda x: x[c].cast("string")), lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(0))
    joined = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("r", lambda x: x[c]), lambda v: v.isNotNull() & (F.trim(v) != ""))), sep)
    union = lambda c: F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x[c], F.array().cast("array<string>")))))
    return merged.select(key, *[pick(c).alias(c) for c in first], *[joined(c).alias(c) for c in concatenated], *[union(c).alias(c) for c in united])
