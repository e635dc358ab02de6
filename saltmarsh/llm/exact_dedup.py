"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.shared import SPACE, bucket, keyed, shared_apart, text_or_empty, written

def normalised(text: Column) -> Column:
    """text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def _open(rows: DataFrame, *columns: str) -> DataFrame:
    """Buckets of the values of columns that two rows or more share."""
    return F.broadcast(rows.groupBy(*columns).count().where("count > 1").select(bucket(*columns).alias("bucket"), F.lit(True).alias("open")).distinct())


def _groups(docs: DataFrame, id_col: str, text_col: str, row: Column, prefix_chars: int, with_digest: bool) -> DataFrame:
    """row, id, keep_id, group_size, kept and digest (null where no full text was read) for each row of docs."""
    norm = docs.select(row.alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    texts = norm.select("*", F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))
    sizes = written(texts.select("len", "prefix"), "exact-sizes")
    by_length = sizes.withColumn("bucket", bucket("len")).join(_open(sizes, "len"), "bucket", "left_semi")
    by_prefix = _open(by_length, "len", "prefix")

    marked = texts.withColumn("bucket", bucket("len", "prefix")).join(by_prefix, "bucket", "left")
    is_open = F.coalesce("open", F.lit(False))
    read = F.lit(True) if with_digest else is_open
    rows = written(marked.select("row", "id", is_open.alias("open"), F.when(read, F.unhex(F.sha2("norm", 256))).alias("digest")), "exact-rows")

    still = rows.where("open").drop("open")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = written(still.groupBy("digest").agg(F.count("*").alias("n"), first).where("n > 1"), "exact-groups")
    placed = shared_apart(still, groups, ["digest"], "n", rows.count())
    kept = F.coalesce(F.col("row") == F.col("first.row"), F.lit(True))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id"))
    met = placed.select("row", "id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), kept.alias("kept"), "digest")
    alone = rows.where("not open").select("row", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return alone.unionByName(met)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    with_digest: bool = False,
) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, and with with_digest text_sha256.

    Texts are equal if they are identical once white space is collapsed. The row with the smallest id of
    equal texts is kept.

    Rows are first told apart by length, those that share one by the hash of their prefix, and only those that share
    both have their full text hashed (all have with with_digest, which asks for it). No text is shuffled:
    what is open is broadcast as BUCKETS numbers at most, and the hash is taken where the text is read. A bucket
    that also holds a settled row costs that row a hash and changes no result. Counts are combined before their
    shuffle, and groups with a large share of all rows are joined by broadcast, as there are few; so a length,
    prefix or group with a third of all rows stays in no one task.

    Null text: empty, so that null and empty texts form one group. Null id: never the smallest unless the
    whole group has none; then keep_id is null and one row is kept. Rows repeated with the same id: each has its own
    result; one of them is kept at most. Ids may have any type that has an order. Empty table: empty result.
    Other columns of docs are ignored, whatever their names.
    """
    found = _groups(docs, id_col, text_col, F.monotonically_increasing_id(), prefix_chars, with_digest)
    out = [F.col("id").alias(id_col), "keep_id", "group_size", "kept"]
    return found.select(*out, *([F.lower(F.hex("digest")).alias("text_sha256")] if with_digest else []))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the smallest id.

    Rows are told apart by a number of their own, so ids may be null (never the smallest, unless the whole group
    has none), of any ordered type and repeated, with the same or with other texts. Columns may have any names.
    Empty table: empty result.
    """
    rows, row = keyed(docs, "exact-keyed")
    found = _groups(rows, id_col, text_col, F.col(row), 256, False)
    gone = written(found.where("not kept").select(F.col("row").alias(row)), "exact-gone")
    return rows.join(gone, row, "left_anti").drop(row)
