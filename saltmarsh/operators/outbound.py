"""What the register of events holds already, and the names that its reviewed rows confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.outbound import COMMON
from saltmarsh.functions.review import IS_CASE
from saltmarsh.functions.text import empty


def marked_seen(rows: DataFrame, stored: DataFrame, uid: str, key: str) -> DataFrame:
    """rows with seen: whether stored has their uid or their key. A blank uid is like none; keys are always compared.

    Both joins are with distinct values, so no row is repeated; null keys meet nothing.
    """
    uids = stored.where(F.trim(empty(F.col(uid))) != "").select(F.col(uid).alias("_uid"), F.lit(True).alias("_by_uid")).distinct()
    keys = stored.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lit(True).alias("_by_key")).distinct()
    joined = rows.join(uids, rows[uid] == F.col("_uid"), "left").join(keys, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("seen", F.coalesce("_by_uid", F.lit(False)) | F.coalesce("_by_key", F.lit(False))).drop("_uid", "_by_uid", "_key", "_by_key")


def confirmed_names(rows: DataFrame, review: Column, organisation: Column, least: int = 4) -> DataFrame:
    """name, each once: organisations of rows reviewed as cases, in lower case, of least characters, neither digits nor common words."""
    names = rows.where(review == IS_CASE).select(F.lower(F.trim(empty(organisation))).alias("name"))
    return names.where((F.length("name") >= least) & ~F.col("name").isin(*COMMON) & ~F.col("name").rlike("^[0-9]+$")).distinct()
