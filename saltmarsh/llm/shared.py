"""What several operators use: working tables in the cluster's shared folder, and plain word rules."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with over a KEYS-th of all rows are joined by broadcast: there are fewer than KEYS of them.
KEYS = 1024
#: A set of values that is broadcast to where rows are read holds so many numbers at most, however many values there are.
BUCKETS = 1 << 18


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="saltmarsh-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without the setting, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saltmarsh-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bucket(*columns: str) -> Column:
    """The number, below BUCKETS, that stands for the values of columns in a broadcast set."""
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def row_name(df: DataFrame) -> str:
    """A name for a row number that no column of df has."""
    name, taken = "_row", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs, written with a number of its own for each row, and the name of that column."""
    row = row_name(docs)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def first_rows(rows: DataFrame, row: str, members: DataFrame, id_col: str) -> DataFrame:
    """rows without those of members (row, group) that are not the first of their group, and without the column row.

    The first of a group has the smallest id, nulls last; of equal ids the smallest row number.
    """
    placed = members.join(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id")), "row")
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    others = placed.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    return rows.join(others.select(F.col("row").alias(row)), row, "left_anti").drop(row)


def shared_apart(rows: DataFrame, keys: DataFrame, on: list[str], size_col: str, total: int, how: str = "left") -> DataFrame:
    """rows joined to keys on their columns on, with no key's rows in one task: keys is one row a key, size_col its number of rows.

    Keys with over a KEYS-th of total rows are fewer than KEYS; they are broadcast. The others meet by shuffle.
    how: left, inner or left_semi.
    """
    heavy = keys.where(F.col(size_col) > total / KEYS)
    light = keys.where(F.col(size_col) <= total / KEYS)
    apart = rows.join(F.broadcast(heavy), on, "left_semi" if how == "left_semi" else "inner")
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return apart.unionByName(rest)
