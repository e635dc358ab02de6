"""Profiles of leaked samples: columns, paths and tables, without ever returning raw values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Types of values and their patterns, the first that half of the values match wins (fixed values).
VALUE_TYPES = (
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("url", r"^https?://"),
    ("ip", r"^\d{1,3}(?:\.\d{1,3}){3}$"),
    ("date", r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"),
    ("rrn", r"^\d{6}-?[1-8]\d{6}$"),
    ("phone", r"^\+?\d[\d\s-]{7,14}\d$"),
    ("hash", r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"),
    ("uuid", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("integer", r"^-?\d+$"),
    ("decimal", r"^-?\d+\.\d+$"),
    ("flag", r"^(?i:true|false|yes|no|y|n|0|1)$"),
)


def unpivoted(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, value: a row for each cell, null and blank as null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in columns])
    return table.select(F.explode(cells).alias("c")).select("c.column", "c.value")


def column_stats(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, filled, distinct_values, repeated_percent, min_length, max_length, mean_length.

    Values are counted once each before columns are summed up, so a value with most of the rows is one row in the second step.
    """
    valued = unpivoted(table, columns).groupBy("column", "value").agg(F.count("*").alias("k"))
    n = F.col("value").isNotNull()
    stats = valued.groupBy("column").agg(
        F.sum("k").alias("n"), F.sum(F.when(n, F.col("k")).otherwise(0)).alias("filled"), F.count("value").alias("distinct_values"),
        F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.sum(F.length("value") * F.col("k")).alias("_chars"),
    )
    percent = F.when(F.col("filled") > 0, F.floor((F.col("filled") - F.col("distinct_values")) * 100 / F.col("filled")))
    return stats.select("column", "n", "filled", "distinct_values", percent.alias("repeated_percent"), "min_length", "max_length", F.round(F.col("_chars") / F.col("filled"), 4).alias("mean_length"))


def value_types(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, type: the first type whose pattern at least half of the filled values match, else text."""
    cells = unpivoted(table, columns).where("value IS NOT NULL")
    hits = cells.groupBy("column").agg(F.count("*").alias("n"), *[F.count_if(F.col("value").rlike(p)).alias(f"_{k}") for k, p in VALUE_TYPES])
    kind = F.coalesce(*[F.when(F.col(f"_{k}") * 2 >= F.col("n"), F.lit(k)) for k, _ in VALUE_TYPES], F.lit("text"))
    return hits.select("column", kind.alias("type"))


def synthetic_marks(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, dummy_percent, top_percent, suspicious: shares of filler values and of the most common value, rounded down; a
    fifth for one value of twenty or more is suspicious."""
    filler = r"(?i)^(?:test|dummy|sample|example|asdf|qwer|foo|bar|n/?a|null|none|xxx+|0+|1234\d*)"
    valued = unpivoted(table, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("k"))
    stats = valued.groupBy("column").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("value").rlike(filler), F.col("k")).otherwise(0)).alias("d"), F.max("k").alias("m"))
    top = F.floor(F.col("m") * 100 / F.col("n"))
    return stats.select("column", F.floor(F.col("d") * 100 / F.col("n")).alias("dummy_percent"), top.alias("top_percent"), ((F.col("n") >= 20) & (top >= 20)).alias("suspicious"))


def auto_increment(table: DataFrame, group: str, number: str) -> DataFrame:
    """group, increments: whether the sorted numbers of a group all follow each other. From their count, minimum, maximum and number of
    different ones, without sorting."""
    stats = table.groupBy(group).agg(F.count(number).alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("a"), F.max(number).alias("b"))
    return stats.select(group, ((F.col("n") > 1) & (F.col("n") == F.col("d")) & (F.col("b") - F.col("a") == F.col("n") - 1)).alias("increments"))


#: Path rules: grade and pattern, the first that matches wins. Callers pass their own lists; these are a start.
PATH_RULES = (
    ("치명", r"(?i)(?:^|/)(?:id_rsa|\.env|wallet\.dat|shadow|\.aws/credentials)"),
    ("치명", r"(?i)(?:password|passwd|credential)s?\.(?:txt|xlsx?|csv)$"),
    ("높음", r"(?i)\.(?:sql|bak|dump|mdb|pst)(?:\.gz)?$"),
    ("높음", r"(?i)(?:resident|passport|payroll|customer)"),
    ("중간", r"(?i)\.(?:xlsx?|csv|docx?|pdf)$"),
)


def path_grades(paths: DataFrame, rules: tuple[tuple[str, str], ...] = PATH_RULES, other: str = "낮음") -> DataFrame:
    """grade, n: distinct paths by the first rule that matches."""
    grade = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(g)) for g, p in rules], F.lit(other))
    return paths.select("path").distinct().groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


def path_shapes(paths: DataFrame) -> DataFrame:
    """extension, depth, n of distinct paths."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1))
    return paths.select("path").distinct().groupBy(ext.alias("extension"), (F.size(F.split("path", "/")) - 1).alias("depth")).agg(F.count("*").alias("n"))


#: Kinds of columns by their names (fixed values).
SENSITIVE = {
    "ident": r"(?i)rrn|resident|ssn|passport|jumin",
    "money": r"(?i)card|account|bank|salary|acctbal|price",
    "login": r"(?i)passw|pwd|secret|token|hash",
    "contact": r"(?i)mail|phone|mobile|tel|addr",
    "name": r"(?i)name",
}


def table_grades(columns: DataFrame) -> DataFrame:
    """table, kinds, grade from rows of table and column: identity or login data is critical, money or contacts with names high, either alone medium."""
    kind = F.coalesce(*[F.when(F.col("column").rlike(p), F.lit(k)) for k, p in SENSITIVE.items()])
    kinds = columns.groupBy("table").agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
    has = lambda k: F.array_contains("kinds", k)
    grade = F.when(has("ident") | has("login"), "치명").when((has("money") | has("contact")) & has("name"), "높음").when(has("money") | has("contact"), "중간").otherwise("낮음")
    return kinds.select("table", F.array_join("kinds", ",").alias("kinds"), grade.alias("grade"))


def diff_histogram(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, change, n: cells filled, blanked or changed between two versions of a table."""
    a = unpivot_keyed(before, key, columns)
    b = unpivot_keyed(after, key, columns).withColumnRenamed("value", "other")
    both = a.join(b, [key, "column"], "full_outer")
    change = F.when(F.col("value").isNull() & F.col("other").isNotNull(), "filled").when(F.col("value").isNotNull() & F.col("other").isNull(), "blanked").when(F.col("value") != F.col("other"), "changed")
    return both.select("column", change.alias("change")).where("change IS NOT NULL").groupBy("column", "change").agg(F.count("*").alias("n"))


def unpivot_keyed(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in columns])
    return table.select(key, F.explode(cells).alias("c")).select(key, "c.column", "c.value")


def common_words(names: DataFrame, least: int = 3) -> DataFrame:
    """word, n of words that least names or more have."""
    words = names.select("id", F.explode(F.array_distinct(F.split(F.lower("name"), r"[\s#_]+"))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def numbered_names(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """rows with label: names that occur several times in a group are numbered by order."""
    same = Window.partitionBy(group, name)
    n, k = F.count("*").over(same), F.row_number().over(same.orderBy(order))
    return rows.withColumn("label", F.when(n > 1, F.concat(F.col(name), F.lit(" "), k.cast("string"))).otherwise(F.col(name)))


def slugs(rows: DataFrame, name: Column, order: str) -> DataFrame:
    """rows with slug: the name in lower case and hyphens; repeats get -2, -3 and so on."""
    base = F.regexp_replace(F.regexp_replace(F.lower(name), "[^0-9a-z]+", "-"), "^-|-$", "")
    k = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return rows.withColumn("_base", base).withColumn("slug", F.when(k == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), k.cast("string")))).drop("_base")
