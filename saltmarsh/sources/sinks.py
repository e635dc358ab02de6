"""Writers: nothing for nothing, one folder a statistic, versions behind a pointer, a gate, and a queue of cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Addresses that must not leave (fixed pattern).
FORBIDDEN = r"(?i)\b[a-z2-7]{56}\b|\b[a-z0-9.-]+\.onion\b|\bt\.me/\S+"


def write_if_any(rows: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Writes rows as Parquet unless there are none, so that a feed that fails does not empty the table it feeds."""
    if rows.isEmpty():
        return False
    rows.write.mode(mode).parquet(path)
    return True


def write_statistics(statistics: dict[str, DataFrame], folder: str) -> None:
    """Each statistic as CSV with a header in its own folder."""
    for name, rows in statistics.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def strings_of(column: Column, kind: DataType) -> Column | None:
    """All texts within a column of any depth as an array; none if it can hold no text."""
    if isinstance(kind, StringType):
        return F.array(column)
    if isinstance(kind, StructType):
        inner = [s for f in kind.fields if (s := strings_of(column[f.name], f.dataType)) is not None]
        return F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in inner])) if inner else None
    if isinstance(kind, ArrayType):
        if strings_of(F.lit(None), kind.elementType) is None:
            return None
        return F.flatten(F.transform(column, lambda x: F.coalesce(strings_of(x, kind.elementType), F.array().cast("array<string>"))))
    if isinstance(kind, MapType):
        parts = [p for c, k in ((F.map_keys(column), kind.keyType), (F.map_values(column), kind.valueType)) if (p := strings_of(c, ArrayType(k))) is not None]
        return F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])) if parts else None
    return None


def violations(rows: DataFrame, pattern: str = FORBIDDEN) -> DataFrame:
    """column, n: how many rows hold a forbidden text in each column, at any depth. Empty if all may leave."""
    found = []
    for field in rows.schema.fields:
        texts = strings_of(F.col(field.name), field.dataType)
        if texts is not None:
            found.append(F.when(F.exists(texts, lambda t: t.rlike(pattern)), F.lit(field.name)))
    if not found:
        return rows.select(F.lit("").alias("column"), F.lit(0).cast("long").alias("n")).limit(0)
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("column")).groupBy("column").agg(F.count("*").alias("n"))


def export(rows: DataFrame, path: str, pattern: str = FORBIDDEN) -> None:
    """Writes rows as JSON if nothing in them is forbidden, else raises and writes nothing."""
    bad = violations(rows, pattern).collect()  # a row a column
    if bad:
        raise ValueError("not written: " + ", ".join(f"{r['column']} in {r['n']} rows" for r in sorted(bad)))
    rows.write.mode("overwrite").json(path)


#: A check of what lies at a path: keys that it may have, values that it may be, a shape, or a most length.
Check = dict[str, object]


def walked(column: Column, kind: DataType, path: str, checks: dict[str, Check]) -> Column | None:
    """What checks find at path and below, as an array of path, what, value; null-safe. None if there is nothing to look at.

    Paths are names joined by dots; [] stands for any item of an array, {} for any value of a map. Values are told as text.
    """
    check, found = checks.get(path, {}), []
    row = lambda where, what, value: F.struct(F.lit(where).alias("path"), F.lit(what).alias("what"), value.cast("string").alias("value"))
    alone = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.array(row(path, what, column)))
    if "values" in check:
        found.append(alone(column.isNotNull() & ~column.isin(*check["values"]), "value"))
    if "shape" in check:
        found.append(alone(~column.cast("string").rlike(check["shape"]), "shape"))
    if "longest" in check:
        found.append(alone(F.length(column.cast("string")) > check["longest"], "length"))
    if isinstance(kind, StringType) and checks.get("*", {}).get("forbidden"):
        found.append(alone(column.rlike(checks["*"]["forbidden"]), "forbidden"))
    if isinstance(kind, StructType):
        keys = check.get("keys")
        for f in kind.fields:
            below = f"{path}.{f.name}" if path else f.name
            if keys is not None and f.name not in keys:
                found.append(F.when(column[f.name].isNotNull(), F.array(row(path, "key", F.lit(f.name)))))
            found.append(walked(column[f.name], f.dataType, below, checks))
    elif isinstance(kind, ArrayType):
        if walked(F.lit(None), kind.elementType, f"{path}[]", checks) is not None:
            found.append(F.flatten(F.transform(column, lambda x: F.coalesce(walked(x, kind.elementType, f"{path}[]", checks), _none()))))
    elif isinstance(kind, MapType):
        keys = check.get("keys")
        if keys is not None:
            found.append(F.transform(F.filter(F.map_keys(column), lambda k: ~k.isin(*keys)), lambda k: row(path, "key", k)))
        if walked(F.lit(None), kind.valueType, f"{path}{{}}", checks) is not None:
            found.append(F.flatten(F.transform(F.map_values(column), lambda x: F.coalesce(walked(x, kind.valueType, f"{path}{{}}", checks), _none()))))
    found = [F.coalesce(f, _none()) for f in found if f is not None]
    return F.concat(*found) if found else None


def _none() -> Column:
    return F.array().cast("array<struct<path:string,what:string,value:string>>")


def checked(rows: DataFrame, checks: dict[str, Check]) -> DataFrame:
    """path, what, value: a row for each place in rows, at any depth, that a check speaks against.

    checks: by path, keys (what a struct or a map may have; a struct's null fields are not there), values, shape (a pattern), longest;
    the path "" is the row, and "*" has forbidden, a pattern that no text anywhere may meet. A null passes every check.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    found = walked(whole, rows.schema, "", checks)
    if found is None:
        return rows.select(F.inline(_none())).limit(0)
    return rows.select(F.inline(found))


def export_checked(rows: DataFrame, path: str, checks: dict[str, Check]) -> None:
    """Writes rows as JSON if no check speaks against anything in them, else raises with a few of the paths and writes nothing."""
    bad = checked(rows, checks).groupBy("path", "what").count().orderBy("path", "what").limit(20).collect()
    if bad:
        raise ValueError("not written: " + ", ".join(f"{r.what} at {r.path or 'the row'} ({r['count']})" for r in bad))
    rows.write.mode("overwrite").json(path)


#: Types that may become others without losing anything.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double", "string"), "smallint": ("int", "bigint", "double", "string"), "int": ("bigint", "double", "string"),
    "bigint": ("string",), "float": ("double", "string"), "double": ("string",), "date": ("timestamp", "string"), "boolean": ("string",),
}


def upgraded(rows: DataFrame, schema: StructType, defaults: dict[str, object]) -> DataFrame:
    """rows in schema: columns that they lack get their default (else null), and types become the wider ones of schema.

    A column that schema lacks, or a type that can't be widened without loss, is an error: nothing is dropped or narrowed.
    """
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    gone = sorted(set(have) - set(schema.names))
    if gone:
        raise ValueError(f"the new schema has no {', '.join(gone)}")
    out = []
    for f in schema.fields:
        want = f.dataType.simpleString()
        if f.name not in have:
            out.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
            continue
        if have[f.name] != want and want not in WIDER.get(have[f.name], ()):
            raise ValueError(f"{f.name}: {have[f.name]} can't become {want} without loss")
        out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return rows.select(*out)


def all_versions(spark: SparkSession, folder: str, versions: list[str], schema: StructType, defaults: dict[str, object]) -> DataFrame:
    """The rows of versions of a table as one, in schema; each version is read with its own schema and upgraded."""
    parts = [upgraded(spark.read.parquet(f"{folder}/version={v}"), schema, defaults) for v in versions]
    return reduce(DataFrame.unionByName, parts)


def migrate(spark: SparkSession, folder: str, version: str, schema: StructType, defaults: dict[str, object]) -> bool:
    """Writes the current version anew in schema and points to it; False if it has that schema already.

    A reader of the old version goes on with it, as nothing in it is touched, and the new one gives it the same rows.
    """
    now = current_version(spark, folder)
    same = [(f.name, f.dataType) for f in now.schema.fields] == [(f.name, f.dataType) for f in schema.fields]
    if not same:
        write_version(upgraded(now, schema, defaults), folder, version)
    return not same


def write_version(rows: DataFrame, folder: str, version: str) -> None:
    """Writes a version, then points to it: a reader sees the old version or the new one, whole."""
    rows.write.mode("errorifexists").parquet(f"{folder}/version={version}")
    spark = rows.sparkSession
    previous = pointer(spark, folder)
    serial = 1 + (previous["serial"] if previous else 0)
    spark.createDataFrame([(serial, version, previous["current"] if previous else None)], "serial long, current string, previous string").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def pointer(spark: SparkSession, folder: str):
    """serial, current, previous of the last version pointed to, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{folder}/pointer").orderBy(F.desc("serial")).first()


def current_version(spark: SparkSession, folder: str) -> DataFrame:
    now = pointer(spark, folder)
    if now is None:
        raise ValueError(f"no version in {folder}")
    return spark.read.parquet(f"{folder}/version={now['current']}")


def new_cases(rows: DataFrame, queued: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not queued yet. Null keys are never queued."""
    return rows.where(F.col(key).isNotNull()).join(queued.select(key).distinct(), key, "left_anti")


def enqueue(rows: DataFrame, queued: DataFrame, key: str, folder: str) -> None:
    """The new cases as JSON, all rows of a case in one folder of its own."""
    new_cases(rows, queued, key).repartition(key).write.partitionBy(key).mode("append").json(folder)
