"""Readers of leaked samples: delimited files, INSERT dumps, file trees and thread files.

All take lines or statements as rows, so that a file of any size is read by many tasks. Only shapes and counts are meant to leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DELIMITERS = (",", "\t", "|", ";", ":")
INSERT = r"(?is)INSERT\s+INTO\s+[`\"\[]?([\w.]+)[`\"\]]?\s*(?:\(([^)]*)\))?\s*VALUES(.*)"
TUPLE = r"\(((?:[^()']++|'[^']*+(?:''[^']*+)*+')*+)\)"
VALUE = r",((?:[^,']++|'[^']*+(?:''[^']*+)*+')*+)"


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file, statement: dumps cut at semicolons that end a line, so that files are split between tasks by line."""
    return spark.read.option("lineSep", ";\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("statement"))


def fields(line: Column, delimiter: str) -> Column:
    """The values of a delimited line; quoted ones without their quotes."""
    d = "\\" + delimiter if delimiter != "\t" else "\t"
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}("[^"]*+(?:""[^"]*+)*+"|[^{d}]*)'))
    return F.transform(found, lambda v: F.when(v.rlike('^".*"$'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))


def delimited(lines: DataFrame, file: str, number: str, line: str, sample: int = 20) -> DataFrame:
    """file, number, delimiter, values for each line that isn't blank.

    A file's delimiter is the one that its first sample lines all have equally often, and most often; of equals the first of
    DELIMITERS; a comma if there is none. Counts of the sample are combined for each file before the shuffle.
    """
    rows = lines.where(F.trim(line) != "").select(F.col(file).alias("file"), F.col(number).alias("number"), F.col(line).alias("line"))
    counts = [(F.length("line") - F.length(F.replace("line", F.lit(d), F.lit("")))).alias(f"n{k}") for k, d in enumerate(DELIMITERS)]
    shape = rows.where(F.col("number") <= sample).select("file", *counts).groupBy("file")
    ends = shape.agg(*[f(f"n{k}").alias(f"{f.__name__}{k}") for k in range(len(DELIMITERS)) for f in (F.min, F.max)])
    fit = F.greatest(*[F.when(F.col(f"min{k}") == F.col(f"max{k}"), F.struct(F.col(f"min{k}").alias("n"), F.lit(-k).alias("k"))) for k in range(len(DELIMITERS))])
    chosen = ends.select("file", F.when(fit.n > 0, -fit.k).otherwise(0).alias("k"))
    placed = rows.join(chosen, "file", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    values, mark = fields(F.col("line"), ","), F.lit(",")
    for k, d in enumerate(DELIMITERS[1:], 1):
        values, mark = F.when(F.col("k") == k, fields(F.col("line"), d)).otherwise(values), F.when(F.col("k") == k, d).otherwise(mark)
    return placed.select("file", "number", mark.alias("delimiter"), values.alias("values"))


def header_like(values: Column) -> Column:
    """Whether a first line can be names: none blank, long, a number, a date or an address."""
    return (F.size(values) > 0) & F.forall(values, lambda v: (F.trim(v) != "") & (F.length(F.trim(v)) <= 40) & ~F.contains(v, F.lit("@")) & ~F.trim(v).rlike(r"^[\d.,:/\- ]+$"))


def insert_rows(dump: DataFrame, statement: str) -> DataFrame:
    """name, columns (null if not given), values for each tuple of the INSERT statements; the other statements give none.

    A null value is the text NULL, as written. Doubled quotes stand for one.
    """
    s = F.col(statement)
    # The head is read before tuples become rows: beside explode() it would be read from the whole statement for each of them.
    heads = dump.where(s.rlike(r"(?i)INSERT\s+INTO")).select(
        F.regexp_extract(s, INSERT, 1).alias("name"), F.regexp_extract(s, INSERT, 2).alias("_columns"), F.regexp_extract_all(F.regexp_extract(s, INSERT, 3), F.lit(TUPLE)).alias("_tuples")
    )
    found = heads.select("name", "_columns", F.explode("_tuples").alias("_tuple"))
    columns = F.when(F.col("_columns") != "", F.transform(F.split("_columns", ","), lambda c: F.btrim(c, F.lit(' `"[]\t\n'))))

    def bare(v: Column) -> Column:
        t = F.btrim(v, F.lit(" \t\n"))
        return F.when(F.startswith(t, F.lit("'")), F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'"))).otherwise(t)

    values = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "_tuple"), F.lit(VALUE)), bare)
    return found.select("name", columns.alias("columns"), values.alias("values"))


def _nested(depth: int) -> str:
    """Anything within brackets: texts in quotes, and brackets down to depth."""
    quoted = r"'[^']*+(?:''[^']*+)*+'|\"[^\"]*+\"|`[^`]*+`"
    inner = r"[^()'\"`]"
    for _ in range(depth):
        inner = rf"[^()'\"`]|{quoted}|\((?:{inner})*+\)"
    return rf"(?:{inner}|{quoted})"


#: The head of a table's definition, its columns' part, one column's part, and parts that are no columns (fixed patterns).
CREATE = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\("
COLUMN_PART = r"(?s)((?:(?!,)" + _nested(4) + r")+)"
COLUMN_NAME = r"^[`\"\[]?(\w+)[`\"\]]?\s"
NO_COLUMN = r"(?i)^(PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FOREIGN|CHECK|FULLTEXT|SPATIAL)\b"
#: How tuples are written (fixed values).
A_LINE, A_LIST, A_STATEMENT = "줄 단위 튜플", "확장 INSERT", "문장당 한 튜플"


def table_shapes(dump: DataFrame, statement: str, *by: str) -> DataFrame:
    """name, columns, n_tuples and ways for each table of a dump's statements (for each value of the columns by).

    columns: of its first definition, in the order of the statements, else those named by its first INSERT, else empty;
    parts of a definition are told apart outside quotes and brackets (down to four deep). n_tuples: of all its INSERTs. ways:
    how many of them are written a tuple a line, as a list, or one alone. Values are counted and never returned.

    A row is a statement, so tasks share a dump of any size; counts are combined before they are shuffled, and a table's
    first statement is found by its place, so that it does not matter where the dump was cut. Statements of other kinds are left out.
    """
    s, at = F.col(statement), F.monotonically_increasing_id()
    body = F.regexp_extract(s, CREATE + "(" + _nested(4) + r"*+)\)", 2)
    parts = F.transform(F.regexp_extract_all(body, F.lit(COLUMN_PART)), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    defined = F.transform(F.filter(parts, lambda p: ~p.rlike(NO_COLUMN) & p.rlike(COLUMN_NAME)), lambda p: F.regexp_extract(p, COLUMN_NAME, 1))
    named = F.transform(F.split(F.regexp_extract(s, INSERT, 2), ","), lambda c: F.btrim(c, F.lit(' `"[]\t\r\n')))
    values = F.regexp_extract(s, INSERT, 3)
    n = F.size(F.regexp_extract_all(values, F.lit(TUPLE)))
    rows = dump.select(
        *by,
        at.alias("at"),
        F.when(s.rlike(CREATE), F.regexp_extract(s, CREATE, 1)).when(s.rlike(INSERT), F.regexp_extract(s, INSERT, 1)).alias("name"),
        F.when(s.rlike(CREATE), defined).alias("defined"),
        F.when(s.rlike(CREATE) | (F.regexp_extract(s, INSERT, 2) == ""), None).otherwise(named).alias("named"),
        F.when(s.rlike(CREATE), 0).otherwise(n).cast("long").alias("n"),
        F.when(~s.rlike(CREATE), F.when(F.size(F.regexp_extract_all(values, F.lit(r"(?m)^[ \t]*(\()"))) > 1, A_LINE).when(n > 1, A_LIST).otherwise(A_STATEMENT)).alias("way"),
    ).where("name IS NOT NULL")
    first = lambda c: F.min(F.when(F.size(c) > 0, F.struct("at", F.col(c).alias("columns"))))["columns"]
    ways = F.map_filter(F.map_from_arrays(F.array(*[F.lit(w) for w in (A_LINE, A_LIST, A_STATEMENT)]), F.array(*[F.count(F.when(F.col("way") == w, 1)) for w in (A_LINE, A_LIST, A_STATEMENT)])), lambda _, k: k > 0)
    found = rows.groupBy(*by, "name").agg(first("defined").alias("_defined"), first("named").alias("_named"), F.sum("n").alias("n_tuples"), ways.alias("ways"))
    return found.select(*by, "name", F.coalesce("_defined", "_named", F.array().cast("array<string>")).alias("columns"), "n_tuples", "ways")


def tree_paths(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """file, number, path for each entry of `tree` output that has none below it.

    The depth is the width of the branch marks over four. An ancestor is the last entry of its level that is
    not older than that of a level above. The levels that occur are read first, in one aggregate, and each has a
    column; so depth has no limit. A file's lines pass through one ordered window, which Spark streams and spills.
    """
    marks = F.regexp_extract(line, r"^[│├└─|`\-\s\x{00A0}]*", 0)
    rows = lines.select(F.col(file).alias("file"), F.col(number).alias("number"), F.floor(F.length(marks) / 4).cast("int").alias("depth"), F.rtrim(F.substring(line, F.length(marks) + 1, F.length(line)), F.lit("/ ")).alias("name"))
    rows = rows.where((F.col("name") != "") & ~F.endswith("name", F.lit(":")))
    levels = sorted(r.depth for r in rows.select("depth").distinct().collect())
    order = Window.partitionBy("file").orderBy("number")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = [F.last(F.when(F.col("depth") == d, F.struct("number", "name")), ignorenulls=True).over(so_far).alias(f"a{d}") for d in levels]
    placed = rows.select("*", (F.coalesce(F.lead("depth").over(order), F.lit(0)) > F.col("depth")).alias("has_below"), *above)
    parts, newest = [], F.lit(None).cast("long")
    for d in levels:
        at = F.col(f"a{d}.number").cast("long")
        parts.append(F.when((F.col("depth") >= d) & (newest.isNull() | (at > newest)), F.col(f"a{d}.name")))
        newest = F.greatest(newest, at)
    return placed.where(~F.col("has_below")).select("file", "number", F.concat_ws("/", *parts).alias("path"))


def thread_posts(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """file, thread, title, post, label, author, body of thread files: `## ` opens a thread, `### ` a post in it.

    Blank lines and fences are no part of a body. Lines before the first thread are left out. A post's lines are
    gathered; a file's lines pass through one ordered window.
    """
    rows = lines.select(F.col(file).alias("file"), F.col(number).alias("number"), F.col(line).alias("line"))
    is_post, is_thread = F.startswith("line", F.lit("### ")), F.startswith("line", F.lit("## "))
    so_far = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("thread", F.count(F.when(is_thread, 1)).over(so_far)).withColumn("_posts", F.count(F.when(is_post, 1)).over(so_far))
    is_body = ~is_post & ~is_thread & ~F.trim("line").isin("", "```")
    found = counted.where("thread > 0").groupBy("file", "thread", "_posts").agg(
        F.max(F.when(is_thread, F.trim(F.substring("line", 4, 1 << 30)))).alias("title"),
        F.max(F.when(is_post, F.trim(F.substring("line", 5, 1 << 30)))).alias("head"),
        F.transform(F.array_sort(F.collect_list(F.when(is_body, F.struct("number", "line")))), lambda x: x.line).alias("body"),
    )
    threads = Window.partitionBy("file", "thread")
    titled = found.select("*", F.max("title").over(threads).alias("_title"), F.row_number().over(threads.orderBy(F.col("title").isNull(), "_posts")).alias("_k"))
    head = r"^(원문|답글 \d+)\s+(\S+)"
    label = F.when(F.col("head").rlike(head), F.regexp_extract("head", head, 1)).otherwise(F.substring("head", 1, 12))
    author = F.when(F.col("head").rlike(head), F.regexp_extract("head", head, 2)).otherwise("?")
    posts = titled.where(F.col("head").isNotNull())
    place = F.row_number().over(threads.orderBy("_posts"))
    return posts.select("file", "thread", F.col("_title").alias("title"), place.alias("post"), label.alias("label"), author.alias("author"), F.array_join("body", "\n").alias("body"))
