"""Readers and writers over small files."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.sources import dumps, feeds, sinks


def test_statements_and_rss_of_files(spark, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE a (x int);\nINSERT INTO a (x, y) VALUES (1, 'b;c'), (2, 'it''s');\n")
    found = dumps.insert_rows(dumps.statements(spark, str(tmp_path / "d.sql")), "statement").collect()
    assert [(r["name"], r["columns"], r["values"]) for r in found] == [("a", ["x", "y"], ["1", "b;c"]), ("a", ["x", "y"], ["2", "it's"])]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>t</title><link>l</link></item><item><title>u</title></item></channel></rss>")
    assert sorted((r.title, r.link) for r in feeds.rss(spark, str(tmp_path / "f.xml")).collect()) == [("t", "l"), ("u", None)]
    assert feeds.whole_files(spark, str(tmp_path / "f.xml")).count() == 1


def test_shapes_at_the_edges(spark):
    lines = spark.createDataFrame([("f", 1, "a"), ("f", 2, "  "), ("g", 1, 'x:"y:""z""":1'), ("g", 2, "p:q:r:s")], "file string, number long, line string")
    got = {(r.file, r.number): (r.delimiter, r["values"]) for r in dumps.delimited(lines, "file", "number", "line").collect()}
    assert got == {("f", 1): (",", ["a"]), ("g", 1): (":", ["x", 'y:"z"', "1"]), ("g", 2): (":", ["p", "q", "r", "s"])}
    heads = spark.createDataFrame([(["id", "mail"],), (["1", "mail"],), (["a@b", "c"],), ([],)], "v array<string>")
    assert [r.h for r in heads.select(dumps.header_like(F.col("v")).alias("h")).collect()] == [True, False, False, False]
    tree = spark.createDataFrame([("t", k, x) for k, x in enumerate(["a", "├── b", "│       └── c", "└── d/", "    └── e", "note:"])], "file string, number int, line string")
    assert sorted(r.path for r in dumps.tree_paths(tree, "file", "number", "line").collect()) == ["a/b/c", "a/d/e"]
    odd = spark.createDataFrame([("[]",), (None,), ("3",), ('{"data": 1}',), ("{",)], "body string")
    assert feeds.feed_rows(odd, "body", {"a": ("b",)}).count() == 0
    assert dumps.thread_posts(lines.limit(0), "file", "number", "line").count() == 0


def test_deep_trees(spark):
    deep = [(k, "    " * k + "└── d%d" % k) for k in range(20)] + [(20, "    " * 18 + "└── e"), (21, "└── f")]
    tree = spark.createDataFrame([("t", k, x) for k, x in deep], "file string, number int, line string")
    above = "/".join(f"d{k}" for k in range(18))
    want = sorted([f"{above}/d18/d19", f"{above}/e", "f"])
    got = sorted(r.path for r in dumps.tree_paths(tree, "file", "number", "line").collect())
    assert got == want
    assert dumps.tree_paths(tree.limit(0), "file", "number", "line").count() == 0


def test_sinks(spark, tmp_path):
    top = str(tmp_path)
    rows = spark.createDataFrame([(1, "a", {"k": ["b"]}), (2, None, None)], "id int, t string, m map<string, array<string>>")
    assert not sinks.write_if_any(rows.limit(0), f"{top}/none") and sinks.write_if_any(rows, f"{top}/some")
    assert spark.read.parquet(f"{top}/some").count() == 2
    sinks.write_statistics({"one": rows.select("id", "t")}, top)
    assert spark.read.option("header", True).csv(f"{top}/one").columns == ["id", "t"]
    sinks.export(rows, f"{top}/out")
    with pytest.raises(ValueError, match="m in 1 rows"):
        sinks.export(rows.withColumn("m", F.expr("if(id = 1, map('k', array('x.onion')), null)")), f"{top}/bad")
    assert not (tmp_path / "bad").exists()
    sinks.write_version(rows, f"{top}/index", "v1")
    sinks.write_version(rows.where("id = 1"), f"{top}/index", "v2")
    now = sinks.pointer(spark, f"{top}/index")
    assert (now["current"], now["previous"], sinks.current_version(spark, f"{top}/index").count()) == ("v2", "v1", 1)
    sinks.enqueue(rows, rows.where("id = 1"), "id", f"{top}/queue")
    assert [r.id for r in spark.read.json(f"{top}/queue").collect()] == [2]
