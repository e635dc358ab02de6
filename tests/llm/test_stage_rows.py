"""The pipeline's stages judge rows, not ids: null and repeated ids."""

from saltmarsh.llm import crf_quality, exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string"
ONE, TWO, THREE = "first text of some words", "quite another text here", "one more without a number"


def kept(rows):
    return sorted(((r.doc_id, r.text, r.lang) for r in rows.collect()), key=str)


def test_copies_by_row(spark):
    rows = [(None, THREE, "a"), (None, THREE, "a"), (5, ONE, "b"), (5, ONE, "b"), (7, ONE, "c"), (7, TWO, "d"), (None, TWO, "e"), (None, ONE, "f"), (8, None, "g"), (None, "", "h")]
    want = sorted([(None, THREE, "a"), (5, ONE, "b"), (7, TWO, "d"), (8, None, "g")], key=str)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert kept(exact_dedup.drop_exact_copies(docs)) == want
    assert kept(simhash.drop_near_copies(docs)) == want
    for stage in (exact_dedup.drop_exact_copies, simhash.drop_near_copies):
        assert stage(docs.limit(0)).count() == 0
        assert stage(docs).columns == docs.columns


def test_quality_by_row(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(None, good, "a"), (3, good, "b"), (3, "short", "c"), (4, good, "d"), (4, good, "d"), (None, None, "e")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = crf_quality.drop_low_quality(spark.createDataFrame(rows, SCHEMA), labels)
    assert kept(got) == sorted([(None, good, "a"), (3, good, "b"), (4, good, "d"), (4, good, "d")], key=str)


def test_clashing_columns_and_text_ids(spark):
    """Stages keep columns of any name, and rows with ids that are no numbers."""
    schema = "doc_id string, text string, _row long, _row_ string, _kept_id int, _first_id int, id long, row long, `group` string, digest string, open boolean, n int"
    rows = [(f"x{k}", t, k, "a", 1, 2, 3, 4, "g", "d", True, 5) for k, t in enumerate([ONE, ONE, TWO, THREE, None, ""])]
    docs = spark.createDataFrame(rows, schema)
    for stage in (exact_dedup.drop_exact_copies, simhash.drop_near_copies):
        got = stage(docs)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=str) == [rows[0], *rows[2:5]]
    labels = spark.createDataFrame([("x0", 1)], "doc_id string, quality int")
    assert crf_quality.drop_low_quality(docs, labels).columns == docs.columns
