"""Round 3, F15: names that only left-out rows have are made once, and a file costs a few rows however many it holds."""

import random
import re

import numpy as np
import pytest

from saltmarsh.operators import guard
from saltmarsh.plans import guards


def counted(spark, rows, schema):
    """rows, and an accumulator of how many were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), made


def test_excluded_rows_are_made_once(spark):
    """Each was made twice before: for the names to look for, and for their kinds."""
    excluded, made = counted(spark, [("Alphaco", "a"), ("Betaco", "b"), ("Betaco", "a"), ("Gammaco", "c"), (None, "c")] * 5, "name string, kind string")
    shown = spark.createDataFrame([("alpha-co",), (None,)], "name string")
    files = spark.createDataFrame([("alphaco, gammaco betaco",), ("xbetaco BETACO",), ("alphaco",), (None,), ("",)], "text string")
    assert {tuple(r) for r in guard.left_out_names(excluded, shown, files).collect()} == {("c", 1), ("a", 1)}
    assert made.value == 25


@pytest.mark.parametrize("leading", [1, 2, 8])
@pytest.mark.parametrize("every", [False, True])
def test_first_names_are_those_that_are_replaced_first(spark, monkeypatch, leading, every):
    """every: all strings have marks, so leading groups often hold no name, and texts are looked through again."""
    if every:
        monkeypatch.setattr(guard, "_marks", lambda hashed, bits: np.full((guard.PROBES, bits // 8), 255, np.uint8))
    monkeypatch.setattr(guard, "TOGETHER", 300)
    r = random.Random(8)
    listed = sorted({" ".join(r.choices("abc ABD bcd cdaé 가나 나다".split(), k=r.randrange(1, 4))) for _ in range(12)})
    said = [" ".join(r.choices("abc abd bcd cdaé x y,z 가나다 q-q".split(), k=r.randrange(40))) for _ in range(80)] + ["", None, "zz" * 400]
    names = guard.usable_names(spark.createDataFrame([(n, "name") for n in listed], "name string, kind string"))
    texts = spark.createDataFrame([(t,) for t in said], "text string").repartition(3)
    want = sorted(h.hits[0]["name"] for h in guard.guarded(texts, names, domains=False).collect() if h.hits)
    assert len(want) > 40
    assert sorted(r.name for r in guard.first_names(texts, names, leading).collect()) == want


def test_a_text_gives_few_places_and_says_if_there_are_more():
    every = np.full(1 << 12, 255, np.uint8)
    texts = ["ab cd " * 500, "", "ab cd", "xabx"]
    text, start, end, more = guard.leading_places(texts, {True: [], False: [2]}, every, 3)
    assert list(zip(text.tolist(), start.tolist(), end.tolist(), more.tolist())) == [(0, 0, 2, True), (0, 3, 5, True), (0, 6, 8, True), (2, 0, 2, False), (2, 3, 5, False)]
    assert len(guard.leading_places(texts, {True: [], False: [2]}, every, None)[0]) == 1002
    # by way of the second, the first and the third string overlap
    text, start, end, more = guard.leading_places(["ab cd ef"], {True: [], False: [5]}, every, 1)
    assert (start.tolist(), end.tolist(), more.tolist()) == ([0, 3], [5, 8], [False, False])
    assert [len(x) for x in guard.leading_places(["ab"], {True: [], False: []}, every, 1)] == [0] * 4


def test_second_and_third_words(spark, tmp_path):
    r = random.Random(3)
    said = ["".join(r.choices("aB1 é가\n", weights=[9, 9, 1, 2, 1, 1, 1], k=r.randrange(60))) for _ in range(300)] + [None, "", "abcd Efgh efgh", "abcd efgh ijkl", "a" * 200_000]
    spark.createDataFrame([(k, t, "xx") for k, t in enumerate(said)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t in enumerate(said):
        w = re.findall("[A-Za-z]{4,}", t or "")
        if len(w) > 2 and w[1].lower() != w[2].lower():
            want += [(k, "xx", w[1]), (k, "xx", f"{w[1]} {w[2]}")]
    assert len(want) > 100
    assert sorted(tuple(x) for x in guards.second_words(spark, str(tmp_path)).collect()) == sorted(want)
