"""Round 3: rows of a band's keys are dealt into chunks without passing a join for the large keys."""

from collections import Counter

import pytest

from saltmarsh.llm import simhash


@pytest.mark.parametrize("most, sizes", [(1024, {1: 1, 2: 5, 3: 4000}), (3, {1: 1, 2: 30, 3: 41, 4: 400, 5: 10}), (1024, {1: 3, 2: 10})])
def test_chunks_of_keys(spark, most, sizes, monkeypatch):
    monkeypatch.setattr(simhash, "KEYS", most)
    rows = spark.createDataFrame([(k, 10_000 * k + n, n, 7) for k, size in sizes.items() for n in range(size)], "key long, row long, fp long, size long")
    placed = simhash._chunked(rows, 10)
    assert placed.columns == ["key", "row", "fp", "size", "chunks", "own"]
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and (most < 1024 or "Join" not in plan)
    got = placed.collect()
    assert Counter(r.key for r in got) == sizes and len({r.row for r in got}) == len(got)
    assert all(r.chunks == -(-sizes[r.key] // 10) and 0 <= r.own < r.chunks for r in got)
