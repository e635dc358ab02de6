"""The permutation index against brute force: recall, exact scores, order, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import permutation_index, queries


def brute(rows, asks, k):
    """query row -> [(id, score)] over usable rows, by plain double products."""
    usable = [(j, i, np.array(v, float)) for j, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for j, i, v in usable:
        if asks(i):
            near = [(-(w * v).sum(), o, n) for n, o, w in usable if n != j]
            out.setdefault(i, []).append([(o, -s) for s, o, _ in sorted(near)[:k]])
    return out


def recall(found, want):
    hits = [sum(i in {r.vec_id for r in found if r.query_id == q} for i, _ in near) / len(near) for q, lists in want.items() for near in lists if near]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = queries.QUERIES["op11_permutation_index"](spark, folder).collect()
    want = brute(rows, lambda i: i % 20 == 0, 20)
    vectors = {i: np.array(v, float) for i, v in rows}
    assert recall(found, want) >= 0.9
    for q in want:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - (vectors[q] * vectors[r.vec_id]).sum()) < 1e-12 and r.vec_id != q for r in mine)


def test_recall_with_lengths_and_copies(spark):
    """Lengths that differ by the factor of 5, and a third of all rows one vector."""
    rng = np.random.default_rng(4)
    mid = rng.normal(size=(12, 24))
    vectors = (mid[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24))) * rng.uniform(1, 5, size=(3000, 1))
    vectors[rng.random(3000) < 0.33] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    found = permutation_index.neighbours(df, F.col("vec_id") % 100 == 0, k=10, candidates=200, block_rows=500).collect()
    want = brute(rows, lambda i: i % 100 == 0, 10)
    reached = [np.mean([r.score >= near[-1][1] - 1e-9 for r in found if r.query_id == q]) for q, (near,) in want.items()]
    assert np.mean(reached) >= 0.9 and len(found) == 10 * len(want)


def test_rows_that_take_no_part(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [2.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, id string, row int, score double")
    found = permutation_index.neighbours(df, F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    told = sorted((r.query_id, r["rank"], -1 if r.vec_id is None else r.vec_id, r.score) for r in found.collect())
    one = [(1, 3, 2.0), (2, 1, 1.0), (3, 20, 1.0), (4, -1, 1.0)]
    assert told == sorted([(20, *x) for x in one] * 2)
    assert permutation_index.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert permutation_index.neighbours(df.where("vec_id = 3"), F.lit(True)).count() == 0
    assert permutation_index.neighbours(df, F.lit(None).cast("boolean")).count() == 0
    texts = df.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding")
    assert {r.vec_id for r in permutation_index.neighbours(texts, F.col("vec_id") == "v3").collect()} == {"v1", "v20", None}
