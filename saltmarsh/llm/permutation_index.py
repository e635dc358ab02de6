"""Approximate nearest neighbours by a permutation index: vectors as the order of their nearest pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.llm.shared import written

BLOCK = "block long, kind int, n int, rows binary, vectors binary, places binary"
FOUND = "query_row long, row long, score double"


def _usable(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """row, id, query, vec (array of double) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), vec.alias("vec"), bad.alias("bad"), some.alias("some"))
    return rows.where("vec IS NOT NULL AND NOT bad AND some").drop("bad", "some")


def _pivots(rows: DataFrame, most: int) -> np.ndarray:
    """Up to most different vectors, drawn by their hash, so that copies of a vector are no more likely than others."""
    drawn = rows.select(F.xxhash64("vec").alias("h")).distinct().orderBy(F.xxhash64("h"), "h").limit(most)
    met = rows.select("vec", F.xxhash64("vec").alias("h")).join(F.broadcast(drawn), "h").groupBy("h").agg(F.min("vec").alias("vec"))
    return np.array([r.vec for r in met.orderBy(F.xxhash64("h"), "h").collect()])


def _places(vectors: np.ndarray, pivots: np.ndarray, longest: float, as_query: bool) -> np.ndarray:
    """The place of each pivot (columns) in each vector's order of pivots, nearest first.

    Vectors get one more coordinate that makes all of them as long as the longest, and queries get zero there: the
    largest inner product is then the shortest distance.
    """
    rest = lambda v: np.sqrt(np.maximum(longest - (v * v).sum(1), 0))
    near = vectors @ pivots.T
    if not as_query:
        near += np.outer(rest(vectors), rest(pivots))
    order = np.argsort(-near, axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(len(pivots), dtype=np.uint8), order.shape), 1)
    return out


def _block(block: int, rows: pa.Table, pivots: np.ndarray, longest: float, as_query: bool) -> pa.RecordBatch:
    vectors = rows.column(1).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    places = _places(vectors, pivots, longest, as_query)
    data = [block, int(as_query), rows.num_rows, rows.column(0).to_numpy().tobytes(), vectors.tobytes(), places.tobytes()]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(data, types)], [f.split()[0] for f in BLOCK.split(", ")])


def _index(rows: DataFrame, pivots: np.ndarray, longest: float, blocks: int) -> DataFrame:
    """The rows dealt into blocks, numbered from 0, with the places of the pivots."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if all_rows := list(batches):
            yield _block(TaskContext.get().partitionId(), pa.Table.from_batches(all_rows), held.value, longest, False)

    return rows.select("row", "vec").repartition(blocks).mapInArrow(run, BLOCK)


def _queries(rows: DataFrame, pivots: np.ndarray, longest: float, most: int = 1024) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                yield _block(0, pa.Table.from_batches([batch.slice(at, most)]), held.value, longest, True)

    return rows.select("row", "vec").mapInArrow(run, BLOCK)


def _searched(k: int, lists: int, candidates: int, n_pivots: int):
    """Queries against a block: those posted in a list of the query, by footrule, and the best of them by inner product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(j, 1).to_pylist()[0] for j in range(batch.num_rows)):
                rows = np.frombuffer(one["rows"], np.int64)
                vectors = np.frombuffer(one["vectors"], np.float64).reshape(one["n"], -1)
                places = np.frombuffer(one["places"], np.uint8).reshape(one["n"], n_pivots)
                if one["kind"] == 0:  # the block comes before its queries
                    mine = rows, vectors, places
                    who, pivot = np.nonzero(places < lists)
                    by = np.argsort(pivot, kind="stable")
                    posted = np.split(who[by], np.cumsum(np.bincount(pivot, minlength=n_pivots))[:-1])
                    continue
                out = []
                for row, vector, place in zip(rows, vectors, places):
                    seen = np.zeros(len(mine[0]), bool)
                    for p in np.flatnonzero(place < lists):
                        seen[posted[p]] = True
                    near = np.flatnonzero(seen & (mine[0] != row))
                    if len(near) > candidates:
                        theirs = mine[2][near]
                        footrule = (np.maximum(theirs, place) - np.minimum(theirs, place)).sum(1, dtype=np.int64)
                        near = near[np.argpartition(footrule * len(near) + np.arange(len(near)), candidates)[:candidates]]
                    score = (mine[1][near] * vector).sum(1)
                    if len(near) > k:  # all that tie with the last stay
                        best = score >= np.partition(score, len(near) - k)[len(near) - k]
                        near, score = near[best], score[best]
                    out.append((np.full(len(near), row), mine[0][near], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_row", "row", "score"])

    return run


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    pivots: int = 256,
    lists: int = 16,
    candidates: int = 1000,
    block_rows: int = 8192,
) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row of vectors with is_query, the k found with the largest inner product.

    A vector is the order of its nearest pivots: up to 256 vectors, drawn by hash from the different ones; a bounded
    sample, that is all the driver sees. A vector is posted in the inverted files of its nearest lists pivots.
    A query reads the files of its own nearest lists pivots, ranks what it finds by Spearman's footrule over the
    places of all pivots, and the first candidates of every block are ranked anew by inner product in double precision.

    Every row is indexed. Vectors are dealt into blocks of about block_rows, each with its own inverted files; the index
    is written. Each block meets each block of queries in one shuffle of blocks, and gives k rows a query (more if some
    tie), of which a window with a limit keeps k. A pivot near to a third of all vectors is spread over all blocks, so
    no key of the data decides which task a row goes to. The work grows with queries times rows.

    Ties: the smaller id first, null ids last. A query's own row is no candidate, other rows with its id are. Vectors
    that are null, zero, or hold null or non-finite components take no part, as queries neither; nor do those of
    another length than most have (of equally frequent lengths, the smaller one counts). Fewer rows than k: all that are
    found. Null is_query: no query. Empty table: empty result. Other columns are ignored.
    """
    if pivots > 256:
        raise ValueError("places of pivots are bytes: at most 256 pivots")
    spark = vectors.sparkSession
    rows = written(_usable(vectors, id_col, vec_col, is_query), "vectors")
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    names = [F.col("query_id"), F.col("rank"), F.col("id").alias(id_col), F.col("score")]
    if most is None:
        none = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))
        return none.where("false").select(*names)
    rows = rows.where(F.size("vec") == most.dim)
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    drawn = _pivots(rows, pivots)
    blocks = max(1, math.ceil(rows.count() / block_rows))
    index = written(_index(rows, drawn, longest, blocks), "permutation-index")
    asked = written(_queries(rows.where("query"), drawn, longest), "permutation-queries")
    to_all = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = index.unionByName(to_all).repartition(parts, "block").sortWithinPartitions("block", "kind")
    found = met.mapInArrow(_searched(k, min(lists, len(drawn)), candidates, len(drawn)), FOUND)
    ids = rows.select("row", "id")
    placed = found.join(ids, "row").select("query_row", "row", "id", "score")
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    best = placed.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(ids.select(F.col("row").alias("query_row"), F.col("id").alias("query_id")), "query_row").select(*names)
