"""Cross-entropy difference of two bigram models, one of target texts and one of all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.byte_bpe import squeezed_ranks, widened_ranks
from saltmarsh.llm.shared import written

#: Texts of so many bytes, or so many texts, make a block.
BLOCK_BYTES, BLOCK_TEXTS = 8_000_000, 100_000
#: Counts of so many tokens' words and pairs are added up together, in one bucket.
BUCKET_TOKENS = 3_000_000
#: Most buckets: a block of full size still sends each some twenty counts, so rows stay few beside what they hold.
MOST_BUCKETS = 50_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than ASCII white space, ASCII letters in lower case."""
    return (text or "").encode().lower().split()


def _blocks(texts: DataFrame) -> DataFrame:
    """Texts (id, text) as numbers of words: a row a block with its ids, words in each text, and the distinct words' hashes."""
    id_type = texts.schema["id"].dataType.simpleString()
    names = ["block", "ids", "sizes", "words", "stream", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        ids, sizes, stream, numbers = [], [], [], {}

        def out(kind: pa.DataType) -> pa.RecordBatch:
            places = np.concatenate(stream)
            often = np.argsort(-np.bincount(places, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in numbers), np.uint64, len(numbers))[often]
            row = [block, ids, squeezed_ranks(np.array(sizes, np.uint32)), hashes.tobytes(), squeezed_ranks(rank[places].astype(np.uint32)), len(places)]
            types = [pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                ids.append(doc_id)
                sizes.append(len(words))
                stream.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)).astype(np.uint32))
                held += sum(map(len, words)) + len(words)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                    yield out(kind)
                    block, held = block + 1, 0
                    ids, sizes, stream, numbers = [], [], [], {}
        if ids:
            yield out(kind)

    return texts.mapInArrow(run, f"block long, ids array<{id_type}>, sizes binary, words binary, stream binary, tokens long")


class Grams:
    """The words and word pairs of a block, each once: hashes, in order and by bucket, and where each token finds its own."""

    def __init__(self, sizes: bytes, words: bytes, stream: bytes, buckets: int, places: bool = False) -> None:
        self.sizes, self.ids = widened_ranks(sizes).astype(np.int64), widened_ranks(stream).astype(np.int64)
        self.words = np.frombuffer(words, np.uint64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.firsts = np.zeros(len(self.ids), bool)
        self.firsts[starts[self.sizes > 0]] = True
        n = max(1, len(self.words))
        self.keys = (np.roll(self.ids, 1) * n + self.ids)[~self.firsts]
        if places:
            pairs, self.pair_at = np.unique(self.keys, return_inverse=True)
        else:
            pairs, self.pair_n = np.unique(self.keys, return_counts=True)
        self.coded, (self.before, self.after) = pairs, np.divmod(pairs, n)
        x = self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.after] * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pairs = (x ^ (x >> np.uint64(32))) * np.uint64(0x165667B19E3779F9)
        self.word_order, self.pair_order = np.argsort(self.words, kind="stable"), np.argsort(self.pairs, kind="stable")
        #: Where each bucket's words and pairs begin in their order: a bucket is a range of hashes.
        low = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
        self.cuts = [np.concatenate(([0], np.searchsorted(x[order], low), [len(x)])) for x, order in ((self.words, self.word_order), (self.pairs, self.pair_order))]


def _steps(words: np.ndarray, pairs: np.ndarray) -> bytes:
    """Rising hashes as their differences, byte plane by byte plane, compressed."""
    steps = np.concatenate([np.diff(x, prepend=np.uint64(0)) for x in (words, pairs)])
    raw = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _stepped(data: bytes, words: int) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.concatenate([np.cumsum(steps[:words]), np.cumsum(steps[words:])])


_SENT = ["block", "bucket", "words", "keys", "target", "background"]


def _own_counts(marked: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket a row with the hashes of the block's words (words of them), then pairs, and their counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams = Grams(row["sizes"], row["words"], row["stream"], buckets)
                good = np.zeros(len(grams.sizes), bool)
                good[row["good"] or []] = True
                of_target = np.repeat(good, grams.sizes)
                size = len(grams.words)
                word_n = np.bincount(grams.ids, minlength=size), np.bincount(grams.ids[of_target], minlength=size)
                coded, n = np.unique(grams.keys[of_target[~grams.firsts]], return_counts=True)
                pair_target = np.zeros(len(grams.pairs), np.int64)
                pair_target[np.searchsorted(grams.coded, coded)] = n
                counts = ((grams.words, *word_n, grams.word_order), (grams.pairs, grams.pair_n, pair_target, grams.pair_order))
                cuts = grams.cuts
                for b in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist():
                    at = [x[3][c[b] : c[b + 1]] for x, c in zip(counts, cuts, strict=True)]
                    every, target = (np.concatenate([x[k][a] for x, a in zip(counts, at, strict=True)]) for k in (1, 2))
                    keys = [x[0][a] for x, a in zip(counts, at, strict=True)]
                    values = [row["block"], b, len(at[0]), _steps(*keys), squeezed_ranks(target.astype(np.uint32)), squeezed_ranks(every.astype(np.uint32))]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], _SENT)

    return marked.select("block", "sizes", "words", "stream", "good").mapInArrow(run, "block long, bucket int, words int, keys binary, target binary, background binary")


_GIVEN = ["block", "bucket", "words", "target", "background", "totals"]
_GIVEN_SCHEMA = "block long, bucket int, words int, target binary, background binary, totals array<long>"


def _all_counts(own: DataFrame, partitions: int) -> DataFrame:
    """The rows of own with counts over all blocks in place of the block's own, without the hashes; totals of each bucket's words apart."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def add_up(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = [_stepped(r["keys"], r["words"]) for r in rows]
        splits = [r["words"] for r in rows]
        own_counts = {c: [widened_ranks(r[c]) for r in rows] for c in ("target", "background")}
        given, totals = {c: [[], []] for c in own_counts}, [0, 0, 0]
        for part in (0, 1):
            cut = [slice(None, s) if part == 0 else slice(s, None) for s in splits]
            every, at = np.unique(np.concatenate([k[c] for k, c in zip(keys, cut, strict=True)]), return_inverse=True)
            ends = np.cumsum([len(k[c]) for k, c in zip(keys, cut, strict=True)])[:-1]
            for k, (name, counts) in enumerate(own_counts.items()):
                total = np.bincount(at, np.concatenate([n[c] for n, c in zip(counts, cut, strict=True)]), minlength=len(every))
                given[name][part] = np.split(total.astype(np.int64)[at], ends)
                if part == 0:
                    totals[k] = int(total.sum())
            if part == 0:
                totals[2] = len(every)
        for k, r in enumerate(rows):
            packed = {c: np.concatenate([given[c][0][k], given[c][1][k]]).astype("<i8") for c in own_counts}
            values = [r["block"], r["bucket"], r["words"], *(_wide(packed[c]) for c in ("target", "background")), totals if k == 0 else None]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], _GIVEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if rows and rows[0]["bucket"] != row["bucket"]:
                    yield from add_up(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from add_up(rows)

    return own.repartition(partitions, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, _GIVEN_SCHEMA)


def _wide(values: np.ndarray) -> bytes:
    """Counts that may pass 32 bits: the low and the high half, each with small numbers in a byte."""
    low, high = squeezed_ranks((values & 0xFFFFFFFF).astype(np.uint32)), squeezed_ranks((values >> 32).astype(np.uint32))
    return len(low).to_bytes(8, "little") + low + high


def _whole(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return widened_ranks(data[8:cut]).astype(np.int64) + (widened_ranks(data[cut:]).astype(np.int64) << 32)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", strength: float = 20.0) -> DataFrame:
    """id_col, n_tokens, target_loss, background_loss, score for each row of docs; losses are means over tokens, in nats.

    The target model is that of all documents that labels call good (label_col 1), the background that of all documents.
    Both are bigram models over one vocabulary, smoothed from single words with a weight of strength counts. score is the
    mean of each token's loss under the target model less its loss under the background: the lower, the more a text is
    like the target.

    Every word and every pair has its own counts, over all documents and all good ones: nothing is left out or limited, and
    three sums reach the driver. Blocks of documents are written as numbers of their words. Each block sends the counts of
    its own words and pairs to buckets by hash, where the counts of all blocks are added up, and gets the sums back in the
    order in which it sent them. A word or pair with any share of the corpus is one entry a block. Buckets and tasks
    grow with the tokens; a task holds a bucket's counts or a block. Words and pairs are told apart by 64-bit hashes.

    A document is good if the largest of its labels is 1; documents without a label are background only. Without good
    documents the target model is uniform. Null or empty text: no tokens, null losses and score. Null or repeated ids:
    each row has its result; ids keep their type. Empty table: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label = 1 AND id IS NOT NULL").select("id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    blocks = written(_blocks(texts), "lm-blocks")
    tokens, n_blocks = blocks.agg(F.sum("tokens"), F.count("*")).first()
    buckets = min(MOST_BUCKETS, max(partitions, (tokens or 0) // BUCKET_TOKENS))
    places = blocks.select("block", F.posexplode("ids").alias("place", "id")).join(good, "id").groupBy("block").agg(F.collect_list("place").alias("good"))
    given = written(_all_counts(_own_counts(blocks.join(places, "block", "left"), buckets), max(partitions, buckets)), "lm-counts")
    sums = given.where("totals IS NOT NULL").agg(*[F.sum(F.col("totals")[k]) for k in range(3)]).first()
    totals, size = np.array([[sums[0] or 0], [sums[1] or 0]], float), (sums[2] or 0) + 1

    def score(row: dict, given: list[dict]) -> pa.RecordBatch:
        grams = Grams(row["sizes"], row["words"], row["stream"], buckets, places=True)
        word, pair = np.zeros((2, len(grams.words))), np.zeros((2, len(grams.pairs)))
        for k, c in enumerate(("target", "background")):
            counts = [_whole(r[c]) for r in given]
            if counts:
                word[k, grams.word_order] = np.concatenate([n[: r["n"]] for n, r in zip(counts, given, strict=True)])
                pair[k, grams.pair_order] = np.concatenate([n[r["n"] :] for n, r in zip(counts, given, strict=True)])
        single = (word + 1.0) / (totals + size)
        follow = (pair + strength * single[:, grams.after]) / (word[:, grams.before] + strength)
        losses = np.empty((2, len(grams.ids)))
        losses[:, grams.firsts] = -np.log(single)[:, grams.ids[grams.firsts]]
        losses[:, ~grams.firsts] = -np.log(follow)[:, grams.pair_at]
        sums, ends = np.concatenate([np.zeros((2, 1)), np.cumsum(losses, axis=1)], axis=1), np.cumsum(grams.sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (sums[:, ends] - sums[:, ends - grams.sizes]) / grams.sizes
        return [row["ids"], grams.sizes, *(pa.array(c, mask=grams.sizes == 0) for c in (mean[0], mean[1], mean[0] - mean[1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.to_pylist()[0]
                if row["n"] is not None:
                    given.append(row)
                    continue
                found = score(row, given)
                ids = pa.array(row["ids"], batch.schema.field("ids").type.value_type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found[1]), *found[2:]], ["id", "n_tokens", "target_loss", "background_loss", "score"])
                given = []

    of_blocks = blocks.select("block", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("int").alias("n"), "ids", "sizes", "words", "stream", *[F.lit(None).cast("binary").alias(c) for c in ("target", "background")])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", f"array<{id_type}>"), ("sizes", "binary"), ("words", "binary"), ("stream", "binary"))]
    met = of_blocks.unionByName(given.select("block", "bucket", F.col("words").alias("n"), *none, "target", "background"))
    met = met.repartition(max(partitions, (n_blocks or 0) // 4), "block").sortWithinPartitions("block", F.col("bucket").asc_nulls_last())
    return met.mapInArrow(run, f"id {id_type}, n_tokens long, target_loss double, background_loss double, score double").withColumnRenamed("id", id_col)
