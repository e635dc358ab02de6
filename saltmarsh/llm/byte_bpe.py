"""Byte-level BPE: each distinct word of the corpus is encoded once, in a shuffle of words, and its ids return to its places."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.shared import written

#: The characters with Unicode's White_Space property (fixed list).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Parts at whose borders the tokenizers' patterns always part too: a run of other characters with the
#: space before it, or a run of white space as far as those patterns take it.
PART = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

BLOCK = "block long, kind int, bucket int, ids array<long>, counts binary, codes binary, data binary"
_names = ["block", "kind", "bucket", "ids", "counts", "codes", "data"]
_types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def squeezed(values: np.ndarray) -> bytes:
    """32-bit unsigned integers, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def widened(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def squeezed_ranks(values: np.ndarray) -> bytes:
    """Numbers of words in which small ones are frequent: a byte each, 255 standing for one of the larger numbers, which follow apart."""
    small = _codec().compress(np.minimum(values, 255).astype(np.uint8).tobytes(), asbytes=True)
    return len(values).to_bytes(8, "little") + len(small).to_bytes(8, "little") + small + squeezed(values[values >= 255] - 255)


def widened_ranks(data: bytes) -> np.ndarray:
    size, cut = int.from_bytes(data[:8], "little"), 16 + int.from_bytes(data[8:16], "little")
    out = np.frombuffer(pa.decompress(data[16:cut], size, codec="zstd", asbytes=True), np.uint8).astype(np.uint32)
    out[out == 255] = widened(data[cut:]) + np.uint32(255)
    return out


def squeezed_strings(parts: list[bytes]) -> bytes:
    lengths, raw = squeezed(np.fromiter(map(len, parts), np.int64, len(parts))), b"".join(parts)
    return len(lengths).to_bytes(8, "little") + lengths + len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def widened_strings(data: bytes) -> list[bytes]:
    cut = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(widened(data[8:cut]).astype(np.int64)).tolist()
    size = int.from_bytes(data[cut : cut + 8], "little")
    raw = pa.decompress(data[cut + 8 :], size, codec="zstd", asbytes=True) if size else b""
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, of which one at a time is in Python's hands: each may hold a block's positions."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(_names, _types, strict=True)], _names)


def _blocks(docs: DataFrame, buckets: int, block_chars: int) -> DataFrame:
    """Texts as places of words: for each block of documents a row of kind 1 with the words' numbers in order, and
    for each bucket of words a row of kind 0 with the block's distinct words in it and their numbers."""

    def rows(block: int, ids: list, counts: list[int], stream: list[np.ndarray], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
        places = np.concatenate(stream) if stream else np.zeros(0, np.int64)
        words = [w.encode() for w in numbers]
        of_bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        # Frequent words have small numbers. Words that are as frequent are in the order of their bucket and of
        # their bytes, so that most numbers in a bucket follow each other, as do words that begin alike.
        spelled = np.empty(len(words), np.int64)
        spelled[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        often = np.lexsort((spelled, of_bucket, -np.bincount(places, minlength=len(words))))
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        order = np.lexsort((rank, of_bucket))
        borders = np.flatnonzero(np.diff(of_bucket[order])) + 1
        for some in np.split(order, borders) if len(order) else []:
            yield _row(block=block, kind=0, bucket=int(of_bucket[some[0]]), codes=squeezed(np.diff(rank[some], prepend=0)), data=squeezed_strings([words[k] for k in some]))
        yield _row(block=block, kind=1, bucket=-1, ids=ids, counts=squeezed(np.array(counts)), codes=squeezed_ranks(rank[places]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars = TaskContext.get().partitionId() << 32, 0
        ids, counts, stream, numbers = [], [], [], {}
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                parts = PART.findall(text.as_py() or "")
                places = np.fromiter((numbers.setdefault(w, len(numbers)) for w in parts), np.int64, len(parts))
                ids.append(doc_id.as_py())
                counts.append(len(parts))
                stream.append(places.astype(np.uint32))
                chars += len(text.as_py() or "")
                if chars >= block_chars:
                    yield from rows(block, ids, counts, stream, numbers)
                    block, chars = block + 1, 0
                    ids, counts, stream, numbers = [], [], [], {}
        if ids:
            yield from rows(block, ids, counts, stream, numbers)

    return docs.mapInArrow(run, BLOCK)


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    block_chars: int = 32_000_000,
) -> DataFrame:
    """id_col, ids (array of int) for each row: the ids that the ranks file and pattern give, without special tokens.

    Words are the parts between which every such pattern parts. They are exploded with their positions a
    block of documents at a time: a block is one row of positions, as numbers of its words, and one row for
    each bucket of its distinct words. The words are shuffled by bucket, where each distinct word is encoded once;
    the ids are joined back to the blocks, and documents reassembled by position. Combined by block, a
    word with any share of the corpus is one entry a block, and a task holds a bucket's distinct words, or a block.

    buckets: as many as the session has shuffle partitions, so they grow with the cluster's setting.

    Null or empty text: no ids. Null or repeated ids: each row has its result. Empty table: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or partitions
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(_blocks(texts, buckets, block_chars), "bpe-blocks")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bucket, known = encoding(ranks, pattern), None, {}
        for row in _each(batches):
            if row["bucket"] != bucket:
                bucket, known = row["bucket"], {}
            found = widened_strings(row["data"])
            for word in found:
                if word not in known:
                    known[word] = np.array(encoder.encode_ordinary(word.decode()), "<u4").tobytes()
            ids = [known[w] for w in found]
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            yield _row(block=row["block"], kind=0, bucket=bucket, codes=row["codes"], counts=squeezed(counts), data=squeezed(np.frombuffer(b"".join(ids), "<u4")))

    word_rows = blocks.where("kind = 0").repartition(min(buckets, partitions), "bucket").sortWithinPartitions("bucket", "block")
    with_ids = word_rows.mapInArrow(words, BLOCK).unionByName(blocks.where("kind = 1"))

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, ids = [], [], []
        for row in _each(batches):
            if row["kind"] == 0:
                codes.append(np.cumsum(widened(row["codes"]).view("<i4").astype(np.int64)))
                counts.append(widened(row["counts"]).astype(np.int64))
                ids.append(widened(row["data"]))
                continue
            if codes:
                code, count, flat = np.concatenate(codes), np.concatenate(counts), np.concatenate(ids)
                length, begin = np.zeros(code.max() + 1, np.int64), np.zeros(code.max() + 1, np.int64)
                length[code], begin[code] = count, np.cumsum(count) - count
            places, at = widened_ranks(row["codes"]), 0
            sizes = widened(row["counts"]).tolist()
            part_ids, part, held = [], [], 0
            for k, (doc_id, size) in enumerate(zip(row["ids"], sizes, strict=True)):
                if size:
                    mine = places[at : at + size]
                    n = length[mine]
                    shift = np.repeat(begin[mine] - (np.cumsum(n) - n), n)
                    part.append(flat[shift + np.arange(len(shift))].astype(np.int32))
                else:
                    part.append(np.zeros(0, np.int32))
                part_ids.append(doc_id)
                at, held = at + size, held + len(part[-1])
                if held > 1_000_000 or k == len(sizes) - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))], ["id", "ids"])
                    part_ids, part, held = [], [], 0
            codes, counts, ids = [], [], []

    whole = with_ids.repartition(partitions, "block").sortWithinPartitions("block", "kind")
    return whole.mapInArrow(assembled, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids_col, decoded (binary): the bytes of the ids, by the table of token bytes (as many rows as the ranks file).

    Null ids: no bytes. An id that the ranks file doesn't have: an error.
    """
    spark = encoded.sparkSession
    tokens = spark.sparkContext.broadcast([t for t, _ in sorted(ranks_of(ranks).items(), key=lambda x: x[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            flat = [b"".join([table[k] for k in (row.as_py() or [])]) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.binary())], [id_col, ids_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} long, {ids_col} array<int>, decoded binary")
