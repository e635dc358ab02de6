"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens are linked how often."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.byte_bpe import _each, squeezed, squeezed_ranks, widened, widened_ranks
from saltmarsh.llm.shared import written

#: Linked pairs are counted by their A id, in so many buckets. A bucket has at most as many pairs as two vocabularies of
#: 2 ** 16 entries allow, however large the corpus is.
BUCKETS = 256
#: Blocks of a bucket that one task takes; more are added up in parts.
PART = 1024
#: Bytes of texts that are laid end to end (a longer text alone).
CHUNK = 4_000_000
#: A run of white space that is too long for the faster library's pattern.
LONG_SPACE = re.compile(r"\s{1000}")
#: Groups with more links than this count their equal tokens before links are made.
SMALL = 64


class Side(NamedTuple):
    """A tokenizer: encode gives the ids of texts, and each entry's bytes lie in flat from starts, lengths long."""

    encode: object
    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def _side(encode, spelled: list[bytes]) -> Side:
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    return Side(encode, np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(lengths) - lengths, lengths)


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> Side:
    """A of a byte-level BPE file: its vocabulary in merge order is a table of ranks; a space goes before each text.

    The faster of the two libraries, which give the same ids, can't take very long runs of white space; the other takes
    those texts.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["id"] for t in model["added_tokens"] if t["special"]}
    words = {i: bytes(byte_of[c] for c in w) for w, i in model["model"]["vocab"].items() if i not in special}
    quick = tiktoken.Encoding("A", pat_str=pattern, mergeable_ranks={w: i for i, w in words.items()}, special_tokens={})
    spelled = [words.get(k, b"") for k in range(max(words) + 1)]
    slow = None

    def encode(texts: list[str]) -> list[list[int]]:
        nonlocal slow
        out = []
        for text in texts:
            if LONG_SPACE.search(text) is None:
                out.append(quick.encode_ordinary(" " + text))
                continue
            if slow is None:
                slow = Tokenizer.from_file(path)
                slow.encode_special_tokens = True
            out.append(slow.encode(" " + text, add_special_tokens=False).ids)
        return out

    return _side(encode, spelled)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """B of a sentencepiece model, which itself puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    said = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(said)]
    return _side(lambda texts: model.encode(texts, num_threads=1), spelled)


@lru_cache(maxsize=2)
def _told(n_a: int, n_b: int) -> list[bytes]:
    """A and B ids in decimal with what follows them: within a group, at its end."""
    return [b"%d%s" % (k, mark) for n, marks in ((n_a, b",|"), (n_b, b",;")) for mark in (marks[:1], marks[1:]) for k in range(n)]


class Aligned(NamedTuple):
    """Per text: n_a, n_b, n_groups, n_links, and the digest of its groups; per text and linked pair: text, pair, times."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between ends (from the first to the last), by prefix sums."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[ends])


def _spelled(side: Side, ids: np.ndarray) -> np.ndarray:
    n = side.lengths[ids]
    return side.flat[np.repeat(side.starts[ids], n) + _within(n)]


def _encoded(side: Side, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = side.encode(texts) if texts else []
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64), counts


def _pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, pair (A id in the upper, B id in the lower 16 bits) and times it is linked there, over all groups."""
    a_from, b_from = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = n_a * n_b > SMALL
    some = ~large[a_group]
    groups = a_group[some]
    fan = n_b[groups]
    partner = np.repeat(b_from[groups], fan) + _within(fan)
    keys = (np.repeat(text_of[groups], fan) << 32) | (np.repeat(a_ids[some], fan) << 16) | b_ids[partner]
    keys, times = np.unique(keys, return_counts=True)
    if large.any():
        all_keys, all_times = [keys], [times]
        for g in np.flatnonzero(large):
            a, of_a = np.unique(a_ids[a_from[g] : a_from[g] + n_a[g]], return_counts=True)
            b, of_b = np.unique(b_ids[b_from[g] : b_from[g] + n_b[g]], return_counts=True)
            all_keys.append(((text_of[g] << 32) | (a[:, None] << 16) | b).ravel())
            all_times.append(np.outer(of_a, of_b).ravel())
        keys, at = np.unique(np.concatenate(all_keys), return_inverse=True)
        whole = np.zeros(len(keys), np.int64)
        np.add.at(whole, at, np.concatenate(all_times))
        times = whole
    return keys >> 32, keys & 0xFFFFFFFF, times


def aligned(texts: list[str], a: Side, b: Side) -> Aligned:
    """texts laid end to end, cut where tokens of A and of B both end."""
    raw = [t.encode() for t in texts]
    size = np.fromiter((len(r) + 1 if r else 0 for r in raw), np.int64, len(raw))
    use = np.flatnonzero(size)
    (a_ids, a_count), (b_ids, b_count) = (_encoded(s, [texts[k] for k in use]) for s in (a, b))
    for side in (a, b):  # texts whose tokens spell anything else are left out: first by length, then byte by byte
        ids, count = (a_ids, a_count) if side is a else (b_ids, b_count)
        fits = _sums(side.lengths[ids], np.concatenate(([0], np.cumsum(count)))) == size[use]
        a_ids, b_ids = a_ids[np.repeat(fits, a_count)], b_ids[np.repeat(fits, b_count)]
        use, a_count, b_count = use[fits], a_count[fits], b_count[fits]
    for side in (a, b):
        want = np.frombuffer(b"".join(b" " + raw[k] for k in use), np.uint8)
        same = _spelled(side, a_ids if side is a else b_ids) == want
        if not same.all():
            fits = _sums(~same, np.concatenate(([0], np.cumsum(size[use])))) == 0
            a_ids, b_ids = a_ids[np.repeat(fits, a_count)], b_ids[np.repeat(fits, b_count)]
            use, a_count, b_count = use[fits], a_count[fits], b_count[fits]

    borders = np.concatenate(([0], np.cumsum(size[use])))
    a_end, b_end = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
    cut = np.bincount(np.concatenate((a_end, b_end)), minlength=borders[-1] + 1) == 2
    cuts = np.cumsum(cut)
    a_group, b_group = cuts[a_end] - cut[a_end], cuts[b_end] - cut[b_end]
    n_a, n_b = np.bincount(a_group, minlength=cuts[-1]), np.bincount(b_group, minlength=cuts[-1])
    group_borders = cuts[borders]

    a_all, b_all = len(a.lengths), len(b.lengths)
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    codes[np.arange(len(a_ids)) + (np.cumsum(n_b) - n_b)[a_group]] = a_ids + a_all * cut[a_end]
    codes[np.arange(len(b_ids)) + np.cumsum(n_a)[b_group]] = 2 * a_all + b_ids + b_all * cut[b_end]
    told = _told(a_all, b_all)
    digests = [""] * len(texts)
    for k, (i, j) in zip(use, pairwise(np.concatenate(([0], np.cumsum(a_count + b_count))))):
        digests[k] = hashlib.sha256(b"".join(map(told.__getitem__, codes[i:j].tolist()))[:-1]).hexdigest()

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        out[use] = values
        return out

    text_of = np.repeat(use, np.diff(group_borders))
    return Aligned(spread(a_count), spread(b_count), spread(np.diff(group_borders)), spread(_sums(n_a * n_b, group_borders)), digests, *_pairs(a_ids, b_ids, a_group, n_a, n_b, text_of))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The rows of a batch, cut where their texts would be longer than CHUNK together."""
    begin, texts, held = 0, [], 0
    for k, text in enumerate(batch.column(1)):
        text = text.as_py() or ""
        if texts and held + len(text) > CHUNK:
            yield batch.column(0).slice(begin, k - begin), texts
            begin, texts, held = k, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield batch.column(0).slice(begin), texts


PAIRS = "block long, bucket int, part int, kind int, pairs binary, counts binary"
ANSWERS = "block long, bucket int, kind int, a binary, b binary"


def _rows(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in fields], [n for n, _ in fields])


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    return pairs, np.bincount(at, weights=np.concatenate([c for _, c in found]), minlength=len(pairs)).astype(np.int64)  # exact below 2 ** 53


def _wide(values: np.ndarray) -> bytes:
    """64-bit counts as two halves."""
    low = squeezed(values & 0xFFFFFFFF)
    return len(low).to_bytes(8, "little") + low + squeezed(values >> 32)


def _unwide(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return widened(data[8:cut]).astype(np.int64) | (widened(data[cut:]).astype(np.int64) << 32)


def _sorted_pairs(data: bytes) -> np.ndarray:
    return np.cumsum(widened(data).astype(np.int64))


def _counted(rows: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """One row for each value of by, with the pairs of all its rows and their counts added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, entries = None, [], 0

        def row() -> pa.RecordBatch:
            pairs, counts = _added(held)
            return _rows(PAIRS, [{"block": -1, "bucket": now[0], "part": now[-1], "kind": 0, "pairs": squeezed(np.diff(pairs, prepend=0)), "counts": _wide(counts)}])

        for one in _each(batches):
            key = [one[c] for c in by]
            if held and key != now:
                yield row()
                held, entries = [], 0
            now = key
            held.append((_sorted_pairs(one["pairs"]), _unwide(one["counts"])))
            entries += len(held[-1][0])
            if entries > 4_000_000 and len(held) > 1:
                held = [_added(held)]
                entries = 0
        if held:
            yield row()

    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, PAIRS)


def alignment(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 24_000_000) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs.

    Tokens of A (a_path, a byte-level BPE, over space+text) and of B (b_path, a sentencepiece model that adds the space)
    are laid end to end for a whole Arrow batch of texts (CHUNK bytes of it). One bincount over all ends tells
    where both occur; there texts are cut into groups, and prefix sums over groups and texts give each text's figures.
    Within a group every A token is linked to every B token. A pair's count is how many rows of docs hold it
    linked; n_best are links whose pair has the highest count of all pairs with its A id, ties included.

    A task keeps its texts' pairs in blocks, each written as a row of texts (their pairs as numbers of the block's pairs) and a
    row for each bucket of A ids (the block's pairs and in how many texts they are). Buckets are added up over blocks, in
    parts of PART blocks and then over parts; the sums go back to the blocks, and from there to the texts. So each text is
    encoded once, and what is shuffled is pairs of blocks, not of texts: a pair in every text is one entry a
    block. A bucket's table is bounded by the vocabularies, and a task reads blocks one at a time.

    Texts that are null, empty, or spelled otherwise by either side's tokens have no tokens: zeros and an empty
    groups_sha256. Ids may have any type, be null and be repeated: each row counts. Very long texts are
    aligned whole. Empty table: empty result. Other columns are ignored. Both vocabularies have at most 2 ** 16 entries.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    figures = ("n_a", "n_b", "n_groups", "n_links")
    texts_ddl = f"block long, bucket int, kind int, ids array<{kind}>, figures array<long>, digests array<string>, sizes binary, pairs binary, counts binary, numbers binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path, pattern), pieces(b_path)
        block, held, ids, size = TaskContext.get().partitionId() << 32, [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            pair = np.concatenate([x.pair for x in held])
            known, at, often = np.unique(pair, return_inverse=True, return_counts=True)
            rank = np.empty(len(known), np.int64)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(known))
            text = np.concatenate([x.text + shift for x, shift in zip(held, np.cumsum([0, *(len(x.digests) for x in held)]))])
            order = np.lexsort((rank[at], text))
            numbers, n_texts = rank[at][order], sum(len(x.digests) for x in held)
            sizes = np.bincount(text, minlength=n_texts)
            steps = np.diff(numbers, prepend=0)
            firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
            steps[firsts] = numbers[firsts]
            bucket = (known >> 16) % BUCKETS
            dealt = np.argsort(bucket, kind="stable")
            flat = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([-1], pa.int32()),
                    pa.array([1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                    pa.array([np.concatenate([np.concatenate([getattr(x, f) for x in held]) for f in figures])]),
                    pa.array([[d for x in held for d in x.digests]], pa.list_(pa.string())),
                    *(pa.array([x], pa.binary()) for x in (squeezed(sizes), squeezed_ranks(steps), squeezed_ranks(np.concatenate([x.times for x in held])[order]), squeezed(rank[dealt]))),
                ],
                [f.split()[0] for f in texts_ddl.split(", ")],
            )
            for some in np.split(dealt, np.flatnonzero(np.diff(bucket[dealt])) + 1) if len(dealt) else []:
                data = {"pairs": squeezed(np.diff(known[some], prepend=0)), "counts": _wide(often[some])}
                none = {"ids": None, "figures": None, "digests": None, "sizes": None, "numbers": None}
                row = {"block": block, "bucket": int(bucket[some[0]]), "kind": 0} | none | data
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(row_names, row_types)], row_names)

        row_names = [f.split()[0] for f in texts_ddl.split(", ")]
        for batch in batches:
            row_types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(batch.column(0).type), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4]
            for some_ids, texts in _chunks(batch):
                held.append(aligned(texts, a, b))
                ids.append(some_ids)
                size += sum(map(len, texts))
                if size >= block_bytes:
                    yield from rows()
                    block, held, ids, size = block + 1, [], [], 0
        if held:
            yield from rows()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(texts.mapInArrow(blocks, texts_ddl), "alignment-blocks")
    parts = max(1, -(-found.where("kind = 1").count() // PART))
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    pairs = found.where("kind = 0").select("block", "bucket", part.alias("part"), "kind", "pairs", "counts")
    tables = written(_counted(_counted(pairs, ["bucket", "part"], tasks), ["bucket"], tasks), "pair-counts")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts = best = None
        for one in _each(batches):
            mine = _sorted_pairs(one["pairs"])
            if one["kind"] == -1:  # a bucket's table comes before its blocks
                known, counts = mine, _unwide(one["counts"])
                firsts = np.flatnonzero(np.diff(known >> 16, prepend=-1))
                best = counts == np.repeat(np.maximum.reduceat(counts, firsts), np.diff(np.append(firsts, len(known))))
                continue
            at = np.searchsorted(known, mine)
            yield _rows(ANSWERS, [{"block": one["block"], "bucket": one["bucket"], "kind": 0, "a": _wide(counts[at]), "b": np.packbits(best[at]).tobytes()}])

    to_parts = tables.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(-1))
    asked = pairs.unionByName(to_parts).repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    answers = asked.mapInArrow(answered, ANSWERS)
    out_ddl = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = [], []
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                if one.column("kind")[0].as_py() == 0:
                    counts.append(_unwide(one.column("a")[0].as_py()))
                    best.append(np.unpackbits(np.frombuffer(one.column("b")[0].as_py(), np.uint8), count=len(counts[-1])))
                    continue
                ids, told, shas, sizes, steps, times, numbers = (one.column(c)[0] for c in ("ids", "figures", "digests", "sizes", "pairs", "counts", "numbers"))
                sizes, steps, times = widened(sizes.as_py()).astype(np.int64), widened_ranks(steps.as_py()).astype(np.int64), widened_ranks(times.as_py()).astype(np.int64)
                of_pair, is_best = np.zeros((2, sum(map(len, counts))), np.int64)
                if counts:
                    rank = widened(numbers.as_py())
                    of_pair[rank], is_best[rank] = np.concatenate(counts), np.concatenate(best)
                borders = np.concatenate(([0], np.cumsum(sizes)))
                total = np.cumsum(steps)
                begun = np.repeat(np.concatenate(([0], total))[borders[:-1]], sizes)
                pair = total - begun
                sums = [_sums(times * of[pair], borders) for of in (is_best, of_pair)]
                per = told.values.to_numpy().reshape(len(figures), -1)
                yield pa.RecordBatch.from_arrays([ids.values, *map(pa.array, per), *map(pa.array, sums), shas.values], [f.split()[0] for f in out_ddl.split(", ")])
                counts, best = [], []

    whole = found.where("kind = 1").withColumns({"a": F.lit(None).cast("binary"), "b": F.lit(None).cast("binary")})
    empty = {c: F.lit(None).cast(found.schema[c].dataType) for c in ("ids", "figures", "digests", "sizes", "pairs", "counts", "numbers")}
    met = answers.withColumns(empty).unionByName(whole).repartition(tasks, "block").sortWithinPartitions("block", "kind", "bucket")
    return met.mapInArrow(summed, out_ddl).withColumnRenamed("id", id_col)
