"""SimHash near-deduplication with a bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.components import components
from saltmarsh.llm.shared import KEYS, bucket, first_rows, keyed, shared_apart, written

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Lanes are checked for abandoned blocks after so many bit planes.
EVERY = 8
#: Cells up to so many fingerprints are compared many at a time; larger ones one by one.
SMALL = 48


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words of text, ASCII letters in lower case; of the whole text if it has fewer words."""
    found = (text or "").encode().lower().split()  # splits at the ASCII white space, and lowers A-Z only
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > len(hashes) else "0" for c in counts.tolist()), 2)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of text; zero without a word."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (64 bits as a signed long) for each row. Null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """The 64 bit planes of values, 64 values to a word: shape (64, words), the last word filled up with zeros."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    out = np.zeros((64, -(-len(values) // 64) * 8), np.uint8)
    out[:, : -(-len(values) // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out.view(np.uint64)


def lanes_within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Lanes in which left and right differ in radius bits at most, as a mask of shape (rows, words).

    left has shape (64, rows, words or 1), right (64, rows or 1, words). Differences are added plane by
    plane into carry-save counters, which hold a bit of the count of 64 lanes in each word and start at such a value
    that they overflow exactly beyond the radius. Rows in which all lanes have overflowed are abandoned.
    """
    rows, digits = left.shape[1], radius.bit_length()
    shape = np.broadcast_shapes(left.shape[1:], right.shape[1:])
    start = (1 << digits) - 1 - radius
    counter = [np.full(shape, ONES if start >> k & 1 else 0, np.uint64) for k in range(digits)]
    over, alive = np.zeros(shape, np.uint64), np.arange(rows)
    for k in range(64):
        carry = left[k] ^ right[k]
        for j, digit in enumerate(counter):
            counter[j], carry = digit ^ carry, digit & carry
        over |= carry
        if k % EVERY == EVERY - 1 and k < 63:
            stay = ~(over == ONES).all(axis=1)
            if not stay.all():
                alive, over, counter = alive[stay], over[stay], [digit[stay] for digit in counter]
                left, right = left[:, stay], right[:, stay] if right.shape[1] > 1 else right
                if not len(alive):
                    break
    out = np.zeros((rows, shape[1]), np.uint64)
    out[alive] = ~over
    return out


def _set_lanes(mask: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(mask.any(axis=1))
    bits = np.unpackbits(np.ascontiguousarray(mask[rows]).view(np.uint8), axis=1, bitorder="little")[:, :lanes]
    r, lane = np.nonzero(bits)
    return rows[r], lane


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (the smallest index known to be reachable) once the pairs a, b are linked too."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def cell_roots(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For each row, the first row of its cell that its links within the cell reach. Rows of a cell are adjacent.

    side is 0 for rows to be compared with each other, else 1 or 2 for rows to be compared across.
    """
    root = np.arange(len(cell))
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else root
    sizes = np.diff(np.append(starts, len(cell)))
    small = np.repeat((sizes <= SMALL) & (side[starts] == 0), sizes)
    behind = np.repeat(starts + sizes, sizes) - root - 1  # rows of the cell after each
    for offset in range(1, SMALL):
        first = np.flatnonzero(small & (behind >= offset))
        if not len(first):
            break
        ok = lanes_within(planes(fp[first])[:, :, None], planes(fp[first + offset])[:, :, None], radius)
        word, lane = _set_lanes(ok, 64)
        hit = word * 64 + lane
        hit = first[hit[hit < len(first)]]
        root = merged(root, hit, hit + offset)
    for start, size in zip(starts[~small[starts]].tolist(), sizes[~small[starts]].tolist(), strict=True):
        rows = np.arange(start, start + size)
        left, right = (rows[side[rows] == 1], rows[side[rows] == 2]) if side[start] else (rows, rows)
        if not len(left) or not len(right):
            continue
        lanes = planes(fp[right])[:, None, :]
        for k in range(0, len(left), 256):
            some = left[k : k + 256]
            set_bits = np.unpackbits(fp[some].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
            query, lane = _set_lanes(lanes_within((set_bits * ONES).astype(np.uint64)[:, :, None], lanes, radius), len(right))
            root = merged(root, some[query], right[lane])
    return root


def near_links(distinct: DataFrame, radius: int = 2, chunk: int = 1024) -> DataFrame:
    """src, dst: links between the ids of distinct (id, fp) that join all fingerprints at most radius bits apart.

    Of radius + 2 equal blocks of bits, two fingerprints within the radius share two at least, so each
    goes to one bucket for each pair of blocks. A bucket larger than chunk is dealt into chunks, and
    each pair of chunks becomes a cell of its own; so no task holds more than two chunks of a bucket. A cell
    returns, for each fingerprint, one link to the first it reaches: at most one link for each row, not all pairs.
    """
    blocks = radius + 2
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    bits = [F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << cuts[k + 1] - cuts[k]) - 1)) for k in range(blocks)]

    def key(number: int, a: int, b: int) -> Column:
        return F.xxhash64(F.lit(number), bits[a], bits[b])

    keys = F.array(*[key(n, a, b) for n, (a, b) in enumerate(combinations(range(blocks), 2))])
    dealt = written(distinct.where("id is not null").select("id", "fp", F.explode(keys).alias("key")), "simhash-keys")
    large = dealt.groupBy("key").count().where(F.col("count") > chunk).select("key", "count", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    placed = shared_apart(dealt, large, ["key"], "count", dealt.count()).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    cells = placed.select(cell.alias("cell"), side.alias("side"), "fp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            cell, side, fp, ids = rows
            root = cell_roots(cell, side, fp.view(np.uint64), radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["src", "dst"])

        for cells in _by_cell(batches):
            yield links(cells)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "src long, dst long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id for each row of docs.

    Texts are linked if their fingerprints differ in radius bits or fewer; component_id is the smallest
    id reachable over links. Equal fingerprints are compared once, and stand for themselves in links and components; a
    component's ids are looked at afterwards, so ids may have any ordered type. Fingerprints and components with a large
    share of all rows are joined by broadcast, as there are few.

    Null text: as empty. Texts without words have fingerprint zero and are linked like others.
    Null ids: take part in links, and take the component's smallest other id; null if it has none. Repeated rows: each has
    its result. Empty table: empty result. Other columns are ignored.
    """
    each = written(fingerprints(docs, id_col, text_col, words), "simhash-each")
    distinct = written(each.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "simhash-distinct")
    found = components(near_links(distinct.select(F.col("fp").alias("id"), "fp"), radius))
    of_print = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "n", "id", F.coalesce("component", "fp").alias("component"))
    of_print = written(of_print, "simhash-components")
    least = of_print.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("prints"))
    named = shared_apart(of_print.select("fp", "n", "component"), least, ["component"], "prints", of_print.count(), "inner").select("fp", "n", "component_id")
    return shared_apart(each, named, ["fp"], "n", each.count(), "inner").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Rows of min-hashes that make a band, and bands: at a similarity of 0.8 a pair shares a band with a chance of 0.9977.
BAND, BANDS = 6, 20
#: Fingerprints of texts with a similarity of 0.8 differ in 10 bits, with a deviation of 3; more than this are not compared.
FAR = 24
#: A leader's set of shingles goes with so many of its members at a time.
WITH_LEADER = 512
#: Bits of the parities of a set: a shingle turns the bit of its hash by this number.
PARITY = 1024

_seeds = np.random.default_rng(42).integers(0, 1 << 64, (2, BAND * BANDS, 1), dtype=np.uint64)


def bands(distinct: np.ndarray) -> list[int]:
    """A key for each band of min-hashes of a set of shingles."""
    least = np.full(BAND * BANDS, ONES)
    for k in range(0, len(distinct), 4096):
        mixed = (distinct[None, k : k + 4096] ^ _seeds[0]) * (_seeds[1] | np.uint64(1))
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, BAND)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def sketches(docs: DataFrame, row: str, text_col: str, words: int) -> DataFrame:
    """row, fp, size (of the set of shingles), set_key, bands and parity of each text."""
    names = ["row", "fp", "size", "set_key", "bands", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some, found = batch.slice(k, 500), []
                for text in some.column(1):
                    every = shingles(text.as_py(), words)
                    own = np.unique(every)
                    found.append((majority(every), len(own), xxhash.xxh64_intdigest(own.tobytes(), len(own)) - (1 << 63), bands(own), parity(own)))
                fps, sizes, keys, of_bands, parities = zip(*found, strict=True)
                columns = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (of_bands, parities))]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names)

    texts = docs.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "row long, fp long, size long, set_key long, bands array<long>, parity array<long>")


def _texts_of(docs: DataFrame, row: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """row and text of the rows of docs that are wanted (row), and of a few others.

    Which are wanted is broadcast as bucket numbers, so no text is shuffled.
    """
    marks = wanted.select(bucket("row").alias("bucket")).distinct()
    texts = docs.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")).withColumn("bucket", bucket("row"))
    return texts.join(F.broadcast(marks), "bucket", "left_semi").select("row", "text")


def shingle_sets(docs: DataFrame, row: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """row and shingles, each once, of the texts whose rows are wanted (row), and of a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                some = batch.slice(k, 100)
                sets = [np.unique(shingles(text.as_py(), words)) for text in some.column(1)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["row", "shingles"])

    return _texts_of(docs, row, text_col, wanted).mapInArrow(run, "row long, shingles array<long>")


def parity(distinct: np.ndarray) -> np.ndarray:
    """PARITY bits, 64 to a number: whether an odd number of the shingles falls on each.

    The parities of two sets differ where an odd number of the shingles that only one of them has falls. So they
    differ in at most as many bits as there are such shingles: a bound that holds without exception.
    """
    fallen = np.bincount((distinct & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((fallen & 1).astype(np.uint8)).view(np.int64)


def may_be_similar[T: (np.ndarray, Column)](size_a: T, size_b: T, apart: T, similarity: float) -> T:
    """Whether sets of these sizes whose parities are so many bits apart can have a Jaccard similarity of similarity.

    With apart shingles or more outside the intersection, that is (size_a + size_b - apart) / 2 at most, and the union
    (size_a + size_b + apart) / 2 at least.
    """
    total = size_a + size_b
    return total - apart >= similarity * (total + apart) - 1e-6


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole cells; the first column is the cell, and rows are in its order."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # where the last cell begins
        if cut or (held and held[-1][0][-1] != rows[0][0]):
            held.append([c[:cut] for c in rows])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = [[c[cut:] for c in rows]]
        else:
            held.append(rows)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (key, ...) with how many chunks of chunk rows their key is dealt into, and their own.

    Keys with over a KEYS-th of all rows are fewer than KEYS. Their chunks are part of the expression, so no row passes a join
    for them; other keys of over chunk rows meet theirs by shuffle.
    """
    large = rows.groupBy("key").count().where(F.col("count") > chunk)
    large = written(large.select("key", "count", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "near-large")
    much = F.col("count") > rows.count() / KEYS
    heavy = {r.key: r.chunks for r in large.where(much).collect()}  # fewer than KEYS
    placed, light = rows.withColumn("chunks", F.lit(1)), large.where(~much).select("key", "chunks")
    if heavy:
        of_key = F.map_from_arrays(F.lit(list(heavy)), F.lit(list(heavy.values())))
        placed = rows.withColumn("chunks", F.when(F.col("key").isin(*heavy), of_key[F.col("key")]).otherwise(1))
    if not light.isEmpty():
        rest = rows.where(~F.col("key").isin(*heavy)).join(light, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        placed = placed.where(F.col("key").isin(*heavy)).unionByName(rest)
    return placed.withColumn("own", F.pmod(F.xxhash64("row", F.lit("chunk")), F.col("chunks").cast("long")).cast("int"))


def _leaders(members: DataFrame) -> DataFrame:
    """members (key, row, fp, size, chunks, own) with the leader of their chunk: dst, with its fp and size in dst_fp and
    dst_size, and near. Chunks of one row are left out, unless their key has more chunks.

    A chunk's leader is the row whose fingerprint is nearest to the bits that most of the chunk have.
    near: whether it is another row, its set not too different in size, and the fingerprints FAR apart at most.
    """
    names = ["key", "row", "fp", "size", "chunks", "own", "dst", "dst_fp", "dst_size", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, *columns in _by_cell(batches):
            _, row, fp, size, chunks, _ = columns
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            sizes = np.diff(np.append(starts, len(cell)))
            bits = np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
            most = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None]
            apart = (bits != np.repeat(most, sizes, axis=0)).sum(axis=1)
            of = np.repeat(np.arange(len(starts)), sizes)
            lead = np.repeat(np.lexsort((row, apart, of))[starts], sizes)
            ok = lanes_within(planes(fp.view(np.uint64))[:, :, None], planes(fp[lead].view(np.uint64))[:, :, None], FAR)
            near = np.zeros(len(cell), bool)
            word, lane = _set_lanes(ok, 64)
            hit = word * 64 + lane
            near[hit[hit < len(cell)]] = True
            near &= (row != row[lead]) & (5 * np.minimum(size, size[lead]) >= 4 * np.maximum(size, size[lead]))
            stay = np.repeat(sizes, sizes) + chunks > 2
            yield pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in (*columns, row[lead], fp[lead], size[lead], near)], names)

    cells = members.select(F.xxhash64("key", "own").alias("cell"), *names[:6])
    schema = "key long, row long, fp long, size long, chunks int, own int, dst long, dst_fp long, dst_size long, near boolean"
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _unlinked(members: DataFrame, similarity: float) -> DataFrame:
    """src, dst: pairs within a key of members (key, row, fp, size, chunks, own, component, parity) from different components,
    with fingerprints FAR apart at most, and parities that similarity allows. Each pair of a key's chunks is a cell;
    distances of fingerprints are counted bit plane by bit plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, side, row, fp, size, component, bits in _by_cell(batches):
            bits = np.stack(bits).view(np.uint64)
            borders = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            fp = fp.view(np.uint64)
            for start, end in zip(borders.tolist(), borders[1:].tolist(), strict=False):
                rows = np.arange(start, end)
                left, right = (rows[side[rows] == 1], rows[side[rows] == 2]) if side[start] else (rows, rows)
                if not len(left) or not len(right):
                    continue
                lanes = planes(fp[right])[:, None, :]
                for k in range(0, len(left), 256):
                    some = left[k : k + 256]
                    set_bits = np.unpackbits(fp[some].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
                    query, lane = _set_lanes(lanes_within((set_bits * ONES).astype(np.uint64)[:, :, None], lanes, FAR), len(right))
                    a, b = some[query], right[lane]
                    keep = (component[a] != component[b]) & (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b]))
                    if side[start] == 0:
                        keep &= row[a] < row[b]
                    a, b = a[keep], b[keep]
                    keep = np.concatenate([np.zeros(0, bool), *(
                        may_be_similar(size[x], size[y], np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64), similarity)
                        for x, y in ((a[j : j + 65536], b[j : j + 65536]) for j in range(0, len(a), 65536))
                    )])
                    yield pa.RecordBatch.from_arrays([pa.array(row[a[keep]]), pa.array(row[b[keep]])], ["src", "dst"])

    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    cells = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"), "row", "fp", "size", "component", "parity")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "src long, dst long").distinct()


def possible_pairs(pairs: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) without those that the parities of their sets, from sketches() of all rows, rule out."""
    led = pairs.groupBy("dst").count().join(each.select(F.col("row").alias("dst"), F.col("size").alias("size_dst"), F.col("parity").alias("of_dst")), "dst")
    met = pairs.join(each.select(F.col("row").alias("src"), F.col("size").alias("size_src"), F.col("parity").alias("of_src")), "src")
    met = shared_apart(met, led, ["dst"], "count", pairs.count(), "inner")
    apart = F.aggregate(F.zip_with("of_src", "of_dst", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    return met.where(may_be_similar(F.col("size_src"), F.col("size_dst"), apart, similarity)).select("src", "dst")


def similar_pairs(pairs: DataFrame, docs: DataFrame, row: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) of rows of docs whose sets of shingles have a Jaccard similarity of similarity or more.

    A row that is dst of many pairs has its set dealt out to parts of WITH_LEADER of them.
    """
    pairs = written(pairs, "near-pairs")
    sets = written(shingle_sets(docs, row, text_col, words, pairs.select(F.explode(F.array("src", "dst")).alias("row"))), "near-shingles")
    counts = pairs.groupBy("dst").count()
    dealt = shared_apart(pairs, counts, ["dst"], "count", pairs.count(), "inner")
    parts = F.ceil(F.col("count") / WITH_LEADER).cast("int")
    dealt = dealt.select("src", "dst", F.pmod(F.xxhash64("src"), parts.cast("long")).cast("int").alias("part"))
    led = counts.join(sets.select(F.col("row").alias("dst"), F.col("shingles").alias("of_dst")), "dst")
    led = led.select("dst", "of_dst", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = dealt.join(sets.select(F.col("row").alias("src"), F.col("shingles").alias("of_src")), "src").join(led, ["dst", "part"])
    both = F.size(F.array_intersect("of_src", "of_dst"))
    return met.where(both >= similarity * (F.size("of_src") + F.size("of_dst") - both)).select("src", "dst")


def _components_of(links: DataFrame) -> DataFrame:
    """row, component of each row with links (src, dst)."""
    return written(components(links), "near-components").withColumnRenamed("node", "row")


def similar_groups(docs: DataFrame, row: str, text_col: str = "text", words: int = 5, similarity: float = 0.8, chunk: int = 1024) -> DataFrame:
    """row, group for each row of docs that is in a group of two or more: texts linked by a Jaccard similarity of their sets of
    word shingles of similarity or more, directly or over others. row numbers the rows; group is the smallest of its group.

    A fingerprint of 64 bits cannot bound a search at 0.8, as such texts differ in 10 bits or so. So rows that share a band of
    min-hashes are candidates. Equal sets are compared once. Within a band's key, chunk rows at a time elect the row whose
    fingerprint is nearest to the bits that most have; leaders of a key's chunks elect theirs. Each row is first compared with
    that of its leaders that leads most rows, then with those that it is not yet linked to. Where a key's rows are then not all
    linked, its rows from different groups are compared by the bit-sliced distance of their fingerprints, those within FAR
    bits by the parities of their sets, which rule out only what cannot be similar, and the rest by the sets. So a group of copies gives a link or so a
    row and not all its pairs, no key or leader stays in one task, and the sets themselves decide on each link.

    similarity: 0.8 or more; bands and FAR are made for that, and lower ones are refused.

    Null text: as empty. Texts without words are equal. Empty table: empty result.
    """
    if similarity < 0.8:
        raise ValueError("a similarity below 0.8: too few of such pairs share a band")
    each = written(sketches(docs, row, text_col, words), "near-sketches")
    whole = each.groupBy("set_key").agg(F.min(F.struct("row", "fp", "size", "bands")).alias("first"), F.count("*").alias("n"))
    whole = written(whole.select("set_key", "first.*", "n"), "near-sets")
    led = _chunked(whole.where("size > 0").select(F.explode("bands").alias("key"), "row", "fp", "size"), chunk)
    entries = pairs = None
    while True:
        found = written(_leaders(led), "near-leaders")
        entries = found.select("key", "row", "fp", "size", "chunks", "own") if entries is None else entries
        near = found.where("near").select(F.col("row").alias("src"), "dst")
        pairs = near if pairs is None else pairs.unionByName(near)
        more = found.where("chunks > 1 AND row = dst").select("key", "row", "fp", "size")
        if more.isEmpty():
            break
        led = _chunked(more, chunk)
    pairs = written(pairs.distinct(), "near-candidates")
    total, led = pairs.count(), pairs.groupBy("dst").count()
    best = shared_apart(pairs, led, ["dst"], "count", total, "inner").groupBy("src").agg(F.max_by("dst", F.struct("count", F.negate("dst"))).alias("dst"))
    best = possible_pairs(written(best, "near-best"), each, similarity)
    linked = written(similar_pairs(best, docs, row, text_col, words, similarity), "near-linked")
    now = _components_of(linked)
    of_dst = led.join(now, led.dst == now.row, "left").select("dst", "count", F.coalesce("component", "dst").alias("of_dst"))
    crossing = shared_apart(pairs, of_dst, ["dst"], "count", total, "inner").join(now, F.col("src") == F.col("row"), "left")
    crossing = crossing.where(F.col("of_dst") != F.coalesce("component", "src")).select("src", "dst")
    crossing = possible_pairs(written(crossing, "near-crossed"), each, similarity)
    linked = linked.unionByName(written(similar_pairs(crossing, docs, row, text_col, words, similarity), "near-crossing"))
    placed = written(entries.join(_components_of(linked), "row", "left").withColumn("component", F.coalesce("component", "row")), "near-placed")
    apart = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    rest = written(shared_apart(placed, apart, ["key"], "n", placed.count(), "left_semi"), "near-rest")
    rest = rest.join(each.select("row", "parity"), "row")
    also = written(similar_pairs(_unlinked(rest, similarity), docs, row, text_col, words, similarity), "near-also")
    found = components(linked.unionByName(also))
    of_set = whole.join(found, F.col("row") == F.col("node"), "left").where("n > 1 OR component IS NOT NULL")
    of_set = written(of_set.select("set_key", "n", F.coalesce("component", "row").alias("group")), "near-groups")
    return shared_apart(each.select("row", "set_key"), of_set, ["set_key"], "n", each.count(), "inner").select("row", "group")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar_groups(), with all its columns: that with the smallest id; and all rows outside groups.

    Rows are told apart by a number of their own, so ids may be null (never the smallest, unless the whole group
    has none), of any ordered type and repeated, with the same or with other texts. Columns may have any names.
    Null text: as empty. Empty table: empty result.
    """
    rows, row = keyed(docs, "near-keyed")
    return first_rows(rows, row, written(similar_groups(rows, row, text_col, words, similarity), "near-members"), id_col)
