"""Prefix trie of conversations: rolling fingerprints of prefixes group turns, groups are verified, nodes are rolled up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.shared import KEYS, text_or_empty, written

#: Two primes below 2 ** 31, so that products stay in 64 bits; a fingerprint is a remainder by each.
PRIMES = (2147483647, 2147483629)
#: The base of both polynomials.
BASE = 1_000_003
EMPTY = hashlib.sha256(b"").hexdigest()


def powers(n: int, prime: int) -> np.ndarray:
    """BASE ** 0 to BASE ** (n - 1), modulo prime."""
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * pow(BASE, have, prime) % prime
        have += more
    return out


def _scan(primes: tuple[int, int]):
    """Places and prefix fingerprints of sorted turns, as if each task's first conversation began there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, open_ = TaskContext.get().partitionId(), 0, True
        conv, place, sums = None, 0, [0, 0]
        known = [powers(1 << 14, p) for p in primes]
        for batch in batches:
            n, convs = batch.num_rows, batch.column("conv")
            if n == 0:
                continue
            first = np.ones(n, bool)
            first[1:] = pc.not_equal(convs.slice(1), convs.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first[0] = at > 0 and convs[0].as_py() != conv
            begun = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            goes_on = begun < 0  # rows of the conversation that the batch before left open
            places = np.where(goes_on, place + 1 + np.arange(n), np.arange(n) - begun + 1)
            if places.max() > len(known[0]):
                known = [powers(2 * int(places.max()), p) for p in primes]
            hashes, columns = batch.column("hash").to_numpy().view(np.uint64), []
            for k, prime in enumerate(primes):
                turn = ((hashes >> np.uint64(32 * k)) % np.uint64(prime)).astype(np.int64)
                total = np.cumsum(turn * known[k][places - 1] % prime)
                before = np.where(goes_on, -sums[k], np.where(begun > 0, total[np.maximum(begun, 1) - 1], 0))
                prefix = (total - before) % prime
                last = np.where(goes_on & (np.arange(n) == 0), sums[k], np.where(first, 0, np.roll(prefix, 1)))
                columns += [prefix, last]
                sums[k] = int(prefix[-1])
            opened = (np.cumsum(first) == 0) & open_
            open_ = bool(opened[-1])
            extra = [np.full(n, part, np.int64), at + np.arange(n), places, opened, *columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], [*batch.schema.names, *SCANNED])
            conv, place, at = convs[n - 1].as_py(), int(places[-1]), at + n

    return run


SCANNED = ("part", "at", "place", "open", "here_0", "before_0", "here_1", "before_1")


def placed(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conv, depth (from 1), key, up, role, text and size for each row of turns (conv, turn, role, text).

    Turns are in the order of turn, role, text, nulls first. key is the fingerprint of the conversation's first depth
    turns, up that of those before it, size the text's bytes.

    Turns are sorted by ranges and scanned with numpy a batch at a time, so a conversation of any length is spread over
    tasks; what a task's first conversation has from the tasks before is added afterwards, from one row a task
    (which the driver gathers).
    """
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    rows = turns.where("conv IS NOT NULL").select("conv", "turn", role.alias("role"), text.alias("text"), F.rand(1).alias("tie"))  # repeated rows may be parted too
    ordered = rows.orderBy("conv", F.asc_nulls_first("turn"), "role", "text", "tie")
    hashed = ordered.select("conv", "role", "text", F.octet_length("text").cast("long").alias("size"), F.xxhash64("role", F.octet_length("role"), "text").alias("hash"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hashed.schema)
    scanned = written(hashed.mapInArrow(_scan(primes), f"{kinds}, {', '.join(f'{n} boolean' if n == 'open' else f'{n} long' for n in SCANNED)}"), "turns")

    so_far = F.struct("at", "place", "here_0", "here_1")
    ends = scanned.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("final"), F.max(so_far).alias("tail"), F.max(F.when(F.col("open"), so_far)).alias("head"))
    parts = sorted(ends.collect(), key=lambda r: r.part)
    shifts, conv, had = [], None, (0, 0, 0)
    for r in parts:
        mine = had if conv == r.first else (0, 0, 0)
        lift = [pow(BASE, mine[0], p) for p in primes]
        shifts.append([r.part, *mine, *lift])
        end = r.head if r.first == r.final else r.tail
        had = (end.place, end.here_0, end.here_1)
        if r.first == r.final:
            had = (mine[0] + had[0], *((mine[k + 1] + lift[k] * had[k + 1]) % primes[k] for k in (0, 1)))
        conv = r.final
    shift = scanned.sparkSession.createDataFrame(shifts, "part long, n long, add_0 long, add_1 long, lift_0 long, lift_1 long")
    all_rows = scanned.join(F.broadcast(shift), "part")  # a row a task

    def whole(name: str, k: int) -> Column:
        return F.when(F.col("open"), (F.col(f"add_{k}") + F.col(f"lift_{k}") * F.col(f"{name}_{k}")) % primes[k]).otherwise(F.col(f"{name}_{k}"))

    key = lambda name: whole(name, 0) * (1 << 31) + whole(name, 1)
    depth = F.when(F.col("open"), F.col("n") + F.col("place")).otherwise(F.col("place"))
    return all_rows.select("conv", depth.alias("depth"), key("here").alias("key"), key("before").alias("up"), "role", "text", "size")


def _lasts(turns: DataFrame) -> DataFrame:
    """conv and depth of each conversation's last turn."""
    return turns.groupBy("conv").agg(F.max("depth").alias("depth"))


def _met(rows: DataFrame, keys: DataFrame, total: int, salt: str, how: str) -> DataFrame:
    """rows joined to keys on depth and key; keys is one row a pair, n the number of rows it meets.

    A pair of over a KEYS-th of total is dealt into so many parts, by salt: it is fewer than KEYS pairs that rows are
    told of by broadcast, three numbers each.
    """
    parts = F.ceil(F.col("n") * KEYS / total).cast("int")
    hot = keys.where(F.col("n") > total / KEYS).select("depth", "key", parts.alias("_parts"))
    rows = rows.join(F.broadcast(hot), ["depth", "key"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt), "_parts").cast("int"), F.lit(0))).drop("_parts")
    dealt = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return rows.join(dealt.drop("n") if "n" in rows.columns else dealt, ["depth", "key", "_salt"], how).drop("_salt")


def _verified(turns: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """turns with keys that stand for one prefix each, and the groups of two or more: depth, key, n, first, size, up.

    Every turn of a group is held against that of its representative, the smallest conversation: the same role and
    text after the same prefix. Those that differ get keys of their own, and the groups are formed and verified again.
    """
    for attempt in range(1 << 30):
        groups = turns.groupBy("depth", "key").agg(F.count("*").alias("n"), F.min("conv").alias("first"))
        groups = written(groups.where("n > 1"), "prefixes")
        heads = turns.select("depth", F.col("conv").alias("first"), "size", "up", "role", "text")
        first = written(groups.join(heads, ["depth", "first"]), "representatives")
        theirs = first.select("depth", "key", "n", F.col("up").alias("_up"), F.col("role").alias("_role"), F.col("text").alias("_text"))
        held = _met(turns.select("conv", "depth", "key", "up", "role", "text"), theirs, total, "conv", "inner")
        other = held.where("up != _up OR role != _role OR text != _text")
        anew = F.xxhash64(F.lit(attempt), "key", "up", "role", F.octet_length("role"), "text").bitwiseAND(F.lit((1 << 62) - 1))
        parted = written(other.select("conv", "depth", anew.alias("anew")), "collisions")
        if parted.isEmpty():
            return turns, first.drop("role", "text")
        after = parted.select("conv", (F.col("depth") + 1).alias("depth"), F.col("anew").alias("up_anew"))
        turns = turns.join(parted, ["conv", "depth"], "left").join(after, ["conv", "depth"], "left")
        turns = written(turns.withColumn("key", F.coalesce("anew", "key")).withColumn("up", F.coalesce("up_anew", "up")).drop("anew", "up_anew"), "parted")


def _ends(rows: DataFrame) -> DataFrame:
    """depth, key, ends: the SHA-256 of the conversations (ascending, joined by commas) of rows (depth, key, conv).

    Conversations are sorted by ranges and joined there, up to 4096 a row; a node's rows then pass one hash in order.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, node, held = TaskContext.get().partitionId(), 0, None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": [node[0]], "key": [node[1]], "part": [part], "seq": [seq], "text": [",".join(held)]})

        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (now != node or len(held) == 4096):
                    yield row()
                    seq, held = seq + 1, []
                node = now
                held.append(conv)
        if held:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for depth, key, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "text"))):
                if (depth, key) != node:
                    out += [(*node, sha.hexdigest())] if node else []
                    node, sha = (depth, key), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), ["depth", "key", "ends"])
                out = []
        out += [(*node, sha.hexdigest())] if node else []
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), ["depth", "key", "ends"])

    ordered = rows.orderBy("depth", "key", "conv").select("depth", "key", F.col("conv").cast("string"))
    chunks = ordered.mapInArrow(joined, "depth long, key long, part long, seq long, text string")
    dealt = chunks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "depth", "key")
    return dealt.sortWithinPartitions("depth", "key", "part", "seq").mapInArrow(hashed, "depth long, key long, ends string")


def _rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """nodes (depth, key, up, leaf, saved) with leaf and saved summed over the subtree.

    Sums reach twice as far up in each round, so rounds grow with the logarithm of the depth.
    """
    now, step = nodes.withColumnRenamed("up", "above"), 1
    total = nodes.count()
    while step <= deepest:
        rising = now.where(F.col("depth") >= step).select((F.col("depth") - step).alias("depth"), F.col("above").alias("key"), "leaf", "saved")
        sums = written(rising.groupBy("depth", "key").agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"), F.count("*").alias("n")), "rising")
        met = now.join(sums, ["depth", "key"], "left")
        summed = met.select("depth", "key", "above", (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        jumps = met.where(F.col("n").isNotNull()).select("depth", "key", F.col("above").alias("_above"), "n")
        own = summed.select((F.col("depth") - step).alias("depth"), F.col("above").alias("key"), F.col("key").alias("_key"), "leaf", "saved")
        far = _met(own, jumps, total, "_key", "left")
        now = written(far.select((F.col("depth") + step).alias("depth"), F.col("_key").alias("key"), F.col("_above").alias("above"), "leaf", "saved"), "rolled")
        step *= 2
    return now


def trie(turns: DataFrame, members: DataFrame | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each distinct prefix of the conversations of turns (conv, turn, role, text).

    conv_id: the smallest member; depth; parent_conv_id: the parent's conv_id (root: null); n_convs: members, the
    conversations that start with it; n_children; n_leaves: nodes without children in its subtree, itself included;
    saved_tokens: over its subtree, each node's members but one times the bytes of its last text; ends_sha256: the hash
    of the members that end there.

    members: a table of conversations (column conv), for those without turns, which are members of the root only; none: those of turns.
    primes: of the fingerprints; smaller ones make collisions, which are found and parted.

    Prefixes that only one conversation has need no rollup and are written as they are; the others are summed up to
    their ancestors in rounds that double their reach. Keys with a large share of all rows, such as a first turn that
    many conversations share, are salted. Nothing is gathered on the driver but one row a task.

    Order: turn, role, text, nulls first, so ties and repeated rows have a fixed place, and each is a turn. Null role or
    text: empty. Rows with a null conversation are left out. Conversations may have any ordered type; the order of
    their hash is that type's. No conversation: empty result. Other columns are ignored.
    """
    kind = turns.schema["conv"].dataType
    rows = placed(turns, primes)
    convs = rows.where("depth = 1").select("conv")
    if members is not None:
        convs = convs.unionByName(members.where("conv IS NOT NULL").select(F.col("conv").cast(kind))).distinct()
    convs = written(convs, "members")
    whole = convs.agg(F.count("*").alias("n"), F.min("conv").alias("first")).first()
    total = max(whole.n, rows.count())
    rows, groups = _verified(rows, total)
    spark = rows.sparkSession
    root = spark.range(1 if whole.n else 0).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("key"), F.lit(whole.n).cast("long").alias("n"), F.lit(whole.first).cast(kind).alias("first"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("up")
    )
    shared = written(groups.select(root.columns).unionByName(root), "shared")

    marked = _met(rows.select("conv", "depth", "key", "up"), shared.select("depth", "key", "n"), total, "conv", "left")
    marked = written(marked.join(_lasts(rows).withColumn("last", F.lit(True)), ["conv", "depth"], "left").withColumn("last", F.coalesce("last", F.lit(False))), "marked")
    single = marked.where("n IS NULL").select((F.col("depth") - 1).alias("depth"), F.col("up").alias("key"), "conv", "last")
    single = written(_met(single, shared.select("depth", "key", "n", "first"), total, "conv", "left").withColumnRenamed("n", "above"), "single")

    below = single.where("above IS NOT NULL").groupBy("depth", "key").agg(F.count("*").alias("alone"))
    inner = shared.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(F.count("*").alias("inner"))
    counted = shared.join(below, ["depth", "key"], "left").join(inner, ["depth", "key"], "left").fillna(0, ["alone", "inner"])
    leaf = F.when(F.col("alone") + F.col("inner") == 0, 1).otherwise(F.col("alone"))
    counted = written(counted.select("*", leaf.cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("size")).alias("saved")), "counted")
    deepest = counted.agg(F.max("depth")).first()[0] or 0
    sums = _rolled_up(counted.select("depth", "key", "up", "leaf", "saved"), deepest)

    turnless = convs.join(rows.where("depth = 1").select("conv"), "conv", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("key"), "conv")
    ends = _ends(marked.where("last AND n IS NOT NULL").select("depth", "key", "conv").unionByName(turnless))
    nodes = counted.select("depth", "key", "up", "n", "first", "alone", "inner").join(sums.select("depth", "key", "leaf", "saved"), ["depth", "key"]).join(ends, ["depth", "key"], "left")
    above = counted.where("inner > 0").select("depth", "key", F.col("inner").alias("n"), F.col("first").alias("parent"))
    nodes = nodes.select((F.col("depth") - 1).alias("depth"), F.col("up").alias("key"), F.col("n").alias("members"), "first", "alone", "inner", "leaf", "saved", "ends")
    found = _met(nodes, above, max(1, shared.count()), "first", "left").select(
        F.col("first").alias("conv_id"),
        (F.col("depth") + 1).alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        (F.col("alone") + F.col("inner")).alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    alone = single.select(
        F.col("conv").alias("conv_id"),
        (F.col("depth") + 1).alias("depth"),
        F.coalesce("first", "conv").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    return found.unionByName(alone)


def with_borrowed_heads(conversations: DataFrame, conv_col: str = "conv_id", every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, turn, role, text) and all conversations (conv).

    Conversation c has the first h turns of conversation c - c % every (all if fewer, none if absent), then its own
    turns after its first h; h is the unsigned CRC-32 of c's decimal digits, modulo most + 1. Null ids are left out.
    """
    rows = placed(conversations.select(F.col(conv_col).alias("conv"), "turn", "role", "text")).select("conv", F.col("depth").alias("turn"), "role", "text")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    convs = written(rows.where("turn = 1").select("conv"), "conversations")
    own = rows.where(F.col("turn") > h)
    heads = rows.where(F.col("turn") <= most).withColumnRenamed("conv", "_base")
    taken = convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("_base"), h.alias("_h")).join(heads, "_base").where("turn <= _h")
    return own.unionByName(taken.select("conv", "turn", "role", "text")), convs
