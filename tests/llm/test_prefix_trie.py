"""The trie of conversations against brute force over whole paths, with collisions made by small primes."""

import hashlib
import random
import zlib

import pytest

from saltmarsh.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(said)] for c, said in talks.items()}


def brute(talks):
    members = {}
    for conv, said in talks.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(conv)
    kids = {p: sum(q[:-1] == p and len(q) == len(p) + 1 for q in members) for p in members}
    out = []
    for path, convs in members.items():
        under = [q for q in members if q[: len(path)] == path]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(convs) if len(talks[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), kids[path], sum(kids[q] == 0 for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(talks):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in talks}
    return {c: talks.get(c - c % 5, [])[: h[c]] + talks[c][h[c] :] for c in talks}


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def sample(seed, convs, turns):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        same = r.random() < 0.3  # a third of all conversations begin alike
        for t in range(r.randrange(0, turns)):
            text = "hot" if same and t < 3 else r.choice(["a", "b", "é", "", None])
            rows.append((c, None if r.random() < 0.1 else t, r.choice(["user", "assistant", None]) if t > 2 or not same else "user", text))
    return rows + rows[:5] + [(None, 1, "user", "x")]


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (7, 5), (2, 2)])
def test_trie_with_collisions(spark, primes):
    rows = sample(3, 40, 9)
    turns = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("conv_id", "conv").repartition(5)
    members = spark.createDataFrame([(k,) for k in range(45)] + [(None,)], "conv long")
    talks = {k: [] for k in range(45)} | ordered(rows)
    assert got(prefix_trie.trie(turns, members, primes)) == brute(talks)


def test_borrowed_heads(spark):
    rows = sample(5, 120, 12)
    turns, convs = prefix_trie.with_borrowed_heads(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.trie(turns, convs)) == brute(rebuilt(ordered(rows)))


def test_long_conversations_over_many_tasks(spark):
    """Two copies of a long conversation and one that leaves it late: fingerprints cross tasks, sums rise far."""
    long = [(c, k, "user" if k % 2 else "assistant", f"turn {k}") for c in (3, 8, 9) for k in range(700 if c < 9 else 650)] + [(9, 900, "user", "else")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = spark.createDataFrame(long, "conv long, turn long, role string, text string").repartition(6)
        found = got(prefix_trie.trie(turns))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == brute(ordered(long))


def test_edges(spark):
    none = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert got(prefix_trie.trie(none)) == []
    assert got(prefix_trie.trie(*prefix_trie.with_borrowed_heads(none.withColumnRenamed("conv", "conv_id")))) == []
    one = spark.createDataFrame([("x", 1, None, None, 5, "n")], "conv string, turn long, role string, text string, depth int, key string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got(prefix_trie.trie(one)) == sorted([("x", 0, None, 1, 1, 1, 0, sha("")), ("x", 1, "x", 1, 0, 1, 0, sha("x"))], key=str)
    only = spark.createDataFrame([(-4,), (7,)], "conv long")
    assert got(prefix_trie.trie(none, only)) == [(-4, 0, None, 2, 0, 1, 0, sha("-4,7"))]
    big = "x" * 300_000
    turns = spark.createDataFrame([(c, 0, "user", big) for c in (1, 2)], "conv long, turn long, role string, text string")
    assert [r.saved_tokens for r in prefix_trie.trie(turns).collect()] == [300_000, 300_000]
