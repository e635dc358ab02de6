import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from saltmarsh.llm import simhash
from saltmarsh.llm.components import components

DOCS = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text, words=3):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Smallest index reachable over pairs within radius, by comparing all pairs."""
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: top(k) for k in prints}


def near(value, bits, rng):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c d e a b c", "É É é x\x85y z", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_lanes_within(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = np.array([near(b, rng.randrange(0, 9), rng) for b in base for _ in range(40)] + [rng.getrandbits(64) for _ in range(99)], dtype=np.uint64)
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    mask = simhash.lanes_within((bits * simhash.ONES).astype(np.uint64)[:, :, None], simhash.planes(values)[:, None, :], radius)
    rows, lanes = simhash._set_lanes(mask, len(values))
    assert set(zip(rows.tolist(), lanes.tolist())) == {(a, b) for a in range(len(values)) for b in range(len(values)) if (int(values[a]) ^ int(values[b])).bit_count() <= radius}


@pytest.mark.parametrize("chunk", [8, 1024])
def test_links_lose_no_group(spark, chunk):
    """One dense group, chains and noise: in large buckets cut into chunks, and in small ones."""
    rng = random.Random(1)
    middle = rng.getrandbits(64)
    values = {middle} | {near(middle, rng.randrange(1, 4), rng) for _ in range(150)}
    for _ in range(5):
        step = rng.getrandbits(64)
        for _ in range(8):
            step = near(step, 2, rng)
            values.add(step)
    values |= {rng.getrandbits(64) for _ in range(100)} | {0, 1, 3, 7}
    prints = dict(enumerate(rng.sample(sorted(values), len(values))))
    rows = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()]
    found = components(simhash.near_links(spark.createDataFrame(rows, "id long, fp long"), 2, chunk)).collect()
    want = plain_groups(prints, 2)
    got = {k: k for k in prints} | {r.node: r.component for r in found}
    assert got == want


def test_links_are_not_all_pairs(spark):
    rows = [(k, v) for k, v in enumerate([0] + [1 << b for b in range(40)])]
    assert simhash.near_links(spark.createDataFrame(rows, "id long, fp long")).count() < 6 * len(rows)


def test_near_groups_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one two three"), (None, "One two three"), (7, "one two three"), (None, "other words here now")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = sorted(((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_groups(docs).collect()))
    zero, one, two = "0" * 16, f"{plain_fingerprint('one two three'):016x}", f"{plain_fingerprint('other words here now'):016x}"
    assert got == sorted([(5, zero, 3), (3, zero, 3), (9, zero, 3), (7, one, 7), (-1, one, 7), (7, one, 7), (-1, two, -1)])
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_components_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 99), (100, 100), (None, 4)], "src long, dst long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {99: 99, 100: 99}


def plain_similar(texts, words=5, similarity=0.8):
    """The smallest index reachable over pairs of texts whose sets of shingles are similar, from all pairs."""
    sets = {}
    for k, text in texts.items():
        found = (text or "").encode().lower().split()
        sets[k] = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            links += sets[a] != sets[b]
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: top(k) for k in sets}, links


def grouped(spark, texts, **how):
    docs = spark.createDataFrame(list(texts.items()), "k long, text string").repartition(3)
    found = {r.row: r.group for r in simhash.similar_groups(docs, "k", **how).collect()}
    return {k: found.get(k, k) for k in texts}


@pytest.mark.parametrize("chunk", [4, 1024])
def test_similar_groups_against_all_pairs(spark, chunk, monkeypatch):
    """Groups of changed copies around an original, chains, common passages and short texts; leaders of chunks of four, and of all."""
    monkeypatch.setattr(simhash, "WITH_LEADER", 3)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    changed = lambda text, n: [word() if k in places else w for places in [set(rng.sample(range(len(text)), n))] for k, w in enumerate(text)]
    texts, passage = [], [word() for _ in range(60)]
    for size in (40, 200, 600):
        original = [word() for _ in range(size)]
        texts += [original] + [changed(original, rng.randrange(0, 1 + size // 60)) for _ in range(40)]
        step = [word() for _ in range(size)]
        for _ in range(12):
            step = changed(step, max(1, size // 60))
            texts.append(step)
    texts += [passage + [word() for _ in range(rng.randrange(5, 200))] for _ in range(40)]
    texts += [[], [], ["one"], ["One"], ["a", "b"], ["a", "b", "c", "d", "e", "f"], ["w"] * 5000, ["w"] * 400]
    rng.shuffle(texts)
    rows = dict(enumerate(" ".join(t) for t in texts))
    want, links = plain_similar(rows)
    assert links > 300
    assert grouped(spark, rows, chunk=chunk) == want


def test_similar_groups_of_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert grouped(spark, rows) == plain_similar(rows)[0]
    assert grouped(spark, {}) == {}


def test_bands_meet_at_the_similarity():
    """Pairs at a similarity of 0.8 share a band nearly always, and differ in far fewer bits than FAR."""
    rng, met, far = np.random.default_rng(1), 0, 0
    for _ in range(300):
        both, a, b = np.split(rng.integers(0, 1 << 64, 400 + 100, dtype=np.uint64), [400, 450])
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        met += any(p == q for p, q in zip(simhash.bands(x), simhash.bands(y)))
        far += (simhash.majority(x) ^ simhash.majority(y)).bit_count() > simhash.FAR
    assert met >= 295 and far == 0


def test_drop_near_copies(spark):
    docs = spark.createDataFrame([(2, "a b c d"), (1, "A b  c d"), (3, "quite another text of words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 3]


def test_parity_bound_rules_out_only_what_is_not_similar():
    """At no size does the bound refuse a pair at 0.8; texts of 200 shingles at 0.7 it mostly refuses."""
    rng, refused = np.random.default_rng(2), 0
    for n in (1, 4, 40, 200, 3000):
        for common in (n, int(n * 0.89), int(n * 0.9), int(n * 0.82)):
            both, a, b = np.split(rng.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64), [common, n])
            x, y = np.concatenate([both, a]), np.concatenate([both, b])
            bits = [int.from_bytes(simhash.parity(v).tobytes(), "big") for v in (x, y)]
            ok = simhash.may_be_similar(np.array([len(x)]), np.array([len(y)]), np.array([(bits[0] ^ bits[1]).bit_count()]), 0.8)[0]
            assert ok or common < 0.8 * (2 * n - common)
            refused += n == 200 and not ok
    assert refused == 1
    empty = np.zeros(0, np.uint64)
    assert not simhash.parity(empty).any()


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError, match="below 0.8"):
        simhash.drop_near_copies(spark.createDataFrame([(1, "a")], "doc_id long, text string"), similarity=0.7)


def test_groups_with_ids_of_any_type(spark):
    """Texts whose rows have no id still join others, and text ids stay."""
    a, b, c = "one two three four five six seven eight nine ten", "another text of quite other words and nothing like it", "one two three four five six seven eight nine ten"
    rows = [("x2", a), ("x1", c), (None, b), ("x3", None), ("x4", ""), ("x0", b), (None, "alone")]
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    told = sorted(((r.doc_id or ""), r.component_id or "") for r in found)
    assert told == [("", ""), ("", "x0"), ("x0", "x0"), ("x1", "x1"), ("x2", "x1"), ("x3", "x3"), ("x4", "x3")]
