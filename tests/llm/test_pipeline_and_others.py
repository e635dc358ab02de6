import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saltmarsh.llm import chat_format, exact_dedup, line_dedup, queries, shared, sharding
from test_simhash import plain_similar

SF = "/root/testdata/sf0.001"


def collapsed(text):
    out = []
    for c in text or "":
        c = " " if c in "\t\n\x0b\x0c\r " else c
        if c != " " or not out or out[-1] != " ":
            out.append(c)
    return "".join(out)


def test_exact_groups(spark):
    texts = [(4, "a  b"), (2, "a\tb"), (9, "a b "), (7, None), (6, ""), (5, "x" * 300 + "1"), (3, "x" * 300 + "2"), (1, "x" * 300 + "1"), (None, "a b"), (2, "a b"), (8, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id long, text string, len int, keep_id string")
    groups = defaultdict(list)
    for i, t in texts:
        groups[collapsed(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        first = min(i for i in ids if i is not None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            want[i, first, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, with_digest=True).collect())
    assert got == want
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()) == [1, 2, 3, 6, 8, 9]


def test_exact_groups_plan_and_hot_groups(spark, monkeypatch):
    """No text is shuffled, also where nothing small is broadcast of itself; groups of every share give the same rows."""
    texts = ["same"] * 400 + ["other"] * 3 + [f"text {k}" for k in range(50)] + ["y" * 300 + str(k % 7) for k in range(30)]
    docs = spark.createDataFrame([(f"x{k:04}", t) for k, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    want = {}
    for k, t in enumerate(texts):
        want[f"x{k:04}"] = (f"x{texts.index(t):04}", texts.count(t), texts.index(t) == k)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in (1024, 2, 1):
            monkeypatch.setattr("saltmarsh.llm.shared.KEYS", keys)
            found = exact_dedup.exact_groups(docs)
            assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()} == want
        plans = []
        monkeypatch.setattr(exact_dedup, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or shared.written(df, name))
        exact_dedup.exact_groups(docs).collect()
        rows = next(p for p in plans if "sha2" in p).split("== Physical Plan ==")[1]
        assert "BroadcastHashJoin" in rows and "norm" not in "".join(re.findall(r"Exchange hashpartitioning.*", rows)) and "SortMergeJoin" not in rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def plain_flow(homes, owners, room):
    """The same rounds row by row: homes is the arc of each row, in the order of its arc."""
    waiting, room, placed = [(arc, arc, k) for k, arc in homes], list(room), {}
    while waiting:
        onward = []
        for node, origin, k in sorted(waiting):
            if room[owners[node]]:
                room[owners[node]] -= 1
                placed[k] = owners[node]
            else:
                onward.append(((node + 1) % len(owners), origin, k))
        waiting = onward
    return placed


@pytest.mark.parametrize(("rows", "epsilon"), [(0, 0.0), (7, 0.0), (500, 0.0), (500, 0.2)])
def test_ring_against_row_by_row(rows, epsilon):
    places, owners = sharding.ring(5, 8)
    arcs = sorted((zlib.crc32(b"%d" % k) % len(owners), k) for k in range(rows))
    room = sharding.capacities(rows, 5, epsilon)
    placed = plain_flow([(k, arc) for k, (arc, _) in enumerate(arcs)], owners.tolist(), room)
    counts = Counter(arc for arc, _ in arcs)
    got = sharding.flow(dict(counts), owners.tolist(), room)
    by_arc = defaultdict(list)
    for k, (arc, _) in enumerate(arcs):
        by_arc[arc].append(placed[k])
    assert {a: [s for n, s in runs for _ in range(n)] for a, runs in got.items()} == by_arc
    assert max(Counter(placed.values()).values(), default=0) <= max(room)


def test_ring_shards(spark):
    docs = spark.createDataFrame([(k, f"text é {k}", 0, "x") for k in range(997)] + [(None, None, 0, "x"), (5, "text é 5", 0, "x")], "doc_id long, text string, slot int, arc string")
    rows = sharding.bounded_ring_shards(docs, shards=8, virtual_nodes=16).collect()
    assert len(rows) == 999
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        text = "" if r.doc_id is None else f"text é {r.doc_id}"
        assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    more = {r.doc_id: r.shard for r in sharding.bounded_ring_shards(docs, shards=9, virtual_nodes=16).collect()}
    loose = {r.doc_id: r.shard for r in sharding.bounded_ring_shards(docs, shards=8, virtual_nodes=64, epsilon=0.5).collect()}
    grown = {r.doc_id: r.shard for r in sharding.bounded_ring_shards(docs, shards=9, virtual_nodes=64, epsilon=0.5).collect()}
    assert sum(more[r.doc_id] != r.shard for r in rows) < 0.5 * len(rows)  # a modulus would move eight ninths
    assert sum(loose[k] != grown[k] for k in loose) < 0.25 * len(loose)
    assert sharding.bounded_ring_shards(docs.limit(0)).count() == 0


def test_chat_examples(spark):
    said = [(1, 2, "user", "q2"), (1, 0, "system", "<|end|>\\<|x"), (1, 1, "assistant", "a\\|<|turn|>"), (1, 3, "assistant", None), (1, 4, "user", "tail"), (2, 0, "user", "only"), (3, 0, "assistant", "<\\|"), (3, 0, "assistant", "<\\|"), (None, None, None, "n" * 50_000)]
    talks = spark.createDataFrame([(*r, "x") for r in said], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.prefix_targets(talks)
    rows = {(r.conv_id, r.example): r for r in examples.collect()}
    assert sorted(k for k in rows if k[0]) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1)]
    first = rows[1, 0]
    assert first.formatted == "<|turn|>system<|text|><\\|end|>\\\\<\\|x<|end|><|turn|>assistant<|text|>a\\\\|<\\|turn|><|end|>"
    assert first.formatted[first.loss_start : first.loss_start + first.loss_length] == "a\\\\|<\\|turn|>"
    assert rows[1, 2].loss_length == 0 and rows[1, 2].n_turns == 5
    back = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((t, r or "", x or "") for c, t, r, x in said if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
        assert [(t.role, t.text) for t in back[conv].turns] == [x[1:] for x in want]
        assert back[conv].loss_text == "".join(x for _, r, x in want if r == "assistant")
    assert chat_format.read_back(chat_format.prefix_targets(talks.limit(0))).count() == 0


def test_site_lines(spark):
    rows = [(k, "http://A.example/x", "<nav>Home</nav><p>Body %d</p><p>Body %d</p>" % (k, k % 2)) for k in range(10)]
    rows += [(100 + k, "https://user@b.example:8/y", "<nav>Home</nav>") for k in range(4)] + [(None, None, None), (1, "http://a.example", "<p>x &amp;lt; y</p>")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, host int")
    got = line_dedup.drop_site_lines(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.page_lines(F.col("html"))).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append((r.host, r.text, r.n_lines, r.n_dropped))
    assert by[7] == [("a.example", "Body 7", 3, 2)]  # Home is on 10 of 11 pages, Body 1 on 5
    assert by[102] == [("b.example", "", 1, 1)]  # on all four pages
    assert by[None] == [("", "", 0, 0)] and ("a.example", "x &lt; y", 1, 0) in by[1]
    assert line_dedup.drop_site_lines(pages.limit(0), "page_id", F.col("url"), F.array("html")).count() == 0


@pytest.mark.parametrize("keys", [1024, 4, 1])
def test_site_lines_of_hot_hosts(spark, monkeypatch, keys):
    """The same rows whichever hosts and lines are joined by broadcast; hosts of one, two and many pages."""
    monkeypatch.setattr("saltmarsh.llm.shared.KEYS", keys)
    rows = [(k, "hot", ["menu", f"own {k}", f"some {k % 9}"]) for k in range(200)] + [(1, "two", ["a", "b"]), (1, "two", ["a", "c", "a"]), (2, "one", ["a", "a"]), (None, None, ["z"])]
    rows += [(k, f"h{k % 20}", ["foot", f"l{k % 40}"]) for k in range(80)]
    pages = spark.createDataFrame(rows, "key long, site string, of array<string>")
    count, total = Counter(), Counter(h or "" for _, h, _ in rows)
    for _, h, lines in rows:
        count.update((h or "", x) for x in set(lines))
    want = []
    for k, h, lines in rows:
        left = [x for x in lines if count[h or "", x] < 2 or count[h or "", x] <= 0.3 * total[h or ""]]
        want.append((k or -1, h or "", "\n".join(left), len(lines), len(lines) - len(left)))
    got = line_dedup.drop_site_lines(pages, "key", F.col("site"), F.col("of")).collect()
    assert sorted((r.key or -1, r.host, r.text, r.n_lines, r.n_dropped) for r in got) == sorted(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (name, stage), op in zip(corpus_pipeline.STAGES[:-1], ("op1_crf_line_quality", None, None), strict=True):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        before, ids = {r.doc_id: r.text for r in docs.collect()}, sorted(r.doc_id for r in kept.collect())
        if op:
            assert ids == sorted(r.doc_id for r in queries.QUERIES[op](spark, SF).where("kept").collect())
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(collapsed(before[i]), i)
            assert ids == sorted(first.values())
        else:
            groups, _ = plain_similar(before)
            assert ids == sorted(set(groups.values()))
        docs = docs.where(F.col("doc_id").isin(ids))
    tokens = {r.doc_id: r.doc_tokens for r in corpus_pipeline.pack(spark, docs, SF).collect()}
    assert sorted(tokens) == ids
    whole = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in whole} == tokens
