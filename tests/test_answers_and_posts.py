"""Sentences and citations, capture plans, posts and dumps against plain rules, row by row."""

import random
import re

from saltmarsh.operators import answers, capture, posts
from saltmarsh.plans import QUERIES
from saltmarsh.sources import dumps

SF = "/root/testdata/sf0.001"
CITES = "answer int, start int, `end` int, source int"


def shown(spark, text, cites):
    said = spark.createDataFrame([(1, text)], "answer int, text string")
    rows = answers.sentences(said, spark.createDataFrame([(1, *c) for c in cites], CITES)).collect()
    return [(r.text, list(r.sources)) for r in sorted(rows, key=lambda r: r.place)]


def test_sentences_of_an_answer(spark):
    text = "첫 문장이다. 다음은 둘째다. (확인일 2026-08-01)\n**INC-7 사고**\n자료가 나왔다."
    spot = lambda part: (text.index(part), text.index(part) + len(part))
    cites = [(*spot("첫"), 2), (*spot("둘째"), 3), (*spot("확인일"), 5), (*spot("자료"), 1), (5, 5, 9), (3, None, 9), (900, 950, 9)]
    assert shown(spark, text, cites) == [("첫 문장이다.", [2]), ("다음은 둘째다. (확인일 2026-08-01)", [3, 5]), ("INC-7 사고: 자료가 나왔다.", [1])]
    text = "목록은 다음과 같습니다:\n- 하나가 있다.\n끝. (꼬리다) 남은 말이다."
    assert shown(spark, text, [(*[text.index("하나"), text.index("하나") + 2], 4), (text.index("남은"), text.index("남은") + 1, 6)]) == [("하나가 있다.", [4]), ("끝. (꼬리다)", []), ("남은 말이다.", [6])]
    assert shown(spark, "", [(0, 3, 1)]) == [] and shown(spark, None, [(0, 3, 1)]) == []


def test_sentences_of_documents(spark):
    """What is shown of whole documents is their pieces, put together by the rules one after another."""
    found = QUERIES["rag_sentences"](spark, SF).collect()
    pieces = {}
    for r in QUERIES["rag_cited_pieces"](spark, SF).collect():
        pieces.setdefault(r.answer, {})[r.place] = (r.text, set(r.sources))
    want = {}
    for answer, held in pieces.items():
        out = []
        for k in sorted(held):
            text, sources = held[k]
            tail = re.match(answers.TAIL, text) if out else None
            if tail:
                out[-1][0] += " " + tail.group(1)
                text = (tail.group(2) or "").strip()
                out[-1][1].update(sources if not text else ())
            if text:
                out.append([text, set(sources)])
        out = [(re.sub(answers.MARK, "", t).strip(), s) for t, s in out]
        shown, head = [], ""
        for k, (text, sources) in enumerate(out):
            whole, head = head + text, ""
            if not sources and re.search(answers.OPENS_LIST, text):
                continue
            if not sources and k + 1 < len(out) and out[k + 1][1] and len(text) <= 60 and not re.search(answers.ENDS, text):
                head = text.rstrip(": ") + ": "
            elif whole:
                shown.append((whole, sorted(sources)))
        want[answer] = shown
    got = {}
    for r in sorted(found, key=lambda r: (r.answer, r.place)):
        got.setdefault(r.answer, []).append((r.text, list(r.sources)))
    assert got == {a: s for a, s in want.items() if s}


def test_capture_by_rule(spark):
    r = random.Random(1)
    quotas = {"a": 3, "b": 1, "c": 2}
    rows = [(r.randrange(4), r.choice("abcd"), r.randrange(9), r.choice([None, *range(8)])) for _ in range(300)]
    want = set()
    for channel in range(4):
        taken = set()
        for name, quota in quotas.items():
            ids = []
            for _, i in sorted((rank, i) for c, n, rank, i in rows if c == channel and n == name and i is not None):
                if i not in taken and i not in ids and len(ids) < quota:
                    ids.append(i)
            taken.update(ids)
            want |= {(channel, name, k + 1, i) for k, i in enumerate(ids)}
    df = spark.createDataFrame(rows, "channel int, list string, rank int, id int")
    assert {tuple(x) for x in capture.capture_plan(df, quotas).collect()} == want
    assert capture.capture_plan(df.limit(0), quotas).count() == 0


def test_posts_read_as_far_as_they_go(spark):
    said = {
        '{"A": 1, "a": 2, "b": null, "c": {"d": [1]}}': ("JSON", {"a": "2", "c": '{"d":[1]}'}, False),
        '{"a": 1} {"b": 2}': ("글자만", {}, True),
        '{\n"Victim": "x "y" z",\n"Group": "<b>g</b>",\n"empty": ""\n}': ("JSON(깨짐)", {"victim": 'x "y" z', "group": "g"}, True),
        '{"Victim": "x",': ("글자만", {}, True),
        "{\nVictim: x\nGroup： y": ("라벨", {"victim": "x", "group": "y"}, True),
        "Victim: x\nVictim: later": ("라벨", {"victim": "later"}, False),
        "{'a': 1}": ("글자만", {}, True),
        "just words": ("글자만", {}, False),
        "": ("빈 글", {}, False),
        None: ("빈 글", {}, False),
    }
    df = spark.createDataFrame(list(enumerate(said)), "k int, text string")
    rows = df.select("k", posts.posts.read_post(df.text).alias("p")).collect()
    got = {list(said)[r.k]: (r.p.shape, dict(r.p.fields), r.p.note != "") for r in rows}
    assert got == said


def test_dump_larger_than_a_split(spark, tmp_path):
    """A dump is the same however it is cut into tasks; brackets, commas and quotes within a definition part nothing."""
    said = ["CREATE TABLE `t` (`id` int(11), note varchar(9) DEFAULT 'a,(;', e enum('x)','y'), KEY k (id, note(5)))"]
    said += [f"INSERT INTO t VALUES ({k},'v),({k}')" + "".join((",\n" if k % 3 == 1 else ",") + f"({k},'w{j}')" for j in range(k % 3)) for k in range(3000)]
    said += ["insert into [other] (a, b) values (1,2)", "DROP TABLE x", "CREATE TABLE other (c int, d text)"]
    (tmp_path / "dump.sql").write_text(";\n".join(said))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("4k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = dumps.table_shapes(dumps.statements(spark, str(tmp_path)), "statement").collect()
            found.append({r.name: (list(r.columns), r.n_tuples, dict(r.ways)) for r in rows})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == {"t": (["id", "note", "e"], 6000, {dumps.A_STATEMENT: 1000, dumps.A_LIST: 1000, dumps.A_LINE: 1000}), "other": (["c", "d"], 1, {dumps.A_STATEMENT: 1})}
