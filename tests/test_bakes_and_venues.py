"""Files by offsets, exports checked at any depth, versions of a table, relations that go, and what pages say."""

import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions import states, webpages
from saltmarsh.operators import baked
from saltmarsh.sources import binary, sinks


def link(path=b"C:\\a\\b.txt", computer=b"PC-1", unc=b"\\\\SRV\\share", label=b"DATA"):
    volume = struct.pack("<IIII", 17 + len(label), 3, 0xBEEF, 16) + label + b"\0"
    net = struct.pack("<IIIII", 20 + len(unc) + 1, 0, 20, 0, 0) + unc + b"\0"
    at = 28 + len(volume)
    info = struct.pack("<IIIIIII", 0, 28, 3, 28, at, at + len(path) + 1, 0) + volume + path + b"\0" + net
    info = struct.pack("<I", len(info)) + info[4:]
    head = binary.SHORTCUT + struct.pack("<I", 2 | 4 | 128) + b"\0" * 20 + struct.pack("<QI", 132_000_000_000_000_000, 4096) + b"\0" * 20
    text = struct.pack("<H", 2) + "hi".encode("utf-16-le")
    return head + info + text + struct.pack("<II", 96, binary.TRACKER) + b"\0" * 8 + computer.ljust(16, b"\0") + b"\0" * 64


def test_shortcuts_and_jump_lists(spark, tmp_path):
    (tmp_path / "one.lnk").write_bytes(link())
    (tmp_path / "list.automaticDestinations-ms").write_bytes(b"junk" + link(computer=b"PC-2") + b"\0\0" + link(path="C:\\한글".encode("cp949")))
    for name, data in (("cut.lnk", link()[:100]), ("none.lnk", b"text"), ("empty.lnk", b"")):
        (tmp_path / name).write_bytes(data)
    rows = binary.shortcuts(binary.files(spark, str(tmp_path))).collect()
    told = {(r.file.rsplit("/", 1)[1], r.computer, r.path, r.unc, r.label, r.drive, r["size"], r.whole) for r in rows}
    one = ("C:\\a\\b.txt", "\\\\SRV\\share", "DATA", "고정", 4096, True)
    listed = "list.automaticDestinations-ms"
    assert told == {("one.lnk", "PC-1", *one), (listed, "PC-2", *one), (listed, "PC-1", "C:\\한글", *one[1:]), ("cut.lnk", None, None, None, None, None, 4096, False)}
    assert {r.modified for r in rows} == {"2019-04-17 18:40:00"}
    figures = {(r.what, r["name"]): r.n for r in binary.usage(binary.shortcuts(binary.files(spark, str(tmp_path)))).collect()}
    assert figures == {("만든 컴퓨터", "PC-1"): 2, ("만든 컴퓨터", "PC-2"): 1, ("공유 폴더", "\\\\SRV\\SHARE"): 3, ("볼륨", "0000BEEF  고정  [DATA]"): 3}
    for n in range(len(link())):  # cut anywhere, it is read or told to be cut
        found = binary.shortcut(link()[:n])
        assert found is None if n < 76 else not found["whole"] or n in (len(link()) - 96, *range(len(link()) - 96, len(link()) - 88))


def test_kinds_of_files(spark):
    rows = [("a/x.csv", b"id,\xb0\xa1"), ("a/y.txt", "가나다".encode()[:-1]), ("a/z.txt", b"\xff\xfe\x01\x02"), ("a/run.txt", b"#!/bin/sh"), ("a/run", b"#!/bin/sh"), ("a/nul.txt ", b""), ("a/n.zip", b"PK\x03\x04"), ("a/q?.bin", None)]
    found = {r.path: (r.kind, r.text_kind, r.lies, len(r.unsafe)) for r in binary.sniffed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found == {"a/x.csv": ("텍스트", "", False, 0), "a/y.txt": ("텍스트", "", False, 0), "a/z.txt": ("이진", "", False, 0), "a/run.txt": ("텍스트", "셔뱅 스크립트", True, 0), "a/run": ("텍스트", "셔뱅 스크립트", False, 0), "a/nul.txt ": ("빈 파일", "", False, 2), "a/n.zip": ("zip 계열(zip·docx·xlsx·jar)", "", False, 0), "a/q?.bin": ("빈 파일", "", False, 1)}


def test_checks_at_any_depth(spark, tmp_path):
    schema = "id int, items array<map<string, struct<name: string, days: array<string>>>>, extra string"
    rows = spark.createDataFrame([(1, [{"a": ("ok", ["2024-01-01", None])}, None, {}], None), (2, [{"b": ("see x.onion", ["soon"])}], "y"), (3, None, None)], schema)
    checks = {"": {"keys": ("id", "items")}, "items[]": {"keys": ("a",)}, "items[]{}.days[]": {"shape": r"^\d{4}-\d\d-\d\d$"}, "*": {"forbidden": r"\.onion"}}
    found = {(r.path, r.what, r.value) for r in sinks.checked(rows, checks).collect()}
    assert found == {("", "key", "extra"), ("items[]", "key", "b"), ("items[]{}.name", "forbidden", "see x.onion"), ("items[]{}.days[]", "shape", "soon")}
    with pytest.raises(ValueError, match="forbidden at items"):
        sinks.export_checked(rows, str(tmp_path / "out"), checks)
    assert not (tmp_path / "out").exists()
    sinks.export_checked(rows.where("id <> 2"), str(tmp_path / "out"), checks)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert sinks.checked(rows, {}).count() == 0


def test_versions_never_lose(spark, tmp_path):
    folder = str(tmp_path / "t")
    schema = lambda *fields: T.StructType([T.StructField(n, t) for n, t in fields])
    sinks.write_version(spark.createDataFrame([(1, "a")], "k int, v string"), folder, "1")
    wide = schema(("k", T.LongType()), ("v", T.StringType()), ("n", T.IntegerType()))
    assert sinks.migrate(spark, folder, "2", wide, {"n": 7}) and not sinks.migrate(spark, folder, "3", wide, {"n": 7})
    assert [tuple(r) for r in sinks.current_version(spark, folder).collect()] == [(1, "a", 7)]
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/version=1").collect()] == [(1, "a")]
    for bad, why in ((schema(("k", T.ShortType()), ("v", T.StringType()), ("n", T.IntegerType())), "without loss"), (schema(("k", T.LongType())), "no n, v")):
        with pytest.raises(ValueError, match=why):
            sinks.migrate(spark, folder, "4", bad, {})


def test_relations_that_go(spark):
    schema = "id string, shown boolean, kind string, from_island string, from_name string, to_island string, to_name string, sureness string, evidence array<string>"
    row = lambda id, **v: tuple({"id": id, "shown": True, "kind": "후속", "from_island": "포럼", "from_name": "Dark Forums", "to_island": "텔레그램", "to_name": "DarkForums", "sureness": None, "evidence": None, **v}.values())
    rows = [row("R-1"), row("제목"), row("R-3", shown=None), row("R-4", kind="확인 필요"), row("R-5", to_name="none"), row("R-6", to_island="포럼"), row("R-7", evidence=["x"]), row("R-8", evidence=["e2", "x", "e1", "e2"]), row("R-9", to_name="twice"), row("R-1")]
    names = spark.createDataFrame([("FORUM", "DARKFORUMS", "f1"), ("TELEGRAM", "darkforums", "t1"), ("TELEGRAM", "twice", "t2"), ("TELEGRAM", "Twice", "t3"), ("TELEGRAM", "", "t4")], "island string, name string, territory string")
    events = spark.createDataFrame([("e1",), ("e2",), ("e2",)], "event string")
    found = sorted((r.reason or "", r.id, list(r.evidence), r.lost) for r in baked.judged(spark.createDataFrame(rows, schema), names, events).collect())
    kept = [f for f in found if not f[0]]
    assert [(i, e, n) for _, i, e, n in kept if not i.startswith("rel-")] == [("R-1", [], 0), ("R-1", [], 0), ("R-8", ["e2", "e1", "e2"], 1)] and len(kept) == 4
    assert sorted((i, r) for r, i, _, _ in found if r) == [("R-3", baked.OFF), ("R-4", baked.NO_KIND), ("R-5", baked.NO_END), ("R-6", baked.SAME_END), ("R-7", baked.NO_EVIDENCE), ("R-9", baked.NO_END)]
    assert sum(n for *_, n in found) == 2


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_values_with_how_they_are_known(spark):
    value = states.seen(F.lit("10"), "page", "2024-01-02", states.ESTIMATED)
    assert one(spark, states.rendered(value)) == "추정: 10 (page · 2024-01-02)"
    assert one(spark, states.rendered(states.blocked("캡차"))) == "못 봄(캡차)" and one(spark, states.rendered(states.absent("page", ""))) == "없음 (page)"
    assert one(spark, states.encoded(states.seen(F.lit(None), "x", "y"))) is None and one(spark, states.rendered(states.decoded(F.lit("broken")))) == "안 봄"
    for v in (value, states.absent("a", "b"), states.blocked("w"), states.unseen()):
        assert one(spark, states.decoded(states.encoded(v))) == one(spark, v) and one(spark, states.is_valid(v))
    assert not one(spark, states.is_valid(F.struct(F.lit("못 봄").alias("state"), *[F.lit(None).cast("string").alias(n) for n in states.FIELDS[1:]])))
    assert one(spark, states.is_evidence_of_absence(states.absent("a", "b"))) and not one(spark, states.is_evidence_of_absence(states.blocked("w")))


def test_pages_of_venues(spark):
    page = F.lit('<nav><a href="/x">Leaks</a><a>Home</a></nav><a href="viewforum?f=1"><b>Data</b> &amp; dumps</a><a href="/forum/2">12</a><a href="/c/3">Selling</a><img alt="captcha">')
    names = webpages.boards(page)
    assert one(spark, names) == ["Data &amp; dumps", "Selling", "Leaks"]
    assert one(spark, webpages.distribution(names)) == ["최초 유출", "되팔이"] and one(spark, webpages.personal_boards(F.array(F.lit("CVV shop"), F.lit("x")))) == "게시판 이름: CVV shop"
    gate = one(spark, webpages.gate(page))
    assert (dict(gate.signals), gate.signup_required, gate.how_to_enter) == ({"캡차": "strong"}, False, "캡차 있음")
    assert one(spark, webpages.gate(F.lit(None).cast("string"))).how_to_enter == "공개 접근 (로그인·캡차 신호 없음)"
    totals = {"Total posts: 1.6M": (1_600_000, True), "Posts: 24.3K and": (24_300, True), "Posts online: 5": None, "newest Posts: 12": None, "873955 Total Posts": (873_955, False), "Messages 185\u202f091 ": (185_091, False), "": None, None: None}
    for text, want in totals.items():
        found = one(spark, webpages.total(F.lit(text).cast("string"), webpages.POSTS))
        assert (found and tuple(found)) == want, text
    assert one(spark, webpages.latest_date(F.lit("2024-1-5, 31.12.2023 and 2030-01-01, 2024-13-01"), F.lit("2024-06-01"))) == "2024-01-05"
    assert one(spark, webpages.meta(F.lit('<meta content="a  b" name="description">'), "name", "description")) == "a b"
    assert one(spark, webpages.last_page(F.lit('<a href="?page=42">last</a>'))) == 42 and one(spark, webpages.last_page(F.lit(None).cast("string"))) is None
    day = F.lit("2024-01-02")
    assert one(spark, webpages.availability(F.lit(None).cast("int"), F.lit(None).cast("string"), day)).why == "타임아웃 또는 접속 실패"
    assert one(spark, webpages.availability(F.lit(200), F.lit("This site has been SEIZED"), day)).v.startswith("후보-OFFLINE")
    assert one(spark, webpages.onion_address(F.lit(None).cast("string"), F.lit("at " + "a" * 56 + ".onion"), day)).src == "본문 정규식 매칭 (후보)"
