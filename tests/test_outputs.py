"""Labelled values, cells, pages of channels and days: what goes on, what ends, and blanks."""

from pyspark.sql import functions as F

from saltmarsh.functions import outputs
from saltmarsh.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_values_that_go_on(spark):
    text = "# 머리: 아님\n대상: Acme  (목록)\n요약: 첫 줄  \n    둘째: 줄\n\n    셋째\n- 목록: 아님\n    이어지지 않음\n   들여쓴 칸 : 값\n| 표: 아님\n대상: 나중\n빈칸:   \n    # 끊김\n    뒤\n--- 아래 ---\n뒤: 아님"
    want = {"요약": "첫 줄\n둘째: 줄\n\n셋째", "들여쓴 칸": "값", "대상": "나중"}
    assert dict(one(spark, outputs.labelled(F.lit(text), "--- 아래 ---"))) == want
    assert dict(one(spark, outputs.labelled(F.lit(None).cast("string")))) == {} and dict(one(spark, outputs.labelled(F.lit("")))) == {}


def test_cells_are_only_filled(spark):
    held = F.create_map(*[F.lit(x) for x in ("a", "", "b", "못 봄(막힘)", "c", " same ", "d", "mine")])
    found = F.create_map(*[F.lit(x) for x in ("a", "1", "b", "2", "c", "same", "d", "theirs", "e", "5", "f", "")])
    x = one(spark, outputs.seated(held, found))
    assert (dict(x.cells), x.filled, x.clashes) == ({"a": "1", "b": "2", "c": " same ", "d": "mine", "e": "5"}, ["a", "b", "e"], ["d"])
    none = F.lit(None).cast("map<string,string>")
    x = one(spark, outputs.seated(none, none))
    assert (dict(x.cells), x.filled, x.clashes) == ({}, [], [])


def test_pages_of_channels(spark):
    post = '<div class="tgme_widget_message text_not_supported_wrap" data-post="c/{n}"><div class="tgme_widget_message_text js-x" dir="auto">a &lt;b&gt;<br/>c <a href="https://x.y/z">z</a></div><span class="tgme_widget_message_views">1.2K</span></div>'
    rows = [(1, post.format(n=1) + post.format(n=2).replace("tgme_widget_message_text", "none")), (2, '<div class="tgme_page">Preview channel</div>'), (3, '<div class="tgme_page">'), (4, "x"), (5, None)]
    found = feeds.channel_page(spark.createDataFrame([(k, "c", p) for k, p in rows], "k int, channel string, page string"), "page", "channel").collect()
    told = sorted((r.k, r.place or 0, r.post or "", r.views or "", r.text or "", list(r.links or []), r.why) for r in found)
    assert told == [(1, 1, "c/1", "1.2K", "a <b>\nc z", ["https://x.y/z"], ""), (1, 2, "c/2", "1.2K", "", [], ""), (2, 0, "", "", "", [], feeds.NO_PREVIEW), (3, 0, "", "", "", [], feeds.NO_POSTS), (4, 0, "", "", "", [], feeds.NO_CHANNEL), (5, 0, "", "", "", [], feeds.NO_CHANNEL)]


def test_days(spark):
    assert one(spark, outputs.found_day(F.lit('{"발견일": "", "discovered": "2024-01-01 15:30:00.5"}'))) == "2024-01-02"
    assert one(spark, outputs.found_day(F.lit('{"발견일": "2024-01-01"}'))) == "2024-01-01" and one(spark, outputs.found_day(F.lit("broken"))) is None and one(spark, outputs.found_day(F.lit('{"discovered": "soon"}'))) is None
    none = F.lit(None).cast("date")
    assert one(spark, outputs.day_bounds(none, none, "UTC").start) is None
    assert [one(spark, outputs.description_kind(F.lit(t).cast("string"))) for t in ("", None, " n/a", "[AI-generated] x", "We have all data", "A bakery")] == ["빈칸", "빈칸", "N/A", "회사 소개(AI 가 지음)", "게시글 문장", "회사 소개로 보임"]
