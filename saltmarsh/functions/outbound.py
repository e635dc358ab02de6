"""Column functions of rows sent to the register of events: which are sent, under what address, with which values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty

#: The register's name of each source (fixed values).
SOURCES = {"ransom": "랜섬웨어", "ransomlive": "랜섬웨어", "telegram": "텔레그램", "forum": "포럼", "kit": "포럼", "x": "X"}
#: What a post is, by the kind of its place, and the kinds that a post may name itself (fixed values).
NATURES = {"dls": "랜섬웨어 유출", "telegram": "확인 못 함", "forum": "확인 못 함", "x": "확인 못 함"}
KINDS = ("랜섬웨어 유출", "DB 판매", "DB 무료 공개", "접근 권한 판매", "사기 의심", "기타", "확인 못 함")
#: Marks that stand for no value (fixed values).
DASHES = ("-", "--", "---", "—", "–", "n/a", "N/A", "na", "unknown", "Unknown", "?")
#: Organisations' names that are too common to look for (fixed values).
COMMON = ("korea", "korean", "seoul", "test", "shop", "mall", "bank", "news", "data")
#: Why a row is sent or not (fixed values).
BY_HAND, NO_LEAK, SIGNAL = "사람이 킷을 돌린 글", "유출 글이 아닙니다", "대상 조직을 못 읽었지만 한국 신호가 있습니다: "
MESSAGE, NUMBER = r"^https://t\.me/[A-Za-z0-9_]{3,64}/[0-9]+$", r"^[A-Za-z0-9_.\-]+/[0-9]+$"
#: Texts are sent up to this length.
MOST = 2000


def looked_up(key: Column, names: dict[str, str]) -> Column:
    """The name of key; null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def source_name(source: Column) -> Column:
    return looked_up(F.trim(empty(source)), SOURCES)


def eligible(source: Column, organisation: Column, ours: Column, tier: Column, reasons: Column) -> Column:
    """struct(send, reason): posts of forums always, any row with an organisation, and of Telegram and X those with a Korean signal.

    ours: false for notices that are no leaks; null: not said. reasons: array of what the tier rests on.
    """
    name = source_name(source)
    forum, named = F.coalesce(name == "포럼", F.lit(False)), F.trim(empty(organisation)) != ""
    open_posts = F.coalesce(name.isin("텔레그램", "X"), F.lit(False))
    leak, signal = F.coalesce(ours, F.lit(True)), F.coalesce(tier, F.lit("none")) != "none"
    reason = (
        F.when(forum, BY_HAND)
        .when(named | ~open_posts, "")
        .when(~leak, NO_LEAK)
        .when(signal, F.concat(F.lit(SIGNAL), F.array_join(F.coalesce(reasons, F.array().cast("array<string>")), " · ")))
        .otherwise("")
    )
    return F.struct((forum | named | (open_posts & leak & signal)).alias("send"), reason.alias("reason"))


def event_url(source: Column, post_url: Column, message_url: Column, number: Column) -> Column:
    """The post's address; for Telegram that of the message that passed it on, noted or made from its number (channel/number)."""
    own, said, numbered = (F.trim(empty(c)) for c in (post_url, message_url, number))
    passed = F.when(said.rlike(MESSAGE), said).when(numbered.rlike(NUMBER), F.concat(F.lit("https://t.me/"), numbered))
    return F.when(F.trim(empty(source)) == "telegram", F.coalesce(passed, own)).otherwise(own)


def event_key(url: Column, title: Column, place: Column) -> Column:
    """What tells rows without uid apart: the address, or title and place."""
    own = F.trim(empty(url))
    return F.when(own != "", own).otherwise(F.concat(F.trim(empty(title)), F.lit("|"), F.trim(empty(place))))


def nature(kind: Column, place_kind: Column) -> Column:
    """What the post says it is, if that is one of the kinds; else by the kind of its place; else null."""
    own = F.trim(empty(kind))
    return F.when(own.isin(*KINDS), own).otherwise(looked_up(place_kind, NATURES))


def properties(values: dict[str, Column]) -> Column:
    """map of name to value, cut to MOST characters; blanks and dashes are not in it."""
    told = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), F.substring(value.cast("string"), 1, MOST))])
    return F.map_filter(told, lambda _, v: v.isNotNull() & (F.trim(v) != "") & ~F.trim(v).isin(*DASHES))
