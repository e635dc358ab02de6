"""Column functions of places and events on the map, of briefs and queues, and of addresses of groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty

#: Why an event is not on the map (fixed values).
X_FEED, NO_SOURCE, NO_PLATFORM, NO_DATE, NOT_KOREAN, NO_TERRITORY = "X 알림 채널(지도 밖)", "소스 없음", "게시 플랫폼 없음", "날짜 없음", "한국 관련 아님", "영토를 정할 수 없음"
#: A channel in an address; hosts that only end like it do not count (fixed value).
CHANNEL = r"(?i)(?<![A-Za-z0-9_-])t\.me/(?:s/)?([A-Za-z0-9_]{3,64})"
#: Parts of the daily brief and of the queue of cases, the latter in their order (fixed values).
UNRELATED, LISTED, NO_SIGNAL, UNSURE = "무관", "목록", "신호 없음", "미확인"
BLOCKED, KNOWN, TO_OPEN, TO_RUN, DONE, LAST_STEP = "막힌 것", "이미 아는 건", "열어야 할 것", "돌릴 수 있는 것", "끝난 것", "⑥"
#: Words that name Korea in a title (fixed values).
KOREA_WORDS = ("korea", "korean", ".kr")


def drop_reason(island: Column, source: Column, platform: Column, posted: Column, korean: Column, territory: Column) -> Column:
    """The first reason for which an event is left out of the map; null for those that stay."""
    return (
        F.when((empty(island) == "") & (empty(source) == "X"), X_FEED)
        .when(empty(island) == "", NO_SOURCE)
        .when(F.trim(empty(platform)) == "", NO_PLATFORM)
        .when(empty(posted) == "", NO_DATE)
        .when((island == "RANSOMWARE") & (empty(korean) != "직접"), NOT_KOREAN)
        .when(territory.isNull(), NO_TERRITORY)
    )


def stays_on_map(on: Column, until: Column, island: Column, online: Column, unknown: Column, main: Column, others: Column, events: Column) -> Column:
    """Whether a place is a territory: by its switch, its end, and by its island what is known of its state and size.

    main: its size; others: array of other sizes; events: its number of Korean events. Nulls count as false and zero.
    """
    is_on, live, dark = (F.coalesce(c, F.lit(False)) for c in (on, online, unknown))
    size, known = F.coalesce(main, F.lit(0)) > 0, F.coalesce(events, F.lit(0)) > 0
    any_size = size | F.coalesce(F.exists(others, lambda x: F.coalesce(x, F.lit(0)) > 0), F.lit(False))
    by_island = F.when(island == "FORUM", (live & any_size) | (dark & known)).when(island == "TELEGRAM", live & size).otherwise((live & size) | known)
    return is_on & F.when(empty(until) != "", known).otherwise(F.coalesce(by_island, known))


def brief_part(review: Column, korean: Column, reasons: Column, country: Column) -> Column:
    """Where a row stands in the daily brief."""
    sure = empty(korean).isin("직접", "간접") | (empty(review) == "사건 O")
    return F.when(empty(review) == "사건 X", UNRELATED).when(sure, LISTED).when((empty(reasons) == "") & (empty(country) == ""), NO_SIGNAL).otherwise(UNSURE)


def case_part(blocked: Column, done: Column, known: Column, has_text: Column) -> Column:
    """Where a case stands in the queue; the first that holds."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(empty(blocked) != "", BLOCKED).when(yes(F.array_contains(done, LAST_STEP)), DONE).when(yes(known), KNOWN).when(~yes(has_text), TO_OPEN).otherwise(TO_RUN)


def group_addresses(locations: Column, url: Column, mirrors: int = 5) -> Column:
    """struct(main, mirrors): a group's main address and its other ones, each once, joined by dots.

    locations: array of struct(type, available, slug, fqdn). Leak sites are taken before others, and of these the first that is available,
    else the first. A main address must begin with http; without any the group's url stands for it.
    """
    known = F.coalesce(locations, F.array().cast("array<struct<type: string, available: boolean, slug: string, fqdn: string>>"))
    sites = F.filter(known, lambda x: F.upper(empty(x.type)) == "DLS")
    some = F.when(F.size(sites) > 0, sites).otherwise(known)
    up = F.array_position(F.transform(some, lambda x: F.coalesce(x.available, F.lit(False))), True)
    place = F.greatest(up, F.lit(1)).cast("int")
    first = F.get(some, place - 1)
    slug, host = F.trim(empty(first.slug)), F.trim(empty(first.fqdn))
    address = F.when(slug != "", slug).when(host != "", F.concat(F.lit("http://"), host)).otherwise("")
    main = F.when(F.startswith(address, F.lit("http")), address).otherwise("")
    rest = F.filter(some, lambda x, k: k + 1 != place)
    said = F.transform(rest, lambda x: F.trim(F.when(empty(x.slug) != "", x.slug).otherwise(empty(x.fqdn))))
    held = F.array_distinct(F.filter(said, lambda x: x != ""))
    none = (main == "") & (F.size(held) == 0)
    return F.struct(F.when(none, empty(url)).otherwise(main).alias("main"), F.when(none, "").otherwise(F.array_join(F.slice(held, 1, mirrors), " · ")).alias("mirrors"))


def forum_host(url: Column) -> Column:
    """Host (with its port, unless it is the scheme's own) of an http address, in lower case; null for other addresses."""
    address = F.trim(empty(url))
    scheme, host = F.lower(F.regexp_extract(address, r"(?i)^(https?)://([^/?#]+)", 1)), F.lower(F.regexp_extract(address, r"(?i)^(https?)://([^/?#]+)", 2))
    return F.when(host != "", F.regexp_replace(host, F.when(scheme == "https", ":443$").otherwise(":80$"), F.lit("")))


def korean_domains(domains: Column, most: int = 10) -> Column:
    """The first domains that end in kr, in lower case."""
    low = F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.lower(F.trim(empty(d))))
    return F.slice(F.filter(low, lambda d: d.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.kr$")), 1, most)


def names_korea(title: Column) -> Column:
    low = F.lower(empty(title))
    return F.lit(False) if not KOREA_WORDS else F.exists(F.array(*map(F.lit, KOREA_WORDS)), lambda w: F.contains(low, w))
