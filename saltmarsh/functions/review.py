"""Column functions of review and publication: what a change of review does, what a verdict proposes, states of groups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Review values and confidences (fixed values).
IS_CASE, NO_CASE, OPEN = "사건 O", "사건 X", "미검토"
HIGH, MIDDLE = "높음", "중간"
#: The reason given by a feed's country alone, and the prefix of notes that are no signals (fixed values).
COUNTRY_ONLY, NOTE = "소스 country=KR", "제외어 "
#: Words of titles that tell nothing (fixed values).
TITLE_STOP = ("the", "and", "for", "com", "www", "forum", "forums", "index", "home", "page", "tor", "onion", "mirror", "official")
SEIZED = "압수됨"


def publish(before: Column, after: Column) -> Column:
    """True to publish, false to withdraw, null to leave as it is, when a review goes from before to after.

    Only a row that was open or no case is published; a blank counts as a case already. Withdrawing has no condition.
    """
    return F.when(after.isin(NO_CASE, OPEN), False).when((after == IS_CASE) & before.isin(OPEN, NO_CASE), True)


def proposal(verdict: Column, confidence: Column, refuted: Column, unattended: bool) -> Column:
    """No case, if the verdict says so with enough confidence and was tried and not refuted; else open."""
    enough = confidence == HIGH if unattended else confidence.isin(HIGH, MIDDLE)
    return F.when((verdict == NO_CASE) & enough & ~refuted, NO_CASE).otherwise(OPEN)


def direct(tier: Column) -> Column:
    """Five tiers as two: direct, or not confirmed."""
    return F.when(tier.isin("confirmed", "strong", "likely"), "직접").otherwise("미확인")


def reasons_text(tier: Column, reasons: Column, by_hand: Column, country_note: str, hand_note: str, most: int = 2000) -> Column:
    """Reasons as one text; with a note first if a direct tier rests on the feed's country alone, and last for a row picked by hand."""
    signals = F.filter(reasons, lambda r: ~F.startswith(r, F.lit(NOTE)))
    is_direct = direct(tier) == "직접"
    alone = is_direct & (signals == F.array(F.lit(COUNTRY_ONLY)))
    noted = F.when(alone, F.concat(F.array(F.lit(country_note)), reasons)).when(~is_direct & by_hand, F.concat(reasons, F.array(F.lit(hand_note)))).otherwise(reasons)
    return F.substring(F.array_join(noted, " · "), 1, most)


def size_origin(noted: Column, source: Column) -> Column:
    """Where a size was read: as noted with the row, else by its source; empty if that isn't known either."""
    text, api, own = F.trim(F.coalesce(noted, F.lit(""))), "집계처 API", "원 출처"
    by_source = F.when(F.coalesce(source, F.lit("")) == "", "").when(source == "랜섬웨어", api).otherwise(own)
    return F.when(text == "", by_source).when(F.startswith(text, F.lit("집계처")), api).otherwise(own)


def group_state(locations: Column, fields: list[Column]) -> Column:
    """online if any mirror is, offline if all known ones are; else seized by a title, else by the first telling field, else unknown.

    locations: array of available (boolean), title.
    """
    known = F.filter(F.coalesce(locations, F.array().cast("array<struct<available: boolean, title: string>>")), lambda x: x.available.isNotNull())
    titles = F.coalesce(F.exists(locations, lambda x: F.lower(F.coalesce(x.title, F.lit(""))).rlike("seiz|law enforcement|operation ")), F.lit(False))
    state = F.when(F.size(known) > 0, F.when(F.exists(known, lambda x: x.available), "online").otherwise("offline")).when(titles, SEIZED)

    def of_field(v: Column) -> Column:
        low = F.lower(v)
        return F.when(low.isin("online", "up", "active", "true"), "online").when(low.isin("offline", "down", "inactive", "false"), "offline").when(low.rlike("seiz|takedown"), SEIZED)

    return F.coalesce(state, *[of_field(v) for v in fields], F.lit("미확인"))


def title_words(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9가-힣]{3,})"))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, TITLE_STOP)))


def titles_alike(a: Column, b: Column) -> Column:
    """Two telling words shared, or all of the shorter title's."""
    wa, wb = title_words(a), title_words(b)
    shared = F.size(F.array_intersect(wa, wb))
    return (shared >= 2) | ((shared >= 1) & (shared == F.least(F.size(wa), F.size(wb))))


def evidence_ids(text: Column) -> Column:
    """Ids parted by commas, without blanks, each once, in order; null: none."""
    bare = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), ",")
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


#: What an entry of a link list says when there is none (fixed values).
PLACEHOLDERS = frozenset(["미기입", "-", "—", "없음", "모름", "미확인", "해당 없음"])
_MARK = re.compile(r"[(\[（)\]）\n;,]| · ")


def _entries(text: str | None) -> list[str]:
    out, depth, start = [], 0, 0
    for found in _MARK.finditer(text or ""):
        mark = found.group()
        if mark in "([（":
            depth += 1
        elif mark in ")]）":
            depth = max(0, depth - 1)
        elif mark in "\n;" or depth == 0:
            out.append(text[start : found.start()])
            start, depth = found.end(), 0 if mark == "\n" else depth
    out.append((text or "")[start:])
    return [x for x in map(str.strip, out) if x and x not in PLACEHOLDERS]


@F.pandas_udf(ArrayType(StringType()))
def links(text: pd.Series) -> pd.Series:
    """Entries parted by line ends, semicolons, and commas or middle dots outside brackets, without those that say there is none.

    Brackets nest to any depth and length; one left open ends with its line. Null: no entries.
    """
    return text.map(_entries, na_action=None)


def without_date(text: Column) -> Column:
    """text without the date in brackets at its end."""
    return F.trim(F.regexp_replace(text, r"\s*\(\d{4}-\d{2}-\d{2}\)\s*$", ""))


def without_active(text: Column) -> Column:
    """text without scripts, frames, event attributes and script addresses."""
    for pattern in (r"(?is)<(script|iframe|object|embed|style)\b.*?(</\1\s*>|$)", r"(?i)\son\w+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", r"(?i)javascript:"):
        text = F.regexp_replace(text, pattern, "")
    return text


def channel_name(address: Column) -> Column:
    """The channel's name in lower case, without sign or address; null for invitations and what is no name."""
    bare = F.regexp_replace(F.trim(address), r"(?i)^(?:https?://)?(?:t\.me|telegram\.me)/(?:s/)?|^@", "")
    name = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9_]{3,31})(?:[/?#].*)?$", 1)
    return F.when((name != "") & ~F.lower(name).isin("joinchat", "addlist"), F.lower(name))


def higher_axis(a: Column, b: Column, first: str, second: str) -> Column:
    """The name of the axis with the higher score; the first of equals. Null: lowest."""
    return F.when(F.coalesce(b, F.lit(-1)) > F.coalesce(a, F.lit(-1)), second).otherwise(first)
