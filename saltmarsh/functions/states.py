"""A value with how it is known: seen, seen to be absent, blocked, or never looked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four states, and how sure a value is (fixed values).
VALUE, ABSENT, BLOCKED, UNSEEN = "값", "없음", "못 봄", "안 봄"
CONFIRMED, ESTIMATED, UNCONFIRMED = "확인", "추정", "미확인"
FIELDS = ("state", "v", "why", "src", "day", "sure")


def _of(state: Column | str, v=None, why="", src="", day="", sure=CONFIRMED) -> Column:
    values = (state, v, why, src, day, sure)
    return F.struct(*[F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("string"), F.lit(None if n == "v" else "")).alias(n) for n, x in zip(FIELDS, values)])


def seen(v: Column, src: Column | str, day: Column | str, sure: Column | str = CONFIRMED) -> Column:
    """A value that was seen; where v is null or empty there is none, and it counts as never looked for."""
    text = v.cast("string")
    return F.when(text.isNotNull() & (text != ""), _of(VALUE, text, src=src, day=day, sure=sure)).otherwise(unseen())


def absent(src: Column | str, day: Column | str) -> Column:
    """Looked for and not there: the only state that is evidence of absence."""
    return _of(ABSENT, src=src, day=day)


def blocked(why: Column | str, src: Column | str = "", day: Column | str = "") -> Column:
    """Looked for in vain; without a reason it counts as never looked for."""
    reason = why if isinstance(why, Column) else F.lit(why)
    return F.when(F.coalesce(reason, F.lit("")) != "", _of(BLOCKED, why=reason, src=src, day=day)).otherwise(unseen())


def unseen() -> Column:
    return _of(UNSEEN)


def is_valid(value: Column) -> Column:
    """Whether a struct of the six fields may stand: known state and sureness, a value where there must be one, a reason if blocked."""
    known = value["state"].isin(VALUE, ABSENT, BLOCKED, UNSEEN) & F.coalesce(value["sure"], F.lit(CONFIRMED)).isin(CONFIRMED, ESTIMATED, UNCONFIRMED)
    has = lambda n: F.coalesce(value[n], F.lit("")) != ""
    return F.coalesce(known, F.lit(False)) & ((value["state"] != VALUE) | has("v")) & ((value["state"] != BLOCKED) | has("why"))


def is_evidence_of_absence(value: Column) -> Column:
    return F.coalesce(value["state"] == ABSENT, F.lit(False))


def rendered(value: Column) -> Column:
    """One line for people. Null: never looked for."""
    tail = F.array_join(F.filter(F.array(value["src"], value["day"]), lambda x: x.isNotNull() & (x != "")), " · ")
    ended = F.when(tail != "", F.concat(F.lit(" ("), tail, F.lit(")"))).otherwise("")
    day = F.when(F.coalesce(value["day"], F.lit("")) != "", F.concat(F.lit(" · "), value["day"])).otherwise("")
    sure = F.when(value["sure"] != CONFIRMED, F.concat(value["sure"], F.lit(": "))).otherwise("")
    return (
        F.when(value["state"] == VALUE, F.concat(sure, value["v"], ended))
        .when(value["state"] == ABSENT, F.concat(F.lit(ABSENT), ended))
        .when(value["state"] == BLOCKED, F.concat(F.lit(BLOCKED + "("), value["why"], F.lit(")"), day))
        .otherwise(UNSEEN)
    )


def encoded(value: Column) -> Column:
    """JSON of the fields that say something; null for what was never looked for, so that it gets no key."""
    said = lambda n: F.when(F.coalesce(value[n], F.lit("")) != "", value[n]).alias(n)
    v = F.when(value["state"] == VALUE, value["v"]).alias("v")
    sure = F.when((value["state"] == VALUE) & (value["sure"] != CONFIRMED), value["sure"]).alias("sure")
    return F.when(value["state"] != UNSEEN, F.to_json(F.struct(value["state"].alias("state"), v, sure, said("why"), said("src"), said("day"))))


def decoded(text: Column) -> Column:
    """The struct that encoded() wrote; null or broken JSON: never looked for."""
    read = F.from_json(text, "state string, v string, why string, src string, day string, sure string")
    known = read["state"].isNotNull()
    return F.when(known, _of(read["state"], read["v"], read["why"], read["src"], read["day"], F.coalesce(read["sure"], F.lit(CONFIRMED)))).otherwise(unseen())
