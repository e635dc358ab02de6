"""What tools and people write down: labelled values with lines that go on, cells filled where they are blank, kinds of descriptions, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.posts import last_wins
from saltmarsh.functions.text import empty

#: A labelled line, and the lines that go on with its value: blank ones, and those four or more blanks in (fixed pattern).
ENTRY = r"(?m)^ {0,3}(?![ \t]*(?:[#*\[■|\-]|```))([^:\n]{1,30}?)[ \t]*:[^\n]*(?:\n(?:[ \t]*(?=\n|\z)| {4,}(?!(?:[#*\[■|]|```))\S[^\n]*))*"
LABEL = r"(?s)^ {0,3}([^:\n]{1,30}?)\s*:\s*(.*)$"
#: Marks of a value that was not seen, of texts that machines wrote, and of what posts say (fixed patterns).
MISSED = "못 봄"
BY_MACHINE = r"(?i)^\s*\[ai[ -]generated\]"
POST_LIKE = (
    r"(?i)\b(we\s+(have|possess|own|got|obtained|leaked|published)|all\s+(the\s+)?(data|customer|client|files)|has\s+been\s+(hacked|breached|compromised)"
    r"|data\s+(is\s+)?(for\s+sale|leaked|published)|sell(ing)?\b[^.]{0,60}\b(database|data|dump)|\bdumps?\b|\bfor\s+sale\b|\b(lines|rows|records)\s*[:=]"
    r"|\d[\d,.]*\s*(k|m|gb|tb)?\s*(rows?|records?|lines?|users?|clients?)\b|download|torrent|magnet)"
)


def labelled(text: Column, mark: str | None = None) -> Column:
    """A map of label to value of text, before mark if one is given.

    A value goes on over lines that begin with four blanks or more, and over blank ones; a line of another kind ends it.
    A remark in brackets after two blanks goes. Headings, lists, tables and fences are no labels; of equal labels
    the last counts; blank values are left out.
    """
    body = F.split(empty(text), mark)[0] if mark else empty(text)
    entries = F.regexp_extract_all(F.regexp_replace(body, r"[ \t]+(?=\n|\z)", ""), F.lit(ENTRY), F.lit(0))

    def read(entry: Column) -> Column:
        lines = F.split(entry, "\n")
        first = F.regexp_replace(F.trim(F.regexp_extract(lines[0], LABEL, 2)), r"\s{2,}\(.*\)$", "")
        value = F.array_join(F.concat(F.array(first), F.transform(F.slice(lines, 2, 1 << 30), lambda s: F.btrim(s, F.lit(" \t")))), "\n")
        return F.struct(F.trim(F.regexp_extract(lines[0], LABEL, 1)).alias("key"), F.btrim(value, F.lit(" \n\t")).alias("value"))

    whole = last_wins(F.filter(F.transform(entries, read), lambda e: e["key"] != ""))
    return F.map_filter(whole, lambda _, v: v != "")


def seated(held: Column, found: Column) -> Column:
    """Struct of cells (map), filled and clashes (sorted names): found's values in held's cells where those are blank or not seen.

    What held has stays; where found has another value, its name is a clash. Blank values of found are like none.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    have, more = F.coalesce(held, none), F.map_filter(F.coalesce(found, none), lambda _, v: F.coalesce(v, F.lit("")) != "")
    free = lambda k: (F.coalesce(F.element_at(have, k), F.lit("")) == "") | F.startswith(F.coalesce(F.element_at(have, k), F.lit("")), F.lit(MISSED))
    put = F.map_filter(more, lambda k, _: free(k))
    clash = F.filter(F.map_keys(more), lambda k: ~free(k) & (F.trim(F.element_at(have, k)) != F.trim(F.element_at(more, k))))
    kept = F.map_filter(have, lambda k, _: ~F.map_contains_key(put, k))
    return F.struct(F.map_concat(kept, put).alias("cells"), F.array_sort(F.map_keys(put)).alias("filled"), F.array_sort(clash).alias("clashes"))


def description_kind(text: Column) -> Column:
    """What a description holds: nothing, a dash, a machine's words, those of a post, or a company's."""
    t = F.trim(empty(text))
    return (
        F.when(t == "", "빈칸")
        .when(F.upper(t).isin("N/A", "NA", "-", "NONE"), "N/A")
        .when(t.rlike(BY_MACHINE), "회사 소개(AI 가 지음)")
        .when(t.rlike(POST_LIKE), "게시글 문장")
        .otherwise("회사 소개로 보임")
    )


def day_bounds(first: Column, last: Column, zone: str) -> Column:
    """Struct of start and end: the first and the last moment of days in a time zone, as UTC; null where no day is given."""
    start = F.to_utc_timestamp(first.cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(last, 1).cast("timestamp"), zone) - F.expr("INTERVAL 1 MICROSECOND")
    return F.struct(start.alias("start"), end.alias("end"))


def found_day(raw: Column, names: tuple[str, ...] = ("발견일", "discovered"), zone: str = "Asia/Seoul") -> Column:
    """The day in zone on which a feed's raw JSON says it was found, by the first of names that has a value; a day without a time stays."""
    said = F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, f"$['{n}']")), F.lit("")) for n in names])
    moment = F.try_to_timestamp(F.regexp_replace(said, " UTC$", "Z"))
    local = F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd")
    return F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}$"), said).otherwise(local)
