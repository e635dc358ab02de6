"""Column functions of single values: rounding, keyed fingerprints, cells of a hexagonal grid, counts, identifiers, names of places."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty, nfkc, once

#: What is left of a name for comparison (fixed value).
DROPPED = "[^0-9a-z가-힣ぁ-んァ-ヶ一-龥а-яё]+"
#: Hosts of channels' addresses (fixed values).
CHANNEL_HOSTS = r"^(?:www\.)?(?:t\.me|telegram\.me)$"
#: Natures of posts that are worth a case (fixed values).
CASE_KINDS = ("랜섬웨어 유출", "DB 판매", "DB 무료 공개", "접근 권한 판매", "사기 의심", "기타", "확인 못 함")


def rounded(number: Column, digits: int = 0) -> Column:
    """number to digits decimals, half away from zero on its shortest decimal form, as spreadsheets do."""
    return F.round(number, digits)


def fingerprint(text: Column, key: str) -> Column:
    """HMAC-SHA-256 of text under key, in hex; null for an empty or null text, and without a key.

    Made of two digests over the padded key, so it stays an expression of the JVM.
    """
    if not key:
        return F.lit(None).cast("string")
    raw = key.encode()
    padded = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ mask for b in padded)) for mask in (0x36, 0x5C))
    return F.when(text != "", F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256))


def name_only(text: Column) -> Column:
    """Compatibility form in lower case, only letters and digits left."""
    return F.regexp_replace(F.lower(nfkc(empty(text))), DROPPED, "")


def word_fingerprints(names: Column, key: str, least: int = 2) -> Column:
    """Fingerprints of names (array, each name_only()) and of two and three neighbours joined, of least characters, each once, in order.

    Names that are empty are left out before neighbours are joined. Null: none.
    """
    held = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "")

    def joined(held: Column, n: int) -> Column:
        grams = F.transform(held, lambda first, k: F.array_join(F.slice(held, k + 1, n), ""))
        return F.slice(grams, 1, F.greatest(F.size(held) - n + 1, F.lit(0)))

    grams = once(held, lambda h: F.concat(h, joined(h, 2), joined(h, 3)))
    return F.transform(F.array_distinct(F.filter(grams, lambda g: F.length(g) >= least)), lambda g: fingerprint(g, key))


def cell_center(col: Column, row: Column, size: float) -> Column:
    """struct(x, y): the middle of a cell; odd rows are moved right by half a cell."""
    odd = row.bitwiseAND(F.lit(1))
    return F.struct((F.lit(size * 3**0.5) * (col + 0.5 * odd)).alias("x"), (F.lit(size * 1.5) * row).alias("y"))


def cell_at(x: Column, y: Column, size: float) -> Column:
    """struct(col, row): the cell whose middle is nearest to a point.

    The point's two axial coordinates and the third, which makes their sum zero, are rounded; the one that moved most is
    taken from the other two.
    """
    nearest = lambda v: F.floor(v + 0.5)
    q, r = (x * (3**0.5 / 3) - y / 3) / size, y * (2 / 3) / size
    s = -q - r
    dq, dr, ds = (F.abs(nearest(v) - v) for v in (q, r, s))
    first = (dq > dr) & (dq > ds)
    row = F.when(~first & (dr > ds), -nearest(q) - nearest(s)).otherwise(nearest(r))
    axial = F.when(first, -nearest(r) - nearest(s)).otherwise(nearest(q))
    return F.struct((axial + F.shiftright(row - row.bitwiseAND(F.lit(1)), 1)).cast("long").alias("col"), row.cast("long").alias("row"))


def grid_size(total: Column, fill: float = 0.6, aspect: float = 1.7) -> Column:
    """struct(cols, rows): a grid with room for total cells when only fill of it is taken, aspect times as many columns as square."""
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(total / fill * aspect)))
    rows = F.greatest(F.lit(1), F.ceil(total / fill / cols) + 2)
    some = total > 0
    return F.struct(F.when(some, cols).otherwise(1).cast("long").alias("cols"), F.when(some, rows).otherwise(1).cast("long").alias("rows"))


def approximate_number(text: Column) -> Column:
    """struct(number, approximate): 8,120 is exact, 8.1K and 2M stand for more digits; of other texts all digits. Null: no digit, or more points than one."""
    bare = F.regexp_replace(empty(text), r"[\s,]", "")
    part, unit = F.regexp_extract(bare, r"^([0-9.]+)([KMkm]?)$", 1), F.upper(F.regexp_extract(bare, r"^([0-9.]+)([KMkm]?)$", 2))
    digits = F.regexp_replace(bare, "[^0-9]", "")
    value = F.when(part.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), part.try_cast("double"))
    times = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).otherwise(1)
    number = F.when(part != "", F.floor(value * times)).otherwise(digits.try_cast("long"))
    return F.struct(number.cast("long").alias("number"), ((unit != "") & number.isNotNull()).alias("approximate"))


def channel_identifier(text: Column) -> Column:
    """The name that an address, @name or name tells, in lower case; null for other hosts and what is no name."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(empty(text))), "hxxp(s?)://", "http$1://"), "^@", "")
    address = F.when(low.rlike(r"^(t\.me|telegram\.me)/"), F.concat(F.lit("https://"), low)).otherwise(low)
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://[^/?#]*/*([^/?#]*)", 1)
    name = F.when(host.rlike(CHANNEL_HOSTS), path).when(host != "", "").otherwise(F.regexp_extract(address, "^([^?#]*)", 1))
    bare = F.regexp_replace(name, "^[/@ ]+|[/@ ]+$", "")
    return F.when(bare.rlike("^[a-z0-9_]{4,}$"), bare)


def channel_number(text: Column) -> Column:
    """A channel's number without sign, blanks, leading zeros and the prefix 100 of long ones; null if it is none."""
    bare = F.replace(F.trim(empty(text)), F.lit(" "))
    digits = F.regexp_extract(bare, "^-*([0-9]+)$", 1)
    short = F.when(F.startswith(digits, F.lit("100")) & (F.length(digits) > 10), F.substring(digits, 4, 1 << 30)).otherwise(digits)
    plain = F.regexp_replace(short, "^0+", "")
    return F.when(bare.rlike("^-?[0-9]+$"), F.when(plain == "", "0").otherwise(plain))


def same_channel(old_number: Column, old_name: Column, number: Column, name: Column) -> Column:
    """Whether a new result may be merged into an old one: by numbers where both have one; by names where the old one has no number."""
    a, b = F.lower(empty(old_name)), F.lower(empty(name))
    other_number = F.coalesce(old_number != number, F.lit(False))
    return ~(other_number | (old_number.isNull() & (a != "") & (b != "") & (a != b)))


def end_day(text: Column) -> Column:
    """The day that a text begins with; null if it begins otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10))


def unique_id(prefix: Column, number: Column) -> Column:
    """prefix-number, or the number alone; null without a number."""
    return F.when(number.isNotNull(), F.concat(F.when(empty(prefix) != "", F.concat(prefix, F.lit("-"))).otherwise(""), number.cast("string")))


def place_keys(text: Column, endings: tuple[str, ...]) -> Column:
    """Parts of the hosts that a text names, without endings of domains, and the text's letters and digits; of 3 to 24 characters."""
    low = F.lower(F.trim(empty(text)))
    parts = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)+)")), lambda h: F.split(h, r"\.")))
    known = F.array(*map(F.lit, endings))
    hosts = F.filter(parts, lambda p: ~F.array_contains(known, p))
    keys = F.concat(hosts, F.array(F.regexp_replace(low, "[^0-9a-z가-힣]+", "")))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k).between(3, 24)))


def same_place(a: Column, b: Column, endings: tuple[str, ...]) -> Column:
    """Whether two texts share a key of a place; null if one has none."""
    x, y = place_keys(a, endings), place_keys(b, endings)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y))


def worth_a_case(kind: Column, has_source: Column) -> Column:
    """Whether a row goes to the queue of cases: by its nature, where its source has natures; else always."""
    return ~has_source | F.coalesce(kind, F.lit("")).isin(*CASE_KINDS)


def title_wanted(title: Column, included: tuple[str, ...], excluded: tuple[str, ...]) -> Column:
    """Whether title has an included term and no excluded one, with no Latin letter or digit beside it.

    A term that begins with a point, as an ending of domains, may follow letters.
    """
    def pattern(terms: tuple[str, ...]) -> str:
        return "(?i)" + ("|".join(("" if t.startswith(".") else "(?<![a-z0-9])") + "\\Q" + t + "\\E(?![a-z0-9])" for t in terms) or "(?!)")

    return ~empty(title).rlike(pattern(excluded)) & empty(title).rlike(pattern(included))


def question_keys(name: Column) -> Column:
    """Keys that a row's name in a question may mean: the whole, without its bracket, and the number of a case."""
    case = F.regexp_extract(empty(name), r"(?i)\b(LEAK|INC)-?(\d+)\b", 1)
    number = F.concat(F.lower(case), F.lit("-"), F.regexp_extract(empty(name), r"(?i)\b(LEAK|INC)-?(\d+)\b", 2))
    keys = F.array(name_only(name), name_only(F.regexp_replace(empty(name), r"\s*[(（].*$", "")), F.when(case != "", number).otherwise(""))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))
