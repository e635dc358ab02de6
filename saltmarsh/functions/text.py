"""Text keys, addresses, masking and counts, as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HANGUL = r"[가-힣ᄀ-ᇿ㄰-㆏]"


def empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: Characters that the compatibility form leaves as they are, whatever stands beside them (fixed ranges).
STABLE = r"^[\x00-\x7f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0430-\u044f\u0410-\u042f\u2013\u2014\u2018-\u201e\u2022\u3001\u3002\u3041-\u3093\u4e00-\u9fff]*+$"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescaped_html(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form, which no built-in function gives; texts that it leaves as they are do not go to Python."""
    return F.coalesce(_nfkc(F.when(~text.rlike(STABLE), text)), text)


def unescaped_html(text: Column) -> Column:
    """text without character references; only texts that hold any go to Python."""
    return F.coalesce(_unescaped_html(F.when(F.contains(text, F.lit("&")), text)), text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use has it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def name_key(text: Column) -> Column:
    """Compatibility form, lower case, trimmed."""
    return F.trim(F.lower(nfkc(empty(text))))


def bare_key(text: Column) -> Column:
    """Lower case with only letters, digits and Hangul left."""
    return F.regexp_replace(F.lower(empty(text)), "[^0-9a-z가-힣]", "")


def handle_key(text: Column) -> Column:
    """bare_key() with the digit zero as the letter o, as look-alike handles write it."""
    return F.translate(bare_key(text), "0", "o")


#: Spellings of one group (fixed values).
GROUP_ALIASES = {
    "lockbit2": "lockbit", "lockbit3": "lockbit", "lockbit30": "lockbit", "lockbit4": "lockbit", "lockbit5": "lockbit",
    "alphv": "blackcat", "alphvblackcat": "blackcat",
    "clop": "cl0p", "cl0pleaks": "cl0p",
    "blackbasta": "basta",
}


def group_key(text: Column) -> Column:
    key = bare_key(text)
    table = F.create_map(*[F.lit(x) for pair in GROUP_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, key), key)


#: Names of the two Koreas as sources write them (fixed values).
COUNTRIES = {
    "kr": "KR", "kor": "KR", "korea": "KR", "korea, south": "KR", "korea (south)": "KR", "south korea": "KR",
    "republic of korea": "KR", "the republic of korea": "KR", "한국": "KR", "대한민국": "KR",
    "kp": "KP", "prk": "KP", "dprk": "KP", "korea, north": "KP", "korea (north)": "KP", "north korea": "KP",
    "democratic people's republic of korea": "KP", "북한": "KP", "조선민주주의인민공화국": "KP",
}


def country(text: Column) -> Column:
    """KR or KP for names of the Koreas, any other name in upper case, empty for none."""
    name = F.trim(F.regexp_replace(empty(text), r"\s+", " "))
    name = F.regexp_replace(name, r"^[ .]+|[ .]+$", "")
    table = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(name)), F.upper(name))


DOMAIN = r"\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})\b"


def domain(url: Column) -> Column:
    """The host name in url without www, empty if there is none."""
    rest = F.regexp_replace(F.lower(empty(url)), "^[a-z]+://", "")
    rest = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":.*$", "")
    return F.regexp_replace(F.regexp_extract(rest, DOMAIN, 1), r"^www\.", "")


def domain_suffixes(name: Column) -> Column:
    """name and each domain above it: a.b.c, b.c, c. Equal to one of them means equal to it or below it."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(empty(text), F.lit(r"https?://[^\s<>\"']+"), 0))


def defanged_url(url: Column) -> Column:
    """url made harmless: hxxp for http, [:] after any other scheme, [.] for dots."""
    u = F.trim(empty(url))
    web = u.rlike("(?i)^https?://")
    named = F.regexp_replace(F.regexp_replace(u, "(?i)^https://", "hxxps://"), "(?i)^http://", "hxxp://")
    other = F.regexp_replace(u, r"(?i)^([a-z][a-z0-9+.\-]{0,20}):", "$1[:]")
    return F.replace(F.when(web, named).otherwise(other), F.lit("."), F.lit("[.]"))


def refanged(text: Column) -> Column:
    """The inverse for the usual spellings."""
    out = F.trim(empty(text))
    for a, b in (("[.]", "."), ("(.)", "."), ("[dot]", "."), ("[:]", ":"), ("hxxps://", "https://"), ("hxxp://", "http://")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DIRECTION = r"[\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200e}\x{200f}\x{61c}]"


def sanitized(text: Column, most: int = 2000) -> Column:
    """Plain text: tags and entities gone, also those hidden in entities, no control or direction characters, compatibility form, most characters."""
    tag = r"<[^>]{0,400}?>"
    out = F.regexp_replace(unescaped_html(F.regexp_replace(empty(text), tag, " ")), tag, " ")
    out = nfkc(F.regexp_replace(F.regexp_replace(out, CONTROL, ""), DIRECTION, ""))
    out = F.trim(F.regexp_replace(out, r"[ \t\x{a0}]{2,}", " "))
    return F.when(F.length(out) > most, F.concat(F.rtrim(F.substring(out, 1, most)), F.lit("…"))).otherwise(out)


#: Shapes of personal data in the order in which they are masked, with their labels (fixed values).
PERSONAL = (
    ("[이메일]", r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("[주민등록번호]", r"(?<![0-9])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\s\-]?[1-8]\d{6}(?![0-9])"),
    ("[카드번호]", r"(?<![0-9])\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{3,4}(?![0-9])"),
    ("[전화번호]", r"(?<![0-9])(?:\+?82[\s\-]?1[016789]|01[016789])[\s\-.]?\d{3,4}[\s\-.]?\d{4}(?![0-9])"),
    ("[전화번호]", r"(?<![0-9])(?:\+?82[\s\-]?|0)(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4]|70)[\s\-.]\d{3,4}[\s\-.]\d{4}(?![0-9])"),
    ("[IP]", r"(?<![0-9])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![0-9])"),
    ("[IP]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("[계좌번호]", r"(?<![0-9])(?!(?:19|20)\d{2}-\d{1,2}-\d{1,2}(?![0-9]))\d{2,6}-\d{2,6}-\d{2,8}(?:-\d{1,3})?(?![0-9])"),
    ("[계좌번호]", r"(?<=계좌)(?:\s*번호)?\s*[:：]?\s*\d{10,14}(?![0-9])"),
)


def personal_masked(text: Column) -> Column:
    """Struct of masked, text with personal data replaced by labels, and labels, which ones in order, each once.

    Each shape is looked for once, in what the ones before it left. Null text: null masked, no labels.
    """
    shapes = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(pattern).alias("pattern")) for label, pattern in PERSONAL])
    start = F.struct(text.alias("masked"), F.array().cast("array<string>").alias("labels"))

    def step(so_far: Column, shape: Column) -> Column:
        left = F.struct(F.regexp_replace(so_far["masked"], shape["pattern"], shape["label"]).alias("masked"), so_far["masked"].alias("was"), so_far["labels"].alias("labels"))
        return F.element_at(
            F.transform(F.array(left), lambda x: F.struct(x["masked"].alias("masked"), F.when(x["masked"] != x["was"], F.array_union(x["labels"], F.array(shape["label"]))).otherwise(x["labels"]).alias("labels"))),
            1,
        )

    return F.aggregate(shapes, start, step)


def masked(text: Column) -> Column:
    """text with personal data replaced by labels."""
    for label, pattern in PERSONAL:
        text = F.regexp_replace(text, pattern, label)
    return text


def personal_labels(text: Column) -> Column:
    """The labels of what masked() would replace, in order, each once."""
    return personal_masked(text)["labels"]


#: Shapes of addresses, and what stands in for them (fixed values).
ADDRESSES = (r"(?i)(?:https?|hxxps?|ftp)://\S+", r"(?i)\bt\.me/\S+", r"(?i)\b[a-z2-7]{56}\b(?:\s*[.\[\]]*\s*onio\W?n\b)?", r"(?i)\b[a-z0-9.-]+\.onion\b")
ADDRESS_MASK = "(주소 가림)"


def masked_addresses(text: Column) -> Column:
    """text with addresses and links replaced; several in a row become one."""
    for pattern in ADDRESSES:
        text = F.regexp_replace(text, pattern, ADDRESS_MASK)
    return F.trim(F.regexp_replace(text, rf"(?:{re.escape(ADDRESS_MASK)}[\s,·/]*){{2,}}", ADDRESS_MASK + " "))


def particle(word: Column, with_final: str, without: str) -> Column:
    """The particle that follows word: Hangul syllables with a final consonant take with_final, all else without."""
    code = F.ascii(F.right(word, F.lit(1)))
    return F.when((code >= 44032) & (code <= 55203) & ((code - 44032) % 28 != 0), with_final).otherwise(without)


def escaped_markdown(text: Column) -> Column:
    return F.regexp_replace(empty(text), r"([\\`*_{}\[\]()#+\-.!|>~])", r"\\$1")


HIDDEN = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}]"


def hidden_count(text: Column) -> Column:
    """How many invisible or direction characters text has."""
    return F.regexp_count(empty(text), F.lit(HIDDEN))


def script_shares(text: Column) -> Column:
    """Letters of each script in text, as a struct of counts."""
    count = lambda pattern: F.regexp_count(empty(text), F.lit(pattern)).cast("long")
    return F.struct(
        count("[가-힣]").alias("ko"), count("[A-Za-z]").alias("latin"), count(r"[\x{400}-\x{4ff}]").alias("ru"), count(r"[\x{4e00}-\x{9fff}]").alias("zh"), count(r"[\x{3040}-\x{30ff}]").alias("ja")
    )


def case_ids(text: Column) -> Column:
    """LEAK-n and INC-n numbers in text, in order, each once, in upper case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(empty(text), F.lit(r"(?i)\b((?:LEAK|INC)-\d+)\b"), 1), lambda x: F.upper(x)))


def mentions(text: Column) -> Column:
    """Links, onion hosts and channel addresses in text, sorted, each once."""
    find = lambda pattern: F.regexp_extract_all(empty(text), F.lit(pattern), 0)
    return F.array_sort(F.array_distinct(F.concat(find(r"https?://[^\s<>\"']+"), find(r"\b[a-z2-7]{16,56}\.onion\b"), find(r"\bt\.me/[A-Za-z0-9_]+"))))


def checksum_ok(digits: Column) -> Column:
    """Whether thirteen digits have the check digit of a resident number."""
    weights = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
    clean = F.regexp_replace(empty(digits), r"[^0-9]", "")
    total = sum((F.substring(clean, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))
    return F.when(F.length(clean) == 13, (11 - total % 11) % 10 == F.substring(clean, 13, 1).cast("int")).otherwise(False)
