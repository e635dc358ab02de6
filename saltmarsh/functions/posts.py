"""Posts of channels read into fields: whole JSON, broken JSON, labelled lines, or text alone; and what they say of a leak."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty

#: Shapes of a post (fixed values).
WHOLE, BROKEN, LABELS, TEXT, NOTHING = "JSON", "JSON(깨짐)", "라벨", "글자만", "빈 글"
CUT_OFF = "중괄호로 시작하는데 닫히지 않았다. 글이 잘렸을 수 있다"
BY_LINES = "JSON 이 깨져 줄 단위로 읽었다"
#: Signs and pictures before a value, a value in brackets, a labelled line, a line of broken JSON, a tag, a link, the messenger's host as a whole (fixed patterns).
LEADING = r"^[\s\x{200d}\x{fe0f}\x{2190}-\x{27bf}\x{2b00}-\x{2bff}\x{1F000}-\x{1FAFF}]+"
WRAPPED = r"^\(([^()]{1,60})\)$"
LABELLED = r"^[•\-*]?\s*([A-Za-z][A-Za-z /_&]{2,30})\s*[:：]\s*(.*)$"
LOOSE = r'(?md)^\s*"([^"\n]{1,40})"\s*:\s*(.+?),?\s*$'
TAG = r"<[^<>]{1,300}>"
LINK = r"https?://\S{6,}"
DOMAIN = r"^[\w-]+(?:\.[\w-]+)+$"
MESSENGER = r"(?i)(?:^|[^\w-])t\.me(?:$|[^\w-])"
KR_DOMAIN = r"(?i)(?<![\w@.-])((?:[a-z0-9-]+\.)+kr)(?![\w-])"
#: A headline that says whose data leaked, what may stand before it, and its subject (fixed patterns).
HEADLINE = (
    r"(?i)^([^\s:：][^:：]{0,60}?)\s+"
    r"(?:(?:customer|customers|user|users|internal|employee|employees|client|clients|patient|patients|member|members|student|students|"
    r"citizen|citizens|personal|account|accounts|company|corporate|business|booking|order|orders)\b.{0,60}?\s+)?"
    r"(?:data|dataset|datasets|database|databases|db|records|credentials|information|info|source code)\b.{0,60}?"
    r"\b(?:allegedly\s+)?(?:leak|leaked|leaks|breach|breached|hacked|exposed|exposes|dumped|"
    r"compromised|stolen|advertised|offered|for sale|on sale|sold|listed)\b"
)
HEADLINE_HEAD = r"(?i)^(?:just in|update|breaking|alert|new)\s*[:：\-]\s*"
HEADLINE_CLAIM = r"(?i)^.{0,40}?\b(?:claims?|claimed|alleges?|says?|reports?)\s+"
#: Defanged forms and what they stand for, in order (fixed values).
DEFANGED = (("[.]", "."), ("(.)", "."), ("[:]", ":"), ("[/]", "/"), ("hxxps://", "https://"), ("hxxp://", "http://"))
#: Fields in the order in which they are asked for (fixed values).
PICK = {
    "org": ("target/title", "victim", "company", "organization", "target"),
    "actor": ("threat actor", "group", "author", "actor"),
    "country": ("country",),
    "size": ("size", "records", "rows", "data size"),
}
TITLE_FIELDS = ("content", "title", "brief summary", "description")
#: Kinds by the field type, then by fields that are all there; whether they are leaks; kinds of items (fixed values).
BY_TYPE = {"data leak": ("유출 알림", True), "ransomware": ("랜섬 피해자", True), "combolist": ("유출 알림", True), "stealer log": ("유출 알림", True)}
BY_FIELDS = (
    ("유출 알림", ("target/title", "threat actor"), True),
    ("랜섬 피해자", ("victim", "group"), True),
    ("CVE 알림", ("cve id", "cvss score"), False),
    ("악성코드 시그니처", ("signature", "file"), False),
)
ITEM_KINDS = {"유출 알림": "확인 못 함", "랜섬 피해자": "랜섬웨어 유출"}
NO_COUNTRY = ("EU", "UN")


def tidy(value: Column) -> Column:
    """value without leading signs and the brackets around all of it."""
    bare = F.btrim(F.regexp_replace(F.btrim(empty(value), F.lit(" \t\r\n")), LEADING, ""), F.lit(" \t\r\n"))
    inner = F.regexp_extract(bare, WRAPPED, 1)
    return F.when(inner != "", F.trim(inner)).otherwise(bare)


def refanged(value: Column) -> Column:
    return reduce(lambda v, pair: F.replace(v, F.lit(pair[0]), F.lit(pair[1])), DEFANGED, F.trim(empty(value)))


def last_wins(entries: Column) -> Column:
    """A map of entries (array of key, value); of equal keys the last one counts."""
    seen = F.transform(entries, lambda e, k: F.struct(e["key"].alias("key"), e["value"].alias("value"), k.alias("at")))
    last = F.filter(seen, lambda e: ~F.exists(entries_after(entries, e["at"]), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def entries_after(entries: Column, at: Column) -> Column:
    return F.slice(entries, at + 2, F.greatest(F.size(entries) - at - 1, F.lit(0)))


def _pairs(text: Column, pattern: str) -> Column:
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(keys.alias("key"), values.alias("value"))


def as_object(text: Column) -> Column:
    """text as one JSON object (map of its fields); null if it is anything else, more than one too."""
    strict = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowNumericLeadingZeros": "false"}
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", strict)
    whole = F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{")) & (F.size(alone) == 1)
    return F.when(whole, F.get(alone, F.lit(0)))


def lower_fields(fields: Column) -> Column:
    """fields with keys in lower case, without nulls; nested values stay JSON."""
    held = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull())
    return last_wins(F.transform(held, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value"))))


def loose_json(text: Column) -> Column:
    """The lines of broken JSON that look like "name": value, without tags; blank values are left out."""

    def bare(v: Column) -> Column:
        v = F.trim(F.rtrim(F.regexp_replace(F.trim(v), ",+$", "")))
        quoted = (F.length(v) > 1) & F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"'))
        return F.trim(F.regexp_replace(F.when(quoted, v.substr(F.lit(2), F.length(v) - 2)).otherwise(v), TAG, ""))

    pairs = F.transform(_pairs(text, LOOSE), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), bare(e["value"]).alias("value")))
    return last_wins(F.filter(pairs, lambda e: e["value"] != ""))


def labels(text: Column) -> Column:
    """The lines that are a name, a colon and a value."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda t: F.btrim(t, F.lit(" \t\r"))), lambda t: t.rlike(LABELLED))
    pairs = F.transform(lines, lambda t: F.struct(F.lower(F.trim(F.regexp_extract(t, LABELLED, 1))).alias("key"), F.trim(F.regexp_extract(t, LABELLED, 2)).alias("value")))
    return last_wins(pairs)


def read_post(text: Column) -> Column:
    """Struct of fields (map), shape and note of a post.

    The widest pair of braces is read as JSON; if it is broken, line by line; then labelled lines; what has none of that
    is text. A post that begins with a brace and has no closing one was cut off, which note says. Null: an empty post.
    """
    said = F.btrim(empty(text), F.lit(" \t\r\n"))
    braces = F.regexp_extract(said, r"(?s)\{.*\}", 0)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    parts = F.struct(as_object(braces).alias("object"), F.when(braces != "", loose_json(braces)).alias("loose"), labels(said).alias("labels"))

    def told(p: Column) -> Column:
        whole = F.size(p["object"]) > 0
        cut = F.when(F.startswith(said, F.lit("{")), CUT_OFF).otherwise("")
        by_labels = F.when(F.size(p["labels"]) > 0, LABELS).otherwise(TEXT)
        broken = (braces != "") & p["object"].isNull()
        by_line = broken & (F.size(p["loose"]) > 0)
        shape = F.when(said == "", NOTHING).when(whole, WHOLE).when(by_line, BROKEN).otherwise(by_labels)
        fields = F.when(said == "", none).when(whole, lower_fields(p["object"])).when(by_line, p["loose"]).otherwise(p["labels"])
        note = F.when((said == "") | whole, "").when(broken, BY_LINES).otherwise(cut)
        return F.struct(fields.alias("fields"), shape.alias("shape"), note.alias("note"))

    return F.element_at(F.transform(F.array(parts), told), 1)


def first_field(fields: Column, names: tuple[str, ...]) -> Column:
    """The first of names that has a value, tidied and refanged; else empty."""
    found = F.filter(F.array(*[F.element_at(fields, n) for n in names]), lambda v: v.isNotNull() & (v != ""))
    return refanged(tidy(F.coalesce(F.get(found, F.lit(0)), F.lit(""))))


def kind_of(fields: Column) -> Column:
    """Struct of kind and ours: whether the post tells of a leak (null: unknown)."""
    own = F.lower(F.trim(F.coalesce(F.element_at(fields, "type"), F.lit(""))))
    out = None
    for key, (kind, ours) in BY_TYPE.items():
        value = F.struct(F.lit(kind).alias("kind"), F.lit(ours).alias("ours"))
        out = F.when(own == key, value) if out is None else out.when(own == key, value)
    for kind, needed, ours in BY_FIELDS:
        out = out.when(reduce(lambda a, b: a & b, [F.map_contains_key(fields, n) for n in needed]), F.struct(F.lit(kind).alias("kind"), F.lit(ours).alias("ours")))
    other = F.when(own != "", F.concat(F.lit("기타("), own, F.lit(")"))).otherwise("기타")
    return out.otherwise(F.struct(other.alias("kind"), F.lit(None).cast("boolean").alias("ours")))


def flag_country(text: Column) -> Column:
    """The country of a flag at the beginning of the first line, as two letters; else empty."""
    head = F.substring(F.split(empty(text), "\n")[0], 1, 16)
    flag = F.regexp_extract(head, r"[\x{1F1E6}-\x{1F1FF}]{2}", 0)
    letters = F.translate(flag, "".join(chr(0x1F1E6 + k) for k in range(26)), "".join(chr(65 + k) for k in range(26)))
    return F.when(letters.isin(*NO_COUNTRY), "").otherwise(letters)


def org_in_text(text: Column) -> Column:
    """Struct of org and how: a Korean domain, else the subject of a headline after a flag; both empty if there is none."""
    domain = F.lower(F.regexp_extract(empty(text), KR_DOMAIN, 1))
    line = F.trim(F.regexp_replace(tidy(F.split(empty(text), "\n")[0]), HEADLINE_HEAD, ""))
    subject = F.btrim(F.regexp_replace(F.regexp_extract(line, HEADLINE, 1), HEADLINE_CLAIM, ""), F.lit(" -–—:,"))
    fits = (flag_country(text) != "") & (subject != "") & (F.size(F.split(subject, r"\s+")) <= 6)
    one = lambda org, how: F.struct(org.alias("org"), F.lit(how).alias("how"))
    return F.when((domain != "") & ~domain.rlike(MESSENGER), one(domain, "본문 한국 도메인")).when(fits, one(subject, "제목(속보 꼴)")).otherwise(one(F.lit(""), ""))


def origin(links: Column, text: Column, fields: Column) -> Column:
    """Where the post has it from: a link that isn't to a channel, then the field source, then a link in the text."""
    outer = refanged(F.get(F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda u: ~u.rlike(MESSENGER)), F.lit(0)))
    source = refanged(F.element_at(fields, "source"))
    found = F.regexp_extract(empty(text), LINK, 0)
    in_text = F.when((found != "") & ~found.rlike(MESSENGER), refanged(F.regexp_replace(found, r"""['").,。]+$""", ""))).otherwise("")
    return F.when(outer != "", outer).when(F.startswith(source, F.lit("http")), source).otherwise(in_text)


def title(text: Column, fields: Column, shape: Column) -> Column:
    """A summary field of JSON, then the organisation, then the first line; 120 letters of it."""
    summary = F.when(F.startswith(shape, F.lit("JSON")), first_field(fields, TITLE_FIELDS)).otherwise("")
    org = first_field(fields, PICK["org"])
    return F.substring(F.when(summary != "", summary).when(org != "", org).otherwise(F.split(empty(text), "\n")[0]), 1, 120)
