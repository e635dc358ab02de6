"""Readers of feeds: JSON of two shapes, channel payloads, tagged properties, profile pages and RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions.text import unescaped_html
from saltmarsh.functions.times import snowflake_time

#: Members that may hold a feed's rows if it isn't a list itself.
LISTS = ("victims", "data")
PAYLOAD = "channel struct<id: string, title: string>, messages array<struct<id: long, date: string, text: string, views: long, reply_to_message_id: long>>"
ITEM = "title string, link string, description string, pubDate string"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """body, file: each file as one row."""
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"))


def feed_rows(raw: DataFrame, body: str, fields: dict[str, tuple[str, ...]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each entry of the JSON feeds in body, with fields: each the first of its members that isn't blank.

    A feed is a list, or an object with the list in one of LISTS. Text that isn't JSON, and other shapes, give no rows.
    """
    parsed = F.try_parse_json(body)
    entries = F.coalesce(*[F.try_variant_get(parsed, path, "array<variant>") for path in ("$", *(f"$.{name}" for name in LISTS))])
    rows = raw.select(*keep, F.explode(entries).alias("_entry"))

    def first(names: tuple[str, ...]) -> Column:
        found = [F.try_variant_get("_entry", f"$.{n}", "string") for n in names]
        return F.coalesce(*[F.when(F.trim(v) != "", v) for v in found])

    return rows.select(*keep, *[first(names).alias(column) for column, names in fields.items()])


def channel_messages(raw: DataFrame, body: str) -> DataFrame:
    """channel, and the columns of each message, of channel payloads; those of another shape give no rows."""
    payload = raw.select(F.from_json(body, PAYLOAD, {"mode": "PERMISSIVE"}).alias("p")).where("p.channel.id IS NOT NULL")
    return payload.select(F.col("p.channel.id").alias("channel"), F.inline("p.messages"))


def property_text(value: Column) -> Column:
    """The value of a tagged property (a variant) as text: lists joined by commas, nothing for unknown tags or blanks."""
    tag = F.try_variant_get(value, "$.type", "string")

    def each(path: str, member: str, sep: str) -> Column:
        return F.array_join(F.transform(F.try_variant_get(value, path, "array<variant>"), lambda x: F.try_variant_get(x, member, "string")), sep)

    found = (
        F.when(tag == "title", each("$.title", "$.plain_text", ""))
        .when(tag == "rich_text", each("$.rich_text", "$.plain_text", ""))
        .when(tag == "multi_select", each("$.multi_select", "$.name", ","))
        .when(tag == "people", each("$.people", "$.id", ","))
        .when(tag == "select", F.try_variant_get(value, "$.select.name", "string"))
        .when(tag == "status", F.try_variant_get(value, "$.status.name", "string"))
        .when(tag == "date", F.try_variant_get(value, "$.date.start", "string"))
    )
    plain = {name: F.try_variant_get(value, f"$.{name}", "string") for name in ("checkbox", "number", "url", "email", "phone_number")}
    for name, v in plain.items():
        found = found.when(tag == name, v)
    return F.when(found != "", found)


def profile_posts(pages: DataFrame, account: str, content: str) -> DataFrame:
    """account, number, at, text for each list entry of a profile page that holds the address of one of the account's posts.

    The time comes from the post's number.
    """
    entry = F.explode(F.filter(F.split(F.concat(F.lit("\n"), F.col(content)), r"\n(?=\*\s{1,4})"), lambda e: F.startswith(e, F.lit("*"))))
    entries = pages.select(account, entry.alias("entry"))
    name = F.lower(F.regexp_extract("entry", r"(?i)(?:x|twitter)\.com/(\w+)/status/\d{6,25}", 1))
    number = F.regexp_extract("entry", r"(?i)(?:x|twitter)\.com/\w+/status/(\d{6,25})", 1)
    own = entries.where(name == F.lower(account)).select(account, number.cast("long").alias("number"), F.trim(F.regexp_replace("entry", r"^\*\s+|\(?https?://\S+", "")).alias("text"))
    return own.select(account, "number", snowflake_time(F.col("number")).alias("at"), "text")


def rss(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS files."""
    return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)


def rss_item(text: Column) -> Column:
    """An item's columns from its XML; malformed: nulls."""
    return F.from_xml(text, ITEM)


#: A post of a channel's public page, its parts, and why a page has none (fixed patterns and values).
CHANNEL_POST = r'(?s)<div class="tgme_widget_message[ "].*?(?=<div class="tgme_widget_message[ "]|\z)'
POST_TEXT = r'(?s)<div class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>'
POST_PARTS = {
    "post": r'data-post="([^"]+)"', "at": r'datetime="([^"]+)"', "url": r'class="tgme_widget_message_date"\s+href="([^"]+)"', "views": r'tgme_widget_message_views">([^<]+)<',
    "channel": r'(?s)tgme_widget_message_owner_name[^>]*>.*?<span[^>]*>([^<]{1,60})<',
}
NO_PREVIEW = "미리보기가 꺼져 있다. 이 채널은 공개 미리보기로 못 본다. 실계정 경로(나)가 필요하다"
NO_POSTS = "채널 쪽은 받았는데 글 묶음이 없다. 채널이 비었거나 꼴이 바뀌었다"
NO_CHANNEL = "채널 쪽이 아닌 것을 받았다. 주소를 확인할 것"


def channel_page(pages: DataFrame, page: str, channel: str) -> DataFrame:
    """The columns of pages but page, with place, post, at, url, views, channel_name, text and links of each post of a channel's page; why where there is none.

    A page without posts gives one row, whose why says what it is: the preview is off, the channel is empty, or the page is
    no channel's. Texts are without tags, with line breaks and references resolved; a post without a text has an empty one.
    Null page: no channel's.
    """
    html = F.coalesce(F.col(page), F.lit(""))
    found = F.regexp_extract_all(html, F.lit(CHANNEL_POST), F.lit(0))
    has = lambda part: F.contains(html, F.lit(part))
    why = F.when(F.size(found) > 0, "").when(has("Preview channel") | has("tgme_page_context_link"), NO_PREVIEW).when(has("tgme_page"), NO_POSTS).otherwise(NO_CHANNEL)
    keep = [c for c in pages.columns if c != page]
    rows = pages.select(*keep, why.alias("why"), F.posexplode_outer(found).alias("_place", "_post"))
    one = lambda name: F.trim(F.regexp_extract("_post", POST_PARTS[name], 1))
    raw = F.regexp_extract("_post", POST_TEXT, 1)
    text = F.btrim(unescaped_html(F.regexp_replace(F.regexp_replace(raw, r"<br\s*/?>", "\n"), "<[^>]+>", "")), F.lit(" \t\r\n"))
    name = one("channel")
    return rows.select(
        *keep, "why", (F.col("_place") + 1).alias("place"), one("post").alias("post"), one("at").alias("at"), one("url").alias("url"), one("views").alias("views"),
        F.when(name != "", name).otherwise(F.col(channel)).alias("channel_name"), text.alias("text"), F.regexp_extract_all(raw, F.lit(r'<a href="(https?://[^"]+)"'), F.lit(1)).alias("links"),
    )
