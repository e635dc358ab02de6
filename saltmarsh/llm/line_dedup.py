"""Line deduplication by how frequent a line is within its site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.shared import SPACE, shared_apart, written

#: What ends a line of a page when its markup is dropped (fixed list of block elements).
BLOCKS = "address|article|aside|blockquote|body|br|button|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|th|thead|title|tr|ul"
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = rf"(?i)</?(?:{BLOCKS})\b[^>]*>"
TAG = r"<[/!a-zA-Z][^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def page_lines(html: Column) -> Column:
    """The lines of text in html: markup dropped, white space collapsed, no empty lines."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " ")
    bare = F.regexp_replace(F.regexp_replace(bare, SPACE, " "), BLOCK, "\n")
    bare = F.regexp_replace(bare, TAG, "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    """The host of url in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def drop_site_lines(
    rows: DataFrame,
    key: str,
    host: Column,
    lines: Column,
    max_ratio: float = 0.3,
) -> DataFrame:
    """key, host, text, n_lines, n_dropped for each row: lines frequent within their host are dropped.

    A line is boilerplate if the pages of a host that contain it, over all pages of that host, exceed
    max_ratio, and if it is on two pages at least (a line of one page repeats nothing).

    Pages are parsed once and written as lines. Those are shuffled as two 64-bit hashes; pages per line and per
    host are combined before their shuffle. Hosts with a large share of all pages, and lines with a large share of
    all lines, are few and are joined by broadcast; all others by shuffle. So no host or line stays in one task,
    whatever its share. Only the hashes of a page's dropped lines return to it.

    Null or empty lines: empty text. Null host: pages without a host form one site named "". Null or
    repeated keys: every row counts as a page and has its own result. Empty table: empty result.
    Other columns are ignored.
    """
    parsed = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("lines"),
    )
    pages = written(parsed, "line-pages")
    both = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"))
    marks = pages.select("row", "host", F.explode(F.array_distinct(F.transform("lines", both))).alias("h"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counted = marks.groupBy("host", "h").agg(F.count("*").alias("with_line"))
    often = shared_apart(counted.where("with_line > 1"), totals, ["host"], "pages", pages.count(), "inner")
    often = written(often.where(F.col("with_line") > max_ratio * F.col("pages")).select("host", "h", "with_line"), "line-often")
    # A line on over a share of all pages counts as large: its share of all lines is less, as pages have several.
    hits = shared_apart(marks, often, ["host", "h"], "with_line", pages.count(), "left_semi")
    dropped = hits.groupBy("row").agg(F.collect_list("h").alias("dropped"))
    found = pages.join(dropped, "row", "left")
    none = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
    left = F.filter("lines", lambda x: ~F.array_contains(F.coalesce(F.col("dropped"), none), both(x)))
    return found.select(
        F.col("key").alias(key),
        "host",
        F.array_join(left, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(left)).cast("long").alias("n_dropped"),
    )
