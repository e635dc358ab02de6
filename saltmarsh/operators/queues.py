"""What people look at next: rows to review, rows to show on either axis, notices, answers to prepare, and a panel of what was collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty, once

#: Names of the country, and reasons why a row waits, in the order in which they hold (fixed values).
KOREA = ("한국", "대한민국", "kr", "kor", "korea", "south korea", "republic of korea")
HELD, KOREAN, FORUM, JUDGED = "보류", "국가 한국", "포럼", "전에 판정함"
#: Roles, shapes and lengths of what may be told of an actor (fixed values).
ROLES = ("판매자", "운영자", "해킹 그룹", "재배포", "중개·보증", "랜섬웨어 그룹")
COUNTRY_NAME = r"^[가-힣A-Za-z ]{1,12}$"
HANDLE = r"^[\w\-]{2,32}$"
DAY = r"^\d{4}-\d{2}-\d{2}"
LONGEST_DEALS = 80
PLACEHOLDERS = ("미기입", "-", "—", "없음", "모름", "미확인", "해당 없음")
UNSAFE = r"(?i)[@＠]|\d{11,}|[a-z0-9가-힣_-]+\.[a-z0-9가-힣_-]{2,}|(?<!\d)(?:\d{2,4}[-.–— _]\d{3,4}[-.–— _]\d{4}|\d{6}\s*[-–—]\s*[1-8]\d{6})(?!\d)|[\[({]\s*at\s*[\]})]|_at_|\s+at\s+\S+\s*(?:\.|\bdot\b)"


def review_queue(rows: DataFrame, held: DataFrame, judged: DataFrame, again: bool = False) -> DataFrame:
    """rows not reviewed yet with reason: why a row waits, or null for those to judge today.

    rows: case, review, country, source. held and judged: case. A row's first reason counts. With again, rows judged before are
    judged once more. Counts by reason are a groupBy of the result.
    """
    marked = rows.where(F.col("review") == "미검토")
    for name, table in (("_held", held), ("_judged", judged)):
        marked = marked.join(table.select("case").distinct().withColumn(name, F.lit(True)), "case", "left")
    korean = F.lower(F.trim(empty(F.col("country")))).isin(*KOREA)
    reason = F.when(F.col("_held"), HELD).when(korean, KOREAN).when(F.col("source") == "포럼", FORUM).when(F.col("_judged") & F.lit(not again), JUDGED)
    return marked.withColumn("reason", reason).drop("_held", "_judged")


def on_either_axis(rows: DataFrame, least: int, least_supply: int, most: int) -> DataFrame:
    """The most newest rows whose score reaches least, or whose supply score (none: 0) reaches least_supply.

    Newest by discovered, else published, else first_seen, blanks being like none; ties by uid. The limit is the feature:
    tasks keep their newest rows, and one row a task and place meets in the end.
    """
    newest = F.coalesce(F.nullif("discovered", F.lit("")), F.nullif("published", F.lit("")), F.col("first_seen"))
    wanted = rows.where((F.col("kr_score") >= least) | (F.coalesce("supply_score", F.lit(0)) >= least_supply))
    return wanted.withColumn("newest", newest).orderBy(F.desc_nulls_last("newest"), "uid").limit(most)


def allowed_columns(documents: DataFrame, allowed: DataFrame) -> DataFrame:
    """documents (kind, metadata: a map) with only the metadata that their kind may give, and dropped, the names of the others, sorted.

    allowed: kind, column. A kind without any gives nothing. allowed is a small table that is grouped to one row a kind.
    """
    lists = allowed.groupBy("kind").agg(F.collect_set("column").alias("_may"))
    rows = documents.join(lists, "kind", "left").withColumn("_may", F.coalesce("_may", F.array().cast("array<string>")))
    dropped = F.array_sort(F.filter(F.map_keys("metadata"), lambda k: ~F.array_contains("_may", k)))
    rows = rows.withColumn("dropped", F.coalesce(dropped, F.array().cast("array<string>")))
    return rows.withColumn("metadata", F.map_filter("metadata", lambda k, _: F.array_contains("_may", k))).drop("_may")


def dropped_columns(documents: DataFrame) -> DataFrame:
    """kind, column, n: how many documents lost each column."""
    return documents.select("kind", F.explode("dropped").alias("column")).groupBy("kind", "column").agg(F.count("*").alias("n"))


def actor_info(actors: DataFrame, organisations: Callable[[Column], Column]) -> DataFrame:
    """actor and what may be told of it: roles, countries, first_seen, deals, other_names, and dropped: how many free texts were left out.

    actors: actor, name, roles, countries, first_seen, deals, aliases. organisations: whether a text names an organisation, as a function
    of a column. Roles are those of ROLES, countries have the shape of a name, deals is one short line without an address, a long
    number or an organisation, and other names have the shape of a handle, differ from the name and each other.
    """
    names = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    deals = F.regexp_replace(F.trim(empty(F.col("deals"))), r"\s*\n\s*", " · ")
    said = (deals != "") & ~deals.isin(*PLACEHOLDERS)
    good_deals = said & (F.length(deals) <= LONGEST_DEALS) & ~deals.rlike(UNSAFE) & ~organisations(deals)
    bare = F.transform(names("aliases"), lambda a: F.trim(F.regexp_replace(F.trim(a), "^@+", "")))
    fine = lambda h: h.rlike(HANDLE) & ~h.isin(*PLACEHOLDERS) & ~h.rlike(UNSAFE) & (F.lower(h) != F.lower("name")) & ~organisations(h)
    others = F.array_distinct(F.filter(bare, fine))
    return actors.select(
        "actor",
        F.filter(names("roles"), lambda r: r.isin(*ROLES)).alias("roles"),
        F.filter(names("countries"), lambda c: ~c.isin(*PLACEHOLDERS) & c.rlike(COUNTRY_NAME)).alias("countries"),
        F.when(F.col("first_seen").rlike(DAY), F.substring("first_seen", 1, 10)).alias("first_seen"),
        F.when(good_deals, deals).alias("deals"),
        others.alias("other_names"),
        (F.size(bare) - F.size(others) + (said & ~good_deals).cast("int")).alias("dropped"),
    )


def to_prepare(examples: DataFrame, evidence: DataFrame, answers: DataFrame, tag: str) -> DataFrame:
    """question, state of example questions: empty (no evidence), same (the answer's evidence is unchanged, and it was reviewed or made as now), todo.

    examples: question. evidence: question, hash, a row for each document. answers: question, hashes (array), reviewed, model.
    """
    found = evidence.groupBy("question").agg(F.sort_array(F.collect_set("hash")).alias("_now"))
    held = answers.select("question", F.sort_array(F.array_distinct("hashes")).alias("_was"), (F.coalesce("reviewed", F.lit(False)) | (F.col("model") == tag)).alias("_good"))
    rows = examples.select("question").distinct().join(found, "question", "left").join(held, "question", "left")
    same = F.coalesce((F.col("_now") == F.col("_was")) & F.col("_good"), F.lit(False))
    return rows.select("question", F.when(F.col("_now").isNull(), "empty").when(same, "same").otherwise("todo").alias("state"))


def panel(items: DataFrame, runs: DataFrame, last: int = 20) -> DataFrame:
    """what, name, n, at: rows of each source and when it was last seen (forgotten ones are left out), and the last runs with what was fresh.

    items: source, first_seen, forgotten. runs: run, started, source, fresh. The last runs are a limit that tasks apply first.
    """
    kept = items.where(~F.coalesce("forgotten", F.lit(False)))
    sources = kept.groupBy(F.coalesce("source", F.lit("?")).alias("name")).agg(F.count("*").alias("n"), F.max("first_seen").alias("at"))
    recent = runs.orderBy(F.desc("run")).limit(last).select(F.col("source").alias("name"), F.col("fresh").cast("long").alias("n"), F.col("started").alias("at"))
    return sources.select(F.lit("source").alias("what"), "name", "n", "at").unionByName(recent.select(F.lit("run").alias("what"), "name", "n", "at"))


def notice(row: dict[str, Column], longest: int = 1900, body_chars: int = 700) -> Column:
    """A notice of one row as a message of longest characters: its labelled lines, what is unknown said so, and the beginning of its text."""
    said = lambda name, other: F.when(F.trim(empty(row[name])) != "", row[name]).otherwise(other)
    cut = lambda c, n: F.when(F.length(F.trim(c)) <= n, F.trim(c)).otherwise(F.concat(F.rtrim(F.substring(F.trim(c), 1, n - 1)), F.lit("…")))
    head = F.coalesce(F.nullif(F.trim(empty(row["org"])), F.lit("")), F.nullif(F.trim(empty(row["title"])), F.lit("")), F.lit("(대상 못 읽음)"))
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    body = cut(F.regexp_replace(empty(row["body"]), r"\n{3,}", "\n\n"), body_chars)
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("**"), cut(head, 90), F.lit("**")),
            *[line(label, said(name, other)) for label, name, other in (("Company", "org", "못 봄"), ("Actor", "actor", "못 봄"), ("Type", "kind", "확인 못 함"), ("Posted", "posted_at", "못 봄"))],
            line("Seen", empty(row["first_seen"])),
            line("Venue", empty(row["venue"])),
            F.when(empty(row["url"]) != "", F.concat(F.lit("Original: <"), row["url"], F.lit(">"))),
            F.when(empty(row["country"]) != "", line("Country", row["country"])),
            F.when(body != "", F.concat(F.lit("\n```\n"), body, F.lit("\n```"))),
            F.lit("\n_이 줄은 단서다. 확인한 것이 아니다. 원 게시물을 보기 전에 검증을 시작하지 않는다._"),
        )
    )
    return cut(F.array_join(lines, "\n"), longest)


#: Lines that are no names of companies (fixed pattern).
NOISE = r"(?i)^(home|blog|news|contact|about|faq|leaks?|posts?|search|login|next|prev|page \d+|published|updated|copyright|all rights reserved|\d{1,4}([-/.]\d{1,2}){0,2})$"


def candidate_lines(text: Column, most: int = 800) -> Column:
    """Lines of text that may be names of companies, each once in any case: short, few words, no menu. The limit is the feature."""
    lines = F.transform(F.split(empty(text), "\r\n|\r|\n"), lambda s: F.btrim(s, F.lit(" \t-–—•|·")))
    good = F.filter(lines, lambda s: F.length(s).between(3, 120) & ~s.rlike(NOISE) & (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) <= 12))
    placed = F.array_sort(F.transform(good, lambda s, k: F.struct(F.lower(s).alias("low"), k.alias("k"), s.alias("s"))))  # equal ones beside each other, the first one first
    first = once(placed, lambda p: F.filter(p, lambda e, k: (k == 0) | (F.get(p, k - 1)["low"] != e["low"])))
    return F.slice(F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["k"].alias("k"), e["s"].alias("s")))), lambda e: e["s"]), 1, most)


def keyword_hits(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """file, keyword, label, number: where threads (file, number, line, label) hold keywords, in any case.

    label: the post that a line belongs to; lines before the first have none, and are told as the head. Keywords are a short list
    that people give for one search, so each line is held against all of them where it is read.
    """
    low = F.lower(empty(F.col("line")))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords]))
    return lines.select("file", F.explode(hits).alias("keyword"), F.coalesce("label", F.lit("머리")).alias("label"), "number")
