"""Matching of rows to registries by keys, names, domains and terms, always as joins on equal keys."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.text import domain_suffixes


def new_rows(rows: DataFrame, known: DataFrame, order: Column) -> DataFrame:
    """Rows whose uid and whose key are both unknown, one for each key: uid, key and all columns.

    Two anti joins, one for each key, instead of a join on either, which could not be shuffled by a key.
    """
    left = rows.join(known.select("uid").distinct(), "uid", "left_anti")
    left = left.join(known.select("key").where("key IS NOT NULL").distinct(), "key", "left_anti")
    first = left.groupBy("key").agg(F.min_by(F.struct(*[c for c in left.columns if c != "key"]), order).alias("r"))
    return first.select("key", "r.*")


def unique_keys(registry: DataFrame, keys: list[Column]) -> list[DataFrame]:
    """For each key, key and id of registry rows that alone have it."""
    out = []
    for key in keys:
        per = registry.select(F.explode(key).alias("key"), "id").where("key IS NOT NULL AND key <> ''")
        out.append(per.groupBy("key").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1").select("key", "id"))
    return out


def cascade(rows: DataFrame, row_keys: list[Column], registry: DataFrame, registry_keys: list[Column]) -> DataFrame:
    """rows with match and level: the registry row that the first level with a hit gives; a level on which several have the key gives none.

    row_keys has a column for each level, registry_keys an array column for each.
    """
    matched = rows
    for level, (key, table) in enumerate(zip(row_keys, unique_keys(registry, registry_keys), strict=True)):
        found = table.select(F.col("key").alias(f"_k{level}"), F.col("id").alias(f"_m{level}"))
        matched = matched.join(found, key == F.col(f"_k{level}"), "left")
    levels = range(len(row_keys))
    match = F.coalesce(*[F.col(f"_m{k}") for k in levels])
    level = F.coalesce(*[F.when(F.col(f"_m{k}").isNotNull(), F.lit(k)) for k in levels])
    return matched.select(*[rows[c] for c in rows.columns], match.alias("match"), level.alias("level"))


def first_registered(registry: DataFrame, key: Column, order: Column) -> DataFrame:
    """key and id of the registry row that came first with it."""
    return registry.where(key != "").groupBy(key.alias("key")).agg(F.min_by("id", order).alias("id"))


def options(rows: DataFrame, key: Column, choices: DataFrame, choice_key: Column, floor: int = 4) -> DataFrame:
    """rows with choice: the option with the same key; keys shorter than floor match only options of the same spelling."""
    table = choices.groupBy(choice_key.alias("_key")).agg(F.min("choice").alias("choice"))
    joined = rows.withColumn("_k", key).join(table, F.col("_k") == F.col("_key"), "left")
    usable = (F.length("_k") >= floor) | (F.col("choice") == F.col("name"))
    return joined.withColumn("choice", F.when(usable, F.col("choice"))).drop("_k", "_key")


def unknown_handles(seen: DataFrame, known: DataFrame) -> DataFrame:
    """key, handle, n of handles that no registry row and none of its aliases has; handle is the most common spelling, the first by name on ties.

    seen: handle, key. known: key.
    """
    spelled = seen.join(known.select("key").distinct(), "key", "left_anti").groupBy("key", "handle").agg(F.count("*").alias("n"))
    return spelled.groupBy("key").agg(F.min_by("handle", F.struct((-F.col("n")).alias("m"), "handle")).alias("handle"), F.sum("n").alias("n"))


def first_case(verified: DataFrame, collected: DataFrame) -> DataFrame:
    """verified rows (id, cases) with the first of their cases that is collected, and how many are."""
    linked = verified.select("id", F.posexplode("cases").alias("at", "case")).join(collected, "case").groupBy("id").agg(F.min_by("case", "at").alias("first_case"), F.count("*").alias("n_cases"))
    return verified.join(linked, "id", "left").select("id", "first_case", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))


def mapped(rows: DataFrame, ids: str, table: DataFrame) -> DataFrame:
    """id, values, unmatched for rows: their id arrays through table (key, value), in order."""
    hit = rows.select("id", F.posexplode_outer(ids).alias("at", "key")).join(table, "key", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value"))))
    return hit.groupBy("id").agg(F.transform(found, lambda x: x.value).alias("values"), F.count_if(F.col("key").isNotNull() & F.col("value").isNull()).alias("unmatched"))


def vendor_matches(rows: DataFrame, website: str, vendors: DataFrame) -> DataFrame:
    """id, vendor: the first vendor in its list's order whose domain the site equals or lies below.

    vendors: domain, vendor, place. Each site is exploded into its own and the domains above, a few a row, so the join is on equal keys.
    """
    parts = rows.where(F.col(website) != "").select("id", F.explode(domain_suffixes(F.col(website))).alias("domain"))
    return parts.join(vendors, "domain").groupBy("id").agg(F.min_by("vendor", "place").alias("vendor"))


def hosts_named(pages: DataFrame, text: str, own: str, hosts: DataFrame, most: int = 10) -> DataFrame:
    """id, named (sorted, most at most), unknown: registered hosts that a page links to, without its own, and how many others.

    hosts: host. The page's links are extracted and joined by host; no text is searched for each host.
    """
    links = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"""https?://([^/\s"'<>?#:]+)"""), 1)
    seen = pages.select("id", F.explode(F.array_distinct(F.transform(links, lambda x: F.regexp_replace(F.lower(x), r"^www\.", "")))).alias("host"), F.col(own).alias("own")).where("host <> own")
    marked = seen.join(hosts.select("host").distinct().withColumn("known", F.lit(True)), "host", "left")
    grouped = marked.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("host")))).alias("named"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return grouped.select("id", F.slice("named", 1, most).alias("named"), "unknown")


#: Legal forms of names, words that name no organisation, and common ends of domains (fixed values).
LEGAL = r"(?i)\b(?:co\.?,?\s*ltd\.?|ltd\.?|inc\.?|corp\.?|corporation|company|co\.|llc|plc|gmbh)(?=$|[^a-z0-9])|주식회사|유한회사|\(주\)|㈜|\(유\)"
NO_NAME = (
    "기타", "미상", "미확인", "없음", "모름", "unknown", "n/a", "한국", "korea", "대한민국",
    "ltd", "inc", "corp", "co", "llc", "plc", "gmbh", "company", "corporation",
    "주식회사", "유한회사", "www", "http", "https", "com", "net", "org",
)
DOMAIN_ENDS = "com|net|org|kr|co|or|go|ac|ne|re|pe|gov|edu|io|jp|cn"
DOMAIN_NAME = r"[a-z0-9-]+(?:\.[a-z0-9-]+)+"


def registered_name(domain: Column) -> Column:
    """The label of a domain before its common ends: lamaba of shop.lamaba.com."""
    return F.regexp_extract(domain, rf"^(?:[^.]+\.)*?([^.]+)(?:\.(?:{DOMAIN_ENDS}))*$", 1)


def _domains(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(DOMAIN_NAME), 0), lambda d: F.regexp_replace(d, r"^www\.", ""))


def _names_only(names: Column, least: int) -> Column:
    return F.array_distinct(F.filter(names, lambda k: (F.length(k) >= least) & ~k.isin(*NO_NAME)))


def org_keys(name: Column) -> Column:
    """Keys of an organisation's name: the whole name, without brackets, and without legal forms, each without blanks and
    marks, of three characters or more; and its domains' registered names of four or more. Parts of a name are no keys."""
    said = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "https?://", " ")
    whole = F.regexp_replace(said, r"\([^)]*\)", " ")
    bare = lambda x: F.regexp_replace(x, r"[\s.,·/\-_:'\"]+", "")
    names = F.array(bare(said), bare(whole), bare(F.regexp_replace(whole, LEGAL, " ")))
    return F.array_union(_names_only(names, 3), _names_only(F.transform(_domains(said), registered_name), 4))


def same_organisation(left: DataFrame, right: DataFrame) -> DataFrame:
    """left rows (id, name) that share an organisation key with some row of right (name)."""
    keys = right.select(F.explode(org_keys(F.col("name"))).alias("key")).distinct()
    return left.select("id", F.explode(org_keys(F.col("name"))).alias("key")).join(keys, "key", "left_semi").select("id").distinct()


def org_tokens(names: DataFrame) -> DataFrame:
    """token: what texts may call the organisations of names (name): the whole cell, its parts, what is in brackets and what is left
    without them, each also without blanks and without legal forms, and domains with their registered names; two characters or more."""
    said = F.regexp_replace(F.col("name"), "(?i)https?://", " ")
    parts = F.split(said, r"[,/·;|]|\s+[-–]\s+|\n")
    inner = F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, F.lit(r"\(([^)]*)\)"), 1)))
    outer = F.transform(parts, lambda x: F.regexp_replace(x, r"\([^)]*\)", " "))
    domains = _domains(F.lower(said))
    every = F.concat(F.array(said), parts, inner, outer, domains, F.transform(domains, registered_name))
    trim = lambda x, marks: F.lower(F.regexp_replace(x, rf"^[{marks}]+|[{marks}]+$", ""))
    plain = names.where("name IS NOT NULL").select(F.explode(every).alias("x")).select(trim(F.col("x"), r"\s.,·/\-_:'\"").alias("x"))
    plain = plain.where(~F.col("x").isin("", *NO_NAME) & ~F.col("x").rlike("^[0-9]+$"))
    bare = trim(F.regexp_replace("x", LEGAL, " "), r"\s.,·/\-")
    bare = F.when((bare != "") & ~bare.isin(*NO_NAME), bare)
    tokens = plain.select(F.explode(F.array_compact(F.array("x", bare))).alias("x"))
    squeezed = tokens.select(F.explode(F.array("x", F.regexp_replace("x", r"\s+", ""))).alias("token"))
    return squeezed.where(F.length("token") >= 2).distinct()


#: Characters of tokens that one pass over the texts looks for.
PASS_CHARS = 32_000_000
_SHORT, _LATIN = re.compile("[a-z0-9]{1,3}"), re.compile("[a-z0-9]")


def mentioning(texts: DataFrame, tokens: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """id, token: the tokens that texts (id, text) hold, in lower case.

    A token of up to three Latin letters or digits must stand between other characters; any other may stand
    anywhere, also across blanks. Texts are read once for every pass_chars characters of tokens, which an automaton finds
    in one go; only what is found leaves the scan, so no text is shuffled and no token, however common, is a key of
    a join. Tokens of a pass are gathered and sent to the tasks: their size is bounded by pass_chars. Null text: nothing.
    """
    spark = texts.sparkSession
    wanted = tokens.select(F.lower("token").alias("token")).where("token <> ''").distinct()
    total = wanted.agg(F.sum(F.length("token"))).first()[0] or 0
    passes = max(1, -(-total // pass_chars))
    rows = texts.where("text IS NOT NULL").select("id", F.lower("text").alias("low"))
    kind = rows.schema["id"].dataType.simpleString()

    def step(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for token in held.value:
                automaton.add_word(token, token)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for k, low in enumerate(batch.column(1).to_pylist()):
                    hits = _held(low, automaton)
                    at += [k] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["id", "token"])

        return run

    parts = []
    for k in range(passes):
        some = [r.token for r in wanted.where(F.pmod(F.xxhash64("token"), F.lit(passes)) == k).collect()]  # pass_chars characters
        if some:
            parts.append(rows.mapInArrow(step(spark.sparkContext.broadcast(some)), f"id {kind}, token string"))
    return reduce(DataFrame.unionByName, parts) if parts else rows.select("id", F.lit("").alias("token")).limit(0)


def _held(low: str, automaton) -> list[str]:
    out = set()
    for end, token in automaton.iter(low):
        if not _SHORT.fullmatch(token) or not (_LATIN.match(low[max(end - len(token), 0) : end - len(token) + 1]) or _LATIN.match(low[end + 1 : end + 2])):
            out.add(token)
    squeezed = re.sub(r"\s+", "", low)
    if squeezed != low:
        out.update(token for _, token in automaton.iter(squeezed) if not _SHORT.fullmatch(token))
    return sorted(out)


def overridden(rows: DataFrame, overrides: DataFrame, column: str) -> DataFrame:
    """rows with column from overrides (id, value) where they have one."""
    return rows.join(overrides.select("id", F.col("value").alias("_value")), "id", "left").withColumn(column, F.coalesce("_value", F.col(column))).drop("_value")


def resolved(rows: DataFrame, query: str) -> DataFrame:
    """One row: how many rows' titles contain query, and the id if it is one."""
    hit = F.contains(F.lower("title"), F.lit(query.lower()))
    return rows.agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("id"))).alias("id")).withColumn("id", F.when(F.col("n") == 1, F.col("id")))


def reply_authors(posts: DataFrame, thread: str, place: str, author: str) -> DataFrame:
    """author, threads: who replies in threads of others; the author of a thread is that of its first post."""
    starters = posts.groupBy(thread).agg(F.min_by(author, place).alias("starter"))
    replies = posts.join(starters, thread).where(F.col(author) != F.col("starter"))
    return replies.groupBy(author).agg(F.countDistinct(thread).alias("threads"))


#: Classes of a pair of cases.
SAME, REPOST, PARTLY, SUSPECTED, DIFFERENT, UNKNOWN = "same", "repost", "partly different", "suspected", "different", "unknown"


def duplicate_cases(rows: DataFrame, new: DataFrame) -> DataFrame:
    """row, case, class for rows and new cases that share a URL or an organisation key (id, url, org, handle, forum each).

    The same URL is the same case. Of others that share an organisation: another handle is partly different, an unknown
    one unknown; of the same handle another forum is a repost, the same forum the same case, an unknown one unknown.
    Pairs without a shared key don't meet at all.
    """
    null = lambda c: F.nullif(F.trim(c), F.lit(""))
    # Equal rows are put together before they meet, and a pair is kept at the first key that it shares: so no pair is shuffled.
    whole = lambda t, name: t.select(
        F.col("id").alias(name), F.struct(null(F.col("url")).alias("url"), null(F.col("handle")).alias("handle"), null(F.col("forum")).alias("forum")).alias(f"{name}_r"),
        F.array_distinct(F.array_compact(F.concat(F.array(null(F.col("url"))), org_keys(F.col("org"))))).alias(f"{name}_keys"),
    ).groupBy(name, f"{name}_r").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{name}_keys")))).alias(f"{name}_keys"))
    keyed = lambda t, name: whole(t, name).select("*", F.explode(f"{name}_keys").alias("key"))
    met = keyed(rows, "row").join(keyed(new, "case"), "key")
    pairs = met.where(F.col("key") == F.get(F.array_intersect("row_keys", "case_keys"), F.lit(0))).select("row", "case", "row_r", "case_r")
    a, b = F.col("row_r"), F.col("case_r")
    known = lambda f: a[f].isNotNull() & b[f].isNotNull()
    kind = (
        F.when(a.url == b.url, SAME)
        .when(~known("handle"), UNKNOWN)
        .when(a.handle != b.handle, PARTLY)
        .when(~known("forum"), UNKNOWN)
        .when(a.forum != b.forum, REPOST)
        .otherwise(SAME)
    )
    return pairs.select("row", "case", kind.alias("class"))
