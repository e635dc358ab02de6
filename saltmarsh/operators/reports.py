"""Matches of channels, questions and rechecks, and reports over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.places import CHANNEL
from saltmarsh.functions.text import empty
from saltmarsh.functions.times import expiry_from

#: States of a post that is watched, and who says so (fixed values).
STATES, SAYERS = ("게시 중", "공개됨", "사라짐", "연장", "안 보임", "불명"), ("agg", "origin")


def event_channels(events: DataFrame, channels: DataFrame, key: str) -> DataFrame:
    """key, channel: the channel that passed an event on. By the address in its platform, then that in its url, then its handle;
    a clue that names no known channel gives way to the next. Events without a channel are not returned.

    events: key, platform, url, handle. channels: channel, name (compared in lower case).
    """
    clues = F.array(F.regexp_extract("platform", CHANNEL, 1), F.regexp_extract("url", CHANNEL, 1), F.col("handle"))
    said = events.select(key, F.posexplode(clues).alias("_rank", "_name")).select(key, "_rank", F.lower(F.trim(empty(F.col("_name")))).alias("_name")).where("_name <> ''")
    known = channels.groupBy(F.lower(F.trim(F.col("name"))).alias("_name")).agg(F.min("channel").alias("channel"))
    return said.join(known, "_name").groupBy(key).agg(F.min_by("channel", "_rank").alias("channel"))


def channel_targets(channels: DataFrame, pages: DataFrame) -> DataFrame:
    """channel, method, matches, page, status: which page a channel's result may go to.

    channels: channel, numbers, names (arrays), title, selected (page picked by hand, or null). pages: page, numbers, names, title.
    Numbers decide; without a match of these, names; titles are only proposed. One match is taken; of several, or by
    title, only that which was selected.
    """
    kinds = ("numbers", "names", "title")

    def keys(rows: DataFrame, *columns: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("keys")) for k, c in enumerate(kinds[:2])])
        parts = rows.select(*columns, F.inline(each)).select(*columns, "kind", F.explode("keys").alias("key"))
        return parts.where("key <> ''").distinct()

    met = keys(channels, "channel", "selected").join(keys(pages, "page"), ["kind", "key"]).select("channel", "kind", "page", "selected").distinct()
    counts = met.groupBy("channel", "kind").agg(F.count("*").alias("matches"), F.min("page").alias("only"), F.max(F.coalesce(F.col("page") == F.col("selected"), F.lit(False))).alias("picked"))
    # A title may be common to many on both sides, so its pages are counted before they meet channels.
    titled = pages.select(F.lower(F.trim("title")).alias("key"), "page").where("key <> ''").distinct()
    of_title = titled.groupBy("key").agg(F.count("*").alias("matches"), F.min("page").alias("only"))
    named = channels.select("channel", "selected", F.lower(F.trim("title")).alias("key")).join(of_title, "key")
    chosen = titled.select("key", F.col("page").alias("selected"), F.lit(True).alias("_picked"))
    named = named.join(chosen, ["key", "selected"], "left")
    counts = counts.unionByName(named.select("channel", F.lit(2).alias("kind"), "matches", "only", F.coalesce("_picked", F.lit(False)).alias("picked")))
    best = counts.groupBy("channel").agg(F.min(F.struct("kind", "matches", "only", "picked")).alias("b"))
    rows = channels.select("channel", "selected").join(best, "channel", "left")
    kind, n, picked = F.col("b.kind"), F.coalesce("b.matches", F.lit(0)), F.col("b.picked")
    status = (
        F.when(n == 0, "stopped_no_match")
        .when(kind == 2, F.when(picked, "ready_manual_name_match").otherwise("stopped_name_only"))
        .when(n == 1, "ready_auto")
        .when(picked, "ready_manual")
        .when(F.col("selected").isNotNull(), "stopped_invalid_selection")
        .otherwise("stopped_multiple_matches")
    )
    page = F.when(status == "ready_auto", F.col("b.only")).when(F.startswith(status, F.lit("ready")), F.col("selected"))
    return rows.select("channel", F.get(F.array(*map(F.lit, kinds)), kind).alias("method"), n.alias("matches"), page.alias("page"), status.alias("status"))


def rechecked(questions: DataFrame, shown: DataFrame, hidden: DataFrame | None) -> DataFrame:
    """question, branch, row: what a question without evidence meets by its word fingerprints.

    questions: question, prints (array). shown, hidden: print, row, place. The first fingerprint with a hit counts, among shown rows
    before hidden ones; of rows with one fingerprint the first by place. branch: shown, hidden, none, or unchecked if there is no hidden list.
    """
    prints = questions.select("question", F.posexplode("prints").alias("pos", "print"))

    def hits(of: DataFrame, name: str) -> DataFrame:
        first = of.groupBy("print").agg(F.min_by("row", "place").alias("row"))
        return prints.join(first, "print").groupBy("question").agg(F.min_by("row", "pos").alias(name))

    found = questions.select("question").join(hits(shown, "_shown"), "question", "left")
    found = found.withColumn("_hidden", F.lit(None).cast("string")) if hidden is None else found.join(hits(hidden, "_hidden"), "question", "left")
    branch = F.when(F.col("_shown").isNotNull(), "shown").when(F.col("_hidden").isNotNull(), "hidden").otherwise("none" if hidden is not None else "unchecked")
    return found.select("question", branch.alias("branch"), F.coalesce("_shown", "_hidden").alias("row"))


def question_kinds(questions: DataFrame, names: DataFrame) -> DataFrame:
    """question, kind, documents: where a question's rows lead.

    questions: question, none, keys (array of the keys of each row). names: key, document, live; document is null for rows that are left
    out of the export. kind: none if no answer is right, answerable with a live document, hidden if all that is
    known is not live, unknown if nothing is. documents are sorted, each once.
    """
    asked = questions.where("NOT none").select("question", F.explode(F.array_distinct(F.flatten("keys"))).alias("key"))
    live = F.when(F.col("live") & F.col("document").isNotNull(), F.col("document"))
    met = asked.join(names, "key").groupBy("question").agg(F.array_sort(F.collect_set(live)).alias("documents"))
    rows = questions.select("question", "none").join(met, "question", "left")
    n = F.size("documents")  # -1 or null without a match
    kind = F.when(F.col("none"), "none").when(n > 0, "answerable").when(F.col("documents").isNotNull(), "hidden").otherwise("unknown")
    return rows.select("question", kind.alias("kind"), F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))


def victim_figures(victims: DataFrame, least: int = 60, most: int = 15) -> DataFrame:
    """what, name, n: victims in all, new ones, by tier, by supply tier (null: none), and the groups with most victims of a score of least or more."""
    one = lambda what, rows, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    total = victims.agg(F.count("*").alias("total"), F.count_if(F.col("is_new")).alias("new")).select(F.inline(F.array(*[F.struct(F.lit("all").alias("what"), F.lit(x).alias("name"), F.col(x).alias("n")) for x in ("total", "new")])))
    groups = one("group", victims.where(F.col("score") >= least), F.col("group")).orderBy(F.desc("n"), "name").limit(most)
    return total.unionByName(one("tier", victims, F.col("tier"))).unionByName(one("supply", victims, F.coalesce("supply", F.lit("none")))).unionByName(groups)


def actor_attributes(rows: DataFrame, actor: str) -> DataFrame:
    """actor, venues, first_day, sources, role, korean: what rows (place, day, source, nature, korean) say of an actor.

    venues and sources are sorted, each once; role is seller if any row sells; korean: months with their number of Korean rows.
    Months are counted before they meet, so an actor's rows do not.
    """
    text = lambda c: F.when(F.trim(empty(F.col(c))) != "", F.col(c))
    seller = F.when(F.max(F.coalesce(F.col("nature") == "DB 판매", F.lit(False))), "판매자").otherwise("미확인")
    flat = rows.groupBy(actor).agg(F.array_sort(F.collect_set(text("place"))).alias("venues"), F.min(text("day")).alias("first_day"), F.array_sort(F.collect_set(text("source"))).alias("sources"), seller.alias("role"))
    months = rows.where(F.col("korean") & text("day").isNotNull()).groupBy(actor, F.substring("day", 1, 7).alias("_month")).agg(F.count("*").alias("_n"))
    said = months.groupBy(F.col(actor).alias("_actor")).agg(F.array_sort(F.collect_list(F.concat("_month", F.lit(" 한국 "), F.col("_n").cast("string"), F.lit("건")))).alias("_said"))
    return flat.join(said, F.col(actor).eqNullSafe(F.col("_actor")), "left").select(actor, "venues", "first_day", "sources", "role", F.coalesce(F.array_join("_said", " · "), F.lit("")).alias("korean"))


def recorded(arrivals: DataFrame) -> DataFrame:
    """arrivals (uid, at, src, state, countdown, expiry) as observations, with the expiry that a countdown tells where none is given.

    A state or source outside the fixed ones stops the job with its name, as it would be counted nowhere.
    """
    bad_state = ~F.coalesce(F.col("state").isin(*STATES), F.lit(False))
    bad_src = ~F.coalesce(F.col("src").isin(*SAYERS), F.lit(False))
    state = F.when(bad_state, F.raise_error(F.concat(F.lit("unknown state "), empty(F.col("state"))))).otherwise(F.col("state"))
    src = F.when(bad_src, F.raise_error(F.concat(F.lit("unknown source "), empty(F.col("src"))))).otherwise(F.col("src"))
    told = F.when(F.trim(empty(F.col("countdown"))) != "", expiry_from(F.col("at"), F.col("countdown")))
    return arrivals.withColumns({"state": state, "src": src, "expiry": F.coalesce("expiry", told), "countdown": empty(F.col("countdown"))})


def kept_answers(answers: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """answers whose key is among those to keep. Null keys go."""
    return answers.join(keep.select(key).distinct(), key, "left_semi")


def observed_items(observations: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """observations with columns of the item of their uid; nulls where there is none."""
    return observations.join(items.select("uid", *columns), "uid", "left")


def newest(posts: DataFrame, wanted: Column, day: Column, tie: Column, most: int) -> DataFrame:
    """The most newest posts that are wanted; those without a day last."""
    return posts.where(wanted).orderBy(day.desc_nulls_last(), tie).limit(most)
