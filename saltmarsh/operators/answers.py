"""Answers: their sentences with the sources cited for them, whether they are grounded, and how often search finds what is wanted."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ends of sentences, a tail in brackets after one, marks of layout, words that only open a list, and ends of prose (fixed patterns).
END = re.compile(r"(?<=[.!?。])\s+|\n+")
TAIL = r"(?s)^(\([^()]{1,40}\)[.]?)(?:\s+(.*))?$"
MARK = r"(?m)\*\*|__|^#{1,6}\s+|^[-*•]\s+"
OPENS_LIST = r"((다음|아래)[^.]{0,40}(있습니다|같습니다|확인됩니다|확인됐습니다|확인되었습니다|정리됩니다)[.:]?|:)$"
ENDS = r"[.!?。다요죠음됨함]\s*[)\]」]?\s*$"
#: Offsets are put into buckets of so many characters.
WIDTH = 256


PIECE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("place", "start", "end")] + [T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(PIECE))
def pieces(texts: pd.Series) -> pd.Series:
    """The sentences of a text with their offsets, the white space after them included; blank ones are left out."""

    def cut(text: str | None) -> list[dict]:
        ends = [m.end() for m in END.finditer(text or "")] + [len(text or "")]
        spans = [(a, b) for a, b in zip([0, *ends], ends) if (text or "")[a:b].strip()]
        return [{"place": k, "start": a, "end": b, "text": text[a:b].strip()} for k, (a, b) in enumerate(spans)]

    return texts.map(cut)


def _buckets(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / WIDTH), F.floor((F.col(end) - 1) / WIDTH)))


def cited_pieces(answers: DataFrame, cites: DataFrame) -> DataFrame:
    """answer, place, text, sources of each sentence of answers (answer, text): those of cites (answer, start, end, source) that overlap it.

    Both are put into the buckets of offsets that they touch and meet there, each pair in the first bucket they share; so a
    sentence meets only what lies near, also in an answer of any length. sources: sorted, each once. Cites without length, with
    a null or outside the text overlap nothing.
    """
    held = answers.select("answer", F.inline(pieces("text")))
    near = cites.where("end > start AND start >= 0 AND source IS NOT NULL").select("answer", F.col("start").alias("from"), F.col("end").alias("to"), "source")
    met = held.select("answer", "place", "start", "end", _buckets("start", "end").alias("bucket")).join(near.select("*", _buckets("from", "to").alias("bucket")), ["answer", "bucket"])
    first = F.floor(F.greatest("start", "from") / WIDTH)
    met = met.where((F.col("from") < F.col("end")) & (F.col("to") > F.col("start")) & (F.col("bucket") == first))
    of = met.groupBy("answer", "place").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    none = F.array().cast(of.schema["sources"].dataType)
    return held.join(of, ["answer", "place"], "left").select("answer", "place", "text", F.coalesce("sources", none).alias("sources"))


def sentences(answers: DataFrame, cites: DataFrame) -> DataFrame:
    """answer, place (from 1), text, sources, cited of each sentence as it is shown.

    A tail in brackets after a sentence joins it, with its sources if nothing else follows; what follows the tail is a
    sentence. Marks of layout go. Words that only open a list, without a source, are left out; a short line without a
    source and without an end that stands before a cited sentence is its heading and joins it.
    """
    by = Window.partitionBy("answer").orderBy("place")
    rows = cited_pieces(answers, cites).withColumn("tail", F.when((F.row_number().over(by) > 1) & F.col("text").rlike(TAIL), F.regexp_extract("text", TAIL, 1)))
    rest = F.trim(F.regexp_extract("text", TAIL, 2))
    rows = rows.withColumn("own", F.when(F.col("tail").isNull(), F.col("text")).when(rest != "", rest))
    # A piece that is a tail and more is two: the tail goes to the group before, the rest begins one.
    part = lambda order, text, sources: F.struct(F.lit(order).alias("order"), text.alias("text"), sources.alias("sources"))
    none = F.slice("sources", 1, 0)
    tail = F.when(F.col("tail").isNotNull(), part(0, F.col("tail"), F.when(F.col("own").isNull(), F.col("sources")).otherwise(none)))
    rows = rows.select("answer", "place", F.inline(F.array_compact(F.array(tail, F.when(F.col("own").isNotNull(), part(1, F.col("own"), F.col("sources")))))))
    order = Window.partitionBy("answer").orderBy("place", "order")
    rows = rows.withColumn("group", F.sum("order").over(order))
    whole = rows.groupBy("answer", "group").agg(F.sort_array(F.collect_list(F.struct("place", "order", "text", "sources"))).alias("parts"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), " "), MARK, ""))
    sources = F.sort_array(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["sources"]))))
    whole = whole.select("answer", "group", text.alias("text"), sources.alias("sources"), (F.size(sources) > 0).alias("cited"))

    along = Window.partitionBy("answer").orderBy("group")
    opens = ~F.col("cited") & F.col("text").rlike(OPENS_LIST)
    head = ~F.col("cited") & ~opens & F.coalesce(F.lead("cited").over(along), F.lit(False)) & (F.length("text") <= 60) & ~F.col("text").rlike(ENDS)
    marked = whole.withColumn("opens", opens).withColumn("head", head)
    before = F.when(F.lag("head").over(along), F.concat(F.regexp_replace(F.lag("text").over(along), "[: ]+$", ""), F.lit(": "))).otherwise("")
    shown = marked.withColumn("shown", F.concat(before, "text")).where("NOT opens AND NOT head AND shown <> ''")
    return shown.select("answer", F.row_number().over(along).cast("long").alias("place"), F.col("shown").alias("text"), "sources", "cited")


def grounded(answers: DataFrame, cites: DataFrame, no_evidence: str) -> DataFrame:
    """answer, grounded: some source is cited, and the text doesn't say itself that there is no evidence."""
    some = cites.where("source IS NOT NULL").select("answer").distinct().withColumn("_some", F.lit(True))
    said = F.contains(F.coalesce("text", F.lit("")), F.lit(no_evidence))
    return answers.join(some, "answer", "left").select("answer", (F.coalesce("_some", F.lit(False)) & ~said).alias("grounded"))


def recall_by_weight(candidates: DataFrame, wanted: DataFrame, weights: list[float], m: int = 100, k: int = 5) -> DataFrame:
    """kind, weight, n, in_m, in_k, missed_candidates, missed_ranking for questions of each kind, over a grid of weights.

    candidates: question, document, base, extra; its score is base + weight * extra, and it is no candidate at 0 or below. Ties: the
    smaller document. wanted: question, document, kind, one row a question; whether it is among the first m, and the first k.

    One pass for all weights: every candidate is held against its question's wanted document, and for each weight those
    before it are counted. Nothing is sorted, and counts are combined before they are shuffled.
    """
    want = wanted.select("question", F.col("document").alias("_want"), "kind")
    mine = candidates.join(want, (candidates["question"] == want["question"]) & (candidates["document"] == want["_want"])).select(want["question"], "_want", F.col("base").alias("_base"), F.col("extra").alias("_extra"))
    met = candidates.join(mine.groupBy("question", "_want").agg(F.max("_base").alias("_base"), F.max("_extra").alias("_extra")), "question")
    ahead = []
    for j, w in enumerate(weights):
        theirs, own = F.col("base") + w * F.col("extra"), F.col("_base") + w * F.col("_extra")
        before = (theirs > 0) & ((theirs > own) | (theirs == own) & (F.col("document") < F.col("_want")))
        ahead.append(F.when(F.max(own) > 0, F.sum(before.cast("long"))).alias(f"ahead_{j}"))
    places = met.groupBy("question").agg(*ahead)
    grid = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"ahead_{j}").alias("ahead")) for j, w in enumerate(weights)])
    rows = want.join(places, "question", "left").select("kind", F.inline(grid))
    hit = lambda n: F.sum((F.coalesce(F.col("ahead") < n, F.lit(False))).cast("long"))
    found = rows.groupBy("kind", "weight").agg(F.count("*").alias("n"), hit(m).alias("in_m"), hit(k).alias("in_k"))
    return found.withColumn("missed_candidates", F.col("n") - F.col("in_m")).withColumn("missed_ranking", F.col("in_m") - F.col("in_k"))


def answer_rates(results: DataFrame) -> DataFrame:
    """One row of rates, rounded to three places: of sentences cited, of unanswerable questions known as such, of answerable and hidden ones refused.

    results: kind (answerable, hidden, none), grounded, sentences, cited. A rate of nothing is null.
    """
    of = lambda kind: F.col("kind") == kind
    refused = ~F.coalesce("grounded", F.lit(False))
    rate = lambda part, whole: F.when(whole > 0, F.round(part / whole, 3))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return results.agg(
        rate(F.sum(F.when(~refused, F.col("cited"))), F.sum(F.when(~refused, F.col("sentences")))).alias("cited_rate"),
        rate(count(of("none") & refused), count(of("none"))).alias("none_known"),
        rate(count(of("answerable") & refused), count(of("answerable"))).alias("answerable_refused"),
        rate(count(of("hidden") & refused), count(of("hidden"))).alias("hidden_refused"),
    )
