"""Posts of channels as items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import posts
from saltmarsh.functions.text import empty


def post_items(rows: DataFrame) -> DataFrame:
    """rows (channel, text, links) with what the post says, in one pass without a shuffle.

    shape and note: how it was read; post_kind and ours; org, country, actor, size from fields, else org and country from
    the text (not for posts that tell of no leak), with org_from and country_from; domain: org if it is one; origin,
    venue and venue_kind: the origin's host, else the field source if it is a domain, else the channel; title; item_kind.
    """
    read = rows.withColumn("_post", posts.read_post(F.col("text"))).withColumn("_kind", posts.kind_of(F.col("_post.fields")))
    fields, text = F.col("_post.fields"), F.col("text")
    read = read.withColumns(
        {
            "_org": posts.first_field(fields, posts.PICK["org"]),
            "_country": posts.first_field(fields, posts.PICK["country"]),
            "_said": posts.org_in_text(text),
            "_flag": posts.flag_country(text),
            "origin": posts.origin(F.col("links"), text, fields),
        }
    )
    asked = ~F.coalesce(F.col("_kind.ours") == F.lit(False), F.lit(False))
    org = F.when(F.col("_org") != "", F.col("_org")).when(asked, F.col("_said.org")).otherwise("")
    org_from = F.when(F.col("_org") != "", "칸").when(asked, F.col("_said.how")).otherwise("")
    country = F.when(F.col("_country") != "", F.col("_country")).otherwise(F.col("_flag"))
    source = posts.refanged(F.element_at(fields, "source"))
    channel = F.concat(F.lit("t.me/"), "channel")
    venue = F.when(F.startswith("origin", F.lit("http")), F.get(F.split("origin", "/"), F.lit(2))).when(source.rlike(posts.DOMAIN), source).otherwise(channel)
    item = F.coalesce(*[F.when(F.col("_kind.kind") == k, v) for k, v in posts.ITEM_KINDS.items()], F.lit(""))
    return read.select(
        *rows.columns,
        F.col("_post.shape").alias("shape"),
        F.col("_post.note").alias("note"),
        F.col("_kind.kind").alias("post_kind"),
        F.col("_kind.ours").alias("ours"),
        org.alias("org"),
        org_from.alias("org_from"),
        F.when(org.rlike(posts.DOMAIN), org).otherwise("").alias("domain"),
        country.alias("country"),
        F.when(F.col("_country") != "", "칸").when(F.col("_flag") != "", "국기").otherwise("").alias("country_from"),
        posts.first_field(fields, posts.PICK["actor"]).alias("actor"),
        posts.first_field(fields, posts.PICK["size"]).alias("size"),
        "origin",
        venue.alias("venue"),
        F.when(venue == channel, "telegram").otherwise("forum").alias("venue_kind"),
        posts.title(text, fields, F.col("_post.shape")).alias("title"),
        item.alias("item_kind"),
        empty(text).alias("body"),
    ).drop("text").withColumnRenamed("body", "text")
