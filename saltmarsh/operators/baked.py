"""Relations baked for the map: ends found by island and name, evidence pruned, every row that goes with its first reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.text import bare_key

#: Islands, kinds and sureness as the register writes them, and reasons in the order in which they hold (fixed values).
ISLANDS = {"포럼": "FORUM", "랜섬웨어": "RANSOMWARE", "텔레그램": "TELEGRAM", "행위자": "ACTOR"}
KINDS = {"제휴자 모집": "affiliate", "공지·연락": "contact", "데이터 유출": "leak", "접근 공급": "access", "데이터 판매": "sale", "후속": "successor", "활동": "activity"}
SURENESS = {"확인됨": "confirmed", "높은 신뢰": "high", "추정": "estimated"}
OFF, NO_KIND, NO_END, SAME_END, NO_EVIDENCE = "DB 반영 꺼짐", "종류 확인 필요", "양 끝 영토가 지도에 없음", "같은 영토끼리", "근거가 모두 지도 밖"
#: The shape of an id that may leave (fixed pattern).
ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"


def _mapped(column: str, values: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def judged(relations: DataFrame, names: DataFrame, events: DataFrame) -> DataFrame:
    """id, from, to, kind, confidence, evidence, lost and reason of each row of relations; reason is null for those that stay.

    relations: id, shown (boolean), kind, from_island, from_name, to_island, to_name, sureness, evidence (array of event ids).
    names: island (code), name and territory, one row or more a territory; a name that two territories of an island share finds none.
    events: event, those on the map.

    An end is found by its island and its name together, so a forum and a channel of one name stay apart. evidence keeps the
    events on the map, in order; lost counts those that went, of rows that come as far. The first reason that holds counts:
    not shown, kind unknown, an end that isn't on the map, both ends one territory, evidence but none of it on the map. A row
    without any evidence stays. Ids of another shape than ID are replaced by rel- and a number.

    Rows keep together with a number of their own: names are two joins, events one; a hot event is for Spark's skew
    handling, and what meets it is a number and a place, not the row.
    """
    unique = names.select("island", bare_key(F.col("name")).alias("key"), "territory").where("key <> ''").distinct()
    unique = unique.groupBy("island", "key").agg(F.min("territory").alias("territory"), F.count("*").alias("n")).where("n = 1").drop("n")
    rows = relations.select(
        F.monotonically_increasing_id().alias("row"), "id", F.coalesce("shown", F.lit(False)).alias("shown"), _mapped("kind", KINDS).alias("kind"), F.coalesce(_mapped("sureness", SURENESS), F.lit("estimated")).alias("confidence"),
        *[c for side in ("from", "to") for c in (_mapped(f"{side}_island", ISLANDS).alias(f"{side}_island"), bare_key(F.col(f"{side}_name")).alias(f"{side}_key"))],
        F.coalesce("evidence", F.array().cast(relations.schema["evidence"].dataType)).alias("said"),
    )
    for side in ("from", "to"):
        ends = unique.select(F.col("island").alias(f"{side}_island"), F.col("key").alias(f"{side}_key"), F.col("territory").alias(side))
        rows = rows.join(ends, [f"{side}_island", f"{side}_key"], "left")
    cited = rows.select("*", F.posexplode_outer("said").alias("place", "event"))
    met = cited.join(events.select("event").distinct().withColumn("_met", F.lit(True)), "event", "left")
    found = F.transform(F.sort_array(F.collect_list(F.when(F.col("_met"), F.struct("place", "event")))), lambda e: e["event"])
    same = ["id", "shown", "kind", "confidence", "from", "to"]
    whole = met.groupBy("row").agg(*[F.any_value(c).alias(c) for c in same], found.alias("evidence"), F.count("place").alias("n"))
    reason = (
        F.when(~F.col("shown"), OFF)
        .when(F.col("kind").isNull(), NO_KIND)
        .when(F.col("from").isNull() | F.col("to").isNull(), NO_END)
        .when(F.col("from") == F.col("to"), SAME_END)
        .when((F.col("n") > 0) & (F.size("evidence") == 0), NO_EVIDENCE)
    )
    counted = reason.isNull() | (reason == NO_EVIDENCE)
    name = F.when(F.col("id").rlike(ID), F.col("id")).otherwise(F.concat(F.lit("rel-"), (F.col("row") + 1).cast("string")))
    return whole.select(name.alias("id"), "from", "to", "kind", "confidence", "evidence", F.when(counted, F.col("n") - F.size("evidence")).otherwise(0).alias("lost"), reason.alias("reason"))


def figures(rows: DataFrame) -> DataFrame:
    """reason, n, lost of judged rows: how many stay (reason null) and how many go for each reason, and the evidence lost."""
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("lost").alias("lost"))
