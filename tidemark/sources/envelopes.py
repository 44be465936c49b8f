"""Batches of alert records as a queue delivers them: base64 payloads in a map of
topic-partitions, or one alert directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.once import once
from tidemark.schema import ALERT
from tidemark.sources.records import decode_alerts

_RECORDS = (
    "map<string,array<struct<topic:string,partition:int,offset:bigint,key:string,value:string>>>"
)
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def open_envelopes(envelopes: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(alerts, problems) of a column of envelope texts.

    Each record stands for itself: a bad one becomes a row of ``problems`` (``source``,
    ``offset``, ``problem``) and the others go on. An envelope that names an alert
    directly carries nothing else.
    """
    parsed = once(
        envelopes.select(F.try_parse_json(F.col(body)).alias("v")),
        F.expr("schema_of_variant(v) LIKE 'OBJECT%'").alias("is_object"),
        F.expr("try_variant_get(v, '$.alert', 'variant')").alias("alert"),
        F.expr("try_variant_get(v, '$.records', 'variant')").alias("some_records"),
        F.expr(f"try_variant_get(v, '$.records', '{_RECORDS}')").alias("records"),
        keep=[],
    )
    given = lambda c: F.coalesce(F.schema_of_variant(c) != "VOID", F.lit(False))
    readable = F.coalesce("is_object", F.lit(False)) & (
        given("alert") | ~given("some_records") | F.col("records").isNotNull()
    )
    direct = F.expr(
        f"CAST(map('', array(named_struct('topic', '', 'partition', 0, 'offset', 0L, 'key', '', "
        f"'value', base64(CAST(to_json(alert) AS BINARY))))) AS {_RECORDS.replace(':', ': ')})"
    )
    opened = parsed.select(
        readable.alias("readable"),
        F.explode_outer(F.when(given("alert"), direct).otherwise(F.col("records"))).alias("source", "_batch"),
    ).select("readable", "source", F.explode_outer("_batch").alias("_r"))
    # Line breaks inside base64 carry nothing.
    packed = F.regexp_replace("_r.value", "[\r\n]", "")
    rows = opened.filter("NOT readable OR _r IS NOT NULL").select(
        "readable", "source", F.col("_r.offset").alias("offset"),
        F.when(packed.rlike(BASE64), F.unbase64(packed).cast("string")).alias("value"),
    )
    decoded = decode_alerts(rows)
    where = F.concat("source", F.lit("@"), F.col("offset"), F.lit(": "))
    problem = (
        F.when(~F.col("readable"), F.lit("unrecognised event shape"))
        .when(F.col("value").isNull(), F.concat(where, F.lit("bad base64")))
        .when(F.col("reason").isNotNull(), F.concat(where, F.lit("bad json: "), F.col("reason")))
    )
    judged = decoded.withColumn("problem", problem)
    return (
        judged.filter("problem IS NULL").select(ALERT.fieldNames()),
        judged.filter("problem IS NOT NULL").select("source", "offset", "problem"),
    )
