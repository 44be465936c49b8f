"""Keyed log records: reading raw ones, decoding and encoding JSON payloads.

Decoding is strict about JSON types: a number where text belongs makes the record
undecodable, as opposed to being converted. Missing and null fields take empty values,
which validation then judges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.once import once
from tidemark.functions.scalars import event_time, parse_rfc3339
from tidemark.schema import RAW

# The logical datasets of a deployment.
TOPICS = ("events", "alerts", "metrics", "state", "dead-letters")


def read_log(spark: SparkSession, options: dict[str, str], streaming: bool = True,
             from_start: bool = True, max_per_trigger: int | None = None) -> DataFrame:
    """A keyed log through Spark's Kafka source, as ``RAW`` rows.

    A new reader starts at the earliest record, or with ``from_start`` false at the end,
    for a live tail. Needs the connector package on the class path; connection and
    security settings go into ``options``.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options)
    reader = reader.option("startingOffsets", "earliest" if from_start or not streaming else "latest")
    if streaming and max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return as_raw(reader.load())


def as_raw(df: DataFrame) -> DataFrame:
    """Any frame with the log columns, keys and values as text."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW])


MALFORMED = "invalid event: malformed JSON"
_NUMBER = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")

# Per JSON type: what schema_of_variant may say, and the empty value of the type.
_ACCEPTS = {
    "text": ("STRING", "''"),
    "time": ("STRING", "''"),
    "number": ("|".join(_NUMBER), "0D"),
    "flag": ("BOOLEAN", "false"),
}
_SQL_TYPE = {"text": "string", "time": "string", "number": "double", "flag": "boolean"}


def _kind(path: str) -> str:
    """JSON type at a path of the column ``v``; null when missing or a JSON null."""
    return f"nullif(schema_of_variant(try_variant_get(v, '$.{path}', 'variant')), 'VOID')"


def _fields(fields: dict[str, str]) -> list[Column]:
    """For every path, its JSON type ``k`` and its value ``x``, as one struct each."""
    out = []
    for path, kind in fields.items():
        sql = f"named_struct('k', {_kind(path)}, 'x', try_variant_get(v, '$.{path}', '{_SQL_TYPE[kind]}'))"
        out.append(F.expr(sql).alias("j_" + path.replace(".", "_")))
    return out


def _value(path: str, kind: str) -> Column:
    name = "j_" + path.replace(".", "_")
    if kind == "time":
        return parse_rfc3339(F.col(f"{name}.x"))
    return F.expr(f"coalesce({name}.x, {_ACCEPTS[kind][1]})")


def _problem(checks: dict[str, str | Column]) -> Column:
    """The first check that does not hold, as a reason; null when all do."""
    pairs = []
    for what, ok in checks.items():
        ok = F.expr(ok) if isinstance(ok, str) else ok
        pairs.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{MALFORMED}: {what}")))
    return F.coalesce(*pairs)


_SAY = {"text": "text", "time": "an RFC 3339 time", "number": "a number", "flag": "true or false"}


def _field_checks(fields: dict[str, str]) -> dict[str, str | Column]:
    out: dict[str, str | Column] = {}
    for path, kind in fields.items():
        name = "j_" + path.replace(".", "_")
        ok = F.expr(f"{name}.k IS NULL OR {name}.k RLIKE '^({_ACCEPTS[kind][0]})'")
        if kind == "time":
            ok = ok & (F.col(f"{name}.k").isNull() | _value(path, kind).isNotNull())
        out[f"{path} is not {_SAY[kind]}"] = ok
    return out


_WHOLE = {
    "not a JSON document": "k_whole IS NOT NULL",
    "not an object": "k_whole RLIKE '^(OBJECT|VOID)'",
}


def _whole() -> list[Column]:
    return [F.expr("schema_of_variant(v)").alias("k_whole")]

_EVENT_FIELDS = {
    "id": "text", "stream": "text", "key": "text", "at": "time", "value": "number", "unit": "text",
    "geo.lat": "number", "geo.lon": "number", "geo.place": "text",
}


def decode_events(raw: DataFrame) -> DataFrame:
    """Event columns, the record's own columns, and ``reason`` where undecodable.

    Nothing is dropped: validation turns reasons into dead letters.
    """
    parsed = raw.select(
        "topic", "partition", "offset", F.col("key").alias("record_key"), F.col("value").alias("payload"),
        F.col("timestamp").alias("record_time"), F.try_parse_json("value").alias("v"),
    )
    taken = once(
        parsed, *_whole(), *_fields(_EVENT_FIELDS),
        F.expr(_kind("geo")).alias("k_geo"), F.expr(_kind("labels")).alias("k_labels"),
        F.expr("try_variant_get(v, '$.labels', 'map<string,variant>')").alias("m_labels"),
        keep=[c for c in parsed.columns if c != "v"],
    )
    texts = "forall(map_values(m_labels), x -> schema_of_variant(x) IN ('STRING', 'VOID'))"
    checks = {
        **_WHOLE,
        **_field_checks(_EVENT_FIELDS),
        "geo is not an object": "k_geo IS NULL OR k_geo LIKE 'OBJECT%'",
        "labels is not an object of texts": f"k_labels IS NULL OR (k_labels LIKE 'OBJECT%' AND coalesce({texts}, true))",
    }
    geo = F.struct(*[_value(f"geo.{n}", _EVENT_FIELDS[f"geo.{n}"]).alias(n) for n in ("lat", "lon", "place")])
    labels = "transform_values(m_labels, (k, x) -> coalesce(try_variant_get(x, '$', 'string'), ''))"
    return taken.select(
        *[_value(n, k).alias(n) for n, k in _EVENT_FIELDS.items() if "." not in n],
        F.when(F.col("k_geo").isNotNull(), geo).alias("geo"),
        F.when(F.col("k_labels").isNotNull(), F.expr(labels)).alias("labels"),
        "topic", "partition", "offset", "record_key", "payload", "record_time",
        _problem(checks).alias("reason"),
    )


_ALERT_FIELDS = {
    "id": "text", "rule": "text", "stream": "text", "key": "text", "at": "time", "detectedAt": "time",
    "severity": "text", "title": "text", "detail": "text", "absence": "flag",
}


def decode_alerts(raw: DataFrame, value: str = "value") -> DataFrame:
    """Alert columns next to the input's; ``reason`` is set where undecodable."""
    kept = [c for c in raw.columns if c not in ("key", "timestamp")]
    taken = once(
        raw.select(*kept, F.try_parse_json(value).alias("v")), *_whole(), *_fields(_ALERT_FIELDS),
        F.expr(_kind("evidence")).alias("k_evidence"), F.expr(_kind("eventIds")).alias("k_ids"),
        F.expr("try_variant_get(v, '$.evidence', 'string')").alias("evidence"),
        F.expr("try_variant_get(v, '$.eventIds', 'array<string>')").alias("event_ids"),
        keep=kept,
    )
    checks = {
        **_WHOLE,
        **_field_checks(_ALERT_FIELDS),
        "evidence is not an object": "k_evidence IS NULL OR k_evidence LIKE 'OBJECT%'",
        "eventIds is not an array of texts": "k_ids IS NULL OR k_ids IN ('ARRAY<STRING>', 'ARRAY<VOID>')",
    }
    renamed = {"detectedAt": "detected_at"}
    return taken.select(
        *kept,
        *[_value(n, k).alias(renamed.get(n, n)) for n, k in _ALERT_FIELDS.items()],
        "evidence", "event_ids",
        F.regexp_replace(_problem(checks), "^invalid event: ", "").alias("reason"),
    )


def metric_inputs(raw: DataFrame) -> DataFrame:
    """(stream, at, value) of records whose stream is text and whose value is a number.

    Everything else is dropped without a trace: dead letters are the detector's business.
    Any stream name counts. Time is the event's own, else the record's.
    """
    fields = {"stream": "text", "at": "time", "value": "number"}
    taken = once(raw.select("timestamp", F.try_parse_json("value").alias("v")), *_fields(fields), keep=["timestamp"])
    numbers = "|".join(_NUMBER)
    return taken.filter(f"j_stream.k = 'STRING' AND j_value.k RLIKE '^({numbers})'").select(
        F.col("j_stream.x").alias("stream"),
        event_time(F.when(F.col("j_at.k") == "STRING", F.col("j_at.x")), F.col("timestamp")).alias("at"),
        F.col("j_value.x").alias("value"),
    )


def closed_windows(raw: DataFrame) -> DataFrame:
    """Metrics records as they are, without empty ones."""
    return raw.filter(F.length("value") > 0)


_RFC3339_OUT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def rfc3339(t: Column) -> Column:
    """UTC text with six decimals always, so that text order is time order."""
    utc = F.to_utc_timestamp(t, F.current_timezone())
    return F.date_format(utc, _RFC3339_OUT)


def encode_events(events: DataFrame) -> DataFrame:
    """Records keyed by entity, with the event's time as record time."""
    body = F.struct("id", "stream", "key", rfc3339(F.col("at")).alias("at"), "value", "unit", "geo", "labels")
    return events.select("key", F.to_json(body).alias("value"), F.col("at").alias("timestamp"))


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """Records keyed by entity, with the detection time as record time."""
    body = F.to_json(
        F.struct(
            "id", "rule", "stream", "key", rfc3339(F.col("at")).alias("at"),
            rfc3339(F.col("detected_at")).alias("detectedAt"), "severity", "title", "detail",
            F.parse_json("evidence").alias("evidence"), F.col("event_ids").alias("eventIds"),
            F.when(F.col("absence"), F.lit(True)).alias("absence"),
        )
    )
    return alerts.select("key", body.alias("value"), F.col("detected_at").alias("timestamp"))


def encode_dead_letters(letters: DataFrame) -> DataFrame:
    body = F.struct("topic", "partition", "offset", "key", "reason", rfc3339(F.col("at")).alias("at"), "payload")
    return letters.select("key", F.to_json(body).alias("value"))


def encode_metrics(metrics: DataFrame) -> DataFrame:
    """Records keyed by stream, one per closed window."""
    body = F.struct(
        "stream", rfc3339(F.col("window_start")).alias("windowStart"),
        rfc3339(F.col("window_end")).alias("windowEnd"),
        "count", "sum", "mean", "min", "max", F.col("per_second").alias("perSecond"),
    )
    return metrics.select(F.col("stream").alias("key"), F.to_json(body).alias("value"))
