import base64
import json

from pyspark.sql import functions as F

from tests.util import at, event, events
from tidemark import default_profiles
from tidemark.operators.validate import dead_letters, invalid_reason, no_profile_reason, split_valid
from tidemark.profiles import by_stream
from tidemark.schema import EVENT, RAW
from tidemark.sources.envelopes import open_envelopes
from tidemark.sources.records import (
    closed_windows, decode_alerts, decode_events, encode_alerts, encode_dead_letters, encode_events, metric_inputs,
)

GOOD = {"id": "e1", "stream": "payments", "key": "c1", "at": "2026-09-02T12:00:00.5Z", "value": -1.5, "unit": "BRL",
        "geo": {"lat": 1, "lon": 2.5, "place": "X"}, "labels": {"status": "done"}}


def raw(spark, values):
    rows = [("k", v, "events", 1, 40 + i, at(i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RAW)


def test_decode(spark):
    changed = [("id", 5), ("stream", True), ("key", ["x"]), ("at", "yesterday"), ("at", 17), ("value", "12"), ("unit", 1),
               ("geo", []), ("geo", {"lat": "1"}), ("labels", {"a": 1}), ("labels", "x")]
    texts = [json.dumps(GOOD), '{"broken":', "[1]", '"text"', None, ""]
    texts += [json.dumps({**GOOD, k: v}) for k, v in changed]
    texts += [json.dumps({**GOOD, k: None}) for k in ("id", "at", "value", "geo", "labels")]
    texts += ["null", json.dumps({**GOOD, "labels": {"a": None}}), json.dumps({**GOOD, "extra": {"x": [1]}})]
    rows = decode_events(raw(spark, texts)).orderBy("offset").collect()
    reasons = [None if r.reason is None else r.reason.removeprefix("invalid event: malformed JSON: ") for r in rows]
    assert reasons == [
        None, "not a JSON document", "not an object", "not an object", "not a JSON document", "not a JSON document",
        "id is not text", "stream is not text", "key is not text", "at is not an RFC 3339 time", "at is not an RFC 3339 time",
        "value is not a number", "unit is not text", "geo is not an object", "geo.lat is not a number",
        "labels is not an object of texts", "labels is not an object of texts",
        None, None, None, None, None, None, None, None,
    ]
    r = rows[0]
    assert (r.id, r.stream, r.key, r.value, r.unit, r.labels) == ("e1", "payments", "c1", -1.5, "BRL", {"status": "done"})
    assert (r.geo.lat, r.geo.lon, r.geo.place) == (1.0, 2.5, "X") and r.at.microsecond == 500000
    assert rows[17].id == "" and rows[18].at is None and rows[19].value == 0 and rows[20].geo is None and rows[21].labels is None
    assert rows[23].labels == {"a": ""}


def test_round_trip(spark):
    rows = events(spark, [event("a", "video", "j", 1.25, -3, (1.0, 2.0), "done", place="P"), event("b", "sensors", "s", 2)])
    records = encode_events(rows)
    assert records.filter("key = 'j'").first().timestamp.microsecond == 250000
    back = decode_events(records.withColumns({
        "topic": F.lit("t"), "partition": F.lit(0), "offset": F.lit(0).cast("long")}))
    assert back.filter("reason is not null").count() == 0
    got, want = ({r.id: r for r in df.select(EVENT.fieldNames()).collect()} for df in (back, rows))
    assert got["a"] == want["a"] and got["b"].at == want["b"].at and got["b"].geo is None


def test_validation_order_and_reasons(spark):
    rows = [event("", "telemetry", "", 0), event("a", "telemetry", "", 0), event("a", "payments", "", 0),
            {**event("a", "payments", "k", 0), "at": None}, event("a", "payments", "k", 0, 0), event("a", "payments", "k", 0, -1)]
    got = [r.r for r in events(spark, rows).select(invalid_reason().alias("r")).collect()]
    assert got == ["invalid event: empty id", 'invalid event: unknown stream "telemetry"', "invalid event: empty key",
                   "invalid event: zero event time", None, None]
    df = events(spark, rows[4:5])
    assert df.select(no_profile_reason([]).alias("r")).first().r == 'invalid event: no profile for stream "payments"'
    zero = df.withColumn("at", F.timestamp_micros(F.lit(-62135596800000000)))
    assert zero.select(invalid_reason().alias("r")).first().r == "invalid event: zero event time"


def test_dead_letters_keep_bytes_and_good_records_go_on(spark):
    source = raw(spark, [json.dumps(GOOD), '{"broken":', json.dumps({**GOOD, "key": ""})])
    valid, rejected = split_valid(decode_events(source), by_stream(default_profiles()))
    assert [r.id for r in valid.collect()] == ["e1"]
    letters = dead_letters(rejected).orderBy("offset").collect()
    assert [(r.topic, r.partition, r.offset, r.key, r.payload) for r in letters][0] == ("events", 1, 41, "k", '{"broken":')
    assert letters[1].reason == "invalid event: empty key" and letters[1].at is not None
    out = encode_dead_letters(dead_letters(rejected)).collect()
    assert {json.loads(r.value)["payload"] for r in out} == {'{"broken":', json.dumps({**GOOD, "key": ""})}


def test_metric_inputs(spark):
    texts = [json.dumps(GOOD), json.dumps({"stream": "anything", "value": 3}), json.dumps({**GOOD, "value": "3"}),
             json.dumps({**GOOD, "stream": 1}), "{not json", None, json.dumps({**GOOD, "at": "bad"}), json.dumps({**GOOD, "value": None})]
    rows = metric_inputs(raw(spark, texts)).orderBy("stream", "at").collect()
    assert sorted((r.stream, r.value) for r in rows) == [("anything", 3.0), ("payments", -1.5), ("payments", -1.5)]
    assert [r.at.replace(tzinfo=None) for r in rows if r.stream == "anything"] == [at(1).replace(tzinfo=None)]


def test_closed_windows_skip_empty(spark):
    assert closed_windows(raw(spark, ["{}", "", None])).count() == 1


def alert_json(id="a1", **more):
    return {"id": id, "rule": "velocity", "stream": "payments", "key": "c", "at": "2026-09-02T12:00:00Z",
            "detectedAt": "2026-09-02T12:00:00.042Z", "severity": "warn", "title": "t", "detail": "d",
            "evidence": {"count": 3}, "eventIds": ["x", "y"], **more}


def test_alert_round_trip(spark):
    alerts = decode_alerts(raw(spark, [json.dumps(alert_json()), json.dumps(alert_json(absence=True)), '{"id":7}'])).orderBy("offset")
    good = alerts.filter("reason is null")
    assert [r.absence for r in good.collect()] == [False, True] and alerts.filter("reason is not null").count() == 1
    encoded = encode_alerts(good).collect()
    assert json.loads(encoded[0].value)["evidence"] == {"count": 3} and "absence" not in json.loads(encoded[0].value)
    again = decode_alerts(spark.createDataFrame([(r.value,) for r in encoded], "value string"))
    assert [(r.id, r.event_ids, r.detected_at) for r in again.collect()] == [(r.id, r.event_ids, r.detected_at) for r in good.collect()]


def test_envelopes(spark):
    def pack(o):
        return base64.b64encode(json.dumps(o).encode()).decode()

    def rec(offset, value):
        return {"topic": "alerts", "partition": 0, "offset": offset, "key": "c", "value": value}

    bodies = [
        {"records": {"alerts-0": [rec(1, pack(alert_json("a"))), rec(2, "%%%"), rec(3, base64.b64encode(b"{oops").decode())],
                     "alerts-1": [rec(9, pack(alert_json("b")))]}},
        {"alert": alert_json("direct")}, {}, {"records": "nope"}, {"records": {"alerts-0": [rec(4, pack({"id": 7}))]}},
    ]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("not json",)], "body string")
    good, problems = open_envelopes(df)
    assert sorted(r.id for r in good.collect()) == ["a", "b", "direct"]
    texts = sorted(r.problem for r in problems.collect())
    assert texts == ["alerts-0@2: bad base64", "alerts-0@3: bad json: malformed JSON: not a JSON document",
                     "alerts-0@4: bad json: malformed JSON: id is not text",
                     "unrecognised event shape", "unrecognised event shape"]
