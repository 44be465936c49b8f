"""The same answers in plain SQL (DuckDB), written from the definitions: windows are
self-joins, repeats are thinned by a recursive query, tombstones by a correlated maximum.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

DAY, HOUR = 86_400_000_000, 3_600_000_000

EV = """
ev AS (
  SELECT event_id AS n, CAST(event_id AS VARCHAR) AS id,
    CASE WHEN event_type = 'purchase' THEN 'payments' WHEN event_type IN ('view','click') THEN 'video' ELSE 'sensors' END AS stream,
    'user-' || user_id AS key, ts AS "at", epoch_us(ts) AS us, CAST(round(value * 100) AS DOUBLE) AS value,
    CAST(regexp_extract(props, '[0-9]+') AS INT) AS k,
    CAST(regexp_extract(props, '[0-9]+') AS INT) >= 98 AS terminal
  FROM events
)"""

# Window, cap, stall and cooldown of a row's stream.
SIZE = 7 * DAY
CAP = "CASE stream WHEN 'sensors' THEN 8 ELSE 256 END"
AFTER = f"CASE stream WHEN 'video' THEN {2 * DAY} WHEN 'sensors' THEN {3 * DAY} END"
GRACE = f"CASE stream WHEN 'payments' THEN {HOUR} WHEN 'video' THEN {2 * HOUR} ELSE {3 * HOUR} END"

SEG = EV + f""",
lagged AS (
  SELECT *, lag(terminal) OVER k AS was_terminal, lag(us) OVER k AS was_us, lead(us) OVER k AS next_us,
    row_number() OVER k AS rn
  FROM ev WINDOW k AS (PARTITION BY stream, key ORDER BY us, n)
),
seg AS (
  SELECT *, {CAP} AS cap, {AFTER} AS after, {GRACE} AS grace,
    sum(CASE WHEN was_terminal OR us - was_us >= {AFTER} THEN 1 ELSE 0 END)
      OVER (PARTITION BY stream, key ORDER BY us, n ROWS UNBOUNDED PRECEDING) AS segment,
    sum(CASE WHEN was_terminal THEN 1 ELSE 0 END)
      OVER (PARTITION BY stream, key ORDER BY us, n ROWS UNBOUNDED PRECEDING) AS epoch
  FROM lagged
),
pairs AS (
  SELECT c.stream, c.key, c.id, c.n, c.us, c.rn, c."at", c.value, c.epoch, p.id AS p_id, p.n AS p_n, p.us AS p_us, p.rn AS p_rn, p.value AS p_value
  FROM seg c JOIN seg p ON p.stream = c.stream AND p.key = c.key AND p.segment = c.segment
    AND p.rn <= c.rn AND p.rn > c.rn - c.cap AND p.us >= c.us - {SIZE}
)"""


def sev(seen: str, limit: str) -> str:
    return f"CASE WHEN {seen} >= 2 * {limit} THEN 'critical' WHEN {seen} >= 1.25 * {limit} THEN 'warn' ELSE 'info' END"


def newest_ids(n: int, where: str = "TRUE") -> str:
    return f"array_to_string((list(p_id ORDER BY p_rn) FILTER (WHERE {where}))[-{n}:], ',')"


def duration(us: str) -> str:
    """Readable span of whole microseconds."""
    sec = f"(({us}) // 1000000)"
    tenths = f"printf('%.1f', ({us}) / 1e6)"
    return (
        f"CASE WHEN {us} < 1000000 THEN (({us}) // 1000) || 'ms' "
        f"WHEN {us} < 60000000 THEN regexp_replace({tenths}, '\\.0$', '') || 's' "
        f"WHEN {us} < 3600000000 THEN printf('%dm%02ds', {sec} // 60, {sec} % 60) "
        f"ELSE printf('%dh%02dm', {sec} // 3600, ({sec} // 60) % 60) END"
    )


def trimmed(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def compact(v: str) -> str:
    return f"""CASE WHEN abs({v}) >= 1e6 THEN {trimmed(f"printf('%.1f', {v} / 1e6)")} || 'M'
  WHEN abs({v}) >= 1e3 THEN {trimmed(f"printf('%.1f', {v} / 1e3)")} || 'K'
  WHEN abs({v}) >= 100 THEN printf('%.0f', {v}) ELSE {trimmed(f"printf('%.2f', {v})")} END"""


UNIT = "CASE stream WHEN 'payments' THEN 'BRL' WHEN 'video' THEN 'fps' ELSE 'µg/m³' END"
TITLE = """CASE stream || ' ' || rule WHEN 'payments velocity' THEN 'Card testing' WHEN 'payments geovelocity' THEN 'Impossible travel'
 WHEN 'payments zscore' THEN 'Amount anomaly' WHEN 'video velocity' THEN 'Retry storm' WHEN 'video stall' THEN 'Job stalled'
 WHEN 'video threshold' THEN 'SLA breach' WHEN 'sensors velocity' THEN 'Sensor flapping' WHEN 'sensors zscore' THEN 'Reading spike'
 WHEN 'sensors stall' THEN 'Sensor offline' WHEN 'sensors threshold' THEN 'Threshold exceeded' ELSE rule END"""

VELOCITY_MAX = "CASE stream WHEN 'payments' THEN 3 WHEN 'video' THEN 7 ELSE 6 END"
VEL = f"""
vel0 AS (
  SELECT stream, key, id, n, us, "at", epoch, count(*) AS count, us - min(p_us) AS span_us, {newest_ids(12)} AS event_ids
  FROM pairs GROUP BY stream, key, id, n, us, "at", epoch
),
vel1 AS (SELECT *, {VELOCITY_MAX} AS most,
  CASE WHEN span_us > 0 THEN round(count / (span_us / 1e6) * 100) / 100 ELSE 0 END AS per_second FROM vel0),
vel AS (SELECT *, 'velocity' AS rule, {sev('per_second', f'(most / {SIZE / 1e6})')} AS severity FROM vel1 WHERE count > most)"""

GEO = """
geo0 AS (
  SELECT s.*, s.k * 1.6::DOUBLE - 80 AS lat, s.k * 3.6::DOUBLE - 180 AS lon FROM seg s WHERE stream = 'payments'
),
geo1 AS (
  SELECT c.stream, c.key, c.id, c.n, c.us, c."at", c.epoch, p.id AS from_id, c.us - p.us AS took, p.lat AS alat, p.lon AS alon, c.lat, c.lon,
    2 * 6371 * asin(sqrt(least(1, power(sin(radians(c.lat - p.lat) / 2), 2)
      + cos(radians(p.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lon - p.lon) / 2), 2)))) AS km
  FROM geo0 c JOIN geo0 p ON p.stream = c.stream AND p.key = c.key AND p.segment = c.segment AND p.rn = c.rn - 1
  WHERE p.us >= c.us - """ + str(SIZE) + """ - c.grace
),
geo2 AS (SELECT *, CASE WHEN took = 0 THEN 'infinity'::DOUBLE ELSE km / (took / 3.6e9) END AS kmh FROM geo1),
geo AS (SELECT *, 'geovelocity' AS rule, """ + sev("kmh", "150") + """ AS severity, from_id || ',' || id AS event_ids
  FROM geo2 WHERE km >= 100 AND kmh > 150)"""

Z = f"""
z0 AS (
  SELECT stream, key, id, n, us, "at", value, epoch, count(*) FILTER (WHERE p_rn < rn) AS samples,
    avg(p_value) FILTER (WHERE p_rn < rn) AS mean, stddev_pop(p_value) FILTER (WHERE p_rn < rn) AS sd,
    {newest_ids(8)} AS event_ids
  FROM pairs WHERE stream IN ('payments', 'sensors') GROUP BY stream, key, id, n, us, "at", value, epoch
),
z1 AS (SELECT *, abs(value - mean) AS delta, abs(value - mean) / sd AS z, CASE stream WHEN 'payments' THEN 1.5 ELSE 2.0 END AS k
  FROM z0 WHERE sd > 0 AND samples >= CASE stream WHEN 'payments' THEN 2 ELSE 5 END),
zs AS (SELECT *, 'zscore' AS rule, {sev('z', 'k')} AS severity FROM z1
  WHERE z > k AND delta >= 1000 AND (stream = 'payments' OR value >= mean))"""

BAD = "(stream = 'video' AND {v} < 6000 OR stream = 'sensors' AND {v} > 2000)"
HELD_AT_LEAST = f"CASE stream WHEN 'video' THEN {36 * HOUR} ELSE {24 * HOUR} END"
THR = f"""
brk AS (
  SELECT stream, key, id, max(p_rn) FILTER (WHERE NOT {BAD.format(v='p_value')}) AS broken
  FROM pairs WHERE {BAD.format(v='value')} GROUP BY stream, key, id
),
thr0 AS (
  SELECT p.stream, p.key, p.id, p.n, p.us, p."at", p.value, p.epoch, count(*) AS samples, p.us - min(p_us) AS held, {newest_ids(12)} AS event_ids
  FROM pairs p JOIN brk b ON b.stream = p.stream AND b.key = p.key AND b.id = p.id WHERE p_rn > coalesce(broken, -1)
  GROUP BY p.stream, p.key, p.id, p.n, p.us, p."at", p.value, p.epoch
),
thr1 AS (SELECT *, {HELD_AT_LEAST} AS need FROM thr0),
thr AS (SELECT *, 'threshold' AS rule, {sev('held', 'need')} AS severity FROM thr1 WHERE held >= need)"""

STALL = """
st AS (
  SELECT *, 'stall' AS rule, us + after AS due FROM seg
  WHERE after IS NOT NULL AND NOT terminal AND (next_us IS NULL OR next_us >= us + after) AND us + after <= epoch_us(TIMESTAMP '{as_of}')
)"""
ST = STALL.format(as_of="2024-02-01 00:00:00")

VEL_TEXT = f"count || ' events in ' || {duration('span_us')} || ' (limit ' || most || ' per 168h00m)'"
GEO_TEXT = (
    f"printf('%.2f,%.2f', alat, alon) || ' → ' || printf('%.2f,%.2f', lat, lon) || ' · ' || {compact('km')} || ' km in ' "
    f"|| {duration('took')} || ' · ' || {compact('kmh')} || ' km/h'"
)
Z_TEXT = (
    f"{compact('value')} || ' ' || {UNIT} || ' is ' || printf('%.1f', z) || 'σ ' || CASE WHEN value < mean THEN 'below' ELSE 'above' END "
    f"|| ' this key''s mean of ' || {compact('mean')} || ' (n=' || samples || ')'"
)
THR_TEXT = (
    f"{compact('value')} || ' ' || {UNIT} || CASE stream WHEN 'video' THEN ' — below 6K for ' ELSE ' — above 2K for ' END "
    f"|| {duration('held')} || ' across ' || samples || ' samples'"
)
STALL_TEXT = f"'no events for ' || (after // {HOUR}) || 'h00m (expected within ' || (after // {HOUR}) || 'h00m)'"

COOLED = f"""
cand AS (
  SELECT rule, stream, key, id, n, us, "at", epoch, severity, event_ids, {VEL_TEXT} AS detail FROM vel UNION ALL
  SELECT rule, stream, key, id, n, us, "at", epoch, severity, event_ids, {GEO_TEXT} AS detail FROM geo UNION ALL
  SELECT rule, stream, key, id, n, us, "at", epoch, severity, event_ids, {Z_TEXT} AS detail FROM zs UNION ALL
  SELECT rule, stream, key, id, n, us, "at", epoch, severity, event_ids, {THR_TEXT} AS detail FROM thr
),
numbered AS (
  SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END AS rank,
    row_number() OVER (PARTITION BY stream, key, rule, epoch ORDER BY us, n) AS i
  FROM cand
),
fold AS (
  SELECT stream, key, rule, epoch, i, id, TRUE AS ok, us + {DAY} AS until, rank AS held FROM numbered WHERE i = 1
  UNION ALL
  SELECT c.stream, c.key, c.rule, c.epoch, c.i, c.id, c.us >= f.until OR c.rank > f.held,
    CASE WHEN c.us >= f.until OR c.rank > f.held THEN c.us + {DAY} ELSE f.until END,
    CASE WHEN c.us >= f.until OR c.rank > f.held THEN c.rank ELSE f.held END
  FROM fold f JOIN numbered c ON c.stream = f.stream AND c.key = f.key AND c.rule = f.rule AND c.epoch = f.epoch AND c.i = f.i + 1
),
admitted AS (
  SELECT c.rule, c.stream, c.key, c."at", c."at" AS detected_at, c.severity, c.event_ids, FALSE AS absence, c.detail
  FROM fold f JOIN numbered c ON c.stream = f.stream AND c.key = f.key AND c.rule = f.rule AND c.id = f.id WHERE f.ok
  UNION ALL
  SELECT rule, stream, key, "at", make_timestamp(due), 'info', id, TRUE, {STALL_TEXT} FROM st
)"""

ALL_RULES = SEG + "," + VEL + "," + GEO + "," + Z + "," + THR + "," + ST + "," + COOLED
ALERTS = f'SELECT rule, stream, key, "at", detected_at, severity, {TITLE} AS title, event_ids, absence, detail FROM admitted'

# Validation and dead letters.

SQL["validate_split"] = f"""
WITH {EV}
SELECT n AS event_id, CASE n % 50 WHEN 7 THEN 'invalid event: empty id' WHEN 13 THEN 'invalid event: unknown stream "telemetry"'
  WHEN 11 THEN 'invalid event: empty key' WHEN 17 THEN 'invalid event: zero event time' ELSE 'valid' END AS reason FROM ev
"""

DLQ = EV + """,
dl AS (
  SELECT 'events' AS topic, CAST(n % 4 AS INT) AS partition, n AS "offset", key, "at",
    CASE n % 40 WHEN 3 THEN 'invalid event: malformed JSON: not a JSON document' WHEN 5 THEN 'invalid event: malformed JSON: id is not text'
      WHEN 9 THEN 'invalid event: malformed JSON: value is not a number' WHEN 15 THEN 'invalid event: malformed JSON: not an object'
      WHEN 21 THEN 'invalid event: empty id' END AS reason,
    CASE n % 40 WHEN 3 THEN '{"broken":' WHEN 5 THEN '{"id":' || n || '}' WHEN 9 THEN '{"id":"x","value":"12"}'
      WHEN 15 THEN '[1,2]' WHEN 21 THEN '{"stream":"video"}' END AS payload
  FROM ev WHERE n % 40 IN (3, 5, 9, 15, 21)
)"""
SQL["dead_letter_records"] = f'WITH {DLQ} SELECT topic, partition, "offset", key, reason, payload FROM dl'
SQL["first_dead_letters"] = f'WITH {DLQ} SELECT partition, "offset", reason FROM dl ORDER BY partition, "offset" LIMIT 20'
SQL["dead_letter_retention"] = f"""WITH {DLQ}
SELECT partition, "offset", "at" FROM dl WHERE "at" > TIMESTAMP '2024-02-01' - INTERVAL 7 DAY"""
SQL["terminal_events"] = f"""
WITH {EV} SELECT id, CASE WHEN k >= 98 THEN 'done' ELSE 'running' END AS status, terminal, '' AS codec FROM ev"""

# Rules.

SQL["velocity"] = f"""
WITH {SEG}, {VEL}
SELECT stream, key, id, "at", severity, {TITLE} AS title,
  {VEL_TEXT} AS detail,
  count, span_us // 1000 AS span_ms, per_second, event_ids FROM vel"""
SQL["geovelocity"] = f"""
WITH {SEG}, {GEO}
SELECT stream, key, id, severity, {TITLE} AS title, printf('%.2f,%.2f', alat, alon) AS from_place,
  printf('%.2f,%.2f', lat, lon) AS to_place, round(km * 10) / 10 AS distance_km, round(took / 1e6, 3) AS seconds, event_ids, {GEO_TEXT} AS detail FROM geo"""
SQL["zscore"] = f"""
WITH {SEG}, {Z}
SELECT stream, key, id, severity, {TITLE} AS title, value, samples, round(sd * 100) / 100 AS stddev, round(z * 100) / 100 AS z, event_ids, {Z_TEXT} AS detail FROM zs"""
SQL["threshold"] = f"""
WITH {SEG}, {THR}
SELECT stream, key, id, severity, {TITLE} AS title, value, held // 1000 AS held_ms, samples, event_ids, {THR_TEXT} AS detail FROM thr"""
SQL["stall"] = f"""
WITH {SEG}, {ST}
SELECT stream, key, id, "at", make_timestamp(due) AS detected_at, 'info' AS severity, {TITLE} AS title,
  {STALL_TEXT} AS detail,
  after // 1000 AS idle_ms, value AS last_value, TRUE AS absence FROM st"""

# Windows.

SQL["window_statistics"] = f"""
WITH {SEG},
held AS (
  SELECT c.stream, c.key, c.id, count(*) AS retained FROM seg c JOIN seg p ON p.stream = c.stream AND p.key = c.key AND p.segment = c.segment
    AND p.rn <= c.rn AND p.rn > c.rn - c.cap AND p.us >= c.us - {SIZE} - c.grace GROUP BY ALL
),
w AS (
  SELECT stream, key, id, count(*) AS count, avg(p_value) AS mean, stddev_pop(p_value) AS sd, us - min(p_us) AS span,
    max(p_id) FILTER (WHERE p_rn = rn - 1) AS previous_id
  FROM pairs GROUP BY stream, key, id, us
)
SELECT stream, key, id, count, round(mean, 6) AS mean, round(sd, 4) AS stddev, span // 1000 AS span_ms,
  CASE WHEN span > 0 THEN round(count / (span / 1e6) * 100) / 100 ELSE 0 END AS per_second, previous_id, id AS last_id, retained
FROM w JOIN held USING (stream, key, id)"""
SQL["segments"] = f"WITH {SEG} SELECT stream, key, id, CAST(segment AS BIGINT) AS segment FROM seg"
MARK = EV + f""",
arr AS (SELECT *, (n + (n * 7919) % 499) * 10000 + n % 10000 AS seq FROM ev),
mk AS (SELECT stream, key, id, "at", max("at") OVER (PARTITION BY stream, key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark FROM arr)"""
LATE = '"at" < mark - INTERVAL 3 HOUR'
SQL["late_filter"] = f"WITH {MARK} SELECT stream, key, id, mark, {LATE} AS late FROM mk"
SQL["late_by_key"] = f"WITH {MARK} SELECT stream, key, count(*) FILTER (WHERE {LATE}) AS late, max(mark) AS mark FROM mk GROUP BY ALL"

# Detection as a whole.

SQL["alerts"] = f"WITH RECURSIVE {ALL_RULES} {ALERTS}"
SQL["alerts_by_rule"] = f"WITH RECURSIVE {ALL_RULES} SELECT stream, rule, count(*) AS alerts FROM admitted GROUP BY ALL"
FAULTY = ALL_RULES.replace("FROM events\n", "FROM events WHERE event_id % 50 NOT IN (7, 11, 13, 17)\n")
SQL["engine_counters"] = f"""
WITH RECURSIVE {FAULTY}
SELECT (SELECT count(*) FROM ev) AS processed, (SELECT count(*) FROM admitted) AS alerted,
  (SELECT count(*) FROM cand) + (SELECT count(*) FROM st) - (SELECT count(*) FROM admitted) AS suppressed,
  CAST(0 AS BIGINT) AS late, (SELECT count(*) FROM st) AS swept, (SELECT count(*) FROM events WHERE event_id % 50 IN (7, 11, 13, 17)) AS invalid"""
# On a stream, silence is known once the watermark, an hour behind, has passed it.
TILL_MARK = "us + after <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - " + str(HOUR)
SQL["streamed_alerts"] = "WITH RECURSIVE " + ALL_RULES.replace(
    "(next_us IS NULL OR next_us >= us + after) AND us + after <= epoch_us(TIMESTAMP '2024-02-01 00:00:00')",
    f"(next_us >= us + after OR next_us IS NULL AND {TILL_MARK})",
) + " " + ALERTS

# Aggregates and statistics.


def metrics(source: str, hours: int) -> str:
    up = lambda e: f"floor({e} * 100 + 0.5) / 100"
    return f"""met AS (
  SELECT stream, time_bucket(INTERVAL {hours} HOUR, "at", TIMESTAMP '1970-01-01') AS window_start, count(*) AS count,
    {up('sum(value)')} AS sum, {up('sum(value) / count(*)')} AS mean, {up('min(value)')} AS min, {up('max(value)')} AS max,
    {up(f'(count(*) * 1000.0::DOUBLE / {hours * 3_600_000}.0::DOUBLE)')} AS per_second
  FROM {source} GROUP BY ALL)"""


MET = "stream, window_start, window_start + INTERVAL {h} HOUR AS window_end, count, sum, mean, min, max, per_second"
SQL["tumbling_metrics"] = f"WITH {EV}, {metrics('ev', 6)} SELECT {MET.format(h=6)} FROM met"
SQL["latest_window"] = f"""WITH {EV}, {metrics('ev', 6)}
SELECT {MET.format(h=6)} FROM met m WHERE window_start = (SELECT max(window_start) FROM met x
  WHERE x.stream = m.stream AND x.window_start + INTERVAL 6 HOUR <= (SELECT max("at") FROM ev) - INTERVAL 1 HOUR)"""
GOOD = EV + """,
good AS (SELECT stream, date_trunc('millisecond', "at") AS "at", value FROM ev WHERE n % 40 NOT IN (3, 5, 9, 15, 21))"""
SQL["streamed_metrics"] = f"""WITH {GOOD}, {metrics('good', 24)}
SELECT {MET.format(h=24)} FROM met WHERE window_start + INTERVAL 24 HOUR <= (SELECT max("at") FROM good) - INTERVAL 1 HOUR"""

HIST = EV + """,
hist AS (
  SELECT 'a-' || n AS id, n, stream, key, "at", us, value,
    CASE WHEN n % 17 = 0 THEN -1500000 ELSE (n * 7919) % 1000003 END AS delay,
    CASE WHEN n % 11 = 0 THEN 'stall' WHEN n % 3 = 0 THEN 'velocity' WHEN n % 3 = 1 THEN 'zscore' ELSE 'threshold' END AS rule,
    CASE WHEN n % 7 = 0 THEN 'critical' WHEN n % 7 < 3 THEN 'warn' ELSE 'info' END AS severity, n % 11 = 0 AS absence
  FROM ev
),
al AS (SELECT *, make_timestamp(us + delay) AS detected_at, CASE WHEN NOT absence AND delay >= 0 THEN delay END AS usable FROM hist)"""
LATENCY = """
newest AS (SELECT usable FROM al WHERE usable IS NOT NULL ORDER BY detected_at DESC, id DESC LIMIT 2000),
ranked AS (SELECT usable, row_number() OVER (ORDER BY usable) - 1 AS i, count(*) OVER () AS m FROM newest),
lat AS (
  SELECT (SELECT count(usable) FROM al) AS count,
    max(usable) FILTER (WHERE i = least(floor(CAST(0.5 AS DOUBLE) * m), m - 1)) / 1000.0::DOUBLE AS p50_ms,
    max(usable) FILTER (WHERE i = least(floor(CAST(0.95 AS DOUBLE) * m), m - 1)) / 1000.0::DOUBLE AS p95_ms,
    max(usable) FILTER (WHERE i = least(floor(CAST(0.99 AS DOUBLE) * m), m - 1)) / 1000.0::DOUBLE AS p99_ms,
    (SELECT max(usable) FROM al) / 1000.0::DOUBLE AS max_ms, max(usable) / 1000.0::DOUBLE AS retained_max_ms
  FROM ranked
)"""
SQL["latency_percentiles"] = f"WITH {HIST}, {LATENCY} SELECT * FROM lat"
SQL["latency_classes"] = f"""WITH {HIST}
SELECT CASE WHEN absence THEN 'absence' WHEN delay < 0 THEN 'skewed' ELSE 'usable' END AS latency_class, count(*) AS alerts FROM al GROUP BY ALL"""
SQL["rates"] = f"""
WITH {EV}, c AS (SELECT us // {HOUR} AS i, count(*) AS n FROM ev GROUP BY ALL),
f AS (SELECT i, n FROM c UNION ALL SELECT i + 1, 0 FROM c WHERE i + 1 NOT IN (SELECT i FROM c))
SELECT make_timestamp(i * {HOUR}) AS interval_start, CAST(n AS BIGINT) AS count, round(n / 3600.0::DOUBLE, 9) AS per_second,
  CAST(sum(n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM f"""
SQL["sample_every"] = f"""
WITH {EV}, c AS (SELECT us // {6 * HOUR} AS i, count(*) AS m FROM ev GROUP BY ALL),
r AS (SELECT id, us // {6 * HOUR} AS i, row_number() OVER (ORDER BY us, n) AS number FROM ev),
e AS (SELECT r.id, r.number, greatest(1, CAST(floor(coalesce(c.m, 0) / 21600.0::DOUBLE / 0.001::DOUBLE) AS BIGINT)) AS every
  FROM r LEFT JOIN c ON c.i = r.i - 1)
SELECT id, number, every FROM e WHERE number % every = 0"""
RECENT_HOUR = "{t} >= TIMESTAMP '2024-01-29 23:00:00' AND {t} < TIMESTAMP '2024-01-30'"
SQL["summary"] = f"""
WITH {HIST}, {LATENCY}, {metrics('ev', 6)},
s AS (SELECT (SELECT count(*) FROM ev WHERE {RECENT_HOUR.format(t='"at"')}) / 3600.0::DOUBLE AS eps,
  (SELECT count(*) FROM al WHERE {RECENT_HOUR.format(t='detected_at')}) / 3600.0::DOUBLE AS aps)
SELECT trunc(eps * 10 + 0.5) / 10 AS events_per_second, trunc(aps * 10 + 0.5) / 10 AS alerts_per_second,
  (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM al) AS alerts, lat.*,
  greatest(1, CAST(floor(eps / 0.001::DOUBLE) AS BIGINT)) AS sample_every,
  (SELECT count(*) FROM al WHERE absence) AS absence_alerts, (SELECT count(*) FROM al WHERE NOT absence AND delay < 0) AS clock_skewed,
  (SELECT count(*) FROM met) AS windows FROM s, lat"""
SQL["flow_counters"] = f"""
WITH {HIST}, g AS (SELECT * FROM ev WHERE n % 40 NOT IN (3, 5, 9, 15, 21)),
last AS (SELECT stream, key, max(us) AS us, arg_max(terminal, us) AS finished FROM g GROUP BY ALL)
SELECT (SELECT count(*) FROM ev) AS consumed, (SELECT count(*) FROM ev WHERE n % 40 IN (3, 5, 9, 15, 21)) AS dead_letters,
  (SELECT count(*) FROM al) AS alerts,
  (SELECT usable // 1000 FROM al WHERE usable IS NOT NULL ORDER BY detected_at DESC, id DESC LIMIT 1) AS latency_ms,
  (SELECT count(*) FROM last WHERE NOT finished AND coalesce(us + {AFTER} > epoch_us(TIMESTAMP '2024-02-01'), TRUE)) AS live_keys"""

# Alert storage.

ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%S.%fZ')"
ROWS = HIST + f""",
rows AS (
  SELECT 'ALERT#' || stream || '#' || key AS pk, {ISO.format(t='detected_at')} || '#' || id AS sk, id AS alert_id, rule, stream,
    key AS entity_key, severity, CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END AS severity_rank, rule AS title,
    'value ' || CAST(value AS BIGINT) AS detail, '{{"value":' || CAST(value AS BIGINT) || '}}' AS evidence, CAST(n AS VARCHAR) AS event_ids,
    {ISO.format(t='"at"')} AS "at", {ISO.format(t='detected_at')} AS detected_at, usable // 1000 AS latency_ms, absence,
    CAST(floor(epoch_us(detected_at) / 1e6) AS BIGINT) + 30 * 86400 AS expires_at, CAST(detected_at AS DATE) AS day, n
  FROM al
)"""
SQL["alert_rows"] = f"WITH {ROWS} SELECT * EXCLUDE (n) FROM rows"
SQL["idempotent_insert"] = f"""
WITH {ROWS}
SELECT stream, pk, count(*) AS rows, count(DISTINCT sk) AS distinct_rows,
  (SELECT count(*) FROM rows WHERE n % 3 = 0) AS written_first, (SELECT count(*) FROM rows WHERE n % 3 <> 0) AS written_then,
  2 * (SELECT count(*) FROM rows WHERE n % 3 = 0) AS skipped_then, CAST(0 AS BIGINT) AS errors
FROM rows GROUP BY stream, pk"""
SQL["retention"] = f"WITH {ROWS} SELECT pk, sk, expires_at FROM rows WHERE expires_at > epoch(TIMESTAMP '2024-02-15')"
SQL["recent_alerts"] = f"WITH {HIST} SELECT id, detected_at, severity FROM al ORDER BY detected_at DESC, id DESC LIMIT 60"
SQL["recent_alerts_of_stream"] = f"""WITH {HIST}
SELECT id, stream, detected_at FROM al WHERE stream = 'payments' ORDER BY detected_at DESC, id DESC LIMIT 20"""
SQL["entity_alerts"] = f"WITH {ROWS} SELECT pk, sk, rule, severity FROM rows WHERE stream = 'video' AND entity_key = 'user-7' ORDER BY sk DESC"
SQL["severity_ranked"] = f"""WITH {ROWS}
SELECT alert_id, severity, severity_rank, detected_at FROM rows ORDER BY severity_rank DESC, detected_at DESC, alert_id DESC"""
SQL["parse_envelope"] = f"""WITH {HIST}
SELECT id, rule, stream, key, severity, "at", detected_at, 'value ' || CAST(value AS BIGINT) AS detail, CAST(n AS VARCHAR) AS event_ids, absence
FROM al WHERE n % 100 = 0 OR n % 29 NOT IN (1, 2)"""
SQL["envelope_problems"] = f"""WITH {EV}
SELECT 'alerts-0' AS source, n AS "offset",
  'alerts-0@' || n || CASE n % 29 WHEN 1 THEN ': bad base64' ELSE ': bad json: malformed JSON: not a JSON document' END AS problem
FROM ev WHERE n % 100 <> 0 AND n % 29 IN (1, 2)"""

# Change log.

SNAP = SEG + f""",
ends AS (
  SELECT stream, key, max(us) AS mark, max(segment) AS segment, arg_max(terminal, (us, n)) AS finished,
    max(us) + {AFTER} <= epoch_us(TIMESTAMP '2024-01-31') AS silent
  FROM seg GROUP BY stream, key
),
kept AS (
  SELECT s.stream, s.key, s.id, s.us, s.n, s."at", s.value, s.cap, row_number() OVER (PARTITION BY s.stream, s.key ORDER BY s.us DESC, s.n DESC) AS i
  FROM seg s JOIN ends e ON e.stream = s.stream AND e.key = s.key AND e.segment = s.segment
  WHERE NOT e.finished AND NOT coalesce(e.silent, FALSE) AND s.us >= e.mark - {SIZE}
)"""
SQL["window_snapshot"] = f"""
WITH {SNAP}, pts AS (SELECT stream, key, count(*) AS points, string_agg(id, ',' ORDER BY us, n) AS ids FROM kept WHERE i <= cap GROUP BY ALL)
SELECT stream, key, coalesce(points, 0) AS points, ids AS point_ids FROM ends LEFT JOIN pts USING (stream, key)"""
SQL["warm_start"] = f"""
WITH {SNAP} SELECT stream, key, count(*) AS points, max("at") AS newest, arg_max(value, (us, n)) AS last_value FROM kept WHERE i <= cap GROUP BY ALL"""
SQL["compact_changelog"] = f"""
WITH {EV},
log AS (SELECT CASE WHEN n % 31 = 0 THEN 'telemetry' ELSE stream END AS stream, key, n, id, "at", n % 5 = 0 AS tomb FROM ev
  WHERE n % 37 <> 0 AND (n % 5 = 0 OR n % 23 <> 0)),
top AS (SELECT stream, key, max(n) AS n FROM log WHERE stream <> 'telemetry' GROUP BY ALL)
SELECT stream, key AS id, n AS "offset", log.id AS point_id, "at" AS written FROM log JOIN top USING (stream, key, n) WHERE NOT tomb"""

# Scalars.


SQL["compact_text"] = f"""
WITH {EV}, t AS (SELECT *, value * 250.0::DOUBLE AS big, value / 100.0::DOUBLE AS small_, n * 7919 * 1000 % 20000000000 AS span FROM ev)
SELECT id, {compact('big')} AS large, {compact('small_')} AS small, {duration('span')} AS duration,
  CASE WHEN stream = 'video' THEN '?' ELSE printf('%.2f,%.2f', k * 1.6::DOUBLE - 80, k * 3.6::DOUBLE - 180) END AS place FROM t"""
SQL["state_keys"] = f"WITH {EV} SELECT stream || '/' || key || '/' || id AS state_key, stream, key || '/' || id AS entity FROM ev"
SQL["distances"] = f"""
WITH {EV}, g AS (SELECT id, k * 1.6::DOUBLE - 80 AS lat, k * 3.6::DOUBLE - 180 AS lon FROM ev WHERE stream <> 'video')
SELECT id, round(2 * 6371 * asin(sqrt(least(1, power(sin(radians(-23.5505 - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(-23.5505)) * power(sin(radians(-46.6333 - lon) / 2), 2)))), 6) AS km FROM g"""


# Two rules of one kind on one stream.


def past(which: int, bad: str, need: int) -> str:
    return f"""
brk{which} AS (
  SELECT stream, key, id, max(p_rn) FILTER (WHERE NOT p_{bad}) AS broken FROM pairs WHERE {bad} AND stream = 'sensors' GROUP BY stream, key, id
),
thr{which} AS (
  SELECT p.stream, p.key, p.id, p.n, p.us, p."at", p.value, p.epoch, {which} AS which, count(*) AS samples, p.us - min(p_us) AS held, {need} AS need, {newest_ids(12)} AS event_ids
  FROM pairs p JOIN brk{which} b ON b.stream = p.stream AND b.key = p.key AND b.id = p.id WHERE p_rn > coalesce(broken, -1)
  GROUP BY p.stream, p.key, p.id, p.n, p.us, p."at", p.value, p.epoch
)"""


SQL["several_bounds"] = f"""
WITH RECURSIVE {SEG},{past(0, "value > 2000", 24 * HOUR)},{past(1, "value < 3000", 12 * HOUR)},{ST},
cand AS (
  SELECT *, {sev("held", "need")} AS severity,
    {compact("value")} || ' µg/m³ — ' || CASE which WHEN 0 THEN 'above 2K' ELSE 'below 3K' END || ' for ' || {duration("held")} || ' across ' || samples || ' samples' AS detail
  FROM (FROM thr0 UNION ALL FROM thr1) WHERE held >= need
),
numbered AS (
  SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END AS rank, row_number() OVER (PARTITION BY key, epoch ORDER BY us, n, which) AS i FROM cand
),
fold AS (
  SELECT key, epoch, i, TRUE AS ok, us + {DAY} AS until, rank AS held FROM numbered WHERE i = 1
  UNION ALL
  SELECT c.key, c.epoch, c.i, c.us >= f.until OR c.rank > f.held, CASE WHEN c.us >= f.until OR c.rank > f.held THEN c.us + {DAY} ELSE f.until END,
    CASE WHEN c.us >= f.until OR c.rank > f.held THEN c.rank ELSE f.held END
  FROM fold f JOIN numbered c ON c.key = f.key AND c.epoch = f.epoch AND c.i = f.i + 1
)
SELECT 'threshold' AS rule, stream, key, "at", "at" AS detected_at, severity, 'Threshold exceeded' AS title, detail, event_ids, FALSE AS absence
FROM numbered JOIN fold USING (key, epoch, i) WHERE ok
UNION ALL
SELECT 'offline', stream, key, "at", make_timestamp(due), 'info', 'offline', 'last value ' || CAST(value AS BIGINT), id, TRUE FROM st WHERE stream = 'sensors'
"""

SQL["compact_in_steps"] = SQL["compact_changelog"]

# In arrival order: each step of a recursive query takes one more arrival of every key, with the key's points, mark and stall cooldown as its state.

SEQ = "(n + (n * 7919) % 499) * 10000 + n % 10000"
DUE = (
    "least(greatest(pts[-1].us + after, until), CASE WHEN held < 1 THEN pts[-1].us + after WHEN held < 2 THEN pts[-1].us + CAST(ceil(after * 1.25) AS BIGINT) "
    "WHEN held < 3 THEN pts[-1].us + 2 * after END)"
)
GRADE = "CASE WHEN due - pts[-1].us >= 2 * after THEN 3 WHEN (due - pts[-1].us) * 4 >= after * 5 THEN 2 ELSE 1 END"
POINT = "STRUCT(us BIGINT, seq BIGINT, id VARCHAR, value DOUBLE, k INT)"
REPLAY = EV + f""",
arrival AS (
  SELECT *, {SEQ} AS seq, {CAP} AS cap, {AFTER} AS after, {GRACE} AS grace, row_number() OVER (PARTITION BY stream, key ORDER BY {SEQ}) AS i FROM ev
),
walk AS (
  SELECT stream, key, 0::BIGINT AS i, []::{POINT}[] AS pts, NULL::BIGINT AS mark, NULL::BIGINT AS clock, 0::BIGINT AS until, 0 AS held,
    NULL::BIGINT AS n, NULL::BIGINT AS us, NULL::DOUBLE AS value, NULL::INT AS k, NULL::BIGINT AS seq, FALSE AS late, FALSE AS terminal,
    NULL::{POINT}[] AS win, NULL::{POINT} AS prev, NULL::{POINT} AS silent, NULL::BIGINT AS due, NULL::INT AS grade
  FROM (SELECT DISTINCT stream, key FROM arrival)
  UNION ALL
  SELECT stream, key, i, CASE WHEN terminal AND NOT late THEN [] ELSE pts END, CASE WHEN terminal AND NOT late THEN NULL ELSE mark END, clock,
    CASE WHEN terminal AND NOT late THEN 0 ELSE until END, CASE WHEN terminal AND NOT late THEN 0 ELSE held END,
    n, us, value, k, seq, late, terminal, CASE WHEN NOT late THEN list_filter(pts, lambda x: x.us >= mark - {SIZE}) END,
    CASE WHEN NOT late THEN list_filter(pts, lambda x: x.us <= us AND x.seq <> seq)[-1] END, silent, due, grade
  FROM (
    SELECT * REPLACE (CASE WHEN late THEN pts ELSE list_sort(list_filter(list_append(pts, {{'us': us, 'seq': seq, 'id': id, 'value': value, 'k': k}}), lambda x: x.us >= mark - {SIZE} - grace))[-cap:] END AS pts)
    FROM (
      SELECT *, us < mark - {SIZE} - grace AS late FROM (
        SELECT * REPLACE (CASE WHEN stalls THEN us ELSE greatest(coalesce(mark, us), us) END AS mark, CASE WHEN stalls THEN [] ELSE pts END AS pts,
          CASE WHEN stalls THEN due + {DAY} ELSE until END AS until, CASE WHEN stalls THEN grade ELSE held END AS held,
          CASE WHEN stalls THEN due END AS due, CASE WHEN stalls THEN grade END AS grade), CASE WHEN stalls THEN pts[-1] END AS silent
        FROM (
          SELECT *, due <= clock AS stalls, {GRADE} AS grade FROM (
            SELECT e.stream, e.key, e.i, e.n, e.id, e.us, e.value, e.k, e.seq, e.terminal, e.cap, e.after, e.grace, w.pts, w.mark, w.until, w.held,
              greatest(coalesce(w.clock, e.us), e.us) AS clock, CASE WHEN len(pts) > 0 AND after IS NOT NULL THEN {DUE} END AS due
            FROM walk w JOIN arrival e ON e.stream = w.stream AND e.key = w.key AND e.i = w.i + 1
          )
        )
      )
    )
  )
),
ended AS (
  SELECT *, {GRADE} AS grade FROM (
    SELECT w.stream, w.key, w.pts, a.after, CASE WHEN len(pts) > 0 AND after IS NOT NULL THEN {DUE} END AS due
    FROM walk w JOIN arrival a ON a.stream = w.stream AND a.key = w.key AND a.i = w.i
    WHERE w.i = (SELECT max(i) FROM arrival x WHERE x.stream = w.stream AND x.key = w.key)
  ) WHERE due <= epoch_us(TIMESTAMP '2024-02-01')
),
silence AS (
  SELECT 'stall' AS rule, *, due - last.us AS idle, {AFTER} AS after FROM (
    SELECT stream, key, silent AS last, due, grade FROM walk WHERE silent IS NOT NULL UNION ALL SELECT stream, key, pts[-1], due, grade FROM ended
  )
),
seen AS (
  SELECT stream, key, CAST(n AS VARCHAR) AS id, n, us, make_timestamp(us) AS "at", value, k, seq, clock, win, prev, {GRACE} AS grace,
    coalesce(sum(CASE WHEN terminal AND NOT late THEN 1 END) OVER (PARTITION BY stream, key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch,
    late
  FROM walk WHERE i > 0
),
frame AS (SELECT * FROM seen WHERE NOT late),
vel1 AS (
  SELECT *, CASE WHEN span_us > 0 THEN round(count / (span_us / 1e6) * 100) / 100 ELSE 0 END AS per_second FROM (
    SELECT *, {VELOCITY_MAX} AS most, len(win) AS count, win[-1].us - win[1].us AS span_us, win[-12:] AS picked FROM frame)
),
vel AS (SELECT *, 'velocity' AS rule, {sev('per_second', f'(most / {SIZE / 1e6})')} AS severity FROM vel1 WHERE count > most),
geo1 AS (
  SELECT *, us - prev.us AS took, prev.k * 1.6::DOUBLE - 80 AS alat, prev.k * 3.6::DOUBLE - 180 AS alon, k * 1.6::DOUBLE - 80 AS lat, k * 3.6::DOUBLE - 180 AS lon
  FROM frame WHERE stream = 'payments' AND prev IS NOT NULL
),
geo2 AS (
  SELECT *, CASE WHEN took = 0 THEN 'infinity'::DOUBLE ELSE km / (took / 3.6e9) END AS kmh FROM (
    SELECT *, 2 * 6371 * asin(sqrt(least(1, power(sin(radians(lat - alat) / 2), 2) + cos(radians(alat)) * cos(radians(lat)) * power(sin(radians(lon - alon) / 2), 2)))) AS km FROM geo1)
),
geo AS (SELECT *, 'geovelocity' AS rule, {sev('kmh', '150')} AS severity, [prev, {{'us': us, 'seq': seq, 'id': id, 'value': value, 'k': k}}] AS picked FROM geo2 WHERE km >= 100 AND kmh > 150),
z1 AS (
  SELECT * EXCLUDE (k), abs(value - mean) AS delta, abs(value - mean) / sd AS z, CASE stream WHEN 'payments' THEN 1.5 ELSE 2.0 END AS k FROM (
    SELECT *, len(win) - 1 AS samples, list_avg(list_transform(win[1:len(win) - 1], lambda x: x.value)) AS mean,
      list_stddev_pop(list_transform(win[1:len(win) - 1], lambda x: x.value)) AS sd, win[-8:] AS picked FROM frame WHERE stream IN ('payments', 'sensors') AND len(win) > 1
  ) WHERE sd > 0 AND samples >= CASE stream WHEN 'payments' THEN 2 ELSE 5 END
),
zs AS (SELECT *, 'zscore' AS rule, {sev('z', 'k')} AS severity FROM z1 WHERE z > k AND delta >= 1000 AND (stream = 'payments' OR value >= mean)),
thr1 AS (
  SELECT *, len(win) - broken AS samples, win[-1].us - win[broken + 1].us AS held, {HELD_AT_LEAST} AS need, win[broken + 1:][-12:] AS picked FROM (
    SELECT *, coalesce(list_max(list_filter(range(1, len(win)), lambda j: NOT {BAD.format(v="win[j].value")})), 0) AS broken FROM frame WHERE {BAD.format(v="value")})
),
thr AS (SELECT *, 'threshold' AS rule, {sev('held', 'need')} AS severity FROM thr1 WHERE held >= need),
cand AS (
  SELECT rule, stream, key, id, clock, seq, "at", epoch, severity, picked, {VEL_TEXT} AS detail FROM vel UNION ALL
  SELECT rule, stream, key, id, clock, seq, "at", epoch, severity, picked, {GEO_TEXT} AS detail FROM geo UNION ALL
  SELECT rule, stream, key, id, clock, seq, "at", epoch, severity, picked, {Z_TEXT} AS detail FROM zs UNION ALL
  SELECT rule, stream, key, id, clock, seq, "at", epoch, severity, picked, {THR_TEXT} AS detail FROM thr
),
numbered AS (
  SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END AS rank, row_number() OVER (PARTITION BY stream, key, rule, epoch ORDER BY clock, seq) AS j FROM cand
),
fold AS (
  SELECT stream, key, rule, epoch, j, TRUE AS ok, clock + {DAY} AS until, rank AS held FROM numbered WHERE j = 1
  UNION ALL
  SELECT c.stream, c.key, c.rule, c.epoch, c.j, c.clock >= f.until OR c.rank > f.held,
    CASE WHEN c.clock >= f.until OR c.rank > f.held THEN c.clock + {DAY} ELSE f.until END, CASE WHEN c.clock >= f.until OR c.rank > f.held THEN c.rank ELSE f.held END
  FROM fold f JOIN numbered c ON c.stream = f.stream AND c.key = f.key AND c.rule = f.rule AND c.epoch = f.epoch AND c.j = f.j + 1
),
admitted AS (
  SELECT rule, stream, key, "at", make_timestamp(clock) AS detected_at, severity, array_to_string(list_transform(picked, lambda x: x.id), ',') AS event_ids, FALSE AS absence, detail
  FROM numbered JOIN fold USING (stream, key, rule, epoch, j) WHERE ok
  UNION ALL
  SELECT rule, stream, key, make_timestamp(last.us), make_timestamp(due), CASE grade WHEN 3 THEN 'critical' WHEN 2 THEN 'warn' ELSE 'info' END, last.id, TRUE,
    'no events for ' || {duration('idle')} || ' (expected within ' || {duration('after')} || ')' FROM silence
)"""
SQL["replayed_alerts"] = f"WITH RECURSIVE {REPLAY} {ALERTS}"
SQL["replay_counters"] = f"""WITH RECURSIVE {REPLAY}
SELECT (SELECT count(*) FROM ev) AS processed, (SELECT count(*) FROM admitted) AS alerted,
  (SELECT count(*) FROM cand) + (SELECT count(*) FROM silence) - (SELECT count(*) FROM admitted) AS suppressed,
  (SELECT count(*) FROM seen WHERE late) AS late, (SELECT count(*) FROM silence) AS swept, CAST(0 AS BIGINT) AS invalid"""


SQL["no_profile"] = f"""
WITH {EV}
SELECT n AS event_id, CASE WHEN n % 50 = 7 THEN 'invalid event: empty id' WHEN n % 50 = 13 THEN 'invalid event: unknown stream "telemetry"'
  WHEN n % 50 = 11 THEN 'invalid event: empty key' WHEN n % 50 = 17 THEN 'invalid event: zero event time'
  WHEN stream <> 'payments' THEN 'invalid event: no profile for stream "' || stream || '"' ELSE 'valid' END AS reason FROM ev
"""
SQL["decoded_events"] = f"""
WITH {EV}
SELECT n AS "offset", id, stream, key, "at", value, {UNIT} AS unit, CASE WHEN stream <> 'video' THEN k * 1.6::DOUBLE - 80 END AS lat,
  CASE WHEN stream <> 'video' THEN k * 3.6::DOUBLE - 180 END AS lon, CASE WHEN stream <> 'video' THEN '' END AS place,
  CASE WHEN terminal THEN 'done' ELSE 'running' END AS status
FROM ev WHERE n % 40 NOT IN (3, 5, 9, 15, 21)
"""
SQL["metrics_log"] = SQL["tumbling_metrics"]
SQL["alert_ids"] = f"""
WITH {HIST} SELECT id, substr(sha256(to_json([rule, stream, key, id])), 1, 32) AS made FROM hist
"""
