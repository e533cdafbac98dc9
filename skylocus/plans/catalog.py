"""All registered queries and their oracle SQL, keyed by operator and slug."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylocus.functions import codec, delivery, wifi
from skylocus.operators import compare, lake, localize, measurements, monitor, positioning, reports
from skylocus.sources import events as file_events
from skylocus.sources import registry as reg_source

from . import harness as h

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
W = h.with_sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


# Ingest


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.events(spark, sf_dir).selectExpr("event_id", "case when event_id % 5 = 0 then concat('  ', props, ' ') when event_id % 7 = 0 then event_type when event_id % 11 = 0 then '{' else props end as value")


_MSG = "msg as (select event_id, case when event_id % 5 = 0 then concat('  ', props, ' ') when event_id % 7 = 0 then event_type when event_id % 11 = 0 then '{' else props end as value from events)"


@query("I01_I02_json_shape", f"with {_MSG} select event_id, value from msg where trim(value) like '{{%' and trim(value) like '%}}' and length(trim(value)) > 1")
def i01(spark, sf_dir):
    """I-01, I-02."""
    return codec.valid_messages(_messages(spark, sf_dir)).where("length(trim(value)) > 1")


@query("I03_I04_T02_T03_codec_round_trip", "select event_id, concat(event_type, ':', props) as message from events")
def i03(spark, sf_dir):
    """I-03, I-04, T-02, T-03: text through gzip and base64 and back."""
    rows = h.events(spark, sf_dir).select("event_id", F.concat_ws(":", "event_type", "props").alias("value"))
    return codec.decode_lines(codec.encode_messages(rows), "encoded").select("event_id", "message")


@query("S20_codec_stats", "select count(*) as messages, sum(strlen(event_type) + 1 + strlen(props))::bigint as original_bytes, true as intact from events")
def s20(spark, sf_dir):
    """S-03, S-20."""
    rows = h.events(spark, sf_dir).select(F.concat_ws(":", "event_type", "props").alias("value"))
    return codec.codec_stats(rows).drop("encoded_bytes")


@query("I05_count_batches", "select event_id, event_type, ((row_number() over (partition by event_type order by ts, event_id) - 1) // 50)::bigint as batch from events")
def i05(spark, sf_dir):
    """I-05 by count."""
    return codec.count_batches(h.events(spark, sf_dir).select("event_id", "event_type", "ts"), ["ts", "event_id"], "event_type", 50).select("event_id", "event_type", "batch")


@query(
    "I05_I12_greedy_batches",
    """with recursive o as (select event_id, event_type, props, strlen(props) as b, row_number() over (partition by event_type order by event_id) as i from events where strlen(props) <= 1024),
    f as (select event_id, event_type, props, i, 0::bigint as batch, 1 as n, b as held from o where i = 1
    union all select o.event_id, o.event_type, o.props, o.i, case when f.n >= 500 or f.held + o.b > 4096 then f.batch + 1 else f.batch end, case when f.n >= 500 or f.held + o.b > 4096 then 1 else f.n + 1 end, case when f.n >= 500 or f.held + o.b > 4096 then o.b else f.held + o.b end
    from f join o on o.event_type = f.event_type and o.i = f.i + 1)
    select event_id, event_type, props, batch from f""",
)
def i05_greedy(spark, sf_dir):
    """I-05, I-12 by count and bytes."""
    from skylocus.config import BatchLimits

    return codec.greedy_batches(h.events(spark, sf_dir).select("event_id", "event_type", "props"), "event_type", ["event_id"], "props", BatchLimits(500, 4096, 1024))


@query("I06_oversize", "select doc_id, strlen(text)::int as n_bytes from documents where strlen(text) <= 8192")
def i06(spark, sf_dir):
    """I-06."""
    from skylocus.config import BatchLimits

    docs = h.read(spark, sf_dir, "documents")
    return docs.where(~codec.droppable(F.col("text"), BatchLimits(record_bytes=8192))).select("doc_id", F.octet_length("text").alias("n_bytes"))


_ERR = {
    "kind": "case event_id % 6 when 0 then 'FirehoseException' when 1 then 'SdkException' when 2 then 'ConnectException' when 3 then 'RuntimeException' when 4 then 'ServiceUnavailableException' end",
    "code": "case event_id % 4 when 0 then 'ThrottlingException' when 1 then 'BufferFull' when 2 then 'Other' end",
    "message": "case event_id % 9 when 0 then 'Rate limit hit' when 1 then 'buffer is FULL' when 2 then 'connection refused by peer' when 3 then 'HTTP 429' when 4 then 'capacity exceeded' when 5 then 'no route to host' when 6 then 'odd' when 7 then '' end",
    "attempt": "cast(event_id % 9 as int)",
}


def _errors(spark, sf_dir):
    return h.read(spark, sf_dir, "events").selectExpr("event_id", *[f"{e} as {a}" for a, e in _ERR.items()])


def _any_sql(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


_S = delivery.SERVICE
_ERR_SQL = f"""with e as (select event_id, {', '.join(f'{e} as {a}' for a, e in _ERR.items())} from events),
x as (select *, coalesce(code, '') as c, lower(coalesce(message, '')) as t, kind in ('FirehoseException', 'ServiceUnavailableException') as svc, kind in ('FirehoseException', 'ServiceUnavailableException', 'SdkException') as sdk from e),
cls as (select *, case when kind is null then 'GENERIC_FAILURE'
 when kind = 'ServiceUnavailableException' or (svc and ({_any_sql('c', _S['buffer_code'])} or {_any_sql('t', _S['buffer_text'])})) or (not svc and {_any_sql('t', _S['buffer_any'])}) then 'BUFFER_FULL'
 when (svc and ({_any_sql('c', _S['rate_code'])} or {_any_sql('t', _S['rate_text'])})) or (not svc and sdk and {_any_sql('t', _S['rate_sdk'])}) then 'RATE_LIMIT'
 when kind = 'ConnectException' or {_any_sql('t', _S['network_any'])} then 'NETWORK_ISSUE' else 'GENERIC_FAILURE' end as label from x)"""


@query("I07_error_class", f"{_ERR_SQL} select event_id, label from cls")
def i07(spark, sf_dir):
    """I-07."""
    return _errors(spark, sf_dir).select("event_id", delivery.classify_error(F.col("kind"), F.col("code"), F.col("message")).alias("label"))


@query(
    "I08_I09_I10_retry_schedule",
    f"""{_ERR_SQL} select event_id, attempt, label, case label when 'BUFFER_FULL' then [5000, 15000, 45000, 120000, 300000][least(attempt, 4) + 1] when 'RATE_LIMIT' then least(30000, 1000 * (1 << attempt))
    when 'NETWORK_ISSUE' then [1000, 2000, 4000][least(attempt, 2) + 1] else least(30000, 2000 * (1 << attempt)) end::bigint as delay_ms,
    attempt >= case label when 'BUFFER_FULL' then 7 when 'RATE_LIMIT' then 5 when 'NETWORK_ISSUE' then 3 else 5 end as stop, least(30000, 1000 * (1 << attempt))::bigint as sink_ms from cls""",
)
def i08(spark, sf_dir):
    """I-08, I-09, I-10."""
    e = _errors(spark, sf_dir).withColumn("label", delivery.classify_error(F.col("kind"), F.col("code"), F.col("message")))
    n = F.col("attempt")
    return e.select("event_id", "attempt", "label", delivery.retry_delay_ms(F.col("label"), n).alias("delay_ms"), delivery.should_stop(F.col("label"), n).alias("stop"), delivery.sink_backoff_ms(F.lit(1000.0), n).alias("sink_ms"))


@query("I11_put_error", "select event_id, case event_id % 3 when 0 then 'permanent' when 1 then 'retriable' else 'unknown' end as label from events")
def i11(spark, sf_dir):
    """I-11."""
    codes = F.expr("case event_id % 3 when 0 then 'InvalidArgumentException' when 1 then 'ThrottlingException' else 'Odd' end")
    return h.read(spark, sf_dir, "events").select("event_id", delivery.put_error(codes).alias("label"))


# File events

_KEY = "case event_id % 8 when 0 then 'file.txt' when 1 then 'year%3D2025/MVS-stream/file.txt' when 2 then 'year%ZZ2025/x/stream/file.txt' when 3 then 'prefix/stream//file.txt' when 4 then concat('a/', event_type, '/f.txt') when 5 then 'a/../f.txt' when 6 then '//file.txt' end"
_STREAM_SQL = "case event_id % 8 when 1 then 'MVS-stream' when 2 then 'stream' when 4 then event_type when 5 then '..' else 'unknown' end"


@query("E07_stream_name", f"select event_id, {_STREAM_SQL} as stream_name from events")
def e07(spark, sf_dir):
    """E-07."""
    return h.read(spark, sf_dir, "events").select("event_id", file_events.stream_name(F.expr(_KEY)).alias("stream_name"))


@query(
    "E01_E06_file_events",
    f"""select event_id, {_STREAM_SQL} as stream_name, case when event_id % 10 = 0 then 'source' when event_id % 9 = 0 then 'bucket' when event_id % 8 in (3, 5, 6, 7) then 'key' when event_id % 7 = 0 then 'size' end as reject,
    case when event_id % 2 = 0 then repeat('a1', 16) end as etag from events""",
)
def e01(spark, sf_dir):
    """E-01 to E-06: notifications and event-bus messages."""
    e = h.read(spark, sf_dir, "events").withColumn("key", F.expr(_KEY))
    obj = F.struct("key", F.expr("case when event_id % 7 = 0 then -1 else event_id end").alias("size"), F.expr("case when event_id % 2 = 0 then repeat('a1', 16) else 'no tag' end").alias("eTag"))
    bucket = F.struct(F.expr("case when event_id % 9 = 0 then 'Bad_Bucket' else 'bucket-1' end").alias("name"))
    record = F.struct(F.expr("case when event_id % 10 = 0 then 'other' else 'aws:s3' end").alias("eventSource"), F.lit("2025-06-01T00:00:00Z").alias("eventTime"), F.struct(bucket.alias("bucket"), obj.alias("object")).alias("s3"))
    said = e.select("event_id", F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"))
    ids = said.withColumn("value", F.regexp_replace("value", r'^\{', F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(","))))
    out = file_events.parse_events(ids, F.to_timestamp(F.lit("2025-07-01")))
    return out.select(F.get_json_object("value", "$.id").cast("long").alias("event_id"), "stream_name", "reject", "etag")


# Measurements


@query("T10_T13_reject_reason", W("raw") + f"select event_id, {h.SQL['reason']} as reject from raw")
def t13(spark, sf_dir):
    """T-10, T-11, T-12, T-13."""
    reason = wifi.reject_reason(F.col("raw_bssid"), F.col("rssi"), F.col("latitude"), F.col("longitude"), F.col("location_accuracy"))
    return h.raw_measurements(spark, sf_dir).select("event_id", reason.alias("reject"))


@query("T14_timestamp", "select event_id, (epoch_us(ts) // 1000) between (epoch_us(timestamp '2024-03-01') // 1000) - 31536000000 and (epoch_us(timestamp '2024-03-01') // 1000) as fresh from events")
def t14(spark, sf_dir):
    """T-14."""
    return h.raw_measurements(spark, sf_dir).select("event_id", wifi.valid_timestamp(F.col("measurement_timestamp"), F.unix_millis(F.to_timestamp(F.lit("2024-03-01")))).alias("fresh"))


@query("T15_T16_hotspot", W("raw") + "select event_id, event_id % 61 = 0 and event_id % 53 <> 0 and event_id % 59 <> 0 as hotspot from raw")
def t15(spark, sf_dir):
    """T-15, T-16."""
    from skylocus.config import FilterConfig

    cfg = FilterConfig(hotspot_enabled=True, hotspot_action="EXCLUDE")
    return h.raw_measurements(spark, sf_dir).select("event_id", wifi.excluded_as_hotspot(F.col("raw_bssid"), cfg).alias("hotspot"))


@query("T17_T18_quality", W("raw") + f"select event_id, {h.WEIGHT_SQL} as weight, round({h.SCORE_SQL}, 6) as score from raw")
def t17(spark, sf_dir):
    """T-17, T-18."""
    weight = wifi.quality_weight(F.col("connection_status"), F.col("link_speed"), F.col("rssi"))
    return h.raw_measurements(spark, sf_dir).select("event_id", weight.alias("weight"), F.round(wifi.quality_score(F.col("location_accuracy"), F.col("rssi")), 6).alias("score"))


@query(
    "T19_T22_identity",
    W("raw") + "select event_id, sha256(concat('maker', ':', device, ':', '', ':', '14')) as device_id, sha256(concat(measurement_timestamp::varchar, ':', raw_bssid)) as scan_id, lower(replace(raw_bssid, '-', ':')) as bssid, nullif(trim(raw_ssid), '') as ssid from raw",
)
def t19(spark, sf_dir):
    """T-19, T-20, T-21, T-22."""
    m = h.raw_measurements(spark, sf_dir)
    device = wifi.device_id(F.lit("maker"), F.col("device"), F.lit(None).cast("string"), F.lit("14"))
    return m.select("event_id", device.alias("device_id"), wifi.scan_event_id(F.col("measurement_timestamp"), F.col("raw_bssid")).alias("scan_id"), wifi.normal_bssid(F.col("raw_bssid")).alias("bssid"), wifi.clean_ssid(F.col("raw_ssid")).alias("ssid"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device document per event: a connected event or a scan with one entry."""
    m = h.raw_measurements(spark, sf_dir)
    loc = F.struct("latitude", "longitude", F.col("location_accuracy").alias("accuracy"))
    info = F.struct(F.col("raw_bssid").alias("bssid"), F.col("raw_ssid").alias("ssid"), "rssi", F.col("link_speed").alias("linkSpeed"))
    on = F.col("connection_status") == "CONNECTED"
    ts = F.col("measurement_timestamp")
    connected = F.when(on, F.array(F.struct(ts.alias("timestamp"), F.col("event_id").cast("string").alias("eventId"), info.alias("wifiConnectedInfo"), loc.alias("location"))))
    entry = F.struct(F.col("raw_ssid").alias("ssid"), F.col("raw_bssid").alias("bssid"), (ts + 5).alias("scantime"), "rssi")
    scanned = F.when(~on, F.array(F.struct(ts.alias("timestamp"), loc.alias("location"), F.array(entry).alias("results"))))
    doc = F.struct(F.lit("14").alias("osVersion"), F.col("device").alias("model"), F.lit("extra").alias("unknownField"), F.col("event_id").cast("string").alias("dataVersion"), connected.alias("wifiConnectedEvents"), scanned.alias("scanResults"))
    return m.select(F.to_json(doc).alias("value"))


@query(
    "T01_T09_scan_documents",
    W("raw", "m") + "select event_id::varchar as data_version, bssid, nullif(trim(raw_ssid), '') as ssid, rssi, latitude, longitude, location_accuracy, connection_status, quality_weight, round(quality_score, 6) as quality_score, link_speed, "
    "measurement_timestamp, case when connection_status = 'CONNECTED' then measurement_timestamp else measurement_timestamp + 5 end as scan_timestamp, case when connection_status = 'CONNECTED' then event_id::varchar else sha256(concat(measurement_timestamp::varchar, ':', raw_bssid)) end as event_id from m",
)
def t01(spark, sf_dir):
    """T-01 to T-09, T-25: encoded documents to measurement rows."""
    lines = codec.encode_messages(scan_documents(spark, sf_dir)).select(F.col("encoded").alias("value"))
    rows = measurements.from_lines(lines, F.to_timestamp(F.lit("2025-01-01")))
    return rows.select("data_version", "bssid", "ssid", "rssi", "latitude", "longitude", "location_accuracy", "connection_status", "quality_weight", F.round("quality_score", 6).alias("quality_score"), "link_speed", "measurement_timestamp", "scan_timestamp", "event_id")


@query(
    "T24_counters",
    W("raw") + f"select count(*) as seen, count(*) filter (where r is null) as accepted, count(*) filter (where r = 'bssid') as invalid_bssid, count(*) filter (where r = 'rssi') as invalid_rssi, count(*) filter (where r = 'location') as invalid_location, 0::bigint as invalid_hotspot from (select {h.SQL['reason']} as r from raw)",
)
def t24(spark, sf_dir):
    """T-24."""
    docs = measurements.parse(scan_documents(spark, sf_dir), "value")
    return measurements.counters(measurements.judged(docs))


# Lake

_BSSIDS = "select distinct bssid from m where bssid < 'aa:bb:cc:00:00:20'"
_M = W("raw", "m")


def _some(m: DataFrame) -> DataFrame:
    return m.where("bssid < 'aa:bb:cc:00:00:20'").select("bssid").distinct()


@query("Q01_recent_of_ap", _M + "select event_id, bssid, measurement_timestamp, rssi from m where bssid = 'aa:bb:cc:00:00:11' and not coalesce(is_global_outlier, false) and measurement_timestamp >= 0 order by measurement_timestamp desc, event_id limit 20")
def q01(spark, sf_dir):
    """Q-01, Q-10, S-15."""
    return lake.recent_of(h.measurements(spark, sf_dir), "aa:bb:cc:00:00:11", 0, 20, ["event_id", "bssid", "measurement_timestamp", "rssi"])


@query("Q02_candidates", _M + f"select event_id, bssid from m where ingestion_timestamp > timestamp '2024-01-10' and not coalesce(is_global_outlier, false) and bssid in ({_BSSIDS})")
def q02(spark, sf_dir):
    """Q-02."""
    m = h.measurements(spark, sf_dir)
    return lake.candidates(m, _some(m), F.to_timestamp(F.lit("2024-01-10"))).select("event_id", "bssid")


@query("Q03_clean", _M + f"select event_id, bssid, rssi from m where ingestion_timestamp >= timestamp '2024-01-10' and not coalesce(is_global_outlier, false) and bssid in ({_BSSIDS})")
def q03(spark, sf_dir):
    """Q-03."""
    m = h.measurements(spark, sf_dir)
    return lake.clean(m, _some(m), F.to_timestamp(F.lit("2024-01-10"))).select("event_id", "bssid", "rssi")


@query("Q04_label_outliers", _M + "select event_id, case when event_id % 37 = 0 then true else is_global_outlier end as is_global_outlier, case when event_id % 37 = 0 then 12.5::double end as global_outlier_distance, case when event_id % 37 = 0 then 'MAD' end as global_detection_algorithm from m")
def q04(spark, sf_dir):
    """Q-04."""
    m = h.measurements(spark, sf_dir)
    none = {"global_outlier_distance": "double", "global_outlier_threshold": "double", "global_detection_algorithm": "string", "global_detection_version": "string", "global_detection_timestamp": "timestamp"}
    m = m.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    labels = m.where("event_id % 37 = 0").select("event_id", F.lit(12.5).alias("distance"), F.lit(9.0).alias("threshold"))
    out = lake.label_outliers(m, labels, "MAD", "v1", F.to_timestamp(F.lit("2025-01-01")))
    return out.select("event_id", "is_global_outlier", "global_outlier_distance", "global_detection_algorithm")


@query("Q05_delete_outliers", _M + f"select event_id from m where not (bssid in ({_BSSIDS}) and coalesce(is_global_outlier, false))")
def q05(spark, sf_dir):
    """Q-05."""
    m = h.measurements(spark, sf_dir)
    return lake.delete_outliers(m, _some(m)).select("event_id")


@query("Q06_delete_aps", _M + f"select event_id, bssid from m where bssid not in ({_BSSIDS})")
def q06(spark, sf_dir):
    """Q-06."""
    m = h.measurements(spark, sf_dir)
    return lake.delete_access_points(m, _some(m)).select("event_id", "bssid")


@query(
    "Q07_coverage",
    _M + "select bssid, count(*) as total, count(case when connection_status = 'CONNECTED' then 1 end) as connected, count(case when connection_status = 'SCAN' then 1 end) as scanned, (epoch_us(min(ingestion_timestamp)) // 1000) as first_ms, (epoch_us(max(ingestion_timestamp)) // 1000) as last_ms, round(avg(location_accuracy), 6) as avg_accuracy from m group by bssid",
)
def q07(spark, sf_dir):
    """Q-07."""
    out = lake.coverage(h.measurements(spark, sf_dir))
    return out.select("bssid", "total", "connected", "scanned", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), F.round("avg_accuracy", 6).alias("avg_accuracy"))


@query("Q08_busy", _M + "select bssid, count(*) as total, round(avg(quality_score), 6) as avg_score from m where not coalesce(is_global_outlier, false) group by bssid having count(*) >= 20 order by total desc, bssid")
def q08(spark, sf_dir):
    """Q-08."""
    return lake.busy(h.measurements(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 6))


@query("Q09_spread", _M + "select bssid, round(avg(quality_weight), 6) as avg_weight, round(stddev(latitude), 6) as lat_stddev, round(stddev(longitude), 6) as lon_stddev, count(distinct ingestion_timestamp::date) as days from m group by bssid")
def q09(spark, sf_dir):
    """Q-09."""
    out = lake.spread(h.measurements(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_weight", "lat_stddev", "lon_stddev")})


# Positioning

_VALID = h.VALID_SQL
_J = h.SQL["reg"] + ", " + h.SQL["scans"] + f", j as (select s.request_id, s.pos, s.mac_addr, s.rssi as s, s.frequency::double as f, r.latitude as lat, r.longitude as lon, r.altitude as alt, r.horizontal_accuracy as hacc, r.confidence as conf, r.vendor, r.status from scans s join reg r using (mac_addr) where r.status in {_VALID})"


def _joined(spark, sf_dir) -> DataFrame:
    return reg_source.known_scans(h.scans(spark, sf_dir), reg_source.usable(h.registry(spark, sf_dir)))


def _requests(spark, sf_dir) -> DataFrame:
    return positioning.gather(_joined(spark, sf_dir))


@query("J01_J02_scan_registry_join", f"with {_J} select request_id, mac_addr, s as rssi, status, vendor from j")
def j01(spark, sf_dir):
    """J-01, J-02, S-11, S-12."""
    return _joined(spark, sf_dir).select("request_id", "mac_addr", "rssi", "status", "vendor")


@query(
    "J04_ap_pairs",
    f"with {_J} select a.request_id, count(*) as pairs, round(sum(abs(a.s - b.s)) / 30, 6) as weight from j a join j b on a.request_id = b.request_id and a.pos < b.pos group by a.request_id",
)
def j04(spark, sf_dir):
    """J-04."""
    pairs = positioning.signal_pairs(F.col("aps"))
    out = _requests(spark, sf_dir).select("request_id", F.size(pairs).cast("long").alias("pairs"), F.round(F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / 30, 6).alias("weight"))
    return out.where("pairs > 0")


def _faults_sql(more: str = "") -> str:
    """P-01 as the list of a scan's messages."""
    rules = ["when not regexp_full_match(mac_addr, '([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})') then 'Invalid MAC address format'", "when rssi < -100 then 'Signal strength must be at least -100 dBm'", "when rssi > 0 then 'Signal strength must be at most 0 dBm'", "when frequency < 2400 then 'Frequency must be at least 2400 MHz'", "when frequency > 6000 then 'Frequency must be at most 6000 MHz'", *filter(None, more.split(";"))]
    return "[" + ", ".join(f"case {r} end" for r in rules) + "]"


_MANY = "case when count(*) > 20 then 'Between 1 and 20 WiFi scan results must be provided' end"
_MORE = "when channel_width < 20 then 'Channel width must be at least 20 MHz';when channel_width > 160 then 'Channel width must be at most 160 MHz';when trim(client) = '' then 'Client is required';when length(client) > 50 then 'Client must be at most 50 characters'"


@query(
    "P01_request_faults",
    f"""with {h.SQL['scans']}, x as (select request_id // 4 as request_id, case when pos % 10 = 9 then replace(mac_addr, ':', '.') else mac_addr end as mac_addr, rssi, frequency - 100 * (request_id % 2) as frequency, 20 * (pos % 10) as channel_width, case when request_id % 68 < 4 then ' ' when request_id % 92 < 4 then repeat('c', 51) else 'c' end as client from scans),
    y as (select request_id, unnest({_faults_sql(_MORE)}) as said from x), z as (select request_id, said from y where said is not null union select request_id, {_MANY} from x group by request_id),
    n as (select request_id, count(*) as n_scans from x group by request_id)
    select request_id, any_value(n_scans) as n_scans, string_agg(distinct said, '; ' order by said) as faults from n left join z using (request_id) group by request_id""",
)
def p01(spark, sf_dir):
    """P-01, on scans of which some are spoilt."""
    scans = h.scans(spark, sf_dir)
    mac = F.when(F.col("pos") % 10 == 9, F.replace("mac_addr", F.lit(":"), F.lit("."))).otherwise(F.col("mac_addr"))
    client = F.when(F.col("request_id") % 68 < 4, " ").when(F.col("request_id") % 92 < 4, "c" * 51).otherwise("c")
    spoilt = scans.select(F.expr("request_id div 4").alias("request_id"), "pos", mac.alias("mac_addr"), "rssi", (F.col("frequency") - 100 * (F.col("request_id") % 2)).alias("frequency"), (20 * (F.col("pos") % 10)).alias("channel_width"), client.alias("client"))
    return positioning.request_faults(spoilt)


@query(
    "P02_signal_physics",
    f"""with {_J}, b as (select request_id, f, max(s) as hi, min(s) as lo, count(*) as n, bool_and(s between -100 and -30) as fine from j group by request_id, f)
    select request_id, bool_and(fine and (n < 2 or hi <= -50 or hi - lo <= 45 or (hi = -30 and lo = -100))) as possible from b group by request_id""",
)
def p02(spark, sf_dir):
    """P-02."""
    return _requests(spark, sf_dir).select("request_id", positioning.physics_ok(F.col("aps")).alias("possible"))


_CTX = f"""{_J}, c0 as (select request_id, count(*) as n, round(avg(s), 9) as mean, round(stddev_pop(s), 9) as sd, avg(lon) as mx, avg(lat) as my, var_pop(lon) as vx, var_pop(lat) as vy, covar_pop(lon, lat) as cv,
  sum(pow(10, s / 10) * lat) / sum(pow(10, s / 10)) as clat, sum(pow(10, s / 10) * lon) / sum(pow(10, s / 10)) as clon from j group by request_id),
c1 as (select request_id, max(abs(lat - (my + cv / vx * (lon - mx)))) as worst from j join c0 using (request_id) where vx > 0 group by request_id),
v0 as (select request_id, (clat - lat) * (6371000 * pi() / 180) as no, (clon - lon) * (6371000 * pi() / 180) * cos(radians(clat)) as ea from j join c0 using (request_id)),
v as (select request_id, case when sqrt(no * no + ea * ea) < 1 then 1 else no / sqrt(no * no + ea * ea) end as x, case when sqrt(no * no + ea * ea) < 1 then 0 else ea / sqrt(no * no + ea * ea) end as y from v0),
s as (select request_id, count(*)::double as n, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy, sum(x) as x, sum(y) as y from v group by request_id),
d as (select *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) as det, (yy * n - y * y) + (xx * n - x * x) + (xx * yy - xy * xy) as adj from s),
g as (select request_id, round(case when n < 3 or abs(det) < 1e-10 or adj / det < 0 then 30 else least(30, sqrt(greatest(adj / det, 0))) end, 9) as gdop from d),
ctx as (select c0.request_id, c0.n, mean, sd, gdop,
  case when mean > -70 then 'STRONG' when mean > -85 then 'MEDIUM' when mean > -95 then 'WEAK' else 'VERY_WEAK' end as signal,
  case when c0.n < 2 then 'UNIFORM' when sd > 10 then 'OUTLIERS' when sd > 3 then 'MIXED' else 'UNIFORM' end as distribution,
  case when c0.n < 3 then 'POOR' when vx < 1e-10 or vy < 1e-10 or round(worst, 12) <= 0.0002 then 'COLLINEAR' when gdop < 2 then 'EXCELLENT' when gdop < 4 then 'GOOD' when gdop < 6 then 'FAIR' else 'POOR' end as geometry
  from c0 join g using (request_id) left join c1 using (request_id))"""


@query("P04_P08_context", f"with {_CTX} select request_id, n::int as n_aps, round(mean, 6) as mean_rssi, signal, distribution, geometry from ctx")
def p04(spark, sf_dir):
    """P-04 to P-08."""
    out = positioning.with_context(_requests(spark, sf_dir))
    return out.select("request_id", "n_aps", F.round("mean_rssi", 6).alias("mean_rssi"), "signal", "distribution", "geometry")


@query("P09_P10_dilution", f"with {_CTX} select request_id, round(gdop, 4) as gdop, round(case when gdop <= 2 then 1 when gdop <= 4 then 1 + 0.25 * (gdop - 2) when gdop <= 6 then 1.5 + 0.25 * (gdop - 4) else least(4, 2 + (gdop - 6) / 2) end, 4) as factor from ctx where n >= 3")
def p09(spark, sf_dir):
    """P-09, P-10."""
    out = positioning.with_context(_requests(spark, sf_dir)).where("n_aps >= 3")
    return out.select("request_id", F.round("gdop", 4).alias("gdop"), F.round(positioning.gdop_factor(F.col("gdop")), 4).alias("factor"))


def _weights_sql() -> str:
    """The eligible algorithms of each request with their weights, from the coefficient table."""
    parts = []
    for name in positioning.ALGORITHMS:
        base, signal, geometry, spread, _ = positioning.WEIGHTS[name]
        pick = lambda c, names, values: f"case {c} " + " ".join(f"when {n!r} then {v}::double" for n, v in zip(names, values)) + " end"
        w = " * ".join([pick("least(n, 4)", [1, 2, 3, 4], base), pick("signal", positioning.SIGNALS, signal), pick("geometry", positioning.GEOMETRIES, geometry), pick("distribution", positioning.DISTRIBUTIONS, spread)])
        at = ", ".join(str(i + 1) for i, names in enumerate(positioning.ALLOWED) if name in names)
        fits = f"least(n, 4) in ({at})" + (" and geometry not in ('COLLINEAR', 'POOR')" if name == "TRILATERATION" else "")
        parts.append(f"select request_id, '{name}' as algorithm, round({w}, 12) as weight from ctx where case when signal = 'VERY_WEAK' then {str(name == 'PROXIMITY').lower()} else {fits} end")
    return " union all ".join(parts)


_SEL = f"""{_CTX}, cand as ({_weights_sql()}), cnt as (select *, count(*) over (partition by request_id) as n from cand),
over_ as (select request_id, algorithm, weight from cnt where weight >= case when n = 1 then weight else 0.4 end),
rk as (select *, row_number() over (partition by request_id order by weight desc, algorithm) as r, max(weight) over (partition by request_id) as top from over_),
sel as (select request_id, algorithm, weight from rk where r <= case when top > 0.8 then 2 else 3 end)"""


@query("P14_P15_weights", f"with {_SEL} select request_id, algorithm, round(weight, 6) as weight from cand")
def p15(spark, sf_dir):
    """P-14, P-15, J-06."""
    out = positioning.with_selection(positioning.with_context(_requests(spark, sf_dir)))
    return out.select("request_id", F.explode("candidates").alias("c")).select("request_id", "c.algorithm", F.round("c.weight", 6).alias("weight"))


@query("P16_P17_selection", f"with {_SEL} select request_id, algorithm, round(weight, 6) as weight from sel")
def p17(spark, sf_dir):
    """P-16, P-17."""
    out = positioning.with_selection(positioning.with_context(_requests(spark, sf_dir)))
    return out.select("request_id", F.explode("selected").alias("c")).select("request_id", "c.algorithm", F.round("c.weight", 6).alias("weight"))


def _reasons_sql() -> str:
    """All that is said of each algorithm of each request, joined by a bar."""
    two = lambda x: f"cast(round(cast(cast({x} as varchar) as decimal(30, 20)), 2) as varchar)"
    pick = lambda c, names, values: f"case {c} " + " ".join(f"when {n!r} then {v}::double" for n, v in zip(names, values)) + " end"
    parts = []
    for name in positioning.ALGORITHMS:
        base, signal, geometry, spread, _ = positioning.WEIGHTS[name]
        few = {"TRILATERATION": "DISQUALIFIED (requires at least 3 APs)", "MAXIMUM_LIKELIHOOD": "DISQUALIFIED (requires at least 4 APS)"}.get(name)
        one = {"PROXIMITY": "Valid for single AP", "LOG_DISTANCE": "Valid for single AP with path loss model"}.get(name, "DISQUALIFIED (insufficient APs)")
        three = few if name == "MAXIMUM_LIKELIHOOD" else "Valid for three APs"
        weak = "Only viable algorithm for extremely weak signals" if name == "PROXIMITY" else "DISQUALIFIED (signal too weak)"
        f = f"select request_id, signal, geometry, least(n, 4) as n, {pick('least(n, 4)', [1, 2, 3, 4], base)} as b, {pick('signal', positioning.SIGNALS, signal)} as s, {pick('geometry', positioning.GEOMETRIES, geometry)} as g, {pick('distribution', positioning.DISTRIBUTIONS, spread)} as d from ctx"
        parts.append(
            f"""select f.request_id, '{name}' as algorithm, sel.algorithm is not null as chosen, concat_ws(' | ',
  case when signal = 'VERY_WEAK' then '{weak}' when f.n = 1 then '{one}' when f.n = 2 then '{few or "Valid for two APs"}' when f.n = 3 then '{three}' else 'Valid for 4+ APs' end,
  case when signal <> 'VERY_WEAK' and cnt.algorithm is null and geometry in ('COLLINEAR', 'POOR') then case geometry when 'POOR' then 'DISQUALIFIED (poor geometry)' else 'DISQUALIFIED (collinear APs)' end end,
  case when cnt.algorithm is not null then case when sel.algorithm is not null then 'SELECTED' when cnt.weight < 0.4 then 'DISQUALIFIED  (below threshold 0.40) ' when best.top > 0.8 then 'DISQUALIFIED (not in top 2 High Confidence)' else 'DISQUALIFIED (not in top 3 below High Confidence)' end
    || '. Weight Calculation: Weight=' || {two('b * s * g * d')} || ': base(' || {two('b')} || ') × signal(' || {two('s')} || ') × geometric(' || {two('g')} || ') × distribution(' || {two('d')} || ')' end) as reasons
from ({f}) f left join cnt on cnt.request_id = f.request_id and cnt.algorithm = '{name}' left join sel on sel.request_id = f.request_id and sel.algorithm = '{name}'
left join (select request_id, max(weight) as top from cand group by request_id) best on best.request_id = f.request_id"""
        )
    return " union all ".join(parts)


@query("P18_reasons", f"with {_SEL} {_reasons_sql()}")
def p18(spark, sf_dir):
    """P-18: the whole texts, of all algorithms."""
    out = positioning.with_reasons(positioning.with_selection(positioning.with_context(_requests(spark, sf_dir))))
    out = out.select("request_id", F.explode("reasons").alias("r"))
    return out.select("request_id", "r.algorithm", "r.chosen", F.array_join("r.reasons", " | ").alias("reasons"))


def _estimate(spark, sf_dir, estimator) -> DataFrame:
    out = _requests(spark, sf_dir).withColumn("p", estimator(F.col("aps"))).where("p is not null")
    return out.select("request_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("latitude", "longitude", "altitude")], *[F.round(f"p.{c}", 8).alias(c) for c in ("accuracy", "confidence")])


def _est_sql(lat: str, lon: str, alt: str, acc: str, conf: str) -> str:
    # accuracies are often ties in the fifth decimal, which the engines round apart
    return f"round({lat}, 6) as latitude, round({lon}, 6) as longitude, round({alt}, 6) as altitude, round({acc}, 8) as accuracy, round({conf}, 8) as confidence"


@query("A01_proximity", f"with {_J}, r as (select *, row_number() over (partition by request_id order by s desc, pos) as k from j) select request_id, {_est_sql('lat', 'lon', 'coalesce(alt, 0)', 'hacc', 'least(0.85, greatest(0, (s + 90) / 60))')} from r where k = 1")
def a01(spark, sf_dir):
    """A-01."""
    return _estimate(spark, sf_dir, positioning.proximity)


_CW = "pow(10, least(1, greatest(0, (s + 30) / -70)))"


@query(
    "A02_weighted_centroid",
    f"with {_J} select request_id, {_est_sql(f'sum({_CW} * lat) / sum({_CW})', f'sum({_CW} * lon) / sum({_CW})', f'coalesce(sum({_CW} * alt) filter (where abs(alt * {_CW}) > 1e-10) / sum({_CW}) filter (where abs(alt * {_CW}) > 1e-10), 0)', 'avg(hacc)', 'least(0.8, count(*) * 1.0 / count(distinct mac_addr) * 0.7)')} from j group by request_id",
)
def a02(spark, sf_dir):
    """A-02."""
    return _estimate(spark, sf_dir, positioning.weighted_centroid)


@query(
    "A03_rssi_ratio",
    f"""with {_J}, p as (select a.request_id, abs(a.s - b.s) / 30 as w, pow(10, (a.s - b.s) / 20) as r, a.lat as la, b.lat as lb, a.lon as oa, b.lon as ob, a.alt as aa, b.alt as ab from j a join j b on a.request_id = b.request_id and a.pos < b.pos),
    q as (select request_id, sum(w) as w, sum(w * (la + r * lb) / (1 + r)) / sum(w) as lat, sum(w * (oa + r * ob) / (1 + r)) / sum(w) as lon, sum(w * (aa + r * ab) / (1 + r)) filter (where aa is not null and ab is not null) as wa, sum(w) filter (where aa is not null and ab is not null) as ww from p group by request_id having sum(w) > 0),
    t as (select request_id, avg(s) as mean, avg(hacc) as hacc, count(*) as n, avg(least(1, greatest(0, (s + 95) / 45))) as q from j group by request_id),
    c as (select *, least(0.85, least(0.85, w / (n * (n - 1) / 2)) + q.q) as c0 from q join (select request_id, mean, hacc, n, q as qq from t) t using (request_id), (select 0 as q) q)
    select request_id, {_est_sql('lat', 'lon', 'case when ww > 0 then wa / ww else 0 end', 'hacc * least(3, greatest(1, (-mean - 50) / 10))', 'case when mean >= -70 then greatest(0.7, least(0.85, least(0.85, w / (n * (n - 1) / 2)) + qq)) else least(0.85, least(0.85, w / (n * (n - 1) / 2)) + qq) end')} from c""",
)
def a03(spark, sf_dir):
    """A-03."""
    return _estimate(spark, sf_dir, positioning.rssi_ratio)


_LN = "case vendor " + " ".join(f"when '{k}' then {v}" for k, v in positioning.VENDOR_EXPONENT.items()) + " else 3.0 end"
_KNOWN = "(" + ", ".join(f"'{k}'" for k in positioning.VENDOR_EXPONENT) + ")"


@query(
    "A04_log_distance",
    f"""with {_J}, a as (select *, ({_LN})::double as n0, case when f >= 5000 then -45 when f >= 2400 then -40 else -43 end as ref, case when s >= -50 then 2 when s <= -80 then 5 else 2 + (-50 - s) / 30 * 3 end as sg from j),
    b as (select *, case when s >= -50 then greatest(2, n0 - least(1, (s + 50) / 5)) when s <= -80 then least(5, n0 + least(1.5, (-80 - s) / 5)) else n0 end as n, case when s >= -50 and sg <= 2 then 1.0 when s >= -80 and sg <= 4 then 0.8 else 0.6 end as env from a),
    c as (select *, pow(10, abs(ref - s) / (10 * n)) * (1 + sg / 10) * env as d from b), e as (select *, 1 / greatest(1, d) as w from c),
    t as (select request_id, sum(w * lat) / sum(w) as lat, sum(w * lon) / sum(w) as lon, coalesce(sum(w * alt), 0) / sum(w) as alt, avg(s) as mean, min(d) as lo, max(d) as hi, avg(d) as ad, avg(n) as an, count(*) as k, avg(case when vendor in {_KNOWN} then 1.0 else 0.0 end) as vr, stddev_pop(s) as sd from e group by request_id)
    select request_id, {_est_sql('lat', 'lon', 'alt', 'case when mean >= -50 then 0.5 * lo when mean <= -80 then 3 * hi else lo * (3 - 2.5 * (mean + 80) / 30) end', 'least(0.95, greatest(0.6, 0.25 * least(1, greatest(0, (mean + 100) / 50)) + 0.2 * exp(-ad / 30) + 0.1 * (1 - least(1, abs(an - 3) / 2)) + 0.2 * (case k when 1 then 0.7 when 2 then 0.8 when 3 then 0.9 else 1.0 end) + 0.2 * (0.6 + 0.4 * vr) + 0.05 * (1 - 0.3 * least(1, sd / 20))))')} from t""",
)
def a04(spark, sf_dir):
    """A-04."""
    return _estimate(spark, sf_dir, positioning.log_distance)


@query("A05_trilateration")
def a05(spark, sf_dir):
    """A-05; near-singular systems differ between engines in the last digits, so it is tested against least squares."""
    out = positioning.trilateration(_requests(spark, sf_dir)).where("trilateration is not null")
    return out.select("request_id", *[F.round(f"trilateration.{c}", 5).alias(c) for c in ("latitude", "longitude", "altitude", "accuracy", "confidence")])


@query("A06_maximum_likelihood")
def a06(spark, sf_dir):
    """A-06: iterative."""
    out = _requests(spark, sf_dir).withColumn("p", positioning.maximum_likelihood(F.col("aps"))).where("p is not null")
    return out.select("request_id", *[F.round(f"p.{c}", 5).alias(c) for c in ("latitude", "longitude", "altitude", "accuracy", "confidence")])


_POSITION_COLUMNS = ["request_id", "result", "error", "n_scans", "n_known", "n_aps", "signal", "distribution", "geometry", "latitude", "longitude", "altitude", "accuracy", "confidence", "vertical_accuracy", "methods"]


@query("A07_P19_P21_positions")
def positions(spark, sf_dir):
    """P-01 to P-21, A-01 to A-07: the whole calculation."""
    out = positioning.positions(h.scans(spark, sf_dir), h.registry(spark, sf_dir))
    return out.select(*_POSITION_COLUMNS)




@query(
    "P03_P20_result_ladder",
    f"""with {h.SQL['reg']}, {h.SQL['scans']}, a as (select request_id, s.frequency as f, rssi as s, r.status, r.status in {_VALID} as valid from scans s left join reg r using (mac_addr)),
    b as (select request_id, f, max(s) as hi, min(s) as lo, count(*) as n, bool_and(s between -100 and -30) as fine from a group by request_id, f),
    p as (select request_id, bool_and(fine and (n < 2 or hi <= -50 or hi - lo <= 45 or (hi = -30 and lo = -100))) as ok from b group by request_id),
    b2 as (select request_id, f, max(s) as hi, min(s) as lo, count(*) as n from a where valid group by request_id, f),
    p2 as (select request_id, bool_and(n < 2 or hi <= -50 or hi - lo <= 45 or (hi = -30 and lo = -100)) as ok2 from b2 group by request_id),
    y as (select request_id, unnest({_faults_sql()}) as said from scans), z as (select request_id, string_agg(distinct said, '; ' order by said) as faults from (select request_id, said from y union select request_id, {_MANY} from scans group by request_id) group by request_id),
    c as (select request_id, count(*) as n_scans, count(status) as n_known, count(*) filter (where valid) as n_valid from a group by request_id)
    select request_id, n_scans, n_known, case when faults is not null then faults when not ok then 'physically impossible signals' when n_known = 0 then 'no known access points found in database' when n_valid = 0 then 'no access points with valid status found' when not ok2 then 'position calculation failed' end as error from c join p using (request_id) left join p2 using (request_id) left join z using (request_id)""",
)
def p03(spark, sf_dir):
    """P-03."""
    return positioning.positions(h.scans(spark, sf_dir), h.registry(spark, sf_dir), likelihood=True).select("request_id", "n_scans", "n_known", "error")


@query("P22_status_histogram", f"with {_J.replace(f' where r.status in {_VALID}', '')} select request_id, string_agg(status || '=' || n, ',' order by status) as statuses from (select request_id, status, count(*) as n from j group by request_id, status) group by request_id")
def p22(spark, sf_dir):
    """P-22."""
    return positioning.status_histogram(reg_source.known_scans(h.scans(spark, sf_dir), h.registry(spark, sf_dir)))


@query("P23_location_certainty", f"with {_J} select request_id, round(avg(conf), 6) as certainty from j group by request_id")
def p23(spark, sf_dir):
    """P-23."""
    return positioning.location_certainty(_joined(spark, sf_dir)).select("request_id", F.round("certainty", 6).alias("certainty"))


# Comparison: provider A is derived from the order, provider B is the loudest access point, so that both engines agree to the last digit

_PAIR_A = {
    "request_id": "o_orderkey",
    "success_a": "case when o_custkey % 11 = 0 then null else o_orderstatus <> 'P' end",
    "lat_a": "377e-1 + (o_custkey % 10) * 5e-4",
    "lon_a": "-12242e-2 + (o_custkey % 13) * 7e-4",
    "acc_a": "cast(10 + (o_custkey % 30) * 10 as double)",
}
_PAIRS = f"""{_J}, k as (select *, row_number() over (partition by request_id order by s desc, pos) as k, count(*) over (partition by request_id) as n_aps from j),
o as (select {', '.join(f'{e} as {a}' for a, e in _PAIR_A.items())} from orders),
pr as (select o.*, case when k.lat is not null and o.request_id % 9 <> 0 then 'SUCCESS' else 'ERROR' end as result_b, case when k.lat is null then 'No known access points found in database' when o.request_id % 9 = 0 then 'other failure' end as error_b,
  case when o.request_id % 9 <> 0 then k.lat end as lat_b, case when o.request_id % 9 <> 0 then k.lon end as lon_b, case when o.request_id % 9 <> 0 then k.hacc end as acc_b, case when o.request_id % 9 <> 0 and k.s is not null then least(85e-2, greatest(0, (k.s + 90) / 6e1)) end as conf_b, k.n_aps from o left join k on o.request_id = k.request_id and k.k = 1),
sc as (select *, case when success_a is null then 'B_ONLY_ANALYSIS' when success_a and result_b = 'SUCCESS' then 'BOTH_WIFI_SUCCESS' when success_a and error_b like 'No known%' and acc_a >= 250 then 'A_CELL_FALLBACK_DETECTED' when success_a and acc_a >= 250 then 'A_SUCCESS_B_ERROR_CELL' when success_a then 'A_SUCCESS_B_ERROR_WIFI' when result_b = 'SUCCESS' then 'A_ERROR_B_SUCCESS' else 'BOTH_INSUFFICIENT_DATA' end as scenario,
  case when lat_a is not null and lat_b is not null then round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat_b - lat_a) / 2), 2) + cos(radians(lat_a)) * cos(radians(lat_b)) * pow(sin(radians(lon_b - lon_a) / 2), 2)))), 6) end as d0 from pr),
cmp as (select *, case when scenario in ('A_CELL_FALLBACK_DETECTED', 'A_SUCCESS_B_ERROR_CELL', 'A_SUCCESS_B_ERROR_WIFI') then null else d0 end as distance_m,
  case when scenario in ('A_CELL_FALLBACK_DETECTED', 'A_SUCCESS_B_ERROR_CELL') then 'CELL' when scenario = 'BOTH_INSUFFICIENT_DATA' then 'NONE' else 'WIFI' end as location_type from sc)"""


def _pairs(spark, sf_dir) -> DataFrame:
    a = h.read(spark, sf_dir, "orders").selectExpr(*[f"{e} as {x}" for x, e in _PAIR_A.items()])
    req = _requests(spark, sf_dir).select(F.col("request_id").alias("r"), F.size("aps").cast("long").alias("n_aps"), positioning.proximity(F.col("aps")).alias("p"))
    fine = F.col("request_id") % 9 != 0
    joined = a.join(req, a.request_id == req.r, "left")
    error = F.when(F.col("p").isNull(), "No known access points found in database").when(~fine, "other failure")
    out = joined.select("request_id", "success_a", "lat_a", "lon_a", "acc_a", F.when(F.col("p").isNotNull() & fine, "SUCCESS").otherwise("ERROR").alias("result_b"), error.alias("error_b"), *[F.when(fine, F.col(f"p.{x}")).alias(y) for x, y in (("latitude", "lat_b"), ("longitude", "lon_b"), ("accuracy", "acc_b"), ("confidence", "conf_b"))], "n_aps")
    return out


def _compared(spark, sf_dir) -> DataFrame:
    return compare.compare(_pairs(spark, sf_dir))


@query(
    "C03_C10_comparison",
    f"""with {_PAIRS} select request_id, scenario, location_type, round(distance_m, 3) as distance_m, round(case when distance_m is not null then sqrt(acc_a * acc_a + acc_b * acc_b) end, 4) as uncertainty_m,
    case when location_type = 'CELL' then 'NO WIFI COVERAGE' when scenario = 'A_SUCCESS_B_ERROR_WIFI' then 'B FAILURE' when distance_m is null then null when distance_m = 0 then 'PERFECT AGREEMENT' when acc_a >= 250 then 'WIFI VS CELL DISAGREEMENT' when distance_m < sqrt(acc_a * acc_a + acc_b * acc_b) then 'GOOD AGREEMENT'
      when distance_m / acc_b <= 1 then 'B WITHIN BOUNDS' when distance_m / acc_b <= 1.5 then 'B MODERATELY OVERCONFIDENT' when distance_m / acc_b <= 2.5 then 'B OVERCONFIDENT' else 'B EXTREMELY OVERCONFIDENT' end as agreement,
    round(case when distance_m = 0 then 0 when acc_a < 250 then distance_m / acc_b end, 4) as confidence_ratio, round(lat_b - lat_a, 6) as lat_delta, round(acc_b - acc_a, 4) as acc_delta from cmp""",
)
def c03(spark, sf_dir):
    """C-03 to C-10, C-18, J-05, S-17."""
    r = lambda c, n=4: F.round(c, n).alias(c)
    return _compared(spark, sf_dir).select("request_id", "scenario", "location_type", r("distance_m", 3), r("uncertainty_m"), "agreement", r("confidence_ratio"), r("lat_delta", 6), r("acc_delta"))


@query("C02_report_mac", "select s_suppkey, case when s_suppkey % 4 = 0 then null else upper(substr(x, 1, 2) || ':' || substr(x, 3, 2) || ':' || substr(x, 5, 2) || ':' || substr(x, 7, 2) || ':' || substr(x, 9, 2) || ':' || substr(x, 11, 2)) end as mac from (select s_suppkey, lpad(lower(to_hex(s_suppkey)), 12, '0') as x from supplier)")
def c02(spark, sf_dir):
    """C-02."""
    x = F.lpad(F.lower(F.hex("s_suppkey")), 12, "0")
    dashed = F.concat_ws("-", *[F.substring(x, 2 * i + 1, 2) for i in range(6)])
    raw = F.when(F.col("s_suppkey") % 4 == 0, "abc").when(F.col("s_suppkey") % 2 == 0, dashed).otherwise(x)
    return h.read(spark, sf_dir, "supplier").select("s_suppkey", wifi.report_mac(raw).alias("mac"))


def _reports(spark, sf_dir) -> DataFrame:
    """Report documents: a request's scans as provider A sent them, some without id or frequency."""
    s = h.scans(spark, sf_dir).withColumn("id", F.when(F.col("pos") % 17 == 0, " ").otherwise(F.col("mac_addr")))
    one = F.struct("pos", "id", F.col("rssi").alias("signalStrength"), F.when(F.col("pos") % 5 != 0, F.col("frequency")).alias("frequency"), F.lit(None).cast("string").alias("ssid"))
    w = s.groupBy("request_id").agg(F.sort_array(F.collect_list(one)).alias("w"))
    info = F.transform("w", lambda x: x.dropFields("pos"))
    cells = F.when(F.col("request_id") % 3 == 0, F.array(F.create_map(F.lit("cellId"), F.lit("1")))).otherwise(F.array().cast("array<map<string,string>>"))
    req = F.struct(F.lit("client").alias("clientId"), F.col("request_id").cast("string").alias("requestId"), info.alias("wifiInfo"), cells.alias("cellInfo"))
    errors = F.array(F.struct(F.lit("E1").alias("code"), F.lit("first").alias("message"), F.lit("why").alias("description")), F.struct(F.lit("E2").alias("code"), F.lit("second").alias("message"), F.lit(None).cast("string").alias("description")))
    response = F.struct((F.col("request_id") % 4 != 0).alias("success"), F.when(F.col("request_id") % 4 == 0, F.lit("old message")).alias("errorMessage"), F.struct(F.when(F.col("request_id") % 8 == 0, errors).alias("errors")).alias("svcError"))
    return w.select(F.struct(F.struct(req.alias("svcReq")).alias("svcBody")).alias("sourceRequest"), response.alias("sourceResponse"))


@query(
    "C01_C19_C20_report_mapping",
    f"with {h.SQL['scans']} select request_id::varchar as request_id, count(*) filter (where pos % 17 <> 0)::int as n_scans, count(*) filter (where pos % 17 <> 0 and pos % 5 = 0)::int as defaults_used, count(*) filter (where pos % 17 = 0)::int as dropped, count(*) filter (where pos % 17 <> 0) = 0 as invalid, "
    "case when any_value(request_id) % 3 = 0 then 'CELL_PRESENT' else 'WIFI_ONLY' end as request_kind, count(*) filter (where pos % 5 <> 0)::int as aps_with_frequency, round(avg(rssi), 6) as avg_signal, max(rssi) as max_signal from scans group by request_id",
)
def c01(spark, sf_dir):
    """C-01, C-19, C-20."""
    out = compare.request_kind(compare.to_request(_reports(spark, sf_dir)))
    return out.select("request_id", F.size("scans").alias("n_scans"), "defaults_used", "dropped", "invalid", "request_kind", "aps_with_frequency", F.round("avg_signal", 6).alias("avg_signal"), "max_signal")


@query("C13_error_details", f"with {h.SQL['scans']} select distinct request_id::varchar as request_id, case when request_id % 8 = 0 then 'Code E1: first (why); Code E2: second' when request_id % 4 = 0 then 'old message' end as details from scans")
def c13(spark, sf_dir):
    """C-13."""
    return _reports(spark, sf_dir).select(F.col("sourceRequest.svcBody.svcReq.requestId").alias("request_id"), compare.error_details(F.col("sourceResponse")).alias("details"))


def _enriched(spark, sf_dir) -> DataFrame:
    s, known = h.scans(spark, sf_dir), h.registry(spark, sf_dir).where("mac_addr not like '%3'")
    used = s.where("pos % 2 = 0").select("request_id", "mac_addr")
    return compare.enrich(s.select("request_id", "mac_addr"), known, used)


@query(
    "C14_C15_J03_enrichment",
    f"""with {h.SQL['reg']}, {h.SQL['scans']}, e as (select s.request_id, r.status is not null as found, pos % 2 = 0 as used, coalesce(r.status in ('active', 'warning'), false) as eligible from scans s left join (select * from reg where mac_addr not like '%3') r using (mac_addr))
    select request_id, count(*) as total, count(*) filter (where found) as found, count(*) filter (where eligible) as eligible, count(*) filter (where used) as used, round(100.0::double * count(*) filter (where found) / count(*), 6) as found_pct, greatest(0, count(*) filter (where eligible) - count(*) filter (where used)) as unknown_exclusions from e group by request_id""",
)
def c15(spark, sf_dir):
    """C-14, C-15, J-03, C-11."""
    return compare.enrichment(_enriched(spark, sf_dir)).select("request_id", "total", "found", "eligible", "used", "found_pct", "unknown_exclusions")


@query("C16_S18_report_events", f"with {_PAIRS} select request_id, scenario from cmp")
def c16(spark, sf_dir):
    """C-16, C-12, S-18: nested JSON events, read back."""
    said = compare.report_events(_compared(spark, sf_dir))
    return said.select(F.get_json_object("value", "$.request.request_id").cast("long").alias("request_id"), F.get_json_object("value", "$.comparison.scenario").alias("scenario"))


# Reports

_CTXS = ["signal", "distribution", "geometry"]


def _contexts(spark, sf_dir) -> DataFrame:
    return positioning.with_context(_requests(spark, sf_dir))


@query("R01_factor_counts", f"with {_CTX} " + " union all ".join(f"select '{c}' as factor, {c} as value, count(*) as n from ctx group by {c}" for c in _CTXS))
def r01(spark, sf_dir):
    """R-01."""
    return reports.factor_counts(_contexts(spark, sf_dir), _CTXS)


@query("R02_aps_per_request", f"with {h.SQL['scans']}, n as (select request_id, count(*) as n from scans group by request_id) select round(avg(n), 6) as mean_n, round(median(n), 6) as median_n, max(n) as max_n, min(n) as min_n from n")
def r02(spark, sf_dir):
    """R-02."""
    n = h.scans(spark, sf_dir).groupBy("request_id").agg(F.count("*").alias("n"))
    return n.agg(*reports.stats("n"))


@query("R02_ap_histogram", f"with {h.SQL['scans']}, n as (select request_id, count(*) as n from scans group by request_id) select case when n > 4 then '4+' else n::varchar end as bucket, count(*) as n from n group by 1")
def r02b(spark, sf_dir):
    """R-02."""
    n = h.scans(spark, sf_dir).groupBy("request_id").agg(F.count("*").alias("n_scans"))
    return reports.ap_histogram(n)


@query("R03_status_counts", f"with {h.SQL['reg']}, {h.SQL['scans']} select coalesce(r.status, 'unknown') as status, count(*) as n, count(*) filter (where pos % 2 = 0) as n_used from scans s left join (select * from reg where mac_addr not like '%3') r using (mac_addr) group by 1")
def r03(spark, sf_dir):
    """R-03."""
    return reports.status_counts(_enriched(spark, sf_dir))


@query("R04_method_counts", f"with {_SEL} select case algorithm when 'LOG_DISTANCE' then 'log_distance_path_loss' when 'RSSI_RATIO' then 'rssiratio' else lower(algorithm) end as method, count(*) as n from sel group by 1")
def r04(spark, sf_dir):
    """R-04."""
    out = positioning.with_selection(_contexts(spark, sf_dir)).select(positioning.method_names(F.col("selected")).alias("methods"))
    return reports.method_counts(out)


@query("R05_success", f"with {_PAIRS} select count(*) as n, round(100 * avg(case when result_b = 'SUCCESS' then 1.0 else 0.0 end), 6) as success_pct, round(avg(acc_b), 3) as mean_acc_b, round(median(acc_b), 3) as median_acc_b, round(max(acc_b), 3) as max_acc_b, round(min(acc_b), 3) as min_acc_b, round(avg(conf_b), 3) as mean_conf_b, round(median(conf_b), 3) as median_conf_b, round(max(conf_b), 3) as max_conf_b, round(min(conf_b), 3) as min_conf_b from cmp")
def r05(spark, sf_dir):
    """R-05."""
    return reports.success(_pairs(spark, sf_dir), "result_b", "acc_b", "conf_b")


@query("R06_location_types", f"with {_PAIRS} select location_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as share_pct from cmp group by 1")
def r06(spark, sf_dir):
    """R-06."""
    return reports.shares(_compared(spark, sf_dir), "location_type")


_DIST = "count(distance_m) as n, round(avg(distance_m), 4) as mean, round(median(distance_m), 4) as median, round(quantile_cont(distance_m, 0.9), 4) as p90, round(max(distance_m), 4) as max, round(stddev(distance_m), 4) as stddev"


@query("R07_distance_stats", f"with {_PAIRS} select {_DIST} from cmp where distance_m is not null")
def r07(spark, sf_dir):
    """R-07."""
    return reports.distances(_compared(spark, sf_dir))


@query("R07_distance_by_aps", f"with {_PAIRS} select n_aps, {_DIST} from cmp where distance_m is not null group by n_aps")
def r07b(spark, sf_dir):
    """R-07."""
    return reports.distances(_compared(spark, sf_dir), "n_aps")


@query(
    "R08_accuracy_by_factor",
    f"with {_PAIRS} " + " union all ".join(f"select '{f}' as factor, {f}::varchar as value, " + ", ".join(f"round({g}({m}), 4) as {a}_{m}" for m in ("acc_a", "acc_b") for g, a in (("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max"))) + f" from cmp group by {f}" for f in ("n_aps", "scenario")),
)
def r08(spark, sf_dir):
    """R-08."""
    return reports.accuracy_by(_compared(spark, sf_dir), ["n_aps", "scenario"], ["acc_a", "acc_b"])


@query("R09_agreement_rates", f"with {_PAIRS} select count(*) filter (where location_type = 'WIFI') as n_wifi, " + ", ".join(f"round(100.0 * count(*) filter (where location_type = 'WIFI' and distance_m < {m}) / count(*) filter (where location_type = 'WIFI'), 6) as within_{m}_pct" for m in (5, 10, 20, 30, 50, 100)) + " from cmp")
def r09(spark, sf_dir):
    """R-09."""
    return reports.agreement_rates(_compared(spark, sf_dir))


@query(
    "R10_correlation",
    f"with {_PAIRS}, r as (select count(*) as n, round(corr(conf_b, distance_m), 6) as r from cmp where conf_b is not null and distance_m is not null) select n, r, case when r <= -0.7 then 'strong negative' when r <= -0.3 then 'moderate negative' when r < 0.3 then 'weak' when r < 0.7 then 'moderate positive' else 'strong positive' end as reading from r",
)
def r10(spark, sf_dir):
    """R-10."""
    return reports.confidence_correlation(_compared(spark, sf_dir), "conf_b")


# Access-point localization


@query("L01_maturity", _M + "select bssid, count(*) as n, case when count(*) < 20 then 'none' when count(*) < 50 then 'centroid' when count(*) >= 100 then 'bayesian' when count(*) % 2 = 0 then 'likelihood' else 'centroid' end as tier from m group by bssid")
def l01(spark, sf_dir):
    """L-01."""
    out = h.measurements(spark, sf_dir).groupBy("bssid").agg(F.count("*").alias("n"))
    return out.withColumn("tier", localize.maturity(F.col("n"), F.when(F.col("n") % 2 == 0, 0.9).otherwise(0.1)))


@query("L02_centroid", _M + "select bssid, count(*) as n, round(sum(quality_weight * pow(10, rssi / 10.0) * latitude) / sum(quality_weight * pow(10, rssi / 10.0)), 6) as latitude, round(sum(quality_weight * pow(10, rssi / 10.0) * longitude) / sum(quality_weight * pow(10, rssi / 10.0)), 6) as longitude from m group by bssid")
def l02(spark, sf_dir):
    """L-02."""
    return localize.centroid(h.measurements(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


_HAV = "round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(clat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(clat)) * pow(sin(radians(clon - longitude) / 2), 2)))), 6)"


@query(
    "L03_global_outliers",
    f"""{_M}, c as (select bssid, avg(latitude) as clat, avg(longitude) as clon from m group by bssid), d as (select event_id, bssid, {_HAV} as distance from m join c using (bssid)),
    e as (select *, median(distance) over (partition by bssid) as mid from d), f as (select *, median(abs(distance - mid)) over (partition by bssid) as mad from e)
    select event_id, bssid, round(distance, 3) as distance, distance > round(mid + 3 * mad, 6) + 1e-3 as is_outlier from f""",
)
def l03(spark, sf_dir):
    """L-03."""
    out = localize.outliers(h.measurements(spark, sf_dir))
    return out.select("event_id", "bssid", F.round("distance", 3).alias("distance"), (F.col("distance") > F.col("threshold") + 1e-3).alias("is_outlier"))


@query("L04_local_outlier_factor")
def l04(spark, sf_dir):
    """L-04."""
    return localize.local_outlier_factor(h.measurements(spark, sf_dir)).withColumn("lof", F.round("lof", 6))


@query("L05_mobile_hotspots", _M + "select bssid, count(*) as n, round(sqrt(pow(coalesce(stddev(latitude), 0) * 111320, 2) + pow(coalesce(stddev(longitude), 0) * 111320 * cos(radians(avg(latitude))), 2)), 3) as spread_m, count(*) >= 5 and round(sqrt(pow(coalesce(stddev(latitude), 0) * 111320, 2) + pow(coalesce(stddev(longitude), 0) * 111320 * cos(radians(avg(latitude))), 2)), 3) > 200 as mobile from m group by bssid")
def l05(spark, sf_dir):
    """L-05."""
    return localize.hotspot_spread(h.measurements(spark, sf_dir))


@query(
    "L05_neighbour_stability",
    _M.rstrip()
    + """, b as (select strftime(ingestion_timestamp, '%Y%m%d%H') as h, list(distinct bssid) as seen from m group by 1),
    r as (select bssid, strftime(ingestion_timestamp, '%Y%m%d%H') as h, min(measurement_timestamp) as ts from m group by 1, 2),
    near as (select bssid, ts, h, list_filter(seen, lambda x: x <> bssid) as near from r join b using (h)),
    was as (select bssid, near, lag(near) over (partition by bssid order by ts, h) as was from near),
    j as (select bssid, len(list_intersect(near, was)) as alike, len(near) + len(was) as all_ from was where was is not null)
    select bssid, count(*) as n, round(avg(case when all_ = 0 then 1e0 else alike::double / (all_ - alike) end), 6) as stability from j group by bssid""",
)
def l05b(spark, sf_dir):
    """L-05: batches are hours."""
    m = h.measurements(spark, sf_dir).withColumn("processing_batch_id", F.date_format("ingestion_timestamp", "yyyyMMddHH"))
    return localize.neighbour_stability(m)


def _cusum_sql() -> str:
    """The two-sided cumulative sums of both coordinates in time order."""
    order = "partition by bssid order by measurement_timestamp, event_id rows unbounded preceding"
    sides = [(c, sign) for c in ("latitude", "longitude") for sign in ("", "-")]
    z = ", ".join(f"coalesce(({c} - avg({c}) over (partition by bssid)) / nullif(stddev_pop({c}) over (partition by bssid), 0), 0) as z_{c}" for c in ("latitude", "longitude"))
    x = ", ".join(f"sum({sign}z_{c} - 0.5e0) over ({order}) as x{i}" for i, (c, sign) in enumerate(sides))
    top = ", ".join(f"x{i} - least(0, min(x{i}) over ({order}))" for i in range(4))
    return f", z as (select bssid, event_id, measurement_timestamp, {z} from m), x as (select *, {x} from z), s as (select bssid, measurement_timestamp, greatest({top}) as top from x) select bssid, count(*) as n, round(max(top), 6) as max_cusum, min(measurement_timestamp) filter (where top > 5) as moved_at from s group by bssid"


@query("L06_relocation", _M.rstrip() + _cusum_sql())
def l06(spark, sf_dir):
    """L-06."""
    return localize.relocation(h.measurements(spark, sf_dir))


@query(
    "L07_smooth_rssi",
    _M.replace("with ", "with recursive ", 1).rstrip()
    + """, o as (select bssid, event_id, measurement_timestamp, rssi::double as rssi, 9 * (1 + 1 / (1 + exp((rssi + 75) / 5e0))) as r, row_number() over (partition by bssid order by measurement_timestamp, event_id) as i from m where rssi is not null and bssid is not null),
    f as (select bssid, event_id, measurement_timestamp, rssi, i, rssi as x, r as p from o where i = 1
    union all select o.bssid, o.event_id, o.measurement_timestamp, o.rssi, o.i, f.x + (f.p + 1) / (f.p + 1 + o.r) * (o.rssi - f.x), (1 - (f.p + 1) / (f.p + 1 + o.r)) * (f.p + 1) from f join o on o.bssid = f.bssid and o.i = f.i + 1)
    select bssid, event_id, measurement_timestamp, rssi, round(x, 6) as rssi_smooth from f""",
)
def l07(spark, sf_dir):
    """L-07."""
    return localize.smooth_rssi(h.measurements(spark, sf_dir)).withColumn("rssi_smooth", F.round("rssi_smooth", 6))


@query("L08_estimate")
def l08(spark, sf_dir):
    """L-08."""
    return localize.estimate(h.measurements(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


def _halves(spark, sf_dir) -> list[DataFrame]:
    m = h.measurements(spark, sf_dir)
    agg = [F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), (F.lit(100.0) / F.count("*")).alias("variance")]
    return [m.where(f"event_id % 2 = {k}").groupBy("bssid").agg(*agg) for k in (0, 1)]


_HALF = "select bssid, avg(latitude) as lat, avg(longitude) as lon, 100.0::double / count(*) as v from m where event_id % 2 = {} group by bssid"


@query(
    "L09_fuse",
    f"""{_M}, a as ({_HALF.format(0)}), b as ({_HALF.format(1)}), f as (select coalesce(a.bssid, b.bssid) as bssid, a.lat, a.lon, a.v, b.lat as lat2, b.lon as lon2, b.v as v2 from a full join b on a.bssid = b.bssid),
    g as (select *, v / (v + v2) as k, 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))) > 5 * sqrt(v + v2) as reset from f)
    select bssid, round(case when v2 is null then lat when v is null or reset then lat2 else lat + k * (lat2 - lat) end, 6) as latitude, round(case when v2 is null then v when v is null or reset then v2 else (1 - k) * v end, 6) as variance, coalesce(reset, false) as reset from g""",
)
def l09(spark, sf_dir):
    """L-09."""
    out = localize.fuse(*_halves(spark, sf_dir))
    return out.select("bssid", F.round("latitude", 6).alias("latitude"), F.round("variance", 6).alias("variance"), "reset")


@query("L10_confidence", _M + "select bssid, round(100 * least(1, greatest(0, 0.5 * exp(-sqrt(100.0 / count(*)) / 50) + 0.3 * (1 - exp(-count(*) / 50.0)) + 0.1)), 3) as confidence from m group by bssid")
def l10(spark, sf_dir):
    """L-10."""
    n = h.measurements(spark, sf_dir).groupBy("bssid").agg(F.count("*").alias("n"))
    return n.select("bssid", F.round(localize.confidence(100.0 / F.col("n"), F.col("n"), F.lit(0.5)), 3).alias("confidence"))


# Monitoring

_L = W("log")


@query(
    "M01_consumer",
    _L + "select component, count(*) as consumed, count(*) filter (where ok) as processed, count(*) filter (where not ok) as failed, round(100.0 * count(*) filter (where ok) / count(*), 6) as success_pct, round(100.0 * count(*) filter (where not ok) / count(*), 6) as error_pct, round(avg(duration_ms), 6) as avg_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms, (epoch_us(min(ts)) // 1000) as first_ms, (epoch_us(max(ts)) // 1000) as last_ms from log group by component",
)
def m01(spark, sf_dir):
    """M-01."""
    out = monitor.consumer(h.log(spark, sf_dir), ["component"])
    return out.withColumns({"first_ms": F.unix_millis("first_at"), "last_ms": F.unix_millis("last_at")}).drop("first_at", "last_at")


@query("M01_M08_windows", _L + "select component, (epoch_us(date_trunc('hour', ts)) // 1000) as window_ms, count(*) as consumed, round(avg(duration_ms), 6) as avg_ms from log group by 1, 2")
def m08(spark, sf_dir):
    """M-01, M-08."""
    return monitor.windows(h.log(spark, sf_dir)).select("component", F.unix_millis("window_start").alias("window_ms"), "consumed", "avg_ms")


@query("M02_M09_batches", _L + "select component, count(*) as batches, count(*) filter (where ok) as delivered, count(*) filter (where not ok) as failed, count(*) filter (where event = 'rate_limited') as rate_limited, count(*) filter (where event = 'partial') as partial, round(count(*) filter (where ok) / count(*), 6) as success_rate, round(avg(batch_size), 6) as avg_messages, round(avg(duration_ms), 6) as avg_ms from log group by component")
def m02(spark, sf_dir):
    """M-02, M-09."""
    return monitor.batches(h.log(spark, sf_dir))


@query("M03_alerts", _L + "select component, count(*) filter (where duration_ms > 1200) as slow_polls, round(sum(duration_ms) / (count(*) * 1500.0) * 100, 6) > 80 as thread_busy, round(100.0 * count(*) filter (where event = 'rejected') / count(*), 6) > 5 as rejecting from log group by component")
def m03(spark, sf_dir):
    """M-03."""
    return monitor.alerts(h.log(spark, sf_dir))


@query("M04_size_buckets", _L + "select case when batch_size <= 60 then 'small' when batch_size <= 100 then 'medium' else 'large' end as bucket, count(*) as n, round(count(*) filter (where ok) / count(*), 6) as success_rate from log group by 1")
def m04(spark, sf_dir):
    """M-04."""
    return monitor.by_size(h.log(spark, sf_dir))


_RATE = "floor(((epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000)) / 60000)"


@query("M05_rate", _L + f"select component, count(*) as total, round(case when {_RATE} > 0 then count(*) / {_RATE} else count(*) end, 6) as per_minute from log group by component")
def m05(spark, sf_dir):
    """M-05."""
    return monitor.rate_per_minute(h.log(spark, sf_dir))


@query("M06_liveness", _L + f"select component, count(*) filter (where ok) >= 0.8 * count(*) as processing, false as stuck from log group by component")
def m06(spark, sf_dir):
    """M-06, as of the last event of all."""
    log = h.log(spark, sf_dir)
    stats = monitor.consumer(log, ["component"]).join(monitor.rate_per_minute(log).select("component", "per_minute"), "component")
    return monitor.liveness(stats, F.col("last_at")).select("component", "processing", "stuck")


@query(
    "M07_failure_runs",
    _L + "select component, max(run) as longest, max(run) > 5 as stuck from (select component, g, count(*) as run from (select component, n - row_number() over (partition by component order by ts, event_id) as g from (select component, ts, event_id, ok, row_number() over (partition by component order by ts, event_id) as n from log) where not ok) group by component, g) group by component",
)
def m07(spark, sf_dir):
    """M-07."""
    return monitor.longest_failures(h.log(spark, sf_dir))


@query(
    "M11_M13_labels",
    _L + "select event_id, case when event_id % 7 = 0 then 'STUCK' when event_id % 5 = 0 then case when batch_size = 0 then 'IDLE_NO_DATA' else 'IDLE_TIMEOUT' end when event_id % 3 = 0 then 'SLOW_PROCESSING' else 'ACTIVE' end as activity, case when event_id % 13 = 0 then 'DISABLED' when batch_size > 95 or (event_id % 100 > 95 and batch_size > 50) then 'CRITICAL' when batch_size > 80 or event_id % 100 > 85 then 'DEGRADED' else 'HEALTHY' end as queue, case when batch_size >= 90 then 'HIGH_USAGE' when batch_size > 72 then 'APPROACHING_LIMIT' when batch_size > 54 then 'MODERATE_USAGE' else 'NORMAL' end as memory from log",
)
def m11(spark, sf_dir):
    """M-11, M-12, M-13."""
    i, n = F.col("event_id"), F.col("batch_size")
    activity = monitor.activity(i % 7 == 0, i % 5 != 0, i % 3 != 0, n)
    return h.log(spark, sf_dir).select("event_id", activity.alias("activity"), monitor.queue_health(n, i % 100, i % 13 != 0).alias("queue"), monitor.memory_label(n.cast("double")).alias("memory"))


@query("S09_json_records", "select event_id, event_type from events")
def s09(spark, sf_dir):
    """S-09: rows to JSON records and back."""
    from skylocus.sources.files import json_records

    rows = json_records(h.read(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    return rows.select(F.from_json("value", "event_id long, event_type string").alias("r")).select("r.*")


@query("S14_registry_upsert", f"with {h.SQL['reg']} select mac_addr, case when mac_addr like '%1' then 'expired' else status end as status from reg")
def s14(spark, sf_dir):
    """S-14."""
    reg = h.registry(spark, sf_dir).select("mac_addr", "status", F.lit(1).alias("version"))
    changes = reg.where("mac_addr like '%1'").select("mac_addr", F.lit("expired").alias("status"), F.lit(2).alias("version"))
    return reg_source.upsert(reg, changes).select("mac_addr", "status")


#: Signal and geometry context of every request.
FLAGSHIP = p04
