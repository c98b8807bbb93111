"""The same results as SQL over the given tables, for the check.

The SQL works from the table columns the messages, lines and documents were
made of, not from the text, so it shares no parsing with the operators.
"""

from __future__ import annotations


# The metric that each type of event stands for, written out here again.
_METRIC_NAME = """CASE event_type
    WHEN 'click' THEN 'kafka_server_brokertopicmetrics_messagesin_total'
    WHEN 'view' THEN 'kafka_server_brokertopicmetrics_bytesin_total'
    WHEN 'purchase' THEN 'kafka_server_replicamanager_partitioncount'
    WHEN 'signup' THEN 'kafka_server_replicamanager_underreplicatedpartitions'
    ELSE 'jvm_threads_current' END"""

_K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"

# Events with the number in props, and the points and messages made of them.
_E = f"e AS (SELECT *, {_K} AS k FROM events)"

_POINTS = f"""{_E}, raw AS (
    SELECT ts AS _time,
           CASE WHEN event_type = 'signup' THEN 'disk_usage' ELSE 'network_traffic' END
               AS _measurement,
           event_type AS host, 'eth' || CAST(user_id % 4 AS VARCHAR) AS interfaces,
           event_id AS seq, 'rx_mibps' AS _field, value AS _value FROM e
    UNION ALL
    SELECT ts, CASE WHEN event_type = 'signup' THEN 'disk_usage' ELSE 'network_traffic' END,
           event_type, 'eth' || CAST(user_id % 4 AS VARCHAR), event_id, 'tx_mibps', k * 0.5
    FROM e WHERE k >= 5),
points AS (SELECT _time, _measurement, host, interfaces, seq, _field, CAST(_value AS DOUBLE) AS _value
           FROM raw WHERE _value IS NOT NULL)"""

_WIDE = f"""{_POINTS}, latest AS (
    SELECT date_trunc('hour', _time) AS _time, _measurement, host, interfaces, _field,
           arg_max(_value, seq) AS _value
    FROM points GROUP BY ALL),
wide AS (SELECT _time, host, interfaces,
                max(CASE WHEN _field = 'rx_mibps' THEN _value END) AS rx_mibps,
                max(CASE WHEN _field = 'tx_mibps' THEN _value END) AS tx_mibps
         FROM latest WHERE _measurement = 'network_traffic' GROUP BY ALL)"""

_METRICS = f"""m AS (SELECT ts AS _time, {_METRIC_NAME} AS metric, value AS _value,
                            event_id AS seq FROM events)"""

_LINES = f"""{_E}, named AS (
    SELECT event_id, ts, value, k,
           {_METRIC_NAME}
           || CASE WHEN event_type = 'view'
                   THEN '{{topic="t ' || CAST(user_id % 3 AS VARCHAR) || '"}}' ELSE '' END AS metric
    FROM e),
samples AS (
    SELECT event_id, ts AS timestamp, metric,
           CASE WHEN k = 3 THEN CAST('Infinity' AS DOUBLE) WHEN k = 6 THEN 1000.0 ELSE value END
               AS value
    FROM named WHERE k NOT IN (0, 1, 2, 4, 7)
      AND (k <> 5 OR {{stripped}}))"""


def _lines(stripped: bool) -> str:
    return _LINES.replace("{stripped}", "TRUE" if stripped else "FALSE")


_IMPORTANT = "metric NOT LIKE 'jvm%'"

_DETECTIONS = f"""{_E}, d AS (
    SELECT event_id AS "offset", k,
           CASE WHEN k > 4 THEN CAST(user_id AS INTEGER) END AS id,
           CASE WHEN k > 4 OR k = 3 THEN event_type END AS type,
           CASE WHEN k > 4 OR k = 3 THEN value / 100 END AS confidence
    FROM e)"""

_SENSORS = f"""{_E}, s AS (
    SELECT k, CASE WHEN k <> 0 THEN date_trunc('milliseconds', ts) END AS "@timestamp",
           CAST(user_id AS INTEGER) AS "objId", event_type AS "rsctypeId", value AS "TEMPERATURE",
           CASE WHEN k > 50 THEN value + 1 END AS "TEMPERATURE1",
           CAST(k AS DOUBLE) AS "HUMIDITY", CAST(NULL AS DOUBLE) AS "HUMIDITY1"
    FROM e)"""

_DESCRIBE = """count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
    round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
    round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
    round(max(v), 6) AS max"""

_SUMMARY = """round(avg(rx_mibps), 6) AS avg_rx_mibps, round(avg(tx_mibps), 6) AS avg_tx_mibps,
    round(max(rx_mibps), 6) AS max_rx_mibps, round(max(tx_mibps), 6) AS max_tx_mibps,
    round(stddev_samp(tx_mibps), 6) AS std_tx_mibps"""

_RESULT_ROW = f"""'2024-01-01 09:00:00' AS reference_time_kst, 43200 AS duration_minutes,
    '2024-01-01T00:00:00+00:00' AS query_start_utc, '2024-01-31T00:00:00+00:00' AS query_end_utc,
    strftime(min(_time), '%Y-%m-%dT%H:%M:%S+00:00') AS actual_data_start,
    strftime(max(_time), '%Y-%m-%dT%H:%M:%S+00:00') AS actual_data_end,
    count(*) AS total_records, {_SUMMARY}"""

_RESULTS = f"""{_WIDE}, full_rows AS (
    SELECT host AS experiment_label, CASE WHEN host = 'view' THEN '4k' ELSE 'FHD' END AS resolution,
           {_RESULT_ROW} FROM wide GROUP BY host),
results AS (SELECT * REPLACE (
    CASE WHEN experiment_label <> 'error' THEN avg_tx_mibps END AS avg_tx_mibps,
    CASE WHEN experiment_label <> 'purchase' THEN std_tx_mibps END AS std_tx_mibps)
    FROM full_rows)"""

_ENDS = """SELECT user_id, event_type, min(ts) AS first_time, arg_min(value, ts) AS first_value,
    max(ts) AS last_time, arg_max(value, ts) AS last_value FROM events GROUP BY ALL"""

_LOG_LINES = """pieces AS (
    SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, lang, unnest(parts) AS piece,
                    unnest(range(len(parts))) AS line_no FROM pieces),
lines AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, piece, lang <> 'fr' AS hit,
                 '2024-01-02T03:04:05.' || lpad(CAST(line_no AS VARCHAR),
                     CASE WHEN lang = 'fr' THEN 6 ELSE 9 END, '0') || 'Z' AS stamp
          FROM numbered)"""

_BOXES = """boxes AS (SELECT c_name AS name,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'N/A' END AS alias,
    CASE WHEN c_nationkey > 3 THEN 'rack-' || CAST(c_nationkey AS VARCHAR) ELSE 'N/A' END AS rack,
    CASE WHEN c_nationkey < 15 THEN '10.0.0.' || CAST(c_nationkey AS VARCHAR) ELSE 'N/A' END
        AS address,
    CASE WHEN c_acctbal > 100 THEN 'On' ELSE 'N/A' END AS power,
    CASE WHEN c_nationkey > 5 THEN 'default' ELSE 'N/A' END AS cluster,
    CASE WHEN c_acctbal > 0 THEN 'Compute' ELSE 'N/A' END AS role,
    CASE WHEN c_nationkey <> 7 THEN 'Running' ELSE 'N/A' END AS state,
    CASE WHEN c_nationkey <> 1 THEN '2024-01-01T00:00:00Z' ELSE 'N/A' END AS created_at,
    CASE WHEN c_nationkey <> 1 THEN '2024-01-01T00:00:00Z' ELSE 'N/A' END AS updated_at,
    CASE WHEN c_nationkey <> 8 THEN '10Gbps' ELSE 'N/A' END AS network_speed,
    CASE WHEN c_nationkey <> 9 THEN 'v2' ELSE 'N/A' END AS version
    FROM customer)"""


def _pivot(names: list[str]) -> str:
    cells = ",\n    ".join(
        f"max(CASE WHEN metric = '{name}' THEN _value END) AS {name}" for name in names
    )
    quoted = ", ".join(f"'{name}'" for name in names)
    return f"""WITH {_METRICS} SELECT _time, {cells} FROM m
    WHERE _time >= TIMESTAMP '2024-01-01' AND _time < TIMESTAMP '2024-01-31'
      AND metric IN ({quoted}) GROUP BY _time"""


_FOUND = [
    "jvm_threads_current",
    "kafka_server_brokertopicmetrics_bytesin_total",
    "kafka_server_brokertopicmetrics_messagesin_total",
    "kafka_server_replicamanager_partitioncount",
    "kafka_server_replicamanager_underreplicatedpartitions",
]
_ASKED = [
    "kafka_server_brokertopicmetrics_messagesin_total",
    "kafka_server_brokertopicmetrics_bytesin_total",
    "kafka_server_brokertopicmetrics_bytesout_total",
    "kafka_server_replicamanager_partitioncount",
    "kafka_server_replicamanager_leadercount",
    "kafka_server_replicamanager_offlinereplicacount",
    "kafka_server_replicamanager_underreplicatedpartitions",
]


def _age(seconds: str) -> str:
    days = f"CAST(floor({seconds} / 86400.0) AS BIGINT)"
    rest = f"((({seconds} % 86400) + 86400) % 86400)"
    return f"""CASE WHEN {days} > 0 THEN CAST({days} AS VARCHAR) || 'd'
        WHEN {rest} // 3600 > 0 THEN CAST({rest} // 3600 AS VARCHAR) || 'h'
        ELSE CAST({rest} // 60 AS VARCHAR) || 'm' END"""


def _full_time(moment: str) -> str:
    return f"""CASE WHEN extract(microseconds FROM {moment}) % 1000000 = 0
        THEN strftime({moment}, '%Y-%m-%d %H:%M:%S+00:00')
        ELSE strftime({moment}, '%Y-%m-%d %H:%M:%S.%f+00:00') END"""


SQL: dict[str, str] = {
    "lake_scan": "SELECT * FROM events",
    "series_range_scan": f"""WITH {_POINTS} SELECT * FROM points
        WHERE _time >= TIMESTAMP '2024-01-05' AND _time < TIMESTAMP '2024-01-25'""",
    "points_store": f"""WITH {_POINTS} SELECT * EXCLUDE (_value), max(_value) AS _value FROM points
        WHERE _time >= TIMESTAMP '2024-01-05' AND _time < TIMESTAMP '2024-01-25'
          AND _measurement = 'network_traffic' AND _field = 'rx_mibps' GROUP BY ALL""",
    "equal_times": """WITH d AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
        e AS (SELECT event_type, min(day) AS first_time, max(day) AS last_time FROM d GROUP BY 1)
        SELECT event_type, first_time, last_time,
            min(value) FILTER (day = first_time) AS first_value,
            max(value) FILTER (day = last_time) AS last_value
        FROM d JOIN e USING (event_type) GROUP BY ALL""",
    "points_last_write": f"""WITH {_POINTS} SELECT * EXCLUDE (_value, _measurement),
        '007' AS _measurement, max(_value) + 1 AS _value FROM points
        WHERE _time >= TIMESTAMP '2024-01-05' AND _time < TIMESTAMP '2024-01-25'
          AND _field = 'rx_mibps' GROUP BY ALL""",
    "schema_report": """SELECT * FROM (VALUES (0, 'event_id', 'bigint'),
        (1, 'ts', 'timestamp_ntz'), (2, 'user_id', 'bigint'), (3, 'event_type', 'string'),
        (4, 'value', 'double'), (5, 'props', 'string')) c(position, column_name, data_type),
        (SELECT count(*) AS row_count FROM events)""",
    "schema_merge_read": """SELECT event_id, value,
        CASE WHEN event_type NOT IN ('click', 'view') THEN props END AS props FROM events""",
    "json_decode": f"""WITH {_DETECTIONS}
        SELECT "offset", id, type, round(confidence, 6) AS confidence FROM d""",
    "threshold_filter": f"""WITH {_DETECTIONS}
        SELECT "offset", id, type, round(confidence, 6) AS confidence FROM d
        WHERE confidence >= 0.9""",
    "positions_decode": f"""WITH {_E} SELECT CASE WHEN k >= 5 THEN CAST(user_id AS INTEGER) END AS id,
        event_type AS tag_id, value AS x_position, -value AS y_position, ts AS "timestamp",
        props AS anchor_info FROM e""",
    "sensor_decode": f"""WITH {_SENSORS} SELECT
        CASE WHEN k NOT IN (1, 2) THEN "@timestamp" END AS "@timestamp",
        CASE WHEN k NOT IN (1, 2) THEN "objId" END AS "objId",
        CASE WHEN k NOT IN (1, 2) THEN "rsctypeId" END AS "rsctypeId",
        CASE WHEN k NOT IN (1, 2) THEN "TEMPERATURE" END AS "TEMPERATURE",
        CASE WHEN k NOT IN (1, 2) THEN "TEMPERATURE1" END AS "TEMPERATURE1",
        CASE WHEN k NOT IN (1, 2) THEN "HUMIDITY" END AS "HUMIDITY", "HUMIDITY1" FROM s""",
    "malformed_split": f"""WITH {_DETECTIONS} SELECT "offset", id, type,
        CASE k WHEN 0 THEN 'null_value' WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed'
               WHEN 3 THEN 'bad_field' WHEN 4 THEN 'malformed' END AS reject_reason,
        k > 4 OR k = 3 AS usable FROM d""",
    "to_json_messages": """SELECT CAST(event_id AS VARCHAR) AS "key",
        '{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type
        || '","value":' || CAST(value AS VARCHAR) || ',"props":"'
        || replace(props, '"', chr(92) || '"') || '"}' AS "value" FROM events""",
    "command_validate": """SELECT conv_id, turn,
        CASE WHEN turn IN (4, 5, 6) THEN NULL WHEN turn = 2 THEN '' ELSE text END AS command,
        CASE WHEN turn IN (1, 3, 5, 6) THEN NULL WHEN turn IN (0, 2, 4) THEN CAST(turn AS DOUBLE)
             ELSE turn + 0.5 END AS duration,
        CASE WHEN (turn = 0 OR turn > 6) AND text <> '' THEN 'success' ELSE 'error' END AS status,
        CASE WHEN turn IN (5, 6) THEN 'Not a JSON object'
             WHEN (turn = 0 OR turn > 6) AND text <> '' THEN 'Command sent successfully'
             ELSE 'Invalid input' END AS message
        FROM conversations""",
    "command_send": """SELECT CAST(conv_id AS VARCHAR) AS "key", text AS command,
        CASE WHEN turn = 0 THEN 0.0 ELSE CAST(turn + 0.5 AS DOUBLE) END AS duration
        FROM conversations WHERE (turn = 0 OR turn > 6) AND text <> ''""",
    "coerce_time_drop": """SELECT event_id, ts AS _time FROM events
        WHERE event_type <> 'error'""",
    "prom_parse": f"WITH {_lines(True)} SELECT * FROM samples",
    "prom_parse_unstripped": f"WITH {_lines(False)} SELECT * FROM samples",
    "prom_file_scan": f"""WITH {_lines(True)} SELECT metric, count(*) AS samples,
        count(*) AS stamped, min(value) AS least, max(value) AS most
        FROM samples GROUP BY metric""",
    "metric_name_filter": f"""WITH {_lines(True)} SELECT event_id, metric, value,
        metric || ': ' || CASE WHEN isinf(value) THEN 'Infinity' ELSE CAST(value AS VARCHAR) END
            AS row_text FROM samples WHERE {_IMPORTANT}""",
    "metric_rename": f"""WITH {_E}, n AS (SELECT event_id, event_type, CAST(k AS VARCHAR) AS k FROM e)
        SELECT event_id, CASE event_type
            WHEN 'click' THEN 'kafka.server<type=BrokerTopicMetrics, name=Bytes' || k
                || 'InPerSec><>Count'
            WHEN 'view' THEN 'kafka.server<type=ReplicaManager, name=Partition-' || k
                || '><>Value: 4'
            WHEN 'purchase' THEN 'kafka.server<type=KafkaServer, name=BrokerState><>Value'
            ELSE 'org.apache.zookeeper<name=Conn' || k || '><>Value' END AS name,
        CASE event_type
            WHEN 'click' THEN 'kafka_server_brokertopicmetrics_bytes' || k || 'in_total'
            WHEN 'view' THEN 'kafka_server_replicamanager_partition_' || k
            WHEN 'purchase' THEN 'kafka_server_kafkaserver_brokerstate'
            ELSE 'zookeeper_conn' || k END AS metric
        FROM n WHERE event_type <> 'error'""",
    "metric_labels": f"""WITH {_lines(True)} SELECT split_part(metric, '{{', 1) AS name,
        CASE WHEN contains(metric, '{{') THEN split_part(metric, '"', 2) END AS topic,
        count(*) AS samples FROM samples GROUP BY ALL""",
    "label_map": """WITH u AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS uid
                               FROM events)
        SELECT event_id, 'container_name' AS label, event_type AS label_value FROM u
        UNION ALL SELECT event_id, 'container_pod_zone', uid FROM u
        UNION ALL SELECT event_id, 'pod_zone', uid FROM u
        UNION ALL SELECT event_id, 'zone', uid FROM u
        UNION ALL SELECT event_id, 'name',
            CASE WHEN event_type = 'click' THEN 'n' ELSE event_type END FROM u
        UNION ALL SELECT event_id, 'node_name', 'n' FROM u WHERE event_type = 'click'
        UNION ALL SELECT event_id, 'pod_', 'bare' FROM u WHERE event_type <> 'click'
        UNION ALL SELECT event_id, '__meta_kubernetes_namespace', 'ns' || uid FROM u
            WHERE event_type <> 'error'
        UNION ALL SELECT event_id, 'namespace', 'ns' || uid FROM u WHERE event_type <> 'error'""",
    "log_parse": f"""WITH {_LOG_LINES} SELECT doc_id, line_no,
        CASE WHEN hit THEN stamp END AS "time", CASE WHEN hit THEN 'stdout' END AS stream,
        CASE WHEN hit THEN 'F' END AS tag, CASE WHEN hit THEN piece END AS message,
        CASE WHEN hit THEN TIMESTAMP '2024-01-02 03:04:05'
            + to_microseconds(CAST(line_no // 1000 AS BIGINT)) END AS ts,
        stamp || ' stdout F ' || piece AS body FROM lines""",
    "to_points": f"""WITH {_lines(False)} SELECT timestamp AS _time,
        'kafka_metrics' AS _measurement, metric, 'value' AS _field, value AS _value
        FROM samples WHERE {_IMPORTANT}""",
    "series_filter": f"""WITH {_POINTS} SELECT * FROM points
        WHERE _measurement = 'network_traffic' AND _field = 'tx_mibps' AND host = 'click'""",
    "series_recent": """SELECT * FROM events
        WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-31'""",
    "older_than": "SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15 23:59:00'",
    "older_than_count": """SELECT count(*) AS total_rows,
        count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 23:59:00') AS older_rows FROM events""",
    "retention_cut": "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-24'",
    "series_pivot": f"""WITH {_POINTS}, latest AS (
            SELECT date_trunc('hour', _time) AS _time, host, interfaces, _field,
                   arg_max(_value, seq) AS _value FROM points GROUP BY ALL)
        SELECT _time, host, interfaces,
            max(CASE WHEN _field = 'rx_mibps' THEN _value END) AS rx_mibps,
            max(CASE WHEN _field = 'tx_mibps' THEN _value END) AS tx_mibps
        FROM latest GROUP BY ALL""",
    "metric_pivot": _pivot(_ASKED),
    "metric_pivot_found": _pivot(_FOUND),
    "union_series": """SELECT event_id, ts,
        CASE WHEN event_type = 'click' THEN value END AS value,
        CASE WHEN event_type = 'error' THEN props END AS props,
        CASE WHEN event_type NOT IN ('click', 'error') THEN user_id END AS user_id FROM events""",
    "head_n": "SELECT * FROM events ORDER BY ts, event_id LIMIT 5",
    "tail_n": "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5",
    "series_summary": f"""WITH {_WIDE} SELECT count(*) AS total_records,
        min(_time) AS time_range_start, max(_time) AS time_range_end, {_SUMMARY} FROM wide""",
    "series_describe": f"""WITH {_POINTS}, v AS (SELECT host, _field, _value AS v FROM points)
        SELECT host, _field, {_DESCRIBE} FROM v GROUP BY ALL""",
    "traffic_describe": f"""WITH {_WIDE}, v AS (
            SELECT 'rx_mibps' AS "column", rx_mibps AS v FROM wide
            UNION ALL SELECT 'tx_mibps', tx_mibps FROM wide)
        SELECT "column", {_DESCRIBE} FROM v GROUP BY ALL""",
    "traffic_experiment": f"""WITH {_WIDE} SELECT 'all days' AS experiment_label,
        '4K' AS resolution, {_RESULT_ROW} FROM wide WHERE host = 'click'""",
    "metric_stats": f"""WITH {_METRICS} SELECT metric, round(avg(_value), 6) AS mean,
        min(_value) AS min, max(_value) AS max, round(stddev_samp(_value), 6) AS std,
        count(*) AS "count", arg_max(_value, _time) AS last_value,
        {_full_time("min(_time)")} || ' to ' || {_full_time("max(_time)")} AS timestamp_range
        FROM m WHERE metric IN ('kafka_server_brokertopicmetrics_messagesin_total',
            'kafka_server_replicamanager_partitioncount',
            'kafka_server_replicamanager_underreplicatedpartitions') GROUP BY metric""",
    "rate_of_change": f"""WITH ends AS ({_ENDS}),
        spans AS (SELECT *, (epoch_us(last_time) - epoch_us(first_time)) / 1e6 AS seconds FROM ends)
        SELECT user_id, event_type, round(seconds, 6) AS seconds,
            round(CASE WHEN seconds > 0 THEN (last_value - first_value) / seconds ELSE 0 END, 9)
                AS rate FROM spans""",
    "metric_rates": f"""WITH {_METRICS}, ends AS (SELECT metric, arg_min(_value, _time) AS a,
            arg_max(_value, _time) AS b,
            (epoch_us(max(_time)) - epoch_us(min(_time))) / 1e6 AS seconds FROM m GROUP BY metric),
        r AS (SELECT metric, CASE WHEN seconds > 0 THEN (b - a) / seconds ELSE 0 END AS rate
              FROM ends)
        SELECT metric, round(rate, 9) AS rate, printf('%.2f', rate) AS rate_text FROM r""",
    "first_last": _ENDS,
    "inventory_nodes": f"""WITH o AS (SELECT *, date_diff('second', o_orderdate,
            TIMESTAMP '1999-01-01 06:30:00') AS secs,
            lower(split_part(o_orderpriority, '-', -1)) AS role,
            CASE WHEN o_totalprice >= 100000 THEN 'v1.' || CAST(o_custkey AS VARCHAR)
                 ELSE 'N/A' END AS version FROM orders)
        SELECT 'node-' || CAST(o_orderkey AS VARCHAR) AS name,
            CASE WHEN o_orderstatus = 'F' THEN 'Ready' ELSE 'N/A' END AS status,
            role || CASE WHEN o_orderstatus = 'O' THEN ',worker' ELSE '' END AS roles,
            {_age("secs")} AS age, version FROM o
        UNION ALL SELECT 'node-' || CAST(o_orderkey AS VARCHAR) || '-b', 'N/A', '',
            {_age("secs")}, version FROM o""",
    "inventory_boxes": f"WITH {_BOXES} SELECT * FROM boxes",
    "inventory_scan": f"""WITH {_BOXES} SELECT cluster, power, state, count(*) AS boxes
        FROM boxes GROUP BY ALL""",
    "age_format": f"""WITH s AS (SELECT event_id,
            CAST(floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(ts)) AS BIGINT) AS secs
            FROM events)
        SELECT event_id, {_age("secs")} AS age FROM s""",
    "results_filter": f"""WITH {_RESULTS} SELECT resolution, experiment_label, avg_tx_mibps,
        coalesce(std_tx_mibps, 0) AS std_tx_mibps, printf('%.1f', avg_tx_mibps) AS bar_text
        FROM results
        WHERE upper(resolution) = 'FHD' AND avg_tx_mibps IS NOT NULL""",
    "results_csv_roundtrip": f"WITH {_RESULTS} SELECT * FROM results",
    "tz_shift": """SELECT ts AS raw_ts, ts + INTERVAL 9 HOUR AS as_local_if_utc,
        ts - INTERVAL 9 HOUR AS as_utc_if_local FROM events""",
    "kst_to_utc": """SELECT event_id, CASE WHEN event_type <> 'error'
        THEN date_trunc('second', ts) - INTERVAL 9 HOUR END AS utc FROM events""",
    "rfc3339_format": f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written,
        {_full_time("ts")} AS "full"
        FROM events""",
    "table_check_counts": f"""WITH {_SENSORS} SELECT count(*) AS total_rows,
        count(*) FILTER (WHERE k NOT IN (1, 2)
            AND "@timestamp" <= TIMESTAMP '2024-01-15 23:59:00') AS older_rows FROM s""",
    "stream_message_source": f"""WITH {_E} SELECT 'detections' AS topic, event_id AS "offset",
        CAST(event_id AS VARCHAR) AS "key",
        k <> 0 AS has_value, ts AS "timestamp" FROM e""",
    "stream_detections_append": f"""WITH {_DETECTIONS}
        SELECT id, type, round(confidence, 6) AS confidence FROM d WHERE confidence >= 0.9""",
    "stream_sensor_append": f"""WITH {_SENSORS} SELECT "@timestamp", "objId", "rsctypeId",
        "TEMPERATURE", "TEMPERATURE1", "HUMIDITY", "HUMIDITY1", NULL AS reject_reason
        FROM s WHERE k NOT IN (1, 2)
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL,
            CASE k WHEN 1 THEN 'malformed' ELSE 'empty' END FROM s WHERE k IN (1, 2)""",
    "stream_all_writers": f"""WITH {_DETECTIONS}
        SELECT id, type, round(confidence, 6) AS confidence, writer FROM d,
            (VALUES ('batch 1'), ('stream 1'), ('stream 2'), ('batch 2')) w(writer)
        WHERE confidence >= 0.9""",
    "stream_restart": f"""WITH {_DETECTIONS}
        SELECT id, type, round(confidence, 6) AS confidence FROM d WHERE confidence >= 0""",
    "stream_fan_out": f"""WITH {_DETECTIONS} SELECT type, count(*) AS in_table,
        count(*) AS in_second FROM d WHERE confidence >= 0.9 GROUP BY type""",
    "stream_batched_export": """SELECT event_id AS "offset", 'detections' AS topic, TRUE AS within_limit FROM events""",
    "stream_log_source": f"""WITH {_LOG_LINES} SELECT CASE WHEN hit THEN 'stdout' END AS stream,
        CASE WHEN hit THEN 'F' END AS tag, count(*) AS lines,
        CAST(sum(CASE WHEN hit THEN length(piece) END) AS BIGINT) AS message_chars,
        CAST(sum(length(stamp || ' stdout F ' || piece)) AS BIGINT) AS body_chars,
        count(*) FILTER (WHERE hit) AS timed FROM lines GROUP BY ALL""",
    "stream_log_growth": f"""WITH {_LOG_LINES}, bodies AS (
            SELECT stamp || ' stdout F ' || piece AS body, count(*) AS times FROM lines GROUP BY 1)
        SELECT length(body) AS chars, CAST(sum(times) AS BIGINT) AS lines, count(*) AS texts FROM bodies GROUP BY 1""",
    "stream_fan_out_once": f"""WITH {_DETECTIONS} SELECT type, count(*) AS in_table,
        count(*) AS in_second FROM d WHERE confidence >= 0.9 GROUP BY type""",
    "stream_rollup": """SELECT event_type, count(*) AS "count", round(avg(value), 6) AS mean,
        round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, min(ts) AS first_time,
        max(ts) AS last_time, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value,
        TRUE AS p25_near, TRUE AS p50_near, TRUE AS p75_near FROM events GROUP BY event_type""",
    "stream_progress": """SELECT count(*) AS input_rows, 3 AS batches, 1 AS failures, 1 AS ended FROM events""",
    "debug_sink": f"""WITH {_DETECTIONS}
        SELECT id, type, round(confidence, 6) AS confidence FROM d WHERE confidence >= 0.99""",
    "table_compaction": """SELECT *, (SELECT count(*) FROM events) AS rows_during, TRUE AS fewer_files,
        TRUE AS old_removed FROM events""",
    "points_compaction": f"""WITH {_POINTS} SELECT * EXCLUDE (_value),
            max(_value + CASE WHEN host = 'click' THEN 2 ELSE 1 END) AS _value, TRUE AS stored_once FROM points
        WHERE _time >= TIMESTAMP '2024-01-05' AND _time < TIMESTAMP '2024-01-25'
          AND _measurement = 'network_traffic' AND _field = 'rx_mibps' GROUP BY ALL""",
    "retention_drop": """SELECT *, FALSE AS again, TRUE AS later_untouched FROM events
        WHERE ts >= TIMESTAMP '2024-01-24 12:00:00'""",
    "schema_changes": """SELECT event_id,
            CASE WHEN event_type IN ('click', 'view') THEN CAST(trunc(value) AS DOUBLE) ELSE value END AS amount,
            CASE WHEN event_type NOT IN ('click', 'view') THEN props END AS props,
            'amount: string does not go into double' AS why, 1 AS refused_columns FROM events""",
    "metric_pivot_map": f"""WITH {_METRICS} SELECT _time, metric, arg_max(_value, seq) AS value
        FROM m WHERE _value IS NOT NULL GROUP BY ALL""",
    "named_result": "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY event_type",
}
