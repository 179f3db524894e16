"""The registered queries as SQL for an independent engine (DuckDB)."""

from __future__ import annotations

from logwarden import constants as K


def _values(mapping: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())


EV = """WITH src AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (SELECT event_id AS record_id, ts, CAST(user_id AS VARCHAR) AS src_ip, 'd' || CAST(k AS VARCHAR) AS dst_ip,
  k * 660 AS dst_port, k, event_type AS action, value AS bytes_total,
  CASE k % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'udp' ELSE 'ICMP' END AS protocol,
  least(1e0, value / 500e0) AS anomaly_score,
  CASE event_type WHEN 'error' THEN 'Malware' WHEN 'signup' THEN 'Benign' WHEN 'purchase' THEN 'Exfiltration'
    WHEN 'click' THEN 'DDoS' ELSE 'BruteForce' END AS classification,
  k / 100e0 AS class_confidence FROM src)"""

SC = EV + """,
s1 AS (SELECT *, classification AS threat_category,
  CASE classification WHEN 'Benign' THEN 0e0 WHEN 'DDoS' THEN 0.6e0 WHEN 'BruteForce' THEN 0.7e0 WHEN 'Malware' THEN 0.9e0
    WHEN 'Exfiltration' THEN 1e0 ELSE 0.5e0 END AS threat_severity FROM ev),
s2 AS (SELECT *, CASE WHEN class_confidence >= 0.4e0 THEN threat_severity * class_confidence ELSE 0.5e0 * threat_severity END
  AS classification_contribution FROM s1),
s3 AS (SELECT *, 0.4e0 * anomaly_score + 0.6e0 * classification_contribution AS raw,
  classification IN ('Malware', 'Exfiltration') AS severe, classification = 'Benign' AS benign FROM s2),
s4 AS (SELECT *, CASE WHEN severe AND anomaly_score >= 0.5e0 THEN least(1e0, raw * 1.2e0)
  WHEN benign AND class_confidence >= 0.85e0 AND anomaly_score < 0.5e0 THEN raw * 0.5e0 ELSE raw END AS combined_risk_score FROM s3),
s5 AS (SELECT *, CASE WHEN combined_risk_score >= 0.8e0 THEN 'Critical' WHEN combined_risk_score >= 0.65e0 THEN 'High'
  WHEN combined_risk_score >= 0.45e0 THEN 'Medium' ELSE 'Low' END AS risk_level FROM s4),
s6 AS (SELECT *, CASE WHEN risk_level = 'Critical' THEN 'P0-Critical' WHEN risk_level = 'High' AND severe THEN 'P1-High'
  WHEN risk_level = 'High' THEN 'P2-Medium' WHEN risk_level = 'Medium' AND class_confidence >= 0.7e0 THEN 'P3-Low'
  ELSE 'P4-Info' END AS alert_priority FROM s5),
sc AS (SELECT *, alert_priority IN ('P0-Critical', 'P1-High', 'P2-Medium') AS requires_alert,
  CASE risk_level WHEN 'Critical' THEN 'Immediate investigation required'
    WHEN 'High' THEN CASE classification WHEN 'Malware' THEN 'Isolate endpoint and investigate'
      WHEN 'Exfiltration' THEN 'Block connection and investigate data access'
      WHEN 'BruteForce' THEN 'Verify account status and block source' WHEN 'DDoS' THEN 'Apply rate limiting and monitor'
      ELSE 'Investigate within 1 hour' END
    WHEN 'Medium' THEN 'Review and investigate if recurring' ELSE 'Monitor' END AS suggested_action FROM s6)"""

AL = SC + """,
al AS (SELECT *, sha256('alert|' || CAST(record_id AS VARCHAR)) AS alert_id, alert_priority AS priority,
  CAST(record_id AS VARCHAR) AS raw_record_id FROM sc WHERE requires_alert)"""

GAP = EV + """,
g AS (SELECT record_id, ts, src_ip, k, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN ' - ' ELSE action END AS txt,
  CASE WHEN k % 10 = 3 THEN NULL ELSE bytes_total END AS num FROM ev),
gm AS (SELECT *, (txt IS NULL OR trim(txt) IN ('', 'null', 'NULL', 'None', 'none', 'N/A', 'n/a', '-', 'NaN', 'nan')) AS txt_m,
  (num IS NULL OR isnan(num)) AS num_m FROM g)"""

FBC = """,
f0 AS (SELECT record_id AS id, ts, 'a' || src_ip AS alert_id, k, CASE WHEN action IN ('click', 'purchase') THEN 'accept'
  WHEN action = 'view' THEN 'reject' WHEN action = 'signup' THEN 'reclassify' ELSE 'escalate' END AS analyst_action FROM ev),
fb AS (SELECT *, CASE WHEN analyst_action = 'reclassify' AND k % 4 > 0 THEN 'class' || CAST(k % 4 AS VARCHAR) END AS analyst_label FROM f0)"""
FB = EV + FBC

HI = SC + """,
hi AS (SELECT record_id, ts, CASE WHEN k % 11 > 0 THEN anomaly_score END AS anomaly_score,
  CASE WHEN k % 13 > 0 THEN combined_risk_score END AS risk_score,
  CASE WHEN k % 17 > 0 THEN classification END AS classification, alert_priority AS priority FROM sc)"""

US = "date_diff('microsecond', TIMESTAMP '1970-01-01 00:00:00', {})"
TS_US = US.format("ts")
ISO = "(strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(({}) % 1000000 // 1000 AS VARCHAR), 3, '0') || 'Z')".format(TS_US)
ISO_SEC = "(strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z')"
BSD_DAY = "(strftime(ts, '%b ') || CAST(day(ts) AS VARCHAR) || strftime(ts, ' %H:%M:%S'))"


def _windows(current: int, baseline: int) -> str:
    return HI + f""",
w AS (SELECT *, CASE WHEN rank <= {current} THEN 'current' ELSE 'baseline' END AS win FROM
  (SELECT *, row_number() OVER (ORDER BY ts DESC, record_id DESC) AS rank FROM hi) WHERE rank <= {current + baseline})"""


def _level(x: str) -> str:
    return f"CASE WHEN {x} < 10 THEN 'NONE' WHEN {x} < 25 THEN 'LOW' WHEN {x} < 50 THEN 'MODERATE' ELSE 'HIGH' END"


def _shift(column: str = "classification") -> str:
    return f""",
dc AS (SELECT coalesce(nullif({column}, ''), 'Unknown') AS v, count(*) FILTER (win = 'current') AS c, count(*) FILTER (win = 'baseline') AS b
  FROM w GROUP BY 1),
dt AS (SELECT sum(c) AS ct, sum(b) AS bt FROM dc),
shift AS (SELECT sum(abs(c / CAST(ct AS DOUBLE) - b / CAST(bt AS DOUBLE))) / 2 AS drift FROM dc, dt)"""


def _entropy(field: str, name: str) -> str:
    return f"""(SELECT src_ip AS e, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS {name}, count(*) AS {name}_u
  FROM (SELECT src_ip, {field} AS v, count(*) AS n FROM ev WHERE {field} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


def _first_seen(field: str) -> str:
    return EV + f""",
old AS (SELECT DISTINCT src_ip, {field} AS v FROM ev WHERE ts < TIMESTAMP '2024-01-04 00:00:00')
SELECT n.record_id, CAST(CASE WHEN n.rn = 1 AND old.v IS NULL THEN 1 ELSE 0 END AS INTEGER) AS is_new FROM
(SELECT *, row_number() OVER (PARTITION BY src_ip, {field} ORDER BY ts, record_id) AS rn FROM ev
  WHERE ts >= TIMESTAMP '2024-01-04 00:00:00') n LEFT JOIN old ON n.src_ip = old.src_ip AND n.{field} = old.v"""


def _greedy(rows: str, seconds: int, out: str = "record_id") -> str:
    """Greedy cooldown over rows(fp, ts, record_id): jump from each kept row to the next one."""
    return f"""numbered AS (SELECT fp, ts, record_id, row_number() OVER (PARTITION BY fp ORDER BY ts, record_id) AS rn FROM {rows}),
kept AS (SELECT fp, rn, ts FROM numbered WHERE rn = 1
  UNION ALL SELECT k.fp, n.rn, n.ts FROM kept k JOIN LATERAL (
    SELECT rn, ts FROM numbered n WHERE n.fp = k.fp AND n.ts >= k.ts + INTERVAL {seconds} SECOND ORDER BY rn LIMIT 1) n ON TRUE)"""


def _cooldown(prefix: str, rows: str, seconds: int) -> str:
    recursive = prefix.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{recursive}, {_greedy(rows, seconds)}
SELECT n.record_id FROM numbered n JOIN kept k ON n.fp = k.fp AND n.rn = k.rn"""


FP = "substring(sha256(classification || '|' || printf('%.1f', trunc(anomaly_score * 10) / 10) || '|' || {}), 1, 16)"

SESS = EV + """,
p AS (SELECT *, lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, record_id) AS prev FROM ev),
q AS (SELECT *, sum(CASE WHEN date_diff('microsecond', prev, ts) > 1800000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY src_ip ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING) AS sid FROM p),
ss AS (SELECT record_id, CAST(sid AS BIGINT) AS behav_session_id,
  row_number() OVER (PARTITION BY src_ip, sid ORDER BY ts, record_id) AS behav_events_in_session,
  date_diff('microsecond', min(ts) OVER (PARTITION BY src_ip, sid), ts) / 1e6 AS behav_session_duration_seconds FROM q)"""

LABELS = EV + f""",
raw AS (SELECT record_id, coalesce(n.name, 'mystery') AS attack FROM ev LEFT JOIN
  (SELECT name, CAST(row_number() OVER () - 1 AS INTEGER) AS i FROM (SELECT unnest([{', '.join("'" + n + "'" for n in K.LABEL_CLASSES)}]) AS name)) n ON ev.k = n.i),
lab AS (SELECT record_id, coalesce(m.cls, 'Unknown') AS label FROM raw LEFT JOIN (VALUES {_values(K.LABEL_CLASSES)}) m(name, cls) ON raw.attack = m.name)"""

CODES = """WITH cnt AS (SELECT 'lang' AS field, lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source),
codes AS (SELECT field, label, rk + 1 AS code FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, label) AS rk FROM cnt) WHERE rk <= 3)"""

PRED = EV + """,
cf AS (SELECT classification AS label, CASE WHEN k % 10 < 7 THEN classification WHEN k % 10 < 9 THEN 'Benign' ELSE 'Probe' END AS prediction,
  count(*) AS n FROM ev GROUP BY 1, 2)"""

LINES = EV + f""",
ln AS (SELECT record_id, k, ts, 'bytes=' || CAST(k AS VARCHAR) || ' action=' || action AS body, src_ip, protocol, dst_port, dst_ip FROM ev)"""


def _mitre(part: int) -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{'; '.join(v[part])}'" for c, v in K.MITRE.items())
    return f"CASE classification {cases} ELSE '' END"


TACTICS = "CASE classification " + " ".join(f"WHEN '{c}' THEN '{', '.join(v[0])}'" for c, v in K.MITRE.items()) + " END"

PRIORITY_LIST = ", ".join(f"('{p}')" for p in K.PRIORITIES)
FAC = ", ".join(f"'{n}'" for n in K.FACILITY_NAMES)
SEV = ", ".join(f"'{n}'" for n in K.SEVERITY_NAMES)


def _stat(table: str, key: str, fields: list[str], digits: int) -> str:
    return ", ".join(f"round(CAST({fn}({f}) AS DOUBLE), {digits}) AS stat_{f}_{n}" for f in fields
                     for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


def _pct(field: str, digits: int) -> str:
    return ", ".join(f"round(quantile_cont({field}, {p / 100}), {digits}) AS stat_{field}_p{p}" for p in K.PERCENTILES)


ORACLES: dict[str, str] = {
    # ---------------------------------------------------------------- 2.1
    "flatten_props": EV + """ SELECT record_id, src_ip AS doc_user_id, action AS doc_user_event_kind,
      '["' || action || '","' || protocol || '"]' AS doc_tags, action AS doc_tags_0, protocol AS doc_tags_1,
      CAST(dst_port AS BIGINT) AS doc_items_0_port FROM ev""",
    "infer_type": EV + """, c AS (SELECT record_id, k, CASE k % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN 'yes' WHEN 2 THEN 'false' WHEN 3 THEN '-' || CAST(k AS VARCHAR) || '.5'
      WHEN 4 THEN 'no' WHEN 5 THEN action WHEN 6 THEN 'inf' ELSE CAST(k AS VARCHAR) END AS s FROM ev)
      SELECT record_id, CASE k % 9 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'bool' WHEN 3 THEN 'float' WHEN 4 THEN 'str' WHEN 5 THEN 'str'
        WHEN 6 THEN 'str' ELSE CASE WHEN s = '1' THEN 'bool' ELSE 'int' END END AS kind,
        CASE WHEN k % 9 IN (7, 8) AND s <> '1' THEN CAST(s AS BIGINT) END AS as_int, CASE WHEN k % 9 = 3 THEN CAST(s AS DOUBLE) END AS as_double,
        CASE WHEN k % 9 > 0 THEN s END AS as_string FROM c""",
    "syslog_pri": EV + f""", p AS (SELECT record_id, (k * 2 + 1) // 8 AS f, (k * 2 + 1) % 8 AS s FROM ev)
      SELECT record_id, CAST(f AS BIGINT) AS facility, coalesce(([{FAC}])[f + 1], 'unknown(' || CAST(f AS VARCHAR) || ')') AS facility_name,
      CAST(s AS BIGINT) AS severity, ([{SEV}])[s + 1] AS severity_name FROM p""",
    "syslog_rfc3164": LINES + f""" SELECT record_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS timestamp, 'RFC3164' AS format, CAST(k AS BIGINT) AS priority,
      'host' || src_ip AS hostname, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN protocol || '[' || CAST(k AS VARCHAR) || ']' ELSE protocol END AS tag,
      CASE WHEN k % 4 = 0 THEN NULL ELSE protocol END AS program, CASE WHEN k % 4 = 0 THEN 'no tag ' ELSE '' END || body AS message FROM ln""",
    "syslog_rfc5424": LINES + f""" SELECT record_id, {ISO} AS timestamp, 'RFC5424' AS format, CAST(1 AS BIGINT) AS version,
      CASE WHEN k % 5 > 0 THEN 'h' || src_ip END AS hostname, 'app' AS app_name, CAST(NULL AS VARCHAR) AS proc_id, 'm' || CAST(k AS VARCHAR) AS msg_id, body AS message,
      CASE WHEN k % 3 > 0 THEN CAST(dst_port AS VARCHAR) END AS sd_port, CASE WHEN k % 3 > 0 THEN dst_ip END AS sd_ip FROM ln""",
    "syslog_mixed_text": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'RFC3164' ELSE 'none' END AS format,
      CAST(CASE WHEN doc_id % 3 = 0 THEN length(regexp_replace(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')) ELSE 0 END AS BIGINT) AS message_chars FROM documents""",
    "extract_ts": EV + f" SELECT record_id, CASE WHEN k % 4 IN (0, 1, 2) THEN {ISO} ELSE '' END AS timestamp FROM ev",
    # ---------------------------------------------------------------- 2.2
    "validate_schema": EV + f""" SELECT record_id, CASE WHEN k % 5 > 0 THEN {ISO} END AS timestamp, CASE WHEN k % 5 <> 1 THEN src_ip END AS src_ip,
      CASE WHEN k % 5 <> 2 THEN dst_ip END AS dst_ip, CASE WHEN k % 5 = 3 THEN 'x' ELSE CAST(dst_port AS VARCHAR) END AS dst_port, protocol,
      CASE k % 5 WHEN 0 THEN 'Missing required timestamp field' WHEN 1 THEN 'Missing required field: src_ip' WHEN 2 THEN 'Missing required field: dst_ip' ELSE '' END AS errors,
      CASE WHEN k % 5 = 3 THEN 'Field dst_port: expected int, got str' ELSE '' END AS warnings, CAST(CASE WHEN k % 5 > 2 THEN 1 ELSE 0 END AS BIGINT) AS valid FROM ev""",
    "norm_name": "SELECT o_orderkey, lower(trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS name FROM orders",
    "norm_name_urls": r"SELECT page_id, lower(trim(regexp_replace(url, '[-.\[\]\s/\\_]+', '_', 'g'), '_')) AS name FROM pages",
    "standardize": EV + """ SELECT record_id, CASE WHEN k % 2 = 0 THEN src_ip ELSE dst_ip END AS src_ip, CAST(dst_port AS BIGINT) AS dst_port,
      action, bytes_total FROM ev""",
    "is_missing": GAP + " SELECT record_id, CAST(txt_m AS BIGINT) AS txt_missing, CAST(num_m AS BIGINT) AS num_missing FROM gm",
    "drop_required": GAP + " SELECT record_id, txt, num FROM gm WHERE NOT txt_m AND NOT num_m",
    "fill_zero": GAP + " SELECT record_id, CASE WHEN txt_m THEN '0' ELSE txt END AS txt, CASE WHEN num_m THEN 0 ELSE num END AS num FROM gm",
    "fill_mean": GAP + " SELECT record_id, round(CASE WHEN num_m THEN (SELECT avg(num) FROM gm WHERE NOT num_m) ELSE num END, 6) AS num FROM gm",
    "fill_median": GAP + " SELECT record_id, round(CASE WHEN num_m THEN (SELECT quantile_cont(num, 0.5) FROM gm WHERE NOT num_m) ELSE num END, 6) AS num FROM gm",
    "fill_mode": GAP + """, mo AS (SELECT txt FROM gm WHERE NOT txt_m GROUP BY txt ORDER BY count(*) DESC, txt LIMIT 1)
      SELECT record_id, CASE WHEN txt_m THEN (SELECT txt FROM mo) ELSE txt END AS txt FROM gm""",
    "ffill": GAP + """ SELECT record_id, coalesce(last_value(CASE WHEN NOT txt_m THEN txt END IGNORE NULLS)
      OVER (PARTITION BY src_ip ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING), txt) AS txt FROM gm""",
    "ffill_global": GAP + """ SELECT record_id, last_value(CASE WHEN NOT num_m THEN num END IGNORE NULLS)
      OVER (ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING) AS num FROM gm""",
    "flag_missing": GAP + " SELECT record_id, CASE WHEN txt_m THEN CAST(1 AS BIGINT) END AS txt_missing FROM gm",
    "required_out": GAP + " SELECT record_id FROM gm WHERE txt IS NOT NULL AND txt <> '' AND num IS NOT NULL",
    "alerts_min_priority": AL + " SELECT raw_record_id, priority FROM al WHERE priority IN ('P0-Critical', 'P1-High')",
    "alert_search": AL + """ SELECT raw_record_id, priority, classification FROM al WHERE contains(lower(priority), 'critical')
      AND (contains(lower(classification), 'mal') OR contains(lower(src_ip), 'mal'))""",
    "benign_only": EV + " SELECT record_id, classification AS label FROM ev WHERE classification = 'Benign'",
    "select_features": EV + """ SELECT dst_port, bytes_total, CASE WHEN k % 3 = 0 THEN 0e0 ELSE CAST(k AS DOUBLE) END AS txt_num FROM ev""",
    "prepare_features": EV + """ SELECT classification AS label, CAST(record_id AS DOUBLE) AS record_id, CASE WHEN k % 5 < 3 THEN 0e0 ELSE bytes_total END AS a,
      CASE WHEN k % 7 > 0 THEN CAST(dst_port AS DOUBLE) ELSE 0e0 END AS b FROM ev""",
    # ---------------------------------------------------------------- 2.3
    "parse_ts": EV + f""" SELECT record_id, CASE WHEN k % 8 IN (0, 3) THEN {ISO} WHEN k % 8 = 6 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000Z'
      WHEN k % 8 = 7 THEN NULL ELSE {ISO_SEC} END AS iso FROM ev""",
    "iso_ts": EV + f" SELECT record_id, {ISO} AS iso FROM ev",
    "normalize_ts": EV + f""" SELECT record_id, CASE k % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN 'bad' END AS "Time",
      CASE WHEN k % 4 = 1 THEN CAST({TS_US} // 1000000 AS VARCHAR) END AS created,
      CASE k % 4 WHEN 0 THEN {ISO_SEC} WHEN 1 THEN {ISO_SEC} WHEN 3 THEN '' END AS timestamp_normalized,
      CASE k % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "Time_raw", CASE WHEN k % 4 = 1 THEN CAST({TS_US} // 1000000 AS VARCHAR) END AS created_raw FROM ev""",
    "time_features": EV + """, c AS (SELECT record_id, hour(ts) AS h, isodow(ts) - 1 AS w FROM ev)
      SELECT record_id, round(sin(2 * pi() * h / 24), 6) AS time_hour_sin, round(cos(2 * pi() * h / 24), 6) AS time_hour_cos,
      round(sin(2 * pi() * w / 7), 6) AS time_dow_sin, round(cos(2 * pi() * w / 7), 6) AS time_dow_cos,
      CAST(w >= 5 AS BIGINT) AS time_is_weekend, CAST(h >= 9 AND h < 17 AND w < 5 AS BIGINT) AS time_is_business_hours,
      h AS time_hour, w AS time_day_of_week FROM c""",
    "hour_dist": EV + """ SELECT r.i AS hour, round(coalesce(c.n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM ev), 6) AS share FROM range(24) r(i)
      LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n FROM ev GROUP BY 1) c ON c.h = r.i""",
    "dow_dist": EV + """ SELECT r.i AS dow, round(coalesce(c.n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM ev), 6) AS share FROM range(7) r(i)
      LEFT JOIN (SELECT isodow(ts) - 1 AS h, count(*) AS n FROM ev GROUP BY 1) c ON c.h = r.i""",
    # ---------------------------------------------------------------- 2.4
    "stat_features": EV + f", p AS (SELECT src_ip, count(*) AS stat_record_count, {_stat('ev', 'src_ip', ['bytes_total', 'dst_port'], 4)} FROM ev GROUP BY src_ip) "
                          "SELECT ev.record_id, p.* EXCLUDE (src_ip) FROM ev JOIN p USING (src_ip)",
    "stat_features_lineitem": f"SELECT l_suppkey, count(*) AS stat_record_count, {_stat('lineitem', 'l_suppkey', ['l_extendedprice', 'l_quantity'], 2)} FROM lineitem GROUP BY l_suppkey",
    "stat_percentiles": EV + f" SELECT src_ip, {_pct('bytes_total', 4)} FROM ev GROUP BY src_ip",
    "stat_percentiles_lineitem": f"SELECT l_suppkey, {_pct('l_extendedprice', 6)} FROM lineitem GROUP BY l_suppkey",
    "stat_unique": EV + " SELECT src_ip, " + ", ".join(f"count(DISTINCT {f}) AS stat_{f}_unique" for f in ("dst_ip", "dst_port", "action", "protocol")) + " FROM ev GROUP BY src_ip",
    "stat_entropy": EV + " SELECT a.e AS src_ip, round(a.x, 6) AS stat_dst_ip_entropy, round(b.x, 6) AS stat_dst_port_entropy, round(c.x, 6) AS stat_action_entropy, round(d.x, 6) AS stat_protocol_entropy FROM "
                    + _entropy("dst_ip", "x") + " a JOIN " + _entropy("dst_port", "x") + " b USING (e) JOIN " + _entropy("action", "x") + " c USING (e) JOIN " + _entropy("protocol", "x") + " d USING (e)",
    "global_stats": EV + " " + " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std, round(CAST(min({f}) AS DOUBLE), 4) AS min, round(CAST(max({f}) AS DOUBLE), 4) AS max FROM ev" for f in ("bytes_total", "dst_port")),
    "entity_baseline": EV + " SELECT src_ip, round(avg(bytes_total), 4) AS bytes_total_mean, round(avg(dst_port), 4) AS dst_port_mean FROM ev GROUP BY src_ip",
    "net_features": EV + """, p AS (SELECT src_ip, count(*) AS c, sum(bytes_total) / count(*) AS b, count(DISTINCT dst_ip) AS ui, count(DISTINCT dst_port) AS up FROM ev GROUP BY src_ip)
      SELECT src_ip, c AS net_conn_count, round(b, 4) AS net_bytes_per_conn, ui AS net_unique_dst_ips, up AS net_unique_dst_ports, round(en.x, 4) AS net_dst_port_entropy,
      round(ui / CAST(c AS DOUBLE), 4) AS net_fanout_ratio, CAST(ui / CAST(c AS DOUBLE) > 0.8e0 AND ui > 10 AS BIGINT) AS net_is_scanner_like FROM p JOIN """ + _entropy("dst_port", "x") + " en ON en.e = p.src_ip",
    "net_features_lineitem": """WITH p AS (SELECT l_suppkey, count(*) AS c, sum(l_quantity) / count(*) AS b, count(DISTINCT l_partkey) AS ui, count(DISTINCT l_linenumber) AS up FROM lineitem GROUP BY 1),
      en AS (SELECT l_suppkey, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS x FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1)
      SELECT p.l_suppkey, c AS net_conn_count, round(b, 4) AS net_bytes_per_conn, ui AS net_unique_dst_ips, up AS net_unique_dst_ports, round(en.x, 4) AS net_dst_port_entropy,
      round(ui / CAST(c AS DOUBLE), 4) AS net_fanout_ratio, CAST(ui / CAST(c AS DOUBLE) > 0.8e0 AND ui > 10 AS BIGINT) AS net_is_scanner_like FROM p JOIN en USING (l_suppkey)""",
    "conn_graph": EV + " SELECT src_ip AS src, count(DISTINCT dst_ip) AS out_degree FROM ev GROUP BY 1",
    "conn_edges": EV + " SELECT DISTINCT src_ip AS src, dst_ip AS dst FROM ev",
    "port_dist": EV + " SELECT CAST(dst_port AS BIGINT) AS port, count(*) AS events FROM ev GROUP BY 1",
    "risk_dist": SC + " SELECT l.risk_level, count(sc.record_id) AS n FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) l(risk_level) LEFT JOIN sc ON sc.risk_level = l.risk_level GROUP BY 1",
    "class_dist": SC + " SELECT classification, count(*) AS n FROM sc GROUP BY 1",
    "result_stats": SC + """ SELECT count(*) AS total_records, count(*) FILTER (requires_alert) AS alerts_generated, round(avg(anomaly_score), 6) AS anomaly_score_mean,
      round(stddev_pop(anomaly_score), 6) AS anomaly_score_std, round(avg(combined_risk_score), 6) AS risk_score_mean, round(stddev_pop(combined_risk_score), 6) AS risk_score_std FROM sc""",
    "priority_counts": SC + " SELECT alert_priority, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM sc) * 100, 6) AS pct FROM sc GROUP BY 1",
    "threat_level": AL + """, c AS (SELECT count(*) AS total, count(*) FILTER (priority = 'P0-Critical') AS critical, count(*) FILTER (priority = 'P1-High') AS high,
      count(*) FILTER (priority = 'P2-Medium') AS medium, CAST(0 AS BIGINT) AS low FROM al)
      SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'elevated' ELSE 'normal' END AS threat_level FROM c""",
    "priority_delta": SC + f""", d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS batch FROM sc), c AS (SELECT d.batch, p.priority, count(sc.record_id) AS n FROM d CROSS JOIN (VALUES {PRIORITY_LIST}) p(priority)
      LEFT JOIN sc ON strftime(sc.ts, '%Y-%m-%d') = d.batch AND sc.alert_priority = p.priority GROUP BY 1, 2)
      SELECT batch, priority, n, n - lag(n, 1, 0) OVER (PARTITION BY priority ORDER BY batch) AS delta FROM c""",
    "feedback_stats": FB + """ SELECT count(*) AS total_count, count(*) FILTER (analyst_action = 'accept') AS accept_count, count(*) FILTER (analyst_action = 'reject') AS reject_count,
      count(*) FILTER (analyst_action = 'reclassify') AS reclassify_count FROM fb WHERE analyst_action <> 'escalate'""",
    "feedback_labels": FB + " SELECT analyst_label, count(*) AS n FROM fb WHERE analyst_action = 'reclassify' AND analyst_label IS NOT NULL GROUP BY 1",
    "label_dist": LABELS + " SELECT label, count(*) AS n FROM lab GROUP BY 1",
    # ---------------------------------------------------------------- 2.5
    "delta_global": EV + " SELECT record_id, round(coalesce(date_diff('microsecond', lag(ts) OVER (ORDER BY ts, record_id), ts), 0) / 1e6, 6) AS time_delta_global_seconds FROM ev",
    "delta_entity": EV + " SELECT record_id, round(coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, record_id), ts), 0) / 1e6, 6) AS time_delta_entity_seconds FROM ev",
    "events_per_hour": EV + " SELECT record_id, count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS time_events_per_hour FROM ev",
    "events_per_day_by_port": EV + " SELECT record_id, count(*) OVER (PARTITION BY dst_port ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS events FROM ev",
    "sessions": SESS + " SELECT record_id, behav_session_id, behav_events_in_session, round(behav_session_duration_seconds, 6) AS behav_session_duration_seconds FROM ss",
    "new_action": _first_seen("action"),
    "new_destination": _first_seen("dst_ip"),
    "drift_windows": _windows(200, 300) + " SELECT record_id, rank, win AS \"window\" FROM w",
    "encode_fit": CODES + " SELECT field, label, code FROM codes",
    # ---------------------------------------------------------------- 2.6
    "zscore": EV + """, b AS (SELECT src_ip, avg(bytes_total) AS m1, coalesce(stddev_samp(bytes_total), 0) AS s1, avg(dst_port) AS m2, coalesce(stddev_samp(dst_port), 0) AS s2
      FROM ev WHERE ts < TIMESTAMP '2024-01-04 00:00:00' GROUP BY 1),
      z AS (SELECT record_id, CASE WHEN s1 > 0 THEN (bytes_total - m1) / s1 ELSE 0 END AS z1, CASE WHEN s2 > 0 THEN (dst_port - m2) / s2 ELSE 0 END AS z2
      FROM ev LEFT JOIN b USING (src_ip) WHERE ts >= TIMESTAMP '2024-01-04 00:00:00')
      SELECT record_id, round(z1, 5) AS behav_bytes_total_zscore, CAST(abs(z1) > 2 AS INTEGER) AS behav_bytes_total_is_anomalous,
      round(z2, 5) AS behav_dst_port_zscore, CAST(abs(z2) > 2 AS INTEGER) AS behav_dst_port_is_anomalous, round((abs(z1) + abs(z2)) / 2, 5) AS behav_deviation_score FROM z""",
    "map_labels": LABELS + " SELECT record_id, label FROM lab",
    "mitre": EV + f" SELECT record_id, {_mitre(0)} AS tactics, {_mitre(1)} AS techniques FROM ev",
    "encode": CODES + """ SELECT d.doc_id, coalesce(l.code, 1) AS lang_encoded, CASE WHEN d.doc_id % 10 = 0 THEN 0 ELSE coalesce(s.code, 1) END AS source_encoded FROM documents d
      LEFT JOIN codes l ON l.field = 'lang' AND l.label = d.lang LEFT JOIN codes s ON s.field = 'source' AND s.label = d.source""",
    "decode": CODES + """ SELECT d.doc_id, coalesce(l.label, '<RARE>') AS lang, coalesce(s.label, '<RARE>') AS source FROM documents d
      LEFT JOIN codes l ON l.field = 'lang' AND l.label = d.lang LEFT JOIN codes s ON s.field = 'source' AND s.label = d.source""",
    "feedback_by_alert": AL + FBC + " SELECT fb.alert_id, fb.id, fb.analyst_action FROM fb WHERE fb.alert_id IN (SELECT 'a' || src_ip FROM al)",
    # ---------------------------------------------------------------- 2.7, 2.8
    "port_flags": EV + f""" SELECT record_id, CAST(dst_port < 1024 AS BIGINT) AS a_dst_port_is_system, CAST(dst_port IN ({', '.join(map(str, K.COMMON_PORTS))}) AS BIGINT) AS a_dst_port_is_common,
      CAST(dst_port >= 49152 AS BIGINT) AS a_dst_port_is_dynamic, CAST(lower(protocol) = 'tcp' AS BIGINT) AS a_is_tcp, CAST(lower(protocol) = 'udp' AS BIGINT) AS a_is_udp,
      CAST(k < 1024 AS BIGINT) AS b_dst_port_is_system, CAST(k IN ({', '.join(map(str, K.COMMON_PORTS))}) AS BIGINT) AS b_dst_port_is_common, CAST(k >= 49152 AS BIGINT) AS b_dst_port_is_dynamic FROM ev""",
    "safe_divide": EV + " SELECT record_id, round(CASE WHEN k % 4 = 0 THEN 0 ELSE bytes_total / (k % 4) END, 6) AS ratio FROM ev",
    "scale": EV + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in ("bytes_total", "dst_port", "k")) + " FROM ev) SELECT record_id, "
             + ", ".join(f"round(({f} - m_{f}) / s_{f}, 6) AS {f}_scaled" for f in ("bytes_total", "dst_port", "k")) + " FROM ev, m",
    "is_anomaly": EV + " SELECT record_id, CAST(anomaly_score >= 0.5e0 AS BIGINT) AS is_anomaly FROM ev",
    "confusion": PRED + " SELECT label, prediction, n FROM cf",
    "class_report": PRED + """, a AS (SELECT label AS cls, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM cf GROUP BY 1),
      b AS (SELECT prediction AS cls, sum(n) AS predicted FROM cf GROUP BY 1),
      j AS (SELECT cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM a FULL JOIN b USING (cls)),
      pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS r FROM j)
      SELECT cls, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM pr""",
    "accuracy": PRED + " SELECT round(sum(CASE WHEN label = prediction THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM cf",
    "score_separation": EV + " SELECT round(avg(anomaly_score) FILTER (classification = 'Benign'), 6) AS benign_mean, round(avg(anomaly_score) FILTER (classification <> 'Benign'), 6) AS attack_mean FROM ev",
    "risk_level_simple": EV + """ SELECT record_id, CASE WHEN anomaly_score > 0.8e0 AND classification <> 'Benign' AND class_confidence > 0.7e0 THEN 'Critical'
      WHEN anomaly_score > 0.7e0 OR (classification IN ('Malware', 'Exfiltration') AND class_confidence > 0.5e0) THEN 'High'
      WHEN anomaly_score > 0.5e0 OR (classification <> 'Benign' AND class_confidence > 0.5e0) THEN 'Medium' ELSE 'Low' END AS risk_level FROM ev""",
    "stratified_split": EV + " SELECT classification AS label, count(*) - CAST(floor(count(*) * 0.8e0 + 1e-9) AS BIGINT) AS test, CAST(floor(count(*) * 0.8e0 + 1e-9) AS BIGINT) AS train FROM ev GROUP BY 1",
    # ---------------------------------------------------------------- 2.9
    "ensemble": SC + """ SELECT record_id, threat_category, threat_severity, round(classification_contribution, 6) AS classification_contribution,
      round(combined_risk_score, 6) AS combined_risk_score, risk_level, alert_priority, CAST(requires_alert AS BIGINT) AS requires_alert FROM sc""",
    "suggested_action": SC + " SELECT record_id, suggested_action FROM sc",
    "reasoning": SC + """ SELECT record_id, concat_ws('; ',
      CASE WHEN class_confidence >= 0.4e0 AND NOT benign THEN 'Classified as ' || classification || ' with ' || printf('%.1f%%', class_confidence * 100) || ' confidence' END,
      CASE WHEN class_confidence < 0.4e0 THEN 'Low classification confidence (' || printf('%.1f%%', class_confidence * 100) || ')' END,
      CASE WHEN anomaly_score >= 0.7e0 THEN 'High anomaly score (' || printf('%.2f', anomaly_score) || ')' WHEN anomaly_score >= 0.5e0 THEN 'Moderate anomaly score (' || printf('%.2f', anomaly_score) || ')' END,
      CASE WHEN severe AND anomaly_score >= 0.5e0 THEN 'Risk boosted: severe threat with anomalous behavior' END,
      CASE WHEN benign AND class_confidence >= 0.85e0 AND anomaly_score < 0.5e0 THEN 'Risk reduced: confident benign with normal behavior' END) AS reasoning FROM sc""",
    "alerts": AL + """ SELECT alert_id, priority, risk_level, threat_category, round(anomaly_score, 6) AS anomaly_score, round(class_confidence, 6) AS classification_confidence,
      round(combined_risk_score, 6) AS combined_risk_score, classification, suggested_action, src_ip AS source_ip, dst_ip AS destination_ip,
      CAST(dst_port AS BIGINT) AS destination_port, protocol, 'New' AS status, raw_record_id FROM al""",
    "fingerprint": EV + f" SELECT record_id, {FP.format('src_ip')} AS fp FROM ev",
    "cooldown_per_source": _cooldown(EV + ", rows0 AS (SELECT src_ip AS fp, ts, record_id FROM ev)", "rows0", 86400),
    "cooldown_busy": _cooldown(EV + f", rows0 AS (SELECT {FP.format(chr(39) + 'unknown' + chr(39))} AS fp, ts, record_id FROM ev)", "rows0", 600),
    "cooldown": (SC + f", pr AS (SELECT record_id, ts, {FP.format('src_ip')} AS fp, alert_priority, requires_alert FROM sc), rows0 AS (SELECT fp, ts, record_id FROM pr WHERE NOT requires_alert), ").replace("WITH ", "WITH RECURSIVE ", 1)
                + _greedy("rows0", 3600) + """ SELECT record_id, fp, alert_priority FROM pr WHERE requires_alert OR record_id IN (SELECT n.record_id FROM numbered n JOIN kept k ON n.fp = k.fp AND n.rn = k.rn)""",
    "alerts_sorted": AL + " SELECT raw_record_id, priority FROM al ORDER BY priority, ts, raw_record_id",
    "recent_alerts": AL + " SELECT raw_record_id, priority FROM al ORDER BY ts DESC, raw_record_id DESC LIMIT 100",
    "distinct_alerts": AL + """ SELECT batch_id, classification, raw_record_id, priority FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS batch_id,
      row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), classification ORDER BY ts, raw_record_id) AS rn FROM al) WHERE rn = 1""",
    "explain": EV + """ SELECT record_id, CASE WHEN anomaly_score > 0.7e0 THEN 'High' WHEN anomaly_score > 0.4e0 THEN 'Moderate' ELSE 'Low' END || ' anomaly detected with ' ||
      CASE WHEN class_confidence > 0.8e0 THEN 'high' WHEN class_confidence > 0.6e0 THEN 'moderate' ELSE 'low' END || ' confidence classification as ' || classification || '.' AS summary,
      CASE WHEN anomaly_score > 0.8e0 THEN 'Highly unusual behavior detected' WHEN anomaly_score > 0.6e0 THEN 'Moderately unusual behavior detected'
        WHEN anomaly_score > 0.4e0 THEN 'Slightly unusual behavior detected' ELSE 'Behavior within normal range' END AS anomaly_interpretation,
      'Pattern shows ' || CASE WHEN class_confidence > 0.8e0 THEN 'strong' WHEN class_confidence > 0.6e0 THEN 'moderate' ELSE 'weak' END || ' resemblance to ' || classification || ' attack type' AS class_interpretation FROM ev""",
    "explain_features": EV + """, x AS (SELECT record_id, CASE WHEN k % 5 = 0 THEN 443 ELSE dst_port END AS p, k * 25 AS c, bytes_total * 1000 AS b FROM ev)
      SELECT record_id, concat_ws('; ', CASE WHEN p <> 0 AND p NOT IN (80, 443, 22, 21, 25) THEN 'dst_port: Uncommon destination port' END,
      CASE WHEN c > 1000 THEN 'packet_count: High packet volume' END, CASE WHEN b > 100000 THEN 'bytes_sent: Large data transfer' END) AS features FROM x""",
    "explain_notes": SC + f""" SELECT record_id, concat_ws('; ', CASE risk_level WHEN 'Critical' THEN 'Immediate investigation recommended' WHEN 'High' THEN 'Prompt investigation recommended' END,
      CASE WHEN class_confidence < 0.6e0 THEN 'Classification confidence is moderate - manual verification suggested' END, 'Mapped to MITRE ATT&CK tactics: ' || {TACTICS}) AS notes FROM sc""",
    "alert_text": AL + """ SELECT raw_record_id, 'ALERT: ' || priority || ' - ' || threat_category AS headline, CAST(9 + 1 + CASE WHEN benign THEN 0 ELSE 1 END AS BIGINT) AS lines FROM al""",
    # ---------------------------------------------------------------- 2.10
    "envelope": """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type || ' "quoted" ' || props END AS raw_log, CASE WHEN event_id % 3 > 0 THEN 'log_entry' END AS action,
      CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k FROM events""",
    # ---------------------------------------------------------------- 2.11
    "drift_stats": _windows(500, 500) + """ SELECT win AS "window", count(*) AS n, round(avg(anomaly_score), 6) AS anomaly_mean, round(coalesce(stddev_samp(anomaly_score), 0), 6) AS anomaly_std,
      round(sum(anomaly_score) / count(*), 6) AS anomaly_mean_all, round(avg(risk_score), 6) AS risk_mean, round(coalesce(stddev_samp(risk_score), 0), 6) AS risk_std,
      round(sum(risk_score) / count(*), 6) AS risk_mean_all FROM w GROUP BY 1""",
    "drift_counts": _windows(500, 500) + """ SELECT win AS "window", coalesce(classification, 'Unknown') AS value, count(*) AS n, 'class' AS kind FROM w GROUP BY 1, 2
      UNION ALL SELECT win, priority, count(*), 'priority' FROM w GROUP BY 1, 2""",
    "drift_report": _windows(400, 500) + _shift() + f""", st AS (SELECT count(*) FILTER (win = 'current') AS cn, count(*) FILTER (win = 'baseline') AS bn,
      avg(anomaly_score) FILTER (win = 'current') AS am, stddev_samp(anomaly_score) FILTER (win = 'current') AS asd, avg(risk_score) FILTER (win = 'current') AS rm, stddev_samp(risk_score) FILTER (win = 'current') AS rsd,
      sum(anomaly_score) FILTER (win = 'baseline') / count(*) FILTER (win = 'baseline') AS ab, sum(risk_score) FILTER (win = 'baseline') / count(*) FILTER (win = 'baseline') AS rb FROM w)
      SELECT cn AS window_size, bn AS baseline_size, round(am, 5) AS anomaly_score_mean, round(asd, 5) AS anomaly_score_std, round((am - ab) / ab * 100, 5) AS anomaly_change_pct, {_level('abs((am - ab) / ab * 100)')} AS anomaly_drift,
      round(rm, 5) AS risk_score_mean, round(rsd, 5) AS risk_score_std, round((rm - rb) / rb * 100, 5) AS risk_change_pct, {_level('abs((rm - rb) / rb * 100)')} AS risk_drift,
      {_level('drift * 100')} AS class_drift FROM st, shift""",
    "class_drift": _windows(300, 600) + _shift() + " SELECT round(drift, 6) AS drift FROM shift",
    "calibrate": FB + """, n AS (SELECT count(*) FILTER (analyst_action IN ('reject', 'reclassify')) AS t, count(*) FILTER (analyst_action = 'reject') AS r FROM fb),
      m AS (SELECT avg(least(1e0, 0.7e0 + record_id % 30 / 100e0)) AS mean FROM (SELECT * FROM ev ORDER BY ts DESC, record_id DESC LIMIT 200))
      SELECT 'anomaly.high_threshold' AS path, 0.7e0 AS current, 0.75e0 AS recommended FROM m WHERE mean > 0.6e0
      UNION ALL SELECT 'priority.critical', 0.85e0, 0.88e0 FROM n WHERE t >= 20 AND r / CAST(t AS DOUBLE) > 0.4e0""",
    "feedback_valid": FB + " SELECT id, analyst_action FROM fb WHERE analyst_action IN ('accept', 'reject', 'reclassify')",
    "feedback_rejected": FB + " SELECT id, analyst_action FROM fb WHERE analyst_action NOT IN ('accept', 'reject', 'reclassify')",
    "audit_query": EV + " SELECT record_id AS event_id, 'u' || src_ip AS actor, action FROM ev WHERE action = 'error' ORDER BY ts DESC, record_id DESC LIMIT 100",
    "approval_query": "SELECT o_orderkey AS request_id, o_orderstatus AS state FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC",
    # ---------------------------------------------------------------- 2.12
    "union_logs": EV + """ SELECT record_id, src_ip, action, CAST(NULL AS VARCHAR) AS language FROM ev UNION ALL SELECT doc_id, NULL, NULL, lang FROM documents""",
    # ---------------------------------------------------------------- 2.14
    "window_profile": EV + f""", x AS (SELECT *, {TS_US} // 86400000000 * 86400 AS window_start FROM ev),
      t AS (SELECT src_ip, window_start, count(*) AS event_count, sum(bytes_total) AS bytes_total, count(DISTINCT dst_ip) AS unique_destinations FROM x GROUP BY 1, 2),
      pe AS (SELECT src_ip, window_start, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS port_entropy FROM (SELECT src_ip, window_start, dst_port, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)
      SELECT src_ip, window_start, event_count, round(bytes_total, 4) AS bytes_total, unique_destinations, round(port_entropy, 4) AS port_entropy FROM t JOIN pe USING (src_ip, window_start)""",
    "request_rate": SESS + " SELECT record_id, round(CASE WHEN behav_session_duration_seconds > 0 THEN behav_events_in_session / behav_session_duration_seconds ELSE behav_events_in_session END, 6) AS request_rate FROM ss",
    "trailing_zscore": EV + """, x AS (SELECT record_id, bytes_total AS v, count(*) OVER w AS n, avg(bytes_total) OVER w AS m, stddev_samp(bytes_total) OVER w AS s FROM ev
      WINDOW w AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW))
      SELECT record_id, round(CASE WHEN n > 1 AND s > 1e-9 THEN (v - m) / s ELSE 0 END, 4) AS deviation_from_baseline FROM x""",
    "ip_rarity": EV + """ SELECT record_id, round(1 - count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)
      / CAST(count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS DOUBLE), 6) AS ip_rarity_score FROM ev""",
    "protocol_anomaly": EV + """, b AS (SELECT src_ip, protocol, count(*) AS n FROM ev WHERE ts < TIMESTAMP '2024-01-04 00:00:00' GROUP BY 1, 2), t AS (SELECT src_ip, sum(n) AS total FROM b GROUP BY 1)
      SELECT record_id, CAST(CASE WHEN t.total IS NOT NULL AND coalesce(b.n, 0) / CAST(t.total AS DOUBLE) < 0.3e0 THEN 1 ELSE 0 END AS BIGINT) AS protocol_anomaly
      FROM ev LEFT JOIN b USING (src_ip, protocol) LEFT JOIN t USING (src_ip) WHERE ts >= TIMESTAMP '2024-01-04 00:00:00'""",
    "port_scans": EV + f""", x AS (SELECT DISTINCT action, dst_port, {TS_US} // 600000000 * 600 AS slot FROM ev),
      y AS (SELECT DISTINCT action, dst_port, slot - o.i * 600 AS window_start FROM x, range(6) o(i))
      SELECT action, window_start, count(*) AS unique_ports FROM y GROUP BY 1, 2 HAVING count(*) >= 10""",
    "alert_groups": AL + f""" SELECT {TS_US} // 3600000000 * 3600 AS window_start, classification, count(*) AS alerts, min({TS_US}) AS first_us, max({TS_US}) AS last_us FROM al GROUP BY 1, 2""",
    # ------------------------------------------------- streams: the batch SQL
    "stream_cooldown": _cooldown(EV + ", rows0 AS (SELECT src_ip AS fp, ts, record_id FROM ev)", "rows0", 86400),
    "stream_sessions": SESS + """ SELECT record_id, behav_session_id AS session_id, behav_events_in_session AS events_in_session,
      round(behav_session_duration_seconds, 6) AS session_duration_seconds FROM ss""",
    "stream_session_windows": SESS.rsplit(",\nss AS", 1)[0] + f""", sw AS (SELECT src_ip, min({TS_US}) AS start_us, max({TS_US}) + 1800000000 AS end_us, count(*) AS events FROM q GROUP BY src_ip, sid)
      SELECT * FROM sw WHERE end_us <= (SELECT max({TS_US}) FROM ev) // 1000 * 1000 - 600000000""",
    "stream_first_seen": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS src_ip, event_type AS action FROM events",
    "stream_alerts": AL + " SELECT raw_record_id, priority, classification, src_ip AS source_ip FROM al",
    "stream_envelope": "SELECT conv_id, turn, regexp_replace(text, '[\\r\\n]+$', '') AS raw_log, '0.0.0.0' AS src_ip FROM conversations",
    # ------------------------------------------------------------------ scans
    "jsonl_scan": EV + f" SELECT record_id, {ISO} AS timestamp, src_ip, CAST(k AS BIGINT) AS k, protocol AS tag FROM ev WHERE k % 10 > 1",
    "json_scan": EV + " SELECT record_id, action, CAST(k AS BIGINT) AS k FROM ev WHERE k % 10 > 0",
    "csv_scan": EV + """ SELECT record_id, action || ';"x"' || chr(10) || protocol AS note, CASE WHEN k % 5 > 0 THEN bytes_total END AS bytes,
      length(CAST(ts AS VARCHAR)) AS stamp_chars FROM ev""",
    "syslog_scan": LINES + """ SELECT CASE k % 3 WHEN 0 THEN 'RFC3164' ELSE 'RFC5424' END AS format,
      CASE WHEN k % 3 = 0 THEN 'host' || src_ip WHEN k % 5 > 0 THEN 'h' || src_ip END AS hostname, count(*) AS n FROM ln WHERE k % 3 < 2 GROUP BY 1, 2""",
    "event_xml_scan": EV + f""" SELECT record_id, CAST(k AS BIGINT) AS event_id, {ISO} AS timestamp, 'host' || src_ip AS computer, action,
      CAST(k AS VARCHAR) AS data0, protocol AS user_data FROM ev""",
    "parse_errors": "SELECT count(*) FILTER (doc_id % 2 = 0) AS parsed, count(*) FILTER (doc_id % 2 <> 0) AS rejected FROM documents",
    "detect_delimiter": EV + """, h AS (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents),
      c AS (SELECT doc_id, length(l) - length(replace(l, ',', '')) AS a, length(l) - length(replace(l, ';', '')) AS b,
        length(l) - length(replace(l, chr(9), '')) AS t, length(l) - length(replace(l, '|', '')) AS p FROM h)
      SELECT doc_id, CASE WHEN greatest(a, b, t, p) = 0 OR a = greatest(a, b, t, p) THEN ',' WHEN b = greatest(a, b, t, p) THEN ';'
        WHEN t = greatest(a, b, t, p) THEN chr(9) ELSE '|' END AS delimiter FROM c
      UNION ALL SELECT 1000000000 + record_id, CASE k % 5 WHEN 0 THEN ';' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE ',' END FROM ev""",
    "detect_format": EV + " SELECT record_id, CASE k % 6 WHEN 0 THEN 'CSV' WHEN 1 THEN 'Syslog' WHEN 2 THEN 'JSON' WHEN 3 THEN 'Syslog' WHEN 4 THEN 'CSV' END AS format FROM ev",
    "step_stats": EV + """ SELECT 'timestamp_normalizer' AS step, count(*) AS n, count(*) FILTER (k % 9 > 0) AS with_time FROM ev
      UNION ALL SELECT 'field_standardizer', count(*), count(*) FILTER (k % 9 > 0) FROM ev
      UNION ALL SELECT 'missing_values', count(*), count(*) FILTER (k % 9 > 0) FROM ev WHERE k % 4 > 0""",
    # -------------------------------------------------------------- pipelines
    "preprocess": EV + """, p AS (SELECT record_id, ts, src_ip, CASE WHEN k % 4 = 0 THEN 'none' ELSE action END AS action, bytes_total, k FROM ev),
      c AS (SELECT action, row_number() OVER (ORDER BY count(*) DESC, action) + 1 AS code FROM p GROUP BY 1)
      SELECT record_id, """ + ISO_SEC + """ AS timestamp_normalized, src_ip, action, code AS action_encoded, bytes_total FROM p JOIN c USING (action) WHERE k % 9 > 0""",
    "analysis": (SC + f", pr AS (SELECT *, {FP.format('src_ip')} AS fp FROM sc), rows0 AS (SELECT fp, ts, record_id FROM pr WHERE NOT requires_alert), ").replace("WITH ", "WITH RECURSIVE ", 1)
                + _greedy("rows0", 60) + f""" SELECT record_id, src_ip, dst_ip, classification, fp AS fingerprint, round(combined_risk_score, 6) AS risk_score, risk_level, alert_priority, suggested_action,
      concat_ws('; ',
      CASE WHEN class_confidence >= 0.4e0 AND NOT benign THEN 'Classified as ' || classification || ' with ' || printf('%.1f%%', class_confidence * 100) || ' confidence' END,
      CASE WHEN class_confidence < 0.4e0 THEN 'Low classification confidence (' || printf('%.1f%%', class_confidence * 100) || ')' END,
      CASE WHEN anomaly_score >= 0.7e0 THEN 'High anomaly score (' || printf('%.2f', anomaly_score) || ')' WHEN anomaly_score >= 0.5e0 THEN 'Moderate anomaly score (' || printf('%.2f', anomaly_score) || ')' END,
      CASE WHEN severe AND anomaly_score >= 0.5e0 THEN 'Risk boosted: severe threat with anomalous behavior' END,
      CASE WHEN benign AND class_confidence >= 0.85e0 AND anomaly_score < 0.5e0 THEN 'Risk reduced: confident benign with normal behavior' END) AS reasoning,
      coalesce({TACTICS}, '') AS mitre_tactics,
      CASE WHEN anomaly_score > 0.7e0 THEN 'High' WHEN anomaly_score > 0.4e0 THEN 'Moderate' ELSE 'Low' END || ' anomaly detected with ' ||
      CASE WHEN class_confidence > 0.8e0 THEN 'high' WHEN class_confidence > 0.6e0 THEN 'moderate' ELSE 'low' END || ' confidence classification as ' || classification || '.' AS summary
      FROM pr WHERE requires_alert OR record_id IN (SELECT n.record_id FROM numbered n JOIN kept k ON n.fp = k.fp AND n.rn = k.rn)""",
    "features": None,
}


def _all_features(fitted: bool = False) -> str:
    """Every feature column from the operators' own SQL; ``fitted`` on the events before a day and of the events since."""
    fields = ("dst_ip", "dst_port", "action", "protocol")
    cats = _entropy(fields[0], "en_" + fields[0]) + "".join(f" JOIN {_entropy(f, 'en_' + f)} USING (e)" for f in fields[1:])
    pick = ", ".join(f"c.en_{f}_u AS stat_{f}_unique, round(c.en_{f}, 6) AS stat_{f}_entropy" for f in fields)
    zero = ", ".join(f"0e0 AS stat_{f}_{n}" for f in ("bytes_in", "bytes_out") for n in ("mean", "std", "min", "max", "p25", "p50", "p75", "p95"))
    flags = lambda p: f"CAST({p} AS BIGINT)"
    day = "TIMESTAMP '2024-01-04 00:00:00'"
    start = SESS.replace("\nev AS (", "\nevery AS (", 1).replace(",\np AS (", f",\nold AS (SELECT * FROM every WHERE ts < {day}), ev AS (SELECT * FROM every WHERE ts >= {day}),\np AS (", 1) if fitted else SESS
    learned = "old" if fitted else "ev"
    new = lambda v, n: (f"CAST(row_number() OVER (PARTITION BY src_ip, {v} ORDER BY ts, record_id) = 1 AND (src_ip, {v}) NOT IN (SELECT src_ip, {v} FROM old) AS BIGINT)"
                        if fitted else "CAST(0 AS BIGINT)") + f" AS behav_is_new_{n}"
    shares = ", ".join(f", coalesce(round((SELECT count(*) FROM old WHERE {part.format('old.ts')} = {at}) / CAST((SELECT count(*) FROM old) AS DOUBLE), 6), 0) AS time_{n}_share"
                       for n, part, at in (("hour", "hour({})", "h"), ("dow", "isodow({}) - 1", "w"))).replace(", ,", ",") if fitted else ""
    return start + f""",
st AS (SELECT src_ip, count(*) AS stat_record_count, {_stat('ev', 'src_ip', ['bytes_total'], 6)}, {_pct('bytes_total', 6)} FROM ev GROUP BY 1),
cat AS (SELECT * FROM {cats}),
nt AS (SELECT src_ip, count(*) AS c, sum(bytes_total) / count(*) AS b, count(DISTINCT dst_ip) AS ui, count(DISTINCT dst_port) AS up FROM ev GROUP BY 1),
ld AS (SELECT src_ip, avg(bytes_total) AS m1, coalesce(stddev_samp(bytes_total), 0) AS d1, avg(dst_port) AS m2, coalesce(stddev_samp(dst_port), 0) AS d2 FROM {learned} GROUP BY 1),
nw AS (SELECT record_id, {new('action', 'action')}, {new('dst_ip', 'destination')} FROM ev),
tm AS (SELECT record_id, src_ip, hour(ts) AS h, isodow(ts) - 1 AS w, bytes_total AS v, dst_port AS port, lower(protocol) AS proto,
  coalesce(date_diff('microsecond', lag(ts) OVER (ORDER BY ts, record_id), ts), 0) / 1e6 AS dg,
  coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, record_id), ts), 0) / 1e6 AS de,
  count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS eh FROM ev),
z AS (SELECT tm.*, CASE WHEN d1 > 0 THEN (v - m1) / d1 ELSE 0 END AS z1, CASE WHEN d2 > 0 THEN (port - m2) / d2 ELSE 0 END AS z2,
  c AS conns, b AS per, ui, up FROM tm JOIN nt USING (src_ip) LEFT JOIN ld USING (src_ip))
SELECT st.* EXCLUDE (src_ip), {zero}, {pick},
  round(sin(2 * pi() * h / 24), 6) AS time_hour_sin, round(cos(2 * pi() * h / 24), 6) AS time_hour_cos, round(sin(2 * pi() * w / 7), 6) AS time_dow_sin, round(cos(2 * pi() * w / 7), 6) AS time_dow_cos,
  {flags('w >= 5')} AS time_is_weekend, {flags('h >= 9 AND h < 17 AND w < 5')} AS time_is_business_hours, round(de, 6) AS time_delta_entity_seconds, round(dg, 6) AS time_delta_global_seconds, eh AS time_events_per_hour{shares},
  ss.behav_session_id, ss.behav_events_in_session, round(ss.behav_session_duration_seconds, 6) AS behav_session_duration_seconds, nw.behav_is_new_action, nw.behav_is_new_destination,
  round(z1, 6) AS behav_bytes_total_zscore, {flags('abs(z1) > 2')} AS behav_bytes_total_is_anomalous, round(z2, 6) AS behav_dst_port_zscore, {flags('abs(z2) > 2')} AS behav_dst_port_is_anomalous,
  round((abs(z1) + abs(z2)) / 2, 6) AS behav_deviation_score,
  {flags('port < 1024')} AS net_dst_port_is_system, {flags(f"port IN ({', '.join(map(str, K.COMMON_PORTS))})")} AS net_dst_port_is_common, {flags('port >= 49152')} AS net_dst_port_is_dynamic,
  ui AS net_unique_dst_ips, up AS net_unique_dst_ports, round(c.en_dst_port, 6) AS net_dst_port_entropy, round(ui / CAST(conns AS DOUBLE), 6) AS net_fanout_ratio,
  {flags('ui / CAST(conns AS DOUBLE) > 0.8e0 AND ui > 10')} AS net_is_scanner_like, round(per, 6) AS net_bytes_per_conn, conns AS net_conn_count,
  {flags("proto = 'tcp'")} AS net_is_tcp, {flags("proto = 'udp'")} AS net_is_udp
FROM z JOIN st USING (src_ip) JOIN cat c ON c.e = z.src_ip JOIN ss ON ss.record_id = z.record_id JOIN nw ON nw.record_id = z.record_id"""


ORACLES["features"] = _all_features()
ORACLES["features_fitted"] = _all_features(fitted=True)
ORACLES["trailing_zscore_outlier"] = ORACLES["trailing_zscore"].replace("FROM ev\n", "FROM (SELECT * REPLACE (CASE WHEN record_id % 997 = 5 THEN 1e12 ELSE bytes_total END AS bytes_total) FROM ev)\n", 1)
ORACLES["step_counters"] = EV + """, kept AS (SELECT *, protocol IN (SELECT protocol FROM ev WHERE protocol IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) AS common
  FROM ev WHERE k % 4 > 0), c AS (SELECT count(*) AS n, count(*) FILTER (k % 4 = 0) AS gone FROM ev),
m AS (SELECT count(*) AS n, count(*) FILTER (k % 7 <= 2) AS b, count(*) FILTER (k % 5 = 0) AS s, count(*) FILTER (k % 3 = 0) AS d,
  count(*) FILTER (k % 10 = 0) AS u, count(*) FILTER (k % 10 > 0 AND NOT common) AS r FROM kept),
t AS (SELECT count(*) FILTER (k % 9 = 0) AS bad, count(*) FILTER (k % 9 = 1) AS absent, count(*) FILTER (k % 9 > 1) AS good,
  count(*) FILTER (k % 9 <> 1) + count(*) FILTER (k % 9 > 1) + count(*) FILTER (k % 4 > 0) + count(*) AS renamed FROM ev)
SELECT unnest(['timestamp_normalizer', 'timestamp_normalizer', 'timestamp_normalizer', 'timestamp_normalizer', 'field_standardizer', 'field_standardizer', 'field_standardizer',
    'missing_values', 'missing_values', 'missing_values', 'missing_values', 'missing_values', 'missing_values', 'missing_values', 'missing_values',
    'categorical_encoder', 'categorical_encoder', 'categorical_encoder', 'categorical_encoder']) AS step,
  unnest(['total_records', 'normalized', 'parse_errors', 'no_timestamp', 'total_records', 'fields_mapped', 'fields_dropped',
    'total_records', 'dropped_records', 'filled_values', 'flagged_missing', 'filled_values.bytes_total', 'filled_values.src_ip', 'filled_values.note', 'flagged_missing.dst_ip',
    'total_records', 'fields_encoded', 'unknown_values', 'rare_values']) AS counter,
  unnest([c.n, good, bad, absent, c.n, renamed, 0, c.n, gone, b + s + m.n, d, b, s, m.n, d, m.n, m.n, u, r]) AS n FROM c, m, t"""
ORACLES["stratified_split_ids"] = EV + """, h AS (SELECT record_id, classification AS label, CAST('0x' || substr(md5('42:' || CAST(record_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM ev)
SELECT record_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY h, record_id) > floor(count(*) OVER (PARTITION BY label) * 0.8e0 + 1e-9) AS BIGINT) AS is_test FROM h"""
ORACLES["alert_search_found"] = AL + """ SELECT raw_record_id, priority, classification FROM al WHERE contains(lower(priority), 'p') AND (contains(lower(classification), '1') OR contains(src_ip, '1'))"""
ORACLES["model_facts"] = EV + """, l AS (SELECT CASE WHEN bytes_total > 150 THEN 'Exfiltration' WHEN dst_port < 6000 THEN 'DDoS' ELSE 'Benign' END AS label, count(*) AS n FROM ev GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS records, CAST(sum(n) AS BIGINT) AS scored_records, CAST(0 AS BIGINT) AS outside_bounds, CAST(0 AS BIGINT) AS odd_confidences,
  CAST(sum(n - floor(n * 0.8e0 + 1e-9)) AS BIGINT) AS test_records, CAST(1 AS BIGINT) AS anomalies_score_higher, CAST(1 AS BIGINT) AS test_accuracy_over_95 FROM l"""
ORACLES["analyze_full"] = "SELECT event_id AS record_id, CAST(1 AS BIGINT) AS well_scored, CAST(1 AS BIGINT) AS alert_follows_result, CAST(1 AS BIGINT) AS first_is_kept FROM events"
ORACLES["directory_scan"] = """SELECT 'CSV' AS format, 'read' AS status, CAST(4 AS BIGINT) AS files, count(*) AS n_rows FROM events
UNION ALL SELECT 'EVTX', 'rejected', 3, 0 UNION ALL SELECT '?', 'foreign', 2, 0"""
for _name in ("cooldown", "sessions", "first_seen"):
    ORACLES[f"stream_{_name}_batches"] = ORACLES[f"stream_{_name}"]
ORACLES["stream_session_windows_batches"] = ORACLES["stream_session_windows"].replace("- 600000000", "- 1728000000000")
ORACLES["first_time_batches"] = EV + """, b AS (SELECT *, CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS batch FROM ev)
SELECT record_id, CAST(action IS NOT NULL AND row_number() OVER (PARTITION BY src_ip, action ORDER BY batch, ts, record_id) = 1 AS BIGINT) AS new_action,
  CAST(dst_ip IS NOT NULL AND row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY batch, ts, record_id) = 1 AS BIGINT) AS new_destination FROM b"""
ORACLES["stat_percentiles_fields"] = "SELECT l_returnflag AS flag, " + ", ".join(
    f"round(quantile_cont({c}, {p / 100}), 6) AS stat_{n}_p{p}" for c, n in (("l_extendedprice", "price"), ("l_quantity", "quantity"), ("l_tax", "l_tax")) for p in (5, 25, 50, 75, 99)
) + " FROM lineitem GROUP BY 1"
