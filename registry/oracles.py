"""SQL counterparts of the queries, for DuckDB over the same tables."""

from __future__ import annotations

W, D, S = r"[\p{L}\p{N}_]", r"\p{Nd}", r"[\t-\r\x1c-\x20\x85\p{Z}]"
THRESHOLD = "0.6::DOUBLE"
FEATURES = [
    "total_logs", "error_count", "warn_count", "error_rate", "warn_rate", "unique_classes", "unique_threads",
    "avg_message_length", "exception_count", "exception_rate", "unique_files", "info_count", "debug_count",
    "top_class_count",
]


def ts(col: str, name: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%g') AS {name}"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def n(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def bucket(col: str, name: str) -> str:
    return f"round(('0x' || left(md5({col}), 8))::BIGINT % 1000 / 1000.0::DOUBLE, 6) + 0.0 AS {name}"


def has(col: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(col, w.replace("'", "''")) for w in words) + ")"


LOGS = f"""
WITH ev AS (
  SELECT *, CASE
    WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'ERROR'
    WHEN ts >= TIMESTAMP '2024-01-28 12:00:00' AND ts < TIMESTAMP '2024-01-28 18:00:00' THEN 'ERROR'
    WHEN event_type = 'signup' THEN 'DEBUG'
    WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'TRACE'
    WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'WARN'
    ELSE 'INFO' END AS lvl
  FROM events
), lines AS (
  SELECT left(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 23) || '  ' || lvl || ' ' || (1000 + user_id % 7)
    || ' --- [ http-nio-8080-exec-' || (user_id % 5) || '] c.e.' || event_type || '.Svc' || (user_id % 11) || ' : ' ||
    CASE WHEN event_id = 4321 THEN 'com.acme.RareException: once'
      WHEN lvl = 'ERROR' THEN CASE event_id % 6
        WHEN 0 THEN 'java.sql.SQLException: query failed after ' || event_id || ' tries'
        WHEN 1 THEN 'java.lang.NullPointerException at com.x.Y'
        WHEN 2 THEN 'java.lang.OutOfMemoryError: Java heap space'
        WHEN 3 THEN 'Request failed status 500'
        WHEN 4 THEN 'java.net.SocketTimeoutException: timeout'
        ELSE 'com.acme.CustomError code: 503' END
      ELSE CASE event_id % 10
        WHEN 0 THEN 'GET /api/v1/items/' || user_id || ' returned: 200 in ' || event_id || ' ms'
        WHEN 1 THEN 'Connection to 10.0.' || (user_id % 256) || '.' || (event_id % 256) || ':5432 established'
        WHEN 2 THEN 'binding parameter [' || (event_id % 9) || '] as [TIMESTAMP] - [2024-01-02T03:04:05]'
        WHEN 3 THEN 'Completed POST /orders/' || event_id || ' status: 404'
        WHEN 4 THEN 'Cache refresh took ' || event_id || ' ms'
        WHEN 5 THEN 'User ' || user_id || ' signed in from /var/log/app/' || user_id || '.log'
        ELSE 'event ' || event_type || ' handled' END
    END AS value,
    'app-' || strftime(ts, '%Y-%m-%d') || '.log' AS file_path, event_id + 1 AS line_number
  FROM ev
), parsed AS (
  SELECT regexp_extract(trim(value),
    '^({D}{{4}}-{D}{{2}}-{D}{{2}}{S}+{D}{{2}}:{D}{{2}}:{D}{{2}}\\.{D}{{3}}){S}+({W}+){S}+({D}+){S}+---{S}+\\[([^\\]]+)\\]{S}+([^\\s:]+){S}*:?{S}*(.*)$',
    ['t', 'level', 'pid', 'thread', 'class_path', 'message']) AS p, file_path, line_number
  FROM lines
), logs AS MATERIALIZED (
  SELECT strptime(p.t, '%Y-%m-%d %H:%M:%S.%g') AS timestamp, p.level AS level, p.pid AS pid, trim(p.thread) AS thread,
    p.class_path AS class_path, p.message AS message, file_path, line_number,
    p.level IN ('ERROR', 'FATAL') OR {has("lower(p.message)", ["exception", "error", "failed", "fatal", "critical", "timeout", "connection refused"])} AS is_error,
    length(p.message) AS message_length,
    contains(p.message, 'Exception') OR contains(p.message, 'Error') AS has_exception,
    trim(regexp_replace(regexp_replace(regexp_replace(p.message, '{D}+', '*', 'g'), '[/\\\\][\\p{{L}}\\p{{N}}_/\\\\.]+', '/*', 'g'),
      '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '*', 'g')) AS template
  FROM parsed WHERE p.t <> ''
)"""

IDX = LOGS + """, rows AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY timestamp, file_path, line_number) - 1 AS idx FROM logs
)"""

BUCKET = "CASE WHEN {0} >= 9 THEN 'CRITICAL' WHEN {0} >= 7 THEN 'HIGH' WHEN {0} >= 5 THEN 'MEDIUM' WHEN {0} >= 1 THEN 'LOW' ELSE 'INFO' END"

SEVERITY = """, sev0 AS (
  SELECT *, regexp_extract(message,
    '(?i)\\b(?:HTTP/[0-9.]+)?\\s*(\\d{3})\\b|status[:\\s]+(\\d{3})|code[:\\s]+(\\d{3})|response[:\\s]+(\\d{3})|returned[:\\s]+(\\d{3})',
    ['a', 'b', 'c', 'd', 'e']) AS m,
    regexp_extract(message, '(?i)(OutOfMemoryError|StackOverflowError|VirtualMachineError|NoClassDefFoundError|ClassNotFoundException)', 1) AS e1,
    regexp_extract(message, '(?i)(SQLException|ConnectException|SocketTimeoutException|ConnectionException|DatabaseException|JDBCException|SQLTimeoutException|SocketException|IOException|NetworkException)', 1) AS e2,
    regexp_extract(message, '(?i)(NullPointerException|IndexOutOfBoundsException|ClassCastException|ArrayIndexOutOfBoundsException|IllegalStateException|ConcurrentModificationException|UnsupportedOperationException|RuntimeException)', 1) AS e3,
    regexp_extract(message, '(?i)(IllegalArgumentException|FileNotFoundException|ValidationException|BusinessException|InvalidParameterException|BadRequestException)', 1) AS e4
  FROM {src}
), sev1 AS (
  SELECT *, coalesce(nullif(m.a, ''), nullif(m.b, ''), nullif(m.c, ''), nullif(m.d, ''), nullif(m.e, '')) AS code FROM sev0
), sev2 AS (
  SELECT *, CASE
    WHEN code IN ('500', '503') THEN 10 WHEN code IN ('502', '504') THEN 9 WHEN code IN ('501', '505') THEN 8
    WHEN code IN ('401', '403') THEN 7 WHEN code IN ('408', '429', '451') THEN 6
    WHEN code IN ('400', '409', '412', '413', '422', '423', '424', '428', '431') THEN 5
    WHEN code IN ('404', '405', '406', '410', '411', '414', '415', '416', '417', '426') THEN 4
    WHEN code IN ('301', '302', '303', '307', '308') THEN 1 ELSE 0 END AS http_status_weight,
    CASE upper(level) WHEN 'FATAL' THEN 10 WHEN 'ERROR' THEN 8 WHEN 'WARN' THEN 5 WHEN 'INFO' THEN 1 ELSE 0 END AS level_weight,
    CASE
      WHEN e1 IN ('OutOfMemoryError', 'StackOverflowError', 'VirtualMachineError', 'NoClassDefFoundError', 'ClassNotFoundException') THEN e1
      WHEN e2 IN ('SQLException', 'ConnectException', 'SocketTimeoutException', 'ConnectionException', 'DatabaseException', 'JDBCException', 'SQLTimeoutException', 'SocketException', 'IOException', 'NetworkException') THEN e2
      WHEN e3 IN ('NullPointerException', 'IndexOutOfBoundsException', 'ClassCastException', 'ArrayIndexOutOfBoundsException', 'IllegalStateException', 'ConcurrentModificationException', 'UnsupportedOperationException', 'RuntimeException') THEN e3
      WHEN e4 IN ('IllegalArgumentException', 'FileNotFoundException', 'ValidationException', 'BusinessException', 'InvalidParameterException', 'BadRequestException') THEN e4
      WHEN contains(message, 'Exception') OR contains(message, 'Error') THEN 'UnknownException' END AS exception_type
  FROM sev1
), sev3 AS (
  SELECT *, CASE WHEN http_status_weight > 0 THEN 'HTTP_' || code END AS http_status_code,
    CASE WHEN exception_type IS NULL THEN 0 WHEN exception_type = 'UnknownException' THEN 5 WHEN exception_type = e1 THEN 10
      WHEN exception_type = e2 THEN 8 WHEN exception_type = e3 THEN 6 ELSE 4 END AS exception_weight
  FROM sev2
), sev AS MATERIALIZED (
  SELECT *, greatest(level_weight, http_status_weight, exception_weight) AS severity_score,
    """ + BUCKET.format("greatest(level_weight, http_status_weight, exception_weight)") + """ AS severity_level
  FROM sev3
)"""


def severity(src: str) -> str:
    return SEVERITY.replace("{src}", src)


def counts_of(col: str, pick: str = "count(*)") -> str:
    return ", ".join(
        f"CAST({pick} FILTER ({col} = '{v}') AS BIGINT) AS {v.lower()}_count" for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
    )


def features(width: str) -> str:
    return f""", win AS (SELECT *, time_bucket(INTERVAL '{width}', timestamp) AS time_window FROM logs),
byclass AS (SELECT time_window, class_path, count(*) AS k FROM win GROUP BY ALL),
top AS (SELECT time_window, class_path AS top_class, k AS top_class_count FROM byclass
  QUALIFY row_number() OVER (PARTITION BY time_window ORDER BY k DESC, class_path) = 1),
sums AS (SELECT time_window, count(*) AS total_logs, count(*) FILTER (level = 'ERROR') AS error_count,
  count(*) FILTER (level = 'WARN') AS warn_count, avg(is_error::INT) AS error_rate, avg((level = 'WARN')::INT) AS warn_rate,
  count(DISTINCT class_path) AS unique_classes, count(DISTINCT thread) AS unique_threads,
  avg(message_length) AS avg_message_length, count(*) FILTER (has_exception) AS exception_count,
  avg(has_exception::INT) AS exception_rate, count(DISTINCT file_path) AS unique_files,
  count(*) FILTER (level = 'INFO') AS info_count, count(*) FILTER (level = 'DEBUG') AS debug_count,
  count(*) FILTER (is_error) AS is_error_count FROM win GROUP BY time_window),
feat AS MATERIALIZED (SELECT sums.*, top_class, top_class_count FROM sums JOIN top USING (time_window)),
parted AS MATERIALIZED (SELECT *, CASE WHEN i < floor(total * 0.8::DOUBLE) THEN 'train'
  WHEN i < floor(total * 0.8::DOUBLE) + floor(total * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY time_window) - 1 AS i, count(*) OVER () AS total FROM feat))"""


WIDE = LOGS + features("6 hours")
FEATURE_OUT = ", ".join(
    [ts("time_window", "time_window")]
    + [r6(c, c) if c.endswith("rate") or c.startswith("avg") else n(c, c) for c in FEATURES]
    + [n("is_error_count", "is_error_count"), "top_class"]
)


def melt(src: str, *keys: str) -> str:
    pre = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(f"SELECT {pre}'{f}' AS feature, {i} AS pos, {f}::DOUBLE AS value FROM {src}" for i, f in enumerate(FEATURES))


BASELINE = WIDE + f""", long_train AS ({melt("(SELECT * FROM parted WHERE split = 'train')")}),
base AS MATERIALIZED (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95
  FROM long_train GROUP BY feature),
spikes AS (SELECT time_window, b AS baseline_error_rate, error_rate AS current_error_rate, error_rate / b AS multiplier,
  error_count, total_logs FROM parted, (SELECT CASE WHEN mean = 0 THEN 0.01 ELSE mean END AS b FROM base WHERE feature = 'error_rate')
  WHERE error_rate > b * 5),
zs AS (SELECT l.time_window, l.feature, l.pos, abs((l.value - b.mean) / b.std) AS z
  FROM ({melt("parted", "time_window")}) l JOIN base b USING (feature) WHERE b.std > 0),
zhits AS (SELECT time_window, sum(z) AS anomaly_score,
  string_agg(feature || ': Z-score=' || printf('%.2f', z), '; ' ORDER BY pos) AS reasons FROM zs WHERE z > 3 GROUP BY time_window)"""

SPECIAL = "length(regexp_replace(lower({0}), '[\\p{{L}}\\p{{N}} ]+', '', 'g'))"
WORDS = "len(regexp_extract_all({0}, '[^\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}]+'))"

SCORED = LOGS + f""", sc AS MATERIALIZED (SELECT line_number, is_error::INT AS y, message_length::DOUBLE AS s_length,
  {WORDS.format("lower(message)")}::DOUBLE AS s_words,
  -({SPECIAL.format("message")}::DOUBLE / greatest(length(message), 1)) AS s_special FROM logs),
scored AS MATERIALIZED (SELECT *, (s_length > 36)::INT AS p_length, (s_words > 5)::INT AS p_words, (s_special < -0.12)::INT AS p_special FROM sc),
preds AS MATERIALIZED (SELECT 'length' AS model, y AS y_true, p_length AS y_pred, s_length AS score FROM scored
  UNION ALL SELECT 'words', y, p_words, s_words FROM scored UNION ALL SELECT 'special', y, p_special, s_special FROM scored)"""


def metrics(src: str, keys: str, name: str = "met", y: str = "y_true", p: str = "y_pred") -> str:
    return f""", cells_{name} AS (SELECT {keys}, count(*) FILTER ({y} = 1 AND {p} = 1) AS tp, count(*) FILTER ({y} = 0 AND {p} = 0) AS tn,
  count(*) FILTER ({y} = 0 AND {p} = 1) AS fp, count(*) FILTER ({y} = 1 AND {p} = 0) AS fn FROM {src} GROUP BY {keys}),
{name} AS MATERIALIZED (SELECT *, coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity,
  coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS fpr, coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0) AS fnr FROM cells_{name})"""


METRIC_OUT = ", ".join([n(c, c) for c in ("tp", "tn", "fp", "fn")] + [
    r6(f'"{c}"', f'"{c}"') for c in ("accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr")
])
RANKED = SCORED + metrics("preds", "model")
AUC = """, auc AS (SELECT a.model, sum(a.neg * (b.above + a.pos / 2.0)) / nullif(max(t.p) * max(t.q), 0) AS roc_auc
  FROM pts a JOIN (SELECT model, score, tp - pos AS above FROM pts) b ON a.model = b.model AND a.score = b.score
  JOIN (SELECT model, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS q FROM pts GROUP BY model) t ON t.model = a.model GROUP BY a.model)"""


def points(src: str) -> str:
    return f""", pts AS MATERIALIZED (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS q FROM (
  SELECT model, score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg FROM {src} GROUP BY model, score)
  WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


POINTS = SCORED + points("preds")

# train: first 80 % of the normal lines; test: the others and all errors
SPLIT = IDX + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY is_error ORDER BY idx) - 1 AS rk,
  count(*) FILTER (NOT is_error) OVER () AS normals FROM rows),
train AS MATERIALIZED (SELECT * EXCLUDE (idx), rk AS idx FROM ranked WHERE NOT is_error AND rk < floor(normals * 0.8::DOUBLE)),
test AS MATERIALIZED (SELECT * EXCLUDE (idx), row_number() OVER (ORDER BY idx) - 1 AS idx FROM ranked
  WHERE is_error OR rk >= floor(normals * 0.8::DOUBLE))"""


def tfidf(src: str, max_terms: int = 100) -> str:
    return f""", tpl AS MATERIALIZED (SELECT DISTINCT template FROM {src}),
tok AS (SELECT template, regexp_extract_all(lower(template), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM tpl),
grams AS (SELECT template, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM tok),
tf AS MATERIALIZED (SELECT template, term, count(*) AS tf FROM grams GROUP BY ALL),
kept AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {max_terms}),
raw AS (SELECT template, term, tf * (ln((1 + (SELECT count(*) FROM tpl))::DOUBLE / (1 + df)) + 1) AS v FROM tf JOIN kept USING (term)),
vec AS MATERIALIZED (SELECT template, term, v / sqrt(sum(v * v) OVER (PARTITION BY template)) AS value FROM raw)"""


def moments(src: str, w: int) -> str:
    """Moments over explicitly unfolded cells: each row once per sequence that holds it."""
    return f""", total AS (SELECT count(*) AS c FROM {src}),
cells AS (SELECT template, count(*) AS c FROM {src} r, total t, range(0, {w}) k(k) WHERE r.idx - k.k >= 0 AND r.idx - k.k <= t.c - {w} GROUP BY template),
mom AS MATERIALIZED (SELECT term, sum(value * cells.c) / any_value((t.c - {w} + 1) * {w}) AS mean,
  sqrt(greatest(sum(value * value * cells.c) / any_value((t.c - {w} + 1) * {w}) - (sum(value * cells.c) / any_value((t.c - {w} + 1) * {w})) ** 2, 0)) + 1e-8 AS std
  FROM vec JOIN cells USING (template), total t GROUP BY term)"""


def tfidf_scores(w: int) -> str:
    return SPLIT + tfidf("train") + moments("train", w) + f""", n_test AS (SELECT count(*) AS c FROM test),
sums AS (SELECT r.idx - k.k AS s, v.term, sum(v.value) / {w} AS m FROM test r JOIN vec v USING (template), range(0, {w}) k(k), n_test
  WHERE r.idx - k.k >= 0 AND r.idx - k.k <= n_test.c - {w} GROUP BY ALL),
base0 AS (SELECT term, abs(mean / std) AS z0, mean, std FROM mom),
present AS (SELECT s, max(abs((m - mean) / std)) AS z FROM sums JOIN base0 USING (term) GROUP BY s),
order0 AS (SELECT term, z0, row_number() OVER (ORDER BY z0 DESC, term) AS r FROM base0),
used AS (SELECT s, list(term) AS terms FROM sums GROUP BY s),
scores AS MATERIALIZED (SELECT t.idx AS sequence_index, greatest(coalesce(p.z, 0), coalesce((SELECT max(z0) FROM order0 o
  WHERE NOT list_contains(coalesce(u.terms, []), o.term)), 0)) AS max_z_score
  FROM test t CROSS JOIN n_test LEFT JOIN present p ON p.s = t.idx LEFT JOIN used u ON u.s = t.idx WHERE t.idx <= n_test.c - {w}),
found AS MATERIALIZED (SELECT sequence_index, max_z_score, max_z_score / {THRESHOLD} AS anomaly_score FROM scores WHERE max_z_score > {THRESHOLD})"""


FOUND = tfidf_scores(15)
SEQ_SEV = FOUND + severity("test") + f""", seqsev AS MATERIALIZED (SELECT f.sequence_index, f.anomaly_score, max(severity_score) AS max_severity_score,
  avg(severity_score) AS avg_severity_score, {counts_of("severity_level")}
  FROM found f JOIN sev ON sev.idx BETWEEN f.sequence_index AND f.sequence_index + 14 GROUP BY ALL)"""
DETAILS = """, det AS MATERIALIZED (SELECT f.sequence_index, count(*) AS log_count, array_to_string(list_sort(list(DISTINCT level)), ', ') AS log_levels,
  string_agg(message, ' | ' ORDER BY idx) FILTER (idx < f.sequence_index + 3) AS sample_messages
  FROM found f JOIN test ON test.idx BETWEEN f.sequence_index AND f.sequence_index + 14 GROUP BY f.sequence_index)"""

NORMAL_TEXT = [
    "binding parameter", "==> parameters", "==>  preparing", "committing jdbc", "extracted value", "<==      total",
    "creating a new sqlsession", "closing non transactional", "jdbc connection", "hikariproxyconnection",
    "will not be managed", "registered for synchronization", "accept-language", "heartbeat status: 200",
    "discoveryclient", "channel=", "asynccommand", "write()", "completing command", "dispatching command",
    "decode done", "stack contains", "converted value on extraction", "completed cache refresh", "got delta update",
    "config resolved", "pinning to endpoint", "total number of instances", "running with spring boot",
    "adding type registration",
]
FALSE_TEXT = [
    "error='null'", "error=null", "error: 'null'", "error: null", "output=null", "output='null'", "output: null", "output: 'null'",
]
REAL_TEXT = [
    "exception", "error", "failed", "timeout", "nullpointer", "outofmemory", "connection refused", "unauthorized",
    "forbidden", "sql injection", "xss", "csrf", "stacktrace", "traceback", "fatal", "critical", "panic", "crash", "hang",
    "deadlock", "out of memory", "memory leak", "disk full", "permission denied",
]


def risk(src: str, text: str, a: str, s: str, keys: str) -> str:
    normal, real = has(f"lower({text})", NORMAL_TEXT), f"({has(f'lower({text})', REAL_TEXT)} AND NOT {has(f'lower({text})', FALSE_TEXT)})"
    return f""", risk0 AS (SELECT {keys}, CASE WHEN {real} THEN {a} * 60 + {s} * 7.0 WHEN {normal} THEN least(79.0, {a} * 15 + {s})
  ELSE least(79.0, {a} * 25 + {s} * 3.0) END AS raw FROM {src}),
risk1 AS MATERIALIZED (SELECT * EXCLUDE (raw), least(150.0, greatest(0.0, raw)) AS risk_score,
  CASE WHEN least(150.0, raw) >= 80 THEN 'CRITICAL' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 40 THEN 'MEDIUM' WHEN raw >= 20 THEN 'LOW' ELSE 'INFO' END AS risk_level
  FROM risk0)"""


SEQ_RISK = SEQ_SEV + DETAILS + risk(
    "(SELECT * FROM seqsev JOIN det USING (sequence_index))", "sample_messages", "anomaly_score", "max_severity_score",
    "sequence_index, anomaly_score, max_severity_score",
)

VOCAB = IDX + """, vocab AS MATERIALIZED (SELECT template, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, min(idx)) - 1 AS template_id
  FROM rows {where} GROUP BY template)"""
IDS = VOCAB.replace("{where}", "WHERE NOT is_error") + """, ids AS MATERIALIZED (SELECT idx, coalesce(template_id, 0) AS template_id
  FROM rows LEFT JOIN vocab USING (template)), cnt AS (SELECT count(*) AS c FROM rows)"""
SEQ_OUT = """SELECT s.idx AS sequence_index, {extra} string_agg(i.template_id::VARCHAR, ',' ORDER BY i.idx) AS "{name}"
  FROM ids s JOIN ids i ON i.idx BETWEEN s.idx AND s.idx + 9, cnt WHERE s.idx <= cnt.c - 10{cond} GROUP BY s.idx"""

NORM = ", ".join(
    f"CASE WHEN min({c}) OVER () < 0 THEN (max({c}) OVER () - {c}) ELSE ({c} - min({c}) OVER ()) END / (max({c}) OVER () - min({c}) OVER () + 1e-8) AS n{i}"
    for i, c in enumerate(("s_length", "s_words", "s_special"))
)
NORMED = SCORED + f", normed AS MATERIALIZED (SELECT *, {NORM} FROM scored)"


def copod(src: str) -> str:
    """``src``: (key, dim, value)."""
    return f""", cc AS (SELECT dim, value, count(*) AS c FROM {src} GROUP BY ALL),
ec AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY value) AS lo, sum(c) OVER (PARTITION BY dim ORDER BY value DESC) AS hi, sum(c) OVER (PARTITION BY dim) AS t FROM cc),
mu AS (SELECT dim, avg(value) AS m FROM {src} GROUP BY dim),
sk AS (SELECT dim, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3 FROM {src} JOIN mu USING (dim) GROUP BY dim),
tails AS (SELECT dim, value, -ln(lo / t) AS l, -ln(hi / t) AS r, CASE WHEN m2 > 0 AND m3 < 0 THEN -ln(lo / t) ELSE -ln(hi / t) END AS p FROM ec JOIN sk USING (dim)),
copod AS MATERIALIZED (SELECT key, greatest(sum(l), sum(r), sum(p)) AS anomaly_score FROM {src} JOIN tails USING (dim, value) GROUP BY key)"""


RUNS = WIDE + f""", wi AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY time_window) - 1 AS wid, count(*) OVER () AS wn FROM feat),
cells AS MATERIALIZED (SELECT w.wid - k.k AS key, k.k * {len(FEATURES)} + w.pos AS dim, w.value FROM ({melt("wi", "wid", "wn")}) w, range(0, 10) k(k)
  WHERE w.wid - k.k >= 0 AND w.wid - k.k <= w.wn - 10)"""
RUN_COPOD = RUNS + copod("cells") + """, flagged AS MATERIALIZED (SELECT key, anomaly_score,
  (anomaly_score > (SELECT quantile_cont(anomaly_score, 0.9) FROM copod))::INT AS is_anomaly FROM copod)"""
RUN_WIN = ", runwin AS MATERIALIZED (SELECT f.key, f.anomaly_score, w.time_window FROM flagged f JOIN wi w ON w.wid BETWEEN f.key AND f.key + 9 WHERE is_anomaly = 1)"

SCALED = WIDE + ", scaled AS MATERIALIZED (SELECT time_window, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM parted {{0}})) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM parted {{0}}) AS {c}"
    for c in FEATURES
) + " FROM parted)"

NGRAM = SPLIT + """, voc AS (SELECT DISTINCT template FROM train),
seen AS (SELECT lag(template, 2) OVER o AS a, lag(template, 1) OVER o AS b, template AS t, idx FROM train WINDOW o AS (ORDER BY idx)),
obs AS MATERIALIZED (SELECT * FROM seen WHERE idx >= 10),
test0 AS (SELECT idx, coalesce(v.template, '#') AS t FROM test LEFT JOIN voc v USING (template)),
seen_t AS (SELECT lag(t, 2) OVER o AS a, lag(t, 1) OVER o AS b, t, idx FROM test0 WINDOW o AS (ORDER BY idx)),
tgt AS MATERIALIZED (SELECT * FROM seen_t WHERE idx >= 10),
c2 AS (SELECT a, b, count(*) AS c FROM obs GROUP BY ALL), c1 AS (SELECT b, count(*) AS c FROM obs GROUP BY ALL), c0 AS (SELECT count(*) AS c FROM obs),
p2 AS (SELECT a, b, t, count(*) AS c FROM obs GROUP BY ALL), p1 AS (SELECT b, t, count(*) AS c FROM obs GROUP BY ALL), p0 AS (SELECT t, count(*) AS c FROM obs GROUP BY ALL),
prob AS MATERIALIZED (SELECT g.idx - 10 AS sequence_index, (1.0 + CASE WHEN c2.c IS NOT NULL THEN coalesce(p2.c, 0) WHEN c1.c IS NOT NULL THEN coalesce(p1.c, 0) ELSE coalesce(p0.c, 0) END)
  / (coalesce(c2.c, c1.c, c0.c) + 1 + (SELECT count(*) FROM voc)) AS p
  FROM tgt g LEFT JOIN c2 ON c2.a = g.a AND c2.b = g.b LEFT JOIN c1 ON c1.b = g.b CROSS JOIN c0
  LEFT JOIN p2 ON p2.a = g.a AND p2.b = g.b AND p2.t = g.t LEFT JOIN p1 ON p1.b = g.b AND p1.t = g.t LEFT JOIN p0 ON p0.t = g.t)"""

BEFORE = "list(t) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def context_tree(w: int, targets: str) -> str:
    """``targets``: (key, t, c) with c the w templates before t; gives cprob (key, p).  Follows SPLIT."""
    seen = BEFORE.format(part="1", order="idx", w=w)
    sizes = f"range(0, {w + 1}) s(k)"
    return f""", cvoc AS MATERIALIZED (SELECT DISTINCT template FROM train),
cobs AS (SELECT * FROM (SELECT t, {seen} AS c FROM (SELECT idx, template AS t FROM train)) WHERE len(c) = {w}),
cpair AS MATERIALIZED (SELECT k, c[{w + 1} - k:{w}] AS ctx, t, count(*) AS n FROM cobs, {sizes} GROUP BY ALL),
cnode AS MATERIALIZED (SELECT k, ctx, sum(n) AS total, count(*) AS kinds FROM cpair GROUP BY ALL HAVING k = 0 OR sum(n) >= 2),
ctgt AS MATERIALIZED ({targets}),
ccase AS MATERIALIZED (SELECT DISTINCT t, c FROM ctgt),
cstep AS (SELECT t, c, k, c[{w + 1} - k:{w}] AS ctx FROM ccase, {sizes}),
cpath AS (SELECT s.t, s.c, list(struct_pack(a := coalesce(n, 0) / (total + kinds), b := kinds / (total + kinds)) ORDER BY s.k) AS path
  FROM cstep s JOIN cnode d ON d.k = s.k AND d.ctx = s.ctx LEFT JOIN cpair p ON p.k = s.k AND p.ctx = s.ctx AND p.t = s.t GROUP BY s.t, s.c),
cp AS (SELECT t, c, list_reduce(path, lambda x, y: struct_pack(a := y.a + y.b * x.a, b := y.b * x.b)) AS r FROM cpath),
cprob AS MATERIALIZED (SELECT key, r.a + r.b / (1 + (SELECT count(*) FROM cvoc)) AS p FROM ctgt JOIN cp ON cp.t = ctgt.t AND cp.c = ctgt.c)"""


def context_tree_test(w: int) -> str:
    known = "(SELECT idx, coalesce(v.template, '#') AS t FROM test LEFT JOIN cvoc v USING (template))"
    before = BEFORE.format(part="1", order="idx", w=w)
    return context_tree(w, f"SELECT * FROM (SELECT idx - {w} AS key, t, {before} AS c FROM {known}) WHERE len(c) = {w}")


def ngram(w: int) -> str:
    """Follows SPLIT."""
    return NGRAM[len(SPLIT):].replace("idx >= 10", f"idx >= {w}").replace("idx - 10", f"idx - {w}")


SIDE_BY_SIDE = FOUND + context_tree_test(15) + ngram(15) + severity("test") + f""", sets AS MATERIALIZED (SELECT 'tfidf' AS model, sequence_index FROM found
  UNION ALL SELECT 'tree', key FROM cprob WHERE 1 - p > 0.9137 UNION ALL SELECT 'ngram', sequence_index FROM prob WHERE 1 - p > 0.9137),
setsev AS MATERIALIZED (SELECT model, sequence_index, max(severity_score) AS mx FROM sets JOIN sev ON sev.idx BETWEEN sequence_index AND sequence_index + 14 GROUP BY ALL)"""

# the ngram model's choices, by template id
CHOICES = NGRAM + """, vid AS (SELECT template, row_number() OVER (ORDER BY count(*) DESC, min(idx)) - 1 AS id FROM train GROUP BY template),
q2 AS (SELECT a, b, first(id ORDER BY c DESC, id) AS top FROM p2 JOIN vid ON template = t GROUP BY ALL),
q1 AS (SELECT b, first(id ORDER BY c DESC, id) AS top FROM p1 JOIN vid ON template = t GROUP BY ALL),
q0 AS (SELECT first(id ORDER BY c DESC, id) AS top FROM p0 JOIN vid ON template = t)"""

STREAMED = SPLIT + """, fvoc AS (SELECT DISTINCT template FROM train),
frows AS MATERIALIZED (SELECT r.*, coalesce(v.template, '#') AS t, row_number() OVER (PARTITION BY file_path ORDER BY line_number) - 1 AS position
  FROM rows r LEFT JOIN fvoc v USING (template))""" + context_tree(
    10, "SELECT * FROM (SELECT idx AS key, t, " + BEFORE.format(part="file_path", order="line_number", w=10) + " AS c FROM frows) WHERE len(c) = 10"
) + severity("frows") + tfidf("train") + moments("train", 10) + """, fsum AS (SELECT r.file_path, r.position + k.k AS e, v.term, sum(v.value) / 10 AS m
  FROM frows r JOIN vec v USING (template), range(0, 10) k(k) GROUP BY ALL),
fz AS (SELECT s.idx, s.file_path, s.position, max(abs((coalesce(f.m, 0) - o.mean) / o.std)) AS z FROM sev s CROSS JOIN mom o
  LEFT JOIN fsum f ON f.file_path = s.file_path AND f.e = s.position AND f.term = o.term WHERE s.position >= 9 GROUP BY ALL),
fsev AS (SELECT idx, max(severity_score) OVER (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mx FROM sev)"""

FOUND_SETS = SCORED + severity("logs") + """, sets AS MATERIALIZED (SELECT m.model, s.line_number AS sequence_index, v.severity_level AS lv FROM scored s
  JOIN sev v USING (line_number), (VALUES ('length'), ('words'), ('special')) m(model)
  WHERE CASE m.model WHEN 'length' THEN p_length WHEN 'words' THEN p_words ELSE p_special END = 1)"""


def nested(cond_error: str, cond_keep: str) -> str:
    return LOGS + f""", kept AS (SELECT *, {cond_error} AS bad FROM logs WHERE {cond_keep}),
o AS (SELECT *, row_number() OVER (ORDER BY timestamp, file_path, line_number) - 1 AS i, count(*) OVER () AS total FROM kept),
s AS (SELECT *, i >= floor(total * 0.8::DOUBLE) AS is_test FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY is_test, bad ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY is_test, bad) AS c FROM s)
SELECT CAST(line_number AS BIGINT) AS line_number, CASE WHEN is_test THEN 'test' WHEN r < floor(c * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'valid' END AS split FROM k"""


def threshold(score: str, metric: str, min_p: float, min_r: float) -> str:
    return SCORED + f""", e AS (SELECT min({score}) AS lo, max({score}) AS hi FROM scored),
t AS (SELECT k.k AS k, CASE WHEN k.k = 99 THEN hi ELSE lo + k.k * ((hi - lo) / 99) END AS thr FROM e, range(0, 100) k(k)),
x AS (SELECT t.k, t.thr, s.y AS y_true, (s.{score} >= t.thr)::INT AS y_pred FROM scored s, t)""" + metrics("x", "k, thr") + f""",
ok AS (SELECT *, {metric} AS goal FROM met WHERE tp + fp > 0 AND tn + fn > 0 AND "precision" >= {min_p} AND recall >= {min_r})
SELECT round(coalesce(thr, 0.5), 6) AS threshold, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1
FROM (SELECT 1) LEFT JOIN (SELECT * FROM ok WHERE goal > 0 ORDER BY goal DESC, k LIMIT 1) ON true"""


ENSEMBLES = NORMED + metrics("preds", "model") + """, w AS (SELECT model, CASE WHEN sum(f1) OVER () > 0 THEN f1 / sum(f1) OVER () ELSE 1.0 / count(*) OVER () END AS w FROM met),
wl AS (SELECT max(w) FILTER (model = 'length') AS a, max(w) FILTER (model = 'words') AS b, max(w) FILTER (model = 'special') AS c FROM w),
ens AS MATERIALIZED (SELECT y, (p_length + p_words + p_special >= 1.5)::INT AS maj, (n0 + n1 + n2) / 3 AS mean,
  (n0 * a + n1 * b + n2 * c) / (a + b + c) AS wmean FROM normed, wl),
allp AS MATERIALIZED (SELECT model, y_true, y_pred, score, 'single' AS kind FROM preds
  UNION ALL SELECT 'ensemble_majority', y, maj, round(mean, 12), 'ensemble' FROM ens
  UNION ALL SELECT 'ensemble_weighted', y, (wmean > 0.5)::INT, round(wmean, 12), 'ensemble' FROM ens)""" + metrics("allp", "model, kind", "met2") + points("allp") + AUC


def oracle_sql() -> dict[str, str]:
    wide_windows = ts("time_window", "time_window")
    sql = {
        "parse_lines": LOGS + f" SELECT {ts('timestamp', 'timestamp')}, level, pid, thread, class_path, message, file_path, {n('line_number', 'line_number')}, is_error, {n('message_length', 'message_length')}, has_exception FROM logs",
        "calendar_fields": LOGS + f" SELECT {n('line_number', 'line_number')}, {n('hour(timestamp)', 'hour')}, {n('minute(timestamp)', 'minute')}, strftime(timestamp, '%Y-%m-%d') AS date, {ts('''time_bucket(INTERVAL '10 minutes', timestamp)''', 'time_window')} FROM logs",
        "message_stats": LOGS + f" SELECT level, is_error, has_exception, {n('count(*)', 'n')}, {r6('avg(message_length)', 'avg_length')}, {n('max(message_length)', 'max_length')} FROM logs GROUP BY ALL",
        "read_limits": LOGS + f" SELECT {n('k', 'line_number')}, {ts('timestamp', 'timestamp')}, level, message FROM (SELECT *, row_number() OVER (ORDER BY line_number) AS k FROM logs WHERE file_path LIKE '%-01.log') WHERE k <= 30",
        "read_first_rows": LOGS + f""" SELECT {n('k', 'line_number')}, {ts('timestamp', 'timestamp')}, level, message FROM (SELECT *, row_number() OVER (ORDER BY day, k) AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY day ORDER BY line_number) AS k, dense_rank() OVER (ORDER BY day) AS file FROM (SELECT *, right(file_path, 6) AS day FROM logs)) WHERE file <= 25 AND k <= 250) WHERE place <= 4010""",
        "template_extract": LOGS + f" SELECT template, {n('count(*)', 'n')} FROM logs GROUP BY template",
        "template_specific_first": LOGS + f""" SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
            '\\d{{4}}-\\d{{2}}-\\d{{2}}[\\sT]\\d{{2}}:\\d{{2}}:\\d{{2}}', '*', 'g'), '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '*', 'g'),
            '\\d+\\.\\d+\\.\\d+\\.\\d+', '*', 'g'), '[/\\\\][\\w/\\\\.]+', '/*', 'g'), '\\d+', '*', 'g')) AS template, {n('count(*)', 'n')} FROM logs GROUP BY 1""",
        "text_templates": f""" SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{D}+', '*', 'g'), '[/\\\\][\\p{{L}}\\p{{N}}_/\\\\.]+', '/*', 'g'),
            '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '*', 'g'), '^{S}+|{S}+$', '', 'g') AS template, {n('count(*)', 'n')} FROM conversations GROUP BY 1""",
        "text_shape": f""" SELECT {n('doc_id', 'doc_id')}, {n(WORDS.format('lower(text)'), 'words')}, {n(SPECIAL.format('text'), 'special')},
            CAST(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{D}+', '*', 'g'), '[/\\\\][\\p{{L}}\\p{{N}}_/\\\\.]+', '/*', 'g'),
            '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '*', 'g'), '^{S}+|{S}+$', '', 'g')) AS BIGINT) AS template_length FROM documents""",
        "row_severity": LOGS + severity("logs") + f" SELECT {n('line_number', 'line_number')}, {n('severity_score', 'severity_score')}, severity_level, {n('level_weight', 'level_weight')}, http_status_code, {n('http_status_weight', 'http_status_weight')}, exception_type, {n('exception_weight', 'exception_weight')} FROM sev",
        "http_status": LOGS + severity("logs") + f" SELECT http_status_code, {n('count(*)', 'n')} FROM sev GROUP BY 1",
        "exception_type": LOGS + severity("logs") + f" SELECT exception_type, {n('count(*)', 'n')} FROM sev GROUP BY 1",
        "row_features": LOGS + " SELECT CAST(line_number AS BIGINT) AS line_number, " + ", ".join(
            [f"(level = '{v}')::INT::DOUBLE AS level_{v.lower()}" for v in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")]
            + ["has_exception::INT::DOUBLE AS f_has_exception", "message_length::DOUBLE AS f_message_length", r6("(pid::BIGINT % 1000) / 1000.0::DOUBLE", "pid_part")]
            + [f"contains(lower(message), '{w}')::INT::DOUBLE AS kw_{w}" for w in ("exception", "error", "failed", "timeout", "connection", "null", "stack", "trace", "warning", "critical")]
            + [f"{WORDS.format('lower(message)')}::DOUBLE AS word_count", r6(f"{SPECIAL.format('message')}::DOUBLE / greatest(length(message), 1)", "special_share")]
        ) + " FROM logs",
        "risk_flags": LOGS + f" SELECT {n('line_number', 'line_number')}, {has('lower(message)', NORMAL_TEXT)} AS normal_query, {has('lower(message)', FALSE_TEXT)} AS false_positive, {has('lower(message)', REAL_TEXT)} AND NOT {has('lower(message)', FALSE_TEXT)} AS real_exception FROM logs",
        "risk_score_rows": LOGS + severity("logs") + risk("sev", "message", "(message_length / 20.0::DOUBLE)", "severity_score", "line_number") + f" SELECT {n('line_number', 'line_number')}, {r6('risk_score', 'risk_score')}, risk_level FROM risk1",
        "split_classes": LOGS + ", ".join([""]) + f""" SELECT side, level, {n('count(*)', 'n')} FROM (
            SELECT 'normal' AS side, level FROM logs WHERE NOT is_error UNION ALL SELECT 'error', level FROM logs WHERE is_error
            UNION ALL SELECT 'strict_normal', level FROM logs WHERE NOT is_error AND level IN ('INFO', 'DEBUG', 'TRACE')
            UNION ALL SELECT 'strict_error', level FROM logs WHERE is_error OR level IN ('WARN', 'ERROR', 'FATAL')) GROUP BY ALL""",
        "load_summary": LOGS + f" SELECT {n('count(*)', 'total_logs')}, {ts('min(timestamp)', 'first_time')}, {ts('max(timestamp)', 'last_time')}, {n('count(*) FILTER (is_error)', 'error_logs')}, {n('''count(*) FILTER (level = 'WARN')''', 'warn_logs')} FROM logs",
        "level_distribution": LOGS + f" SELECT level, {n('count(*)', 'n')}, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM logs GROUP BY level",
        "window_features": LOGS + features("10 minutes") + f" SELECT {FEATURE_OUT} FROM feat",
        "window_features_wide": WIDE + f" SELECT {FEATURE_OUT} FROM feat",
        "level_counts": LOGS + features("10 minutes") + f" SELECT {wide_windows}, {', '.join(n(c, c) for c in ('error_count', 'warn_count', 'info_count', 'debug_count'))} FROM feat",
        "top_class": WIDE + f" SELECT {wide_windows}, top_class, {n('top_class_count', 'top_class_count')} FROM feat",
        "describe_features": WIDE + f", l AS ({melt('feat')}) SELECT feature, {n('count(value)', 'count')}, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, {r6('min(value)', 'min')}, {r6('quantile_cont(value, 0.25)', 'q25')}, {r6('quantile_cont(value, 0.5)', 'median')}, {r6('quantile_cont(value, 0.75)', 'q75')}, {r6('max(value)', 'max')} FROM l GROUP BY feature",
        "baseline_stats": BASELINE + f" SELECT feature, {', '.join(r6(c, c) for c in ('mean', 'std', 'median', 'q25', 'q75', 'q95'))} FROM base",
        "row_baseline": SCORED + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM scored" for c in ("s_length", "s_words", "s_special")) + f") SELECT feature, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, {r6('quantile_cont(value, 0.5)', 'median')}, {r6('quantile_cont(value, 0.25)', 'q25')}, {r6('quantile_cont(value, 0.75)', 'q75')}, {r6('quantile_cont(value, 0.95)', 'q95')} FROM l GROUP BY feature",
        "zscore_anomalies": BASELINE + f" SELECT {wide_windows}, {r6('anomaly_score', 'anomaly_score')}, reasons FROM zhits",
        "error_spikes": BASELINE + f" SELECT {wide_windows}, {r6('baseline_error_rate', 'baseline_error_rate')}, {r6('current_error_rate', 'current_error_rate')}, {r6('multiplier', 'multiplier')}, {n('error_count', 'error_count')}, {n('total_logs', 'total_logs')} FROM spikes",
        "error_concentration": LOGS + f" SELECT 'error_concentration' AS type, class_path AS class, {n('c', 'error_count')}, {n('t', 'total_errors')}, {r6('c::DOUBLE / t * 100', 'percentage')} FROM (SELECT class_path, count(*) AS c, sum(count(*)) OVER () AS t FROM logs WHERE is_error GROUP BY class_path ORDER BY c DESC, class_path LIMIT 1) WHERE c > t * 0.01",
        "attach_severity": BASELINE + severity("win") + f", ws AS (SELECT time_window, max(severity_score) AS mx, avg(severity_score) AS av, {counts_of('severity_level')} FROM sev GROUP BY 1) SELECT {wide_windows}, {r6('baseline_error_rate', 'baseline_error_rate')}, {r6('current_error_rate', 'current_error_rate')}, {r6('multiplier', 'multiplier')}, {n('error_count', 'error_count')}, {n('total_logs', 'total_logs')}, {n('mx', 'max_severity_score')}, {BUCKET.format('mx')} AS max_severity_level, {r6('av', 'avg_severity_score')}, critical_count, high_count, medium_count, low_count, info_count FROM spikes JOIN ws USING (time_window)",
        "window_labels": BASELINE + f" SELECT {wide_windows}, {r6('error_rate', 'error_rate')}, {n('''(error_rate > 2 * (SELECT mean FROM base WHERE feature = 'error_rate'))::INT''', 'true_label')} FROM parted",
        "window_evaluation": BASELINE + ", lab AS (SELECT p.split, (p.error_rate > 2 * (SELECT mean FROM base WHERE feature = 'error_rate'))::INT AS y_true, (z.time_window IS NOT NULL)::INT AS y_pred FROM parted p LEFT JOIN zhits z USING (time_window))" + metrics("lab", "split") + f" SELECT split, {METRIC_OUT} FROM met",
        "scaled_features": SCALED.replace("{0}", "WHERE split = 'train'") + f" SELECT {wide_windows}, {', '.join(r6(c, c) for c in FEATURES)} FROM scaled",
        "flag_top": SCORED + f" SELECT {n('line_number', 'line_number')}, {n('(s_special > (SELECT quantile_cont(s_special, 0.9) FROM scored))::INT', 'is_anomaly')} FROM scored",
        "window_severity": LOGS + severity("logs") + f", w AS (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS time_window, * FROM sev) SELECT {wide_windows}, {n('max(severity_score)', 'max_severity_score')}, {BUCKET.format('max(severity_score)')} AS max_severity_level, {r6('avg(severity_score)', 'avg_severity_score')}, {counts_of('severity_level')} FROM w GROUP BY w.time_window",
        "severity_summary": LOGS + severity("logs") + f" SELECT {n('count(*)', 'total_anomalies')}, {counts_of('severity_level')}, {r6('avg(severity_score)', 'avg_severity_score')}, {n('max(severity_score)', 'max_severity_score')} FROM sev",
        "top_exceptions": LOGS + severity("logs") + f" SELECT exception_type, {n('count(*)', 'n')} FROM sev WHERE exception_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "row_index": IDX + f" SELECT {n('idx', 'idx')}, {n('line_number', 'line_number')}, {ts('timestamp', 'timestamp')} FROM rows",
        "template_vocab": VOCAB.replace("{where}", "") + f" SELECT template, {n('template_id', 'template_id')}, {n('c', 'n')} FROM vocab",
        "template_ids": IDS + f" SELECT {n('idx', 'idx')}, {n('template_id', 'template_id')} FROM ids",
        "sequence_ids": IDS + " " + SEQ_OUT.format(extra="", name="sequence", cond=""),
        "sequence_steps": IDS + " " + SEQ_OUT.format(extra="", name="sequence", cond=" AND s.idx % 3 = 0"),
        "sequence_spans": IDX + " SELECT CAST(idx AS BIGINT) AS sequence_index, CAST(idx AS BIGINT) AS start_idx, CAST(idx + 10 AS BIGINT) AS end_idx FROM rows WHERE idx % 3 = 0 AND idx <= (SELECT count(*) FROM rows) - 10",
        "next_event_pairs": IDS + ", nx AS (SELECT idx - 10 AS s, template_id AS next_value FROM ids WHERE idx >= 10), sq AS (" + SEQ_OUT.format(extra="", name="sequence", cond="") + ") SELECT CAST(sequence_index AS BIGINT) AS sequence_index, sequence, CAST(next_value AS BIGINT) AS next_value FROM sq JOIN nx ON nx.s = sequence_index",
        "sequence_means": IDX + f" SELECT * FROM (SELECT {n('idx', 'sequence_index')}, round(avg(message_length) OVER w, 6) AS mean_length, round(avg(is_error::INT) OVER w, 6) AS mean_errors FROM rows WINDOW w AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) WHERE sequence_index <= (SELECT count(*) FROM rows) - 15",
        "split_time": IDX + f" SELECT {n('idx', 'idx')}, {n('line_number', 'line_number')}, CASE WHEN idx < floor(c * 0.8::DOUBLE) THEN 'train' WHEN idx < floor(c * 0.8::DOUBLE) + floor(c * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM rows, (SELECT count(*) AS c FROM rows)",
        "split_nested": nested("is_error", "true"),
        "split_nested_strict": nested("is_error OR level IN ('WARN', 'ERROR', 'FATAL')", "is_error OR level IN ('WARN', 'ERROR', 'FATAL', 'INFO', 'DEBUG', 'TRACE')"),
        "split_chunked": IDX + ", b AS (SELECT floor(count(*) * 0.8::DOUBLE) AS te, count(*) AS c FROM rows), v AS (SELECT *, floor(te * (1 - 0.2::DOUBLE)) AS vs FROM b), ch AS (SELECT idx, idx - idx % 700 AS a, least(idx - idx % 700 + 700, c) AS z, te, vs FROM rows, v) SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN z <= te THEN CASE WHEN a < vs THEN 'train' ELSE 'valid' END WHEN idx >= te THEN 'test' WHEN idx < vs THEN 'train' ELSE 'valid' END AS split FROM ch",
        "split_chunked_exact": IDX + ", b AS (SELECT floor(count(*) * 0.8::DOUBLE) AS te FROM rows) SELECT CASE WHEN idx >= te THEN 'test' WHEN idx >= floor(te * (1 - 0.2::DOUBLE)) THEN 'valid' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, CAST(min(idx) AS BIGINT) AS first_idx, CAST(max(idx) AS BIGINT) AS last_idx FROM rows, b GROUP BY 1",
        "first_share": SPLIT + f" SELECT {n('idx', 'idx')}, {n('line_number', 'line_number')} FROM train",
        "sample_systematic": IDX + f", c AS (SELECT greatest(count(*) // 300, 1) AS step FROM rows) SELECT {n('idx', 'idx')}, {n('line_number', 'line_number')} FROM rows, c WHERE idx % step = 0 AND idx // step < 300",
        "sample_even": IDX + f", p AS (SELECT DISTINCT CASE WHEN k.k = 332 THEN c - 1 ELSE floor(k.k * ((c - 1)::DOUBLE / 332))::BIGINT END AS idx FROM (SELECT count(*) AS c FROM rows), range(0, 333) k(k)) SELECT {n('rows.idx', 'idx')}, {n('line_number', 'line_number')} FROM rows JOIN p ON rows.idx = p.idx",
        "tfidf_templates": LOGS + tfidf("logs") + f" SELECT template, term, {r6('value', 'value')} FROM vec",
        "sequence_baseline": IDX + tfidf("rows") + moments("rows", 15) + f" SELECT term, {r6('mean', 'mean')}, {r6('std', 'std')} FROM mom",
        "tfidf_seq_anomalies": FOUND + f" SELECT {n('sequence_index', 'sequence_index')}, {r6('max_z_score', 'max_z_score')}, {r6('anomaly_score', 'anomaly_score')} FROM found",
        "tfidf_seq_scores": tfidf_scores(10) + f" SELECT {n('sequence_index', 'sequence_index')}, {r6('max_z_score', 'max_z_score')} FROM scores",
        "spread_scores": FOUND + f" SELECT {n('t.idx', 'idx')}, {n('(max(f.anomaly_score) IS NOT NULL)::INT', 'y_pred')}, {r6('coalesce(max(f.anomaly_score), 0)', 'anomaly_score')} FROM test t LEFT JOIN found f ON t.idx BETWEEN f.sequence_index AND f.sequence_index + 14 GROUP BY t.idx",
        "spread_raw_scores": FOUND + f" SELECT {n('t.idx', 'idx')}, {n('(max(f.max_z_score) IS NOT NULL)::INT', 'y_pred')}, {r6('coalesce(max(f.max_z_score) / 0.6::DOUBLE, 0)', 'anomaly_score')} FROM test t LEFT JOIN scores f ON t.idx BETWEEN f.sequence_index AND f.sequence_index + 14 GROUP BY t.idx",
        "sequence_severity": SEQ_SEV + f" SELECT {n('sequence_index', 'sequence_index')}, {r6('anomaly_score', 'anomaly_score')}, {n('max_severity_score', 'max_severity_score')}, {BUCKET.format('max_severity_score')} AS max_severity_level, {r6('avg_severity_score', 'avg_severity_score')}, critical_count, high_count, medium_count, low_count, info_count FROM seqsev",
        "sequence_priority": SEQ_SEV + f" SELECT {n('sequence_index', 'sequence_index')}, {n('max_severity_score', 'max_severity_score')}, row_number() OVER (ORDER BY max_severity_score DESC, round(anomaly_score, 9) DESC, sequence_index) AS priority FROM seqsev",
        "sequence_summary": SEQ_SEV + f", b AS (SELECT *, {BUCKET.format('max_severity_score')} AS lv FROM seqsev) SELECT {n('count(*)', 'total_anomalies')}, {counts_of('lv')}, {r6('avg(max_severity_score)', 'avg_severity_score')}, {n('max(max_severity_score)', 'max_severity_score')} FROM b",
        "sequence_details": FOUND + DETAILS + f" SELECT {n('sequence_index', 'sequence_index')}, {n('log_count', 'log_count')}, log_levels, sample_messages FROM det",
        "sequence_members": FOUND + f" SELECT {n('t.idx', 'idx')}, {n('f.sequence_index', 'sequence_index')}, {n('line_number', 'line_number')} FROM found f JOIN test t ON t.idx BETWEEN f.sequence_index AND f.sequence_index + 14",
        "sequence_risk": SEQ_RISK + f" SELECT {n('sequence_index', 'sequence_index')}, {r6('anomaly_score', 'anomaly_score')}, {n('max_severity_score', 'max_severity_score')}, {r6('risk_score', 'risk_score')}, risk_level FROM risk1",
        "risk_distribution": SEQ_RISK + f" SELECT risk_level, {n('count(*)', 'n')}, {r6('avg(risk_score)', 'avg_risk_score')}, {r6('max(risk_score)', 'max_risk_score')} FROM risk1 GROUP BY 1",
        "risk_totals": SEQ_RISK + f" SELECT {n('count(*)', 'total_anomalies')}, " + ", ".join(f"CAST(count(*) FILTER (risk_level = '{v}') AS BIGINT) AS {v.lower()}_anomalies" for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")) + f", {r6('avg(risk_score)', 'avg_risk_score')}, {r6('max(risk_score)', 'max_risk_score')} FROM risk1",
        "risk_top": SEQ_RISK + f" SELECT risk_level, row_number() OVER w AS rank, {r6('risk_score', 'risk_score')} FROM risk1 WINDOW w AS (PARTITION BY risk_level ORDER BY risk_score DESC, sequence_index) QUALIFY row_number() OVER w <= 10",
        "ngram_next": NGRAM + f" SELECT {n('sequence_index', 'sequence_index')}, {r6('p', 'prediction_prob')}, {r6('1 - p', 'anomaly_score')} FROM prob",
        "confusion_metrics": RANKED + f" SELECT model, {METRIC_OUT} FROM met",
        "roc_auc": POINTS + AUC + f" SELECT model, {r6('roc_auc', 'roc_auc')} FROM auc",
        "roc_points": POINTS + f" SELECT model, {r6('score', 'threshold')}, {r6('fp / nullif(q, 0)', 'fpr')}, {r6('tp / nullif(p, 0)', 'tpr')} FROM pts",
        "pr_points": POINTS + ' SELECT model, round(score, 6) + 0.0 AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / nullif(p, 0), 6) AS recall FROM pts',
        "best_threshold": threshold("s_length", "f1", 0.01, 0.01),
        "best_threshold_balanced": threshold("s_words", '("precision" + recall) / 2', 0.02, 0.5),
        "target_check": RANKED + ' SELECT model, accuracy >= 0.70 AND "precision" >= 0.50 AND recall >= 0.60 AND f1 >= 0.55 AND specificity >= 0.80 AS meets_target FROM met',
        "best_model": RANKED + ' SELECT model, round(f1 * 0.4::DOUBLE + accuracy * 0.3::DOUBLE + recall * 0.2::DOUBLE + "precision" * 0.1::DOUBLE, 6) AS total FROM met ORDER BY 2 DESC, 1 LIMIT 1',
        "compare_models": RANKED + " SELECT model, " + ", ".join(f'row_number() OVER (ORDER BY "{c}" DESC, model) AS rank_{c}' for c in ("f1", "accuracy", "recall", "precision")) + " FROM met",
        "vote_majority": SCORED + f" SELECT {n('line_number', 'line_number')}, {n('(p_length + p_words + p_special >= 1.5)::INT', 'ensemble_pred')} FROM scored",
        "vote_tie": SCORED + f" SELECT {n('line_number', 'line_number')}, {n('(p_length + p_words >= 1)::INT', 'ensemble_pred')} FROM scored",
        "vote_any": SCORED + f" SELECT {n('line_number', 'line_number')}, {n('greatest(p_length, p_words, p_special)', 'ensemble_pred')} FROM scored",
        "vote_all": SCORED + f" SELECT {n('line_number', 'line_number')}, {n('least(p_length, p_words, p_special)', 'ensemble_pred')} FROM scored",
        "vote_weighted": NORMED + f" SELECT {n('line_number', 'line_number')}, {n('((2 * n0 + n1 + 3 * n2) / 6 > 0.5)::INT', 'ensemble_pred')} FROM normed",
        "mean_score": NORMED + f" SELECT {n('line_number', 'line_number')}, {r6('(n0 + n1 + n2) / 3', 'ensemble_score')} FROM normed",
        "weighted_score": NORMED + f" SELECT {n('line_number', 'line_number')}, {r6('(2 * n0 + n1 + 3 * n2) / 6', 'ensemble_score')} FROM normed",
        "f1_weights": RANKED + " SELECT model, round(CASE WHEN sum(f1) OVER () > 0 THEN f1 / sum(f1) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM met",
        "ensemble_comparison": ENSEMBLES + f" SELECT model, kind, {n('tp', 'tp')}, {n('tn', 'tn')}, {n('fp', 'fp')}, {n('fn', 'fn')}, {r6('f1', 'f1')}, {r6('roc_auc', 'roc_auc')} FROM met2 JOIN auc USING (model)",
        "overlap_all": FOUND_SETS + f" SELECT {n('sequence_index', 'sequence_index')} FROM (SELECT sequence_index FROM sets WHERE model = 'length' INTERSECT SELECT sequence_index FROM sets WHERE model = 'words' INTERSECT SELECT sequence_index FROM sets WHERE model = 'special')",
        "overlap_unique": FOUND_SETS + f" SELECT min(model) AS model, {n('sequence_index', 'sequence_index')} FROM sets GROUP BY sequence_index HAVING count(*) = 1",
        "severity_by_model": FOUND_SETS + f" SELECT model, {n('count(*)', 'detected')}, " + ", ".join(f"CAST(count(*) FILTER (lv = '{v}') AS BIGINT) AS {v.lower()}" for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + " FROM sets GROUP BY model",
        "copod": WIDE + f", cells AS MATERIALIZED (SELECT time_window AS key, pos AS dim, value FROM ({melt('feat', 'time_window')}))" + copod("cells") + f" SELECT {ts('key', 'time_window')}, {r6('anomaly_score', 'anomaly_score')} FROM copod",
        "temporal_runs": RUNS + f" SELECT {n('a.wid', 'sequence_index')}, {ts('a.time_window', 'start_time')}, {ts('z.time_window', 'end_time')}, round(a.total_logs::DOUBLE, 6) AS first_total, round(b.total_logs::DOUBLE, 6) AS second_total, round(z.top_class_count::DOUBLE, 6) AS last_top FROM wi a JOIN wi b ON b.wid = a.wid + 1 JOIN wi z ON z.wid = a.wid + 9",
        "temporal_copod": RUN_COPOD + f" SELECT {n('key', 'sequence_index')}, {r6('anomaly_score', 'anomaly_score')}, {n('is_anomaly', 'is_anomaly')} FROM flagged",
        "temporal_logs": RUN_COPOD + RUN_WIN + f" SELECT {n('key', 'sequence_index')}, level, {n('count(*)', 'n')} FROM runwin JOIN win USING (time_window) GROUP BY key, level",
        "temporal_anomalies": RUN_COPOD + RUN_WIN + severity("win") + f""", agg AS (SELECT key, anomaly_score, count(*) AS lc, max(severity_score) AS mx, avg(severity_score) AS av, {counts_of('severity_level')}
            FROM runwin JOIN sev USING (time_window) GROUP BY key, anomaly_score) SELECT {n('key', 'sequence_index')}, {r6('anomaly_score', 'anomaly_score')}, {n('lc', 'log_count')}, {n('mx', 'max_severity_score')}, {BUCKET.format('mx')} AS max_severity_level,
            {r6('av', 'avg_severity_score')}, critical_count, high_count, medium_count, low_count, info_count, row_number() OVER (ORDER BY mx DESC, round(anomaly_score, 9) DESC, key) AS priority FROM agg""",
        "lof": SCALED.replace("{0}", "") + f""", pairs AS (SELECT a.time_window AS p, b.time_window AS o, sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in FEATURES)}) AS d
            FROM scaled a JOIN scaled b ON a.time_window <> b.time_window),
            near AS MATERIALIZED (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, o) <= 20),
            kd AS (SELECT p AS o, max(d) AS kd FROM near GROUP BY p),
            lrd AS MATERIALIZED (SELECT p, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN kd USING (o) GROUP BY p)
            SELECT {ts('near.p', 'time_window')}, round(avg(x.lrd) / any_value(y.lrd), 6) AS anomaly_score FROM near JOIN lrd x ON x.p = near.o JOIN lrd y ON y.p = near.p GROUP BY near.p""",
    }
    sql["context_tree"] = SPLIT + context_tree_test(10) + f" SELECT {n('key', 'sequence_index')}, {r6('p', 'prediction_prob')}, {r6('1 - p', 'anomaly_score')} FROM cprob"
    sql["ngram_anomalies"] = CHOICES + f""" SELECT {n('sequence_index', 'sequence_index')}, {n('coalesce(q2.top, q1.top, q0.top)', 'predicted_template')}, {n('coalesce(id, -1)', 'actual_template')}
        FROM prob JOIN tgt g ON g.idx - 10 = sequence_index LEFT JOIN q2 ON q2.a = g.a AND q2.b = g.b LEFT JOIN q1 ON q1.b = g.b CROSS JOIN q0 LEFT JOIN vid ON vid.template = g.t WHERE 1 - p > 0.9"""
    sql["sequence_overlap_all"] = SIDE_BY_SIDE + f" SELECT {n('sequence_index', 'sequence_index')} FROM sets GROUP BY sequence_index HAVING count(DISTINCT model) = 3"
    sql["sequence_overlap_unique"] = SIDE_BY_SIDE + f" SELECT min(model) AS model, {n('sequence_index', 'sequence_index')} FROM sets GROUP BY sequence_index HAVING count(DISTINCT model) = 1"
    sql["sequence_severity_by_model"] = SIDE_BY_SIDE + f" SELECT model, {n('count(*)', 'detected')}, " + ", ".join(
        f"CAST(count(*) FILTER (lv = '{v}') AS BIGINT) AS {v.lower()}" for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    ) + f" FROM (SELECT model, {BUCKET.format('mx')} AS lv FROM setsev) GROUP BY model"
    sql["stream_sequence_scores"] = STREAMED + f""" SELECT z.file_path, {n('z.position', 'position')}, {n('mx', 'max_severity_score')}, {r6('p', 'prediction_prob')}, {r6('z', 'max_z_score')}
        FROM fz z JOIN fsev USING (idx) LEFT JOIN cprob ON key = idx"""
    sql["hash_features"] = LOGS + f" SELECT {n('line_number', 'line_number')}, {bucket('class_path', 'class_bucket')}, {bucket('thread', 'thread_bucket')}, {bucket('message', 'message_code')} FROM logs"
    sql["sample_random"] = LOGS + f" SELECT {n('line_number', 'line_number')}, level FROM logs ORDER BY md5(line_number || ':42'), line_number LIMIT 300"
    sql["copod_new"] = WIDE + f""", cells AS MATERIALIZED (SELECT time_window AS key, pos AS dim, value, split = 'train' AS tr FROM ({melt('parted', 'time_window', 'split')})),
        tot AS (SELECT dim, count(*) AS t, avg(value) AS m FROM cells WHERE tr GROUP BY dim),
        sk AS (SELECT dim, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3 FROM cells JOIN tot USING (dim) WHERE tr GROUP BY dim),
        ask AS (SELECT c.key, c.dim, c.value, t, m2, m3, (SELECT count(*) FROM cells x WHERE x.tr AND x.dim = c.dim AND x.value <= c.value) AS lo,
          (SELECT count(*) FROM cells x WHERE x.tr AND x.dim = c.dim AND x.value >= c.value) AS hi FROM cells c JOIN tot USING (dim) JOIN sk USING (dim) WHERE NOT tr),
        tl AS (SELECT key, -ln(greatest(lo, 1) / t) AS l, -ln(greatest(hi, 1) / t) AS r, m2 > 0 AND m3 < 0 AS neg FROM ask)
        SELECT {ts('key', 'time_window')}, round(greatest(sum(l), sum(r), sum(CASE WHEN neg THEN l ELSE r END)), 6) + 0.0 AS anomaly_score FROM tl GROUP BY key"""
    sql["lof_new"] = SCALED.replace("{0}", "WHERE split = 'train'") + f""", side AS (SELECT s.*, p.split = 'train' AS tr FROM scaled s JOIN parted p USING (time_window)),
        pairs AS (SELECT a.time_window AS p, b.time_window AS o, a.tr, sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in FEATURES)}) AS d
        FROM side a JOIN side b ON a.time_window <> b.time_window AND b.tr),
        near AS MATERIALIZED (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, o) <= 20),
        kd AS (SELECT p AS o, max(d) AS kd FROM near WHERE tr GROUP BY p),
        lrd AS MATERIALIZED (SELECT p, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN kd USING (o) GROUP BY p)
        SELECT {ts('near.p', 'time_window')}, round(avg(x.lrd) / any_value(y.lrd), 6) AS anomaly_score FROM near JOIN lrd x ON x.p = near.o JOIN lrd y ON y.p = near.p WHERE NOT near.tr GROUP BY near.p"""
    sql["text_source"] = LOGS + f" SELECT {n('row_number() OVER (PARTITION BY file_path ORDER BY line_number)', 'line_number')}, {ts('timestamp', 'timestamp')}, level, pid, thread, class_path, message, is_error FROM logs"
    sql["detect_new"] = sql["error_spikes"] + " WHERE time_window IN (SELECT time_window FROM parted WHERE split = 'test')"
    sql["parsed_table"] = nested("is_error", "true").replace("SELECT CAST(line_number AS BIGINT) AS line_number,", ", z AS (SELECT level, is_error,") + f") SELECT level, is_error, {n('count(*)', 'n')} FROM z WHERE split = 'valid' GROUP BY ALL"
    sql["csv_report"] = sql["level_distribution"]
    sql["stream_window_features"] = sql["window_features_wide"]
    sql["stream_error_spikes"] = sql["error_spikes"]
    sql["stream_zscore"] = sql["zscore_anomalies"]
    sql["stream_row_severity"] = LOGS + severity("logs") + f" SELECT {n('line_number', 'line_number')}, {n('severity_score', 'severity_score')}, severity_level FROM sev"
    sql["template_vectors"] = LOGS + tfidf("(SELECT * FROM logs WHERE NOT is_error)") + f""", e AS (SELECT template, count(*) AS c FROM vec GROUP BY 1)
        SELECT is_error, {n('count(*)', 'n')}, {n('sum(coalesce(c, 0))', 'entries')} FROM logs LEFT JOIN e USING (template) GROUP BY is_error"""
    freq = f""" freq AS (SELECT 'frequency_anomaly' AS type, time_window, k AS log_count, m AS mean, abs((k - m) / s) AS z_score
        FROM (SELECT *, avg(k) OVER () AS m, stddev_samp(k) OVER () AS s FROM (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS time_window, count(*) AS k FROM logs GROUP BY 1)) WHERE s > 0 AND abs((k - m) / s) > 3)"""
    rare = f""" rare AS (SELECT 'new_exception_type' AS type, e AS exception_type, c AS "count", c::DOUBLE / t * 100 AS percentage FROM (
        SELECT e, count(*) AS c, sum(count(*)) OVER () AS t FROM (SELECT regexp_extract(message, '({W}+Exception|{W}+Error)', 1) AS e FROM logs WHERE has_exception) WHERE e <> '' GROUP BY e) WHERE c < t * 0.01::DOUBLE)"""
    conc = """ conc AS (SELECT 'error_concentration' AS type, class_path AS class, c AS error_count, t AS total_errors, c::DOUBLE / t * 100 AS percentage
        FROM (SELECT class_path, count(*) AS c, sum(count(*)) OVER () AS t FROM logs WHERE is_error GROUP BY class_path ORDER BY c DESC, class_path LIMIT 1) WHERE c > t * 0.5)"""
    sql["frequency_anomalies"] = LOGS + "," + freq + f" SELECT type, {wide_windows}, {n('log_count', 'log_count')}, {r6('mean', 'mean')}, {r6('z_score', 'z_score')} FROM freq"
    sql["rare_exceptions"] = LOGS + "," + rare + f''' SELECT type, exception_type, CAST("count" AS BIGINT) AS "count", {r6('percentage', 'percentage')} FROM rare'''
    sql["unusual_patterns"] = LOGS + "," + freq + "," + rare + "," + conc + f""" SELECT type, class, {n('error_count', 'error_count')}, {n('total_errors', 'total_errors')}, {r6('percentage', 'percentage')},
        strftime(time_window, '%Y-%m-%d %H:%M:%S.%g') AS time_window, {n('log_count', 'log_count')}, {r6('mean', 'mean')}, {r6('z_score', 'z_score')}, exception_type, CAST("count" AS BIGINT) AS "count"
        FROM (SELECT * FROM conc UNION ALL BY NAME SELECT * FROM freq UNION ALL BY NAME SELECT * FROM rare)"""
    return sql
