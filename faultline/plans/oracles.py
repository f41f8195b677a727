"""SQL for the catalogue queries, to be run on the same tables by another engine."""

from faultline.plans import catalog as C
from faultline.plans import inputs as I

LEVELS = "['debug','info','warn','error','fatal']"
SEVERITY = (
    "CASE WHEN {w} IN ('debug','trace') THEN 1 WHEN {w} IN ('info','notice','informational')"
    " THEN 2 WHEN {w} IN ('warn','warning') THEN 3 WHEN {w} IN ('error','err') THEN 4"
    " WHEN {w} IN ('fatal','panic','critical','crit','emerg','alert') THEN 5 ELSE 0 END"
)
NAME = "CASE WHEN {s} BETWEEN 1 AND 5 THEN " + LEVELS + "[{s}] ELSE 'unknown' END"

# JSON lines


def _json(raw: str) -> str:
    """Raw rows with their outcome and the parsed columns, as CTEs ending in ``ev``."""
    time = "json_extract_string(doc, '$.time')"
    return f"""
raw AS ({raw}),
docs AS (SELECT *, CASE WHEN payload <> '' AND json_valid(payload) THEN payload END AS doc FROM raw),
parts AS (
  SELECT *,
    coalesce(nullif(json_extract_string(doc, '$.service'), ''), stream_id) AS service,
    coalesce(json_extract_string(doc, '$.host'), '') AS host,
    coalesce(json_extract_string(doc, '$.level'), json_extract_string(doc, '$.Level')) AS word,
    coalesce(CASE WHEN json_type(doc, '$.msg') = 'VARCHAR' THEN json_extract_string(doc, '$.msg')
      ELSE json_extract_string(doc, '$.err_msg') END, '') AS message,
    CASE WHEN json_type(doc, '$.time') = 'VARCHAR'
        THEN epoch_us(strptime({time}, '%Y-%m-%dT%H:%M:%S.%fZ'))
      WHEN CAST({time} AS BIGINT) > 100000000000 THEN CAST({time} AS BIGINT) * 1000
      ELSE CAST({time} AS BIGINT) * 1000000 END AS t,
    list_filter(list_transform(
      CASE WHEN json_type(doc, '$.stack') = 'VARCHAR'
          THEN string_split(json_extract_string(doc, '$.stack'), chr(10))
        WHEN json_type(doc, '$.trace') = 'ARRAY'
          THEN list_transform(
            list_filter(CAST(json_extract(doc, '$.trace') AS JSON[]), lambda v: json_type(v) = 'VARCHAR'),
            lambda v: json_extract_string(v, '$'))
        ELSE CAST([] AS VARCHAR[]) END, lambda f: trim(f)), lambda f: f <> '') AS frames
  FROM docs),
steps AS (
  SELECT *, {SEVERITY.format(w="word")} AS severity,
    CASE WHEN payload = '' THEN 'raw' WHEN doc IS NULL THEN 'parse'
      WHEN message = '' THEN 'event' ELSE '' END AS failed_step,
    CASE WHEN payload = '' THEN 'domain: validation failed: payload: domain: empty raw payload'
      WHEN doc IS NULL THEN 'ingest: invalid json payload'
      WHEN message = '' THEN 'domain: validation failed: message: domain: missing message body'
      ELSE '' END AS reason,
    stream_id || '-' || seq_no AS event_id
  FROM parts),
ev AS (
  SELECT *, CASE WHEN failed_step = '' AND severity >= 4 THEN {template('service', 'message', 'frames')}
      ELSE '' END AS template
  FROM steps),
ok AS (SELECT *, {signature('template')} AS signature FROM ev WHERE failed_step = '')"""


def message_template(message: str) -> str:
    """Kind after kind; right as long as no address touches a word."""
    text = message
    for pattern, name in (
        ("\"[^\"]*\"|''[^'']*''", "<str>"),
        ("0[xX][0-9a-fA-F]+", "<hex>"),
        ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
        (
            r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}"
            r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?::[0-9]+)?\b",
            "<ip>",
        ),
        ("[0-9]+", "<n>"),
        (r"[ \t\n\x0B\f\r]+", " "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return f"trim({text}, ' ')"


def frame_template(frame: str) -> str:
    bare = f"trim({frame})"
    cut = (
        f"CASE WHEN regexp_matches({bare}, '\\+0[xX]')"
        f" THEN trim(regexp_replace({bare}, '\\+[^+]{{0,2}}[0-9a-fA-F \\t\\n\\r\\x0B\\f]*$', ''))"
        f" ELSE {bare} END"
    )
    return f"regexp_replace(trim(regexp_replace({cut}, ':[0-9]+$', '')), '0[xX][0-9a-fA-F]+', '<hex>', 'g')"


def template(service: str, message: str, frames: str, depth: int = 5) -> str:
    return (
        f"array_to_string([{service} || '|' || {message_template(message)}] ||"
        f" list_transform(({frames})[1:{depth}], lambda f: {frame_template('f')}), chr(10))"
    )


def signature(of: str) -> str:
    return f"CASE WHEN {of} = '' THEN '' ELSE sha256({of})[1:32] END"


JSON = "WITH" + _json(I.JSON_RAW)
INCIDENT = _json(I.INCIDENT_RAW)

# Syslog


SYSLOG = f"""WITH
raw AS ({I.SYSLOG_RAW}),
pri AS (SELECT *, CAST(nullif(regexp_extract(payload, '^<([0-9]+)>', 1), '') AS INTEGER) AS pri,
  regexp_replace(payload, '^<[0-9]+>', '') AS rest0 FROM raw),
stamp AS (SELECT *,
  regexp_matches(rest0, '^[A-Z][a-z][a-z] [ 0-9][0-9] [0-9][0-9]:[0-9][0-9]:[0-9][0-9]') AS timed FROM pri),
rest AS (SELECT *,
  CASE WHEN timed THEN epoch_us(strptime(year(received_at) || ' ' || rest0[1:15], '%Y %b %d %H:%M:%S')) END AS parsed_t,
  CASE WHEN timed THEN trim(rest0[16:]) ELSE rest0 END AS rest FROM stamp),
head AS (SELECT *, regexp_split_to_array(trim(rest[:strpos(rest, ':') - 1]), '\\s+') AS words FROM rest),
tagged AS (SELECT *, CASE WHEN len(words) >= 2 THEN words[2] ELSE words[1] END AS tag FROM head),
ev AS (SELECT stream_id || '-' || seq_no AS event_id,
  CASE WHEN pri IS NULL THEN 2 ELSE [5,5,5,4,3,2,2,1][pri % 8 + 1] END AS severity,
  CASE WHEN pri IS NOT NULL AND timed THEN parsed_t ELSE epoch_us(received_at) END AS t,
  CASE WHEN pri IS NULL THEN stream_id ELSE regexp_extract(tag, '^([^\\[]*)', 1) END AS service,
  CASE WHEN pri IS NULL OR len(words) < 2 THEN '' ELSE words[1] END AS host,
  CASE WHEN pri IS NULL THEN payload ELSE trim(rest[strpos(rest, ':') + 1:]) END AS message,
  CASE WHEN pri IS NULL THEN '' ELSE 'pid=' || regexp_extract(tag, '\\[([^\\]]*)\\]', 1)
    || ';syslog_facility=' || pri // 8 || ';syslog_pri=' || pri END AS fields,
  strlen(payload) AS raw_size FROM tagged)"""

# Text streams

LINES = f"lines AS ({I.TRACE_LINES})"
CONTINUES = r"(starts_with(line, chr(9)) OR starts_with(line, '    ') OR starts_with(trim(line), 'at '))"


def _blocks(lines: str) -> str:
    """CTEs from ``lines`` to ``blocks``."""
    return f"""
opened AS (SELECT *, coalesce(lag(line <> '') OVER w, false) AS open FROM {lines}
  WINDOW w AS (PARTITION BY stream_id ORDER BY line_no)),
numbered AS (SELECT *, sum(CASE WHEN line <> '' AND NOT ({CONTINUES} AND open) THEN 1 ELSE 0 END)
  OVER (PARTITION BY stream_id ORDER BY line_no) AS seq_no FROM opened),
blocks AS (SELECT stream_id, CAST(seq_no AS BIGINT) AS seq_no, string_agg(line, chr(10) ORDER BY line_no) AS payload
  FROM numbered WHERE line <> '' GROUP BY stream_id, seq_no)"""


FRAMED_LINES = (
    f"WITH {LINES} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no)"
    " AS seq_no, line AS payload FROM lines WHERE line <> ''"
)
FRAMED_BLOCKS = f"WITH {LINES}, {_blocks('lines')} SELECT stream_id, seq_no, payload FROM blocks"
TRACE_EVENTS = f"""WITH {LINES}, {_blocks('lines')},
traces AS (SELECT *, string_split(payload, chr(10)) AS parts FROM blocks),
ev AS (SELECT stream_id || '-' || seq_no AS event_id, stream_id AS service, parts[1] AS message,
  CASE WHEN regexp_matches(lower(parts[1]), 'panic|fatal|critical') THEN 5 ELSE 4 END AS severity,
  parts[2:] AS frames, strlen(payload) AS raw_size, payload FROM traces)"""

# The documents of three streams, one after the other.
LOG_LINES = (
    "lines AS (SELECT 'log-' || (doc % 3) AS stream_id, line,"
    " row_number() OVER (PARTITION BY doc % 3 ORDER BY doc, line_no) AS line_no"
    f" FROM (SELECT *, CAST(substr(stream_id, 5) AS BIGINT) AS doc FROM ({I.TRACE_LINES})))"
)

LANGUAGE_LINES = (
    "lines AS (SELECT lang || '/' || source AS stream_id, doc_id AS line_no,"
    f" replace(text, chr(10), ' ') AS line, strlen(text) >= {C.LINE_BYTES} AS long FROM documents)"
)

# Deduplication


def _windows(events: str, width_us: int) -> str:
    """CTEs from events (signature, stream_id, seq_no, t) to ``deduped``.

    The next window starts at the first event at or beyond the end of the current one.
    """
    return f"""
WITH RECURSIVE e AS MATERIALIZED ({events}),
starts AS (
  SELECT signature, min(t) AS a FROM e WHERE signature <> '' GROUP BY signature
  UNION ALL
  SELECT s.signature, min(e.t) FROM starts s JOIN e ON e.signature = s.signature AND e.t >= s.a + {width_us}
  GROUP BY s.signature, s.a),
placed AS (SELECT e.*, s.a AS window_start FROM e ASOF JOIN starts s
  ON e.signature = s.signature AND e.t >= s.a),
counted AS (SELECT *, row_number() OVER (PARTITION BY signature, window_start
  ORDER BY t, stream_id, seq_no) AS window_count FROM placed),
deduped AS (SELECT *, window_count = 1 AS is_novel FROM counted
  UNION ALL BY NAME
  SELECT *, CAST(NULL AS BIGINT) AS window_start, CAST(1 AS BIGINT) AS window_count, true AS is_novel
  FROM e WHERE signature = '')"""


HOUR_US = 3_600_000_000
BY_USER = _windows(I.signature_events_sql(C.BY_USER), 6 * HOUR_US)
DEDUP_COLUMNS = "SELECT signature, stream_id, seq_no, window_start, is_novel, window_count FROM deduped"
RECORDS = (
    "SELECT signature, window_start, min(t) AS first_seen, max(t) AS last_seen, count(*) AS count"
    " FROM deduped WHERE signature <> '' {also} GROUP BY signature, window_start"
)
CURRENT = (
    "SELECT signature, first_seen, last_seen, count FROM (" + RECORDS + ")"
    " QUALIFY row_number() OVER (PARTITION BY signature ORDER BY window_start DESC) = 1"
)
AS_OF_US = f"epoch_us({C.AS_OF})"
TRACKED = (
    f"SELECT * FROM ({CURRENT.format(also=f'AND t <= {AS_OF_US}')})"
    f" WHERE {AS_OF_US} - last_seen < {6 * HOUR_US}"
)


def _error_windows(json: str) -> str:
    """The windows of the signed errors of a JSON input, one CTE chain."""
    windows = _windows(
        "SELECT *, epoch_us(received_at) AS received FROM ok WHERE severity >= 4", HOUR_US
    ).strip()
    windows = windows.removeprefix("WITH RECURSIVE")
    for old, new in (("min(t)", "min(received)"), ("e.t", "e.received"), ("ORDER BY t,", "ORDER BY received,")):
        windows = windows.replace(old, new)
    return f"WITH RECURSIVE {json}, {windows}"


INCIDENTS = (
    _error_windows(INCIDENT)
    + """, incident AS (SELECT d.*, r.dedup_count FROM deduped d JOIN (
  SELECT signature, window_start, count(*) AS dedup_count FROM deduped GROUP BY signature, window_start) r
  USING (signature, window_start) WHERE d.is_novel)"""
)

TEXT = "array_to_string([{}], '')"
EXTRA = "'- ctx: ' || json_extract(doc, '$.ctx') || chr(10) || '- none: <nil>' || chr(10) || '- ok: true' || chr(10) || '- ratio: 1.50' || chr(10) || '- try: ' || json_extract_string(doc, '$.try') || chr(10)"
PROMPT = f"""'You diagnose production incidents for the team that runs the service.' || chr(10)
|| 'Find the most likely cause of the error below and say how to fix it.' || chr(10) || chr(10)
|| '=== INCIDENT CONTEXT ===' || chr(10) || 'Service: ' || service || chr(10)
|| CASE WHEN host <> '' THEN 'Host: ' || host || chr(10) ELSE '' END
|| 'Severity: ' || {NAME.format(s='severity')} || chr(10)
|| 'Timestamp: ' || strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%SZ') || chr(10)
|| 'Event ID: ' || event_id || chr(10) || 'Signature Hash: ' || signature || chr(10)
|| 'Occurrence Frequency: ' || dedup_count || ' times in the last 1h0m0s' || chr(10) || chr(10)
|| '=== ERROR MESSAGE ===' || chr(10) || message || chr(10) || chr(10)
|| CASE WHEN len(frames) > 0 THEN '=== STACK TRACE FRAMES ===' || chr(10)
  || array_to_string(list_transform(frames, lambda f, i: '[' || i || '] ' || f || chr(10)), '') || chr(10)
  ELSE '' END
|| '=== METADATA & FIELDS ===' || chr(10) || {EXTRA} || chr(10)
|| '=== REQUIRED OUTPUT FORMAT ===' || chr(10) || 'Answer with one JSON object and nothing else. Its keys:' || chr(10)
|| 'root_cause: text, why the error happened' || chr(10) || 'severity: fatal, error or warn' || chr(10)
|| 'affected_component: text, the failing service, database or network part' || chr(10)
|| 'fix_commands: list of shell commands' || chr(10) || 'confidence_score: number from 0 to 1' || chr(10)"""

KIND = """CASE WHEN contains(lower(message), 'nil pointer') OR contains(lower(message), 'dereference') THEN 1
WHEN contains(lower(message), 'connection refused') OR contains(lower(message), 'timeout') OR contains(lower(message), 'dial tcp') THEN 2
WHEN contains(lower(message), 'out of memory') OR contains(lower(message), 'oom') OR contains(lower(message), 'cannot allocate') THEN 3
ELSE 4 END"""
DIAGNOSED = f"""{INCIDENTS}, kinds AS (SELECT *, {KIND} AS kind FROM incident),
diagnosed AS (SELECT event_id, signature,
  CASE kind WHEN 1 THEN 'Nil pointer dereference when accessing uninitialized object instance in application code.'
    WHEN 2 THEN 'Upstream network failure or database connection pool exhaustion.'
    WHEN 3 THEN 'Container memory limit exceeded causing Linux kernel OOM killer trigger.'
    ELSE 'Unhandled application error: ' || message END AS root_cause,
  CASE kind WHEN 1 THEN 'fatal' WHEN 2 THEN 'error' WHEN 3 THEN 'fatal' ELSE {NAME.format(s='severity')} END AS severity,
  CASE kind WHEN 2 THEN 'database-pool' WHEN 3 THEN 'k8s-pod-memory' ELSE service END AS affected_component,
  CASE kind WHEN 1 THEN ['kubectl rollout undo deployment/' || service, 'git log -n 1 --stat']
    WHEN 2 THEN ['kubectl scale deployment/' || service || ' --replicas=5', 'pg_isready -h db-cluster.internal -p 5432']
    WHEN 3 THEN ['kubectl top pod -l app=' || service, 'kubectl edit deployment/' || service || ' # increase memory limit to 2Gi']
    ELSE ['kubectl logs -l app=' || service || ' --tail=100'] END AS commands
  FROM kinds)"""

# Validation inputs

QUESTIONABLE = """rows AS (SELECT event_id + 1 AS seq_no,
  CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'stacktrace' WHEN 3 THEN 'csv' ELSE '' END AS source,
  event_id % 3 = 0 AS no_payload, event_id % 7 = 0 AS no_time,
  user_id % 4 = 0 AS no_service, user_id % 6 = 0 AS no_message, event_id % 5 > 2 AS bad_source FROM events)"""


def _findings(*checks: tuple[str, str, str]) -> str:
    """List of finding texts."""
    items = ", ".join(f"CASE WHEN {flag} THEN '{field}: domain: {text}' END" for flag, field, text in checks)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _validation(*checks: tuple[str, str, str]) -> str:
    return (
        f"WITH {QUESTIONABLE}, found AS (SELECT seq_no, {_findings(*checks)} AS f FROM rows)"
        " SELECT seq_no, CAST(len(f) AS INTEGER) AS findings, CASE WHEN len(f) = 0 THEN ''"
        " ELSE 'domain: validation failed: ' || array_to_string(f, '; ') END AS text FROM found"
    )


RAW_CHECKS = (
    ("no_payload", "payload", "empty raw payload"),
    ("bad_source", "source", "unknown source type"),
    ("no_time", "received_at", "invalid or zero timestamp"),
)
EVENT_CHECKS = (
    ("bad_source", "source", "unknown source type"),
    ("no_service", "service", "missing service name"),
    ("no_message", "message", "missing message body"),
    ("no_time", "timestamp", "invalid or zero timestamp"),
)
LETTERS = (
    "letters AS (SELECT event_id, stream_id, seq_no, source, payload AS raw_payload, reason,"
    " epoch_us(received_at) AS failed_at, CAST((seq_no - 1) % 5 AS INTEGER) AS attempt_count"
    " FROM ev WHERE failed_step <> '')"
)
LETTER_COLUMNS = (
    "SELECT event_id, stream_id, seq_no, source, raw_payload, reason, attempt_count, failed_at FROM letters"
)
MIXED = f"""{JSON},
sys AS (SELECT * FROM ({SYSLOG} SELECT * FROM ev)),
trc AS (SELECT * FROM ({TRACE_EVENTS} SELECT * FROM ev)),
mixed AS (
  SELECT 'json' AS source, failed_step, CASE WHEN failed_step IN ('', 'event') THEN severity ELSE 0 END AS severity, strlen(payload) AS bytes,
    failed_step = '' AND severity >= 4 AS signed FROM ev
  UNION ALL SELECT 'syslog', '', severity, raw_size, severity >= 4 FROM sys
  UNION ALL SELECT 'stacktrace', '', severity, raw_size, true FROM trc)"""
CATALOGUE = (
    "SELECT signature, template, count(*) AS events, min(epoch_us(received_at)) AS first_seen,"
    " max(epoch_us(received_at)) AS last_seen FROM ok WHERE signature <> '' GROUP BY signature, template"
)
GAPS = f"""WITH turns AS ({I.TURNS}),
paired AS (SELECT *, lag(seq_no) OVER (PARTITION BY stream_id ORDER BY t, seq_no) AS previous_seq FROM turns)
SELECT stream_id, previous_seq, seq_no, greatest(seq_no - previous_seq - 1, 0) AS missing,
  seq_no <= previous_seq AS reordered FROM paired WHERE seq_no <> previous_seq + 1"""
RANGES = f"""WITH turns AS ({I.TURNS}), numbers AS (SELECT DISTINCT stream_id, seq_no FROM turns),
paired AS (SELECT *, lag(seq_no) OVER (PARTITION BY stream_id ORDER BY seq_no) AS below FROM numbers)
SELECT stream_id, below + 1 AS missing_from, seq_no - 1 AS missing_to, seq_no - below - 1 AS missing FROM paired WHERE seq_no > below + 1"""
FRAME_LIST = "[" + ", ".join(C.FRAME_SHAPES) + "]"
DEPTH_FRAMES = f"({FRAME_LIST} || ['tail.' || event_type])"
ANSWERS = C.ANSWER_BODY.format(id="event_id").replace("{{", "{").replace("}}", "}")

def _responses(k: str) -> str:
    """Diagnoses of all requests; ``k`` says what their answer is like, 0 for none."""
    return f"""WITH {INCIDENT}, asked AS (SELECT event_id, signature, seq_no, {k} AS k FROM ok WHERE severity >= 4)
SELECT event_id, signature, CASE WHEN k > 3 THEN 'cause ' || event_id WHEN k = 0 THEN NULL ELSE '' END AS root_cause,
CASE WHEN k > 3 THEN 'error' WHEN k = 0 THEN NULL ELSE '' END AS severity,
CASE WHEN k > 3 THEN 'db' WHEN k = 0 THEN NULL ELSE '' END AS affected_component,
CASE WHEN k > 3 THEN 'restart ' || seq_no || '|check' WHEN k = 0 THEN NULL ELSE '' END AS fix_commands,
CASE WHEN k > 3 THEN 50 WHEN k = 0 THEN NULL ELSE 0 END AS confidence_percent,
CAST(CASE WHEN k > 3 THEN seq_no WHEN k = 0 THEN NULL ELSE 0 END AS INTEGER) AS tokens_used,
CASE WHEN k > 3 THEN '' WHEN k = 0 THEN 'llm: provider request failed' WHEN k = 1 THEN 'llm: provider request failed: http status 503: busy'
ELSE 'llm: invalid json response from provider' END AS failure FROM asked"""


ORACLES = {
    "error_incidents": _error_windows(_json(I.JSON_RAW))
    + " SELECT service, signature, template, count_if(is_novel)::BIGINT AS incidents, count(*) AS events,"
    " max(window_count) AS largest_window, min(received) AS first_seen, max(received) AS last_seen"
    " FROM deduped GROUP BY service, signature, template",
    "frame_lines_of_text": FRAMED_LINES,
    "frame_lines_of_rows": FRAMED_LINES,
    "frame_blocks_of_text": FRAMED_BLOCKS,
    "frame_blocks_of_rows": FRAMED_BLOCKS,
    "stream_lines_over_files": f"WITH {LOG_LINES} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no)"
    " AS seq_no, line AS payload FROM lines WHERE line <> ''",
    "stream_blocks_over_files": f"WITH {LOG_LINES}, {_blocks('lines')} SELECT stream_id, seq_no, payload FROM blocks",
    "frame_by_source": f"""WITH {LINES}, traces AS (SELECT * FROM lines WHERE stream_id LIKE '%7'), {_blocks('traces')}
SELECT 'stacktrace' AS source, stream_id, seq_no, payload FROM blocks UNION ALL
SELECT 'syslog', stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no), line
FROM lines WHERE line <> '' AND stream_id NOT LIKE '%7'""",
    "long_lines_stop": f"""WITH {LANGUAGE_LINES},
ends AS (SELECT stream_id, min(line_no) AS stop FROM lines WHERE long GROUP BY stream_id)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS seq_no, line AS payload
FROM lines LEFT JOIN ends USING (stream_id) WHERE line <> '' AND (stop IS NULL OR line_no < stop)""",
    "long_lines_left_out": f"""WITH {LANGUAGE_LINES}
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS seq_no, line AS payload
FROM lines WHERE line <> '' AND NOT long""",
    "long_lines_dead_letters": f"""WITH {LINES} SELECT stream_id || '--' || (line_no + 1) AS event_id,
'ingest: line too long' AS reason, CAST(strlen(line) AS INTEGER) AS bytes FROM lines WHERE strlen(line) >= {C.LINE_BYTES}""",
    "long_line_letters_of_rows": f"""WITH {LANGUAGE_LINES} SELECT stream_id || '--' || (line_no + 1) AS event_id, stream_id, -line_no - 1 AS seq_no,
'ingest: line too long' AS reason, CAST(strlen(line) AS INTEGER) AS bytes FROM lines WHERE long""",
    "long_line_letters_of_stop": f"""WITH {LANGUAGE_LINES}, ends AS (SELECT stream_id, min(line_no) AS stop FROM lines WHERE long GROUP BY stream_id)
SELECT stream_id || '--' || (line_no + 1) AS event_id, stream_id, -line_no - 1 AS seq_no,
CASE WHEN long THEN 'ingest: line too long' ELSE 'ingest: stream stopped at a long line' END AS reason, CAST(strlen(line) AS INTEGER) AS bytes
FROM lines JOIN ends USING (stream_id) WHERE line_no >= stop AND rtrim(line, chr(13)) <> ''""",
    "long_line_letters_of_files": f"""WITH {LANGUAGE_LINES}, placed AS (
  SELECT *, regexp_replace(stream_id, '[^a-z0-9]', '-', 'g') AS log, row_number() OVER (PARTITION BY regexp_replace(stream_id, '[^a-z0-9]', '-', 'g') ORDER BY line_no) AS k
  FROM lines WHERE long)
SELECT log || '--' || k AS event_id, log AS stream_id, -k AS seq_no, 'ingest: line too long' AS reason, CAST(strlen(line) AS INTEGER) AS bytes FROM placed""",
    "file_lines": """WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT count(*) AS records, count(*) AS numbers, CAST(count(*) AS BIGINT) AS last_numbers,
CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM lines WHERE line <> ''""",
    "event_ids": """SELECT event_id AS row, CASE WHEN user_id % 9 = 0 THEN 'evt' ELSE 'user-' || user_id END
|| '-' || (event_id + 1) AS id FROM events""",
    "dead_letters": f"{JSON}, {LETTERS} {LETTER_COLUMNS}",
    "dead_letter_round_trip": f"{JSON}, {LETTERS} {LETTER_COLUMNS}",
    "dead_letter_replay": f"{JSON} SELECT failed_step, reason, count(*) AS events FROM ev WHERE failed_step <> '' GROUP BY ALL",
    "retry_plan": f"""{JSON}, {LETTERS}, plan AS (SELECT *, attempt_count < 3 AND reason <> 'ingest: invalid json payload' AS eligible FROM letters)
SELECT event_id, attempt_count, eligible, CAST(least(100 * pow(2, greatest(attempt_count - 1, 0)), 5000) AS BIGINT) AS delay_cap_ms,
eligible AS within_cap FROM plan""",
    "raw_validation": _validation(*RAW_CHECKS),
    "event_validation": _validation(*EVENT_CHECKS),
    "error_membership": f"""WITH {QUESTIONABLE} SELECT seq_no, bad_source AS unknown_source, no_time AS invalid_timestamp,
bad_source OR no_time OR no_payload AS invalid FROM rows""",
    "source_check": f"""WITH {QUESTIONABLE} SELECT source, count(*) AS events, source IN ('json','syslog','stacktrace') AS valid
FROM rows GROUP BY source""",
    "accepted_and_rejected": f"{JSON} SELECT failed_step, count(*) AS events FROM ev GROUP BY failed_step",
    "severity_compare": f"""WITH s AS (SELECT event_id, {I.LEVEL} AS w FROM events), v AS (SELECT event_id, {SEVERITY.format(w='w')} AS severity FROM s)
SELECT event_id, severity, {NAME.format(s='severity')} AS name, severity >= 3 AS at_least_warn, severity >= 4 AS error_level FROM v""",
    "severity_words": f"""WITH w AS (SELECT {list(C.SEVERITY_WORDS)}[event_id % {len(C.SEVERITY_WORDS)} + 1] AS word FROM events),
g AS (SELECT word, count(*) AS events, {SEVERITY.format(w='word')} AS severity FROM w GROUP BY word)
SELECT word, events, severity, {NAME.format(s='severity')} AS name FROM g""",
    "json_events": f"""{JSON} SELECT event_id, severity, t AS timestamp, service, host, message, CAST(strlen(payload) AS INTEGER) AS raw_size FROM ok""",
    "json_frames": f"""{JSON} SELECT event_id, CAST(len(frames) AS INTEGER) AS n_frames, array_to_string(frames, '|') AS frames
FROM ok WHERE len(frames) > 0""",
    "json_fields": f"""{JSON} SELECT event_id, 'ctx=' || json_extract(doc, '$.ctx') || ';none=<nil>;ok=true;ratio=1.50;try='
|| json_extract_string(doc, '$.try') AS fields FROM ok""",
    "json_rejects": f"{JSON} SELECT stream_id, seq_no, failed_step, reason FROM ev WHERE failed_step <> ''",
    "syslog_events": f"""{SYSLOG} SELECT event_id, severity, t AS timestamp, service, host, message, CAST(raw_size AS INTEGER) AS raw_size FROM ev""",
    "syslog_fields": f"{SYSLOG} SELECT event_id, fields FROM ev",
    "stacktrace_events": f"""{TRACE_EVENTS} SELECT event_id, severity, service, message, CAST(len(frames) AS INTEGER) AS n_frames,
array_to_string(frames, '|') AS frames, CAST(raw_size AS INTEGER) AS raw_size FROM ev""",
    "routed_events": f"""{MIXED} SELECT source, failed_step, {NAME.format(s='severity')} AS severity_name, count(*) AS events,
CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count_if(signed) AS BIGINT) AS signed FROM mixed GROUP BY ALL""",
    "message_templates": f"WITH m AS ({I.MESSAGES}) SELECT id, {message_template('message')} AS template FROM m",
    "frame_templates": f"""WITH f AS (SELECT event_id, unnest({FRAME_LIST}) AS frame, generate_subscripts({FRAME_LIST}, 1) - 1 AS place FROM events)
SELECT event_id, CAST(place AS INTEGER) AS place, {frame_template('frame')} AS template FROM f""",
    "message_signatures": f"""WITH m AS ({I.MESSAGES}), t AS (SELECT id, service || '|' || {message_template('message')} AS template FROM m)
SELECT id, {signature('template')} AS signature FROM t""",
    "signature_depth": f"""WITH t AS (SELECT event_id, 'svc-' || (user_id % 5) AS service, {I.MESSAGE} AS message, {DEPTH_FRAMES} AS frames FROM events),
x AS (SELECT event_id, {template('service', 'message', 'frames', 6)} AS a, {template('service', 'message', 'frames', 2)} AS b,
{template('service', 'message', 'frames', 5)} AS c FROM t)
SELECT event_id, {signature('a')} AS all_frames, {signature('b')} AS two_frames, {signature('c')} AS "default" FROM x""",
    "empty_signature": f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE (CASE WHEN event_id % 3 = 0 THEN '' ELSE 'svc' END)
|| '|' || (CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END) END AS template FROM events)
SELECT event_id, {signature('template')} AS signature FROM t""",
    "error_signatures": f"{JSON} SELECT event_id, signature, template FROM ok",
    "dedup_events": f"{BY_USER} {DEDUP_COLUMNS}",
    "dedup_few_signatures": f"{_windows(I.signature_events_sql(C.BY_TYPE), HOUR_US)} {DEDUP_COLUMNS}",
    "dedup_hot_signatures": f"{_windows(I.signature_events_sql(C.BY_TYPE), HOUR_US)} {DEDUP_COLUMNS}",
    "dedup_default_window": f"{_windows(I.signature_events_sql(C.BY_TYPE), 300_000_000)} {DEDUP_COLUMNS}",
    "dedup_unsigned": f"{_windows(I.signature_events_sql(C.SOME_UNSIGNED), 6 * HOUR_US)} {DEDUP_COLUMNS}",
    "novel_events": f"{BY_USER} SELECT signature, stream_id, seq_no FROM deduped WHERE is_novel",
    "window_records": f"{BY_USER} SELECT signature, first_seen, last_seen, count FROM ({RECORDS.format(also='')})",
    "current_records": f"{BY_USER} {CURRENT.format(also='')}",
    "tracked_records": f"{BY_USER} {TRACKED}",
    "tracked_count": f"{BY_USER} SELECT count(*) AS tracked FROM ({TRACKED})",
    "ingest_stats": f"""{MIXED} SELECT source, count(*) AS ingested, CAST(count_if(failed_step = '') AS BIGINT) AS parsed,
CAST(count_if(failed_step <> '') AS BIGINT) AS errors FROM mixed GROUP BY source""",
    "ingest_totals": f"""{JSON} SELECT count(*) AS ingested, CAST(count_if(failed_step = '') AS BIGINT) AS parsed,
CAST(count_if(failed_step <> '') AS BIGINT) AS errors FROM ev""",
    "sequence_gaps": GAPS,
    "sequence_gaps_hot_stream": GAPS,
    "missing_ranges": RANGES,
    "missing_ranges_hot_stream": RANGES,
    "sequence_summary": f"""WITH turns AS ({I.TURNS}),
paired AS (SELECT *, lag(seq_no) OVER (PARTITION BY stream_id ORDER BY t, seq_no) AS previous_seq FROM turns)
SELECT stream_id, count(*) AS events, min(seq_no) AS first_seq, max(seq_no) AS last_seq, count(*) - count(DISTINCT seq_no) AS repeated,
max(seq_no) - min(seq_no) + 1 - count(DISTINCT seq_no) AS missing, count_if(seq_no <= previous_seq)::BIGINT AS reordered FROM paired GROUP BY stream_id""",
    "ingestion_lag": f"""{JSON}, lag AS (SELECT service, epoch_us(received_at) + (seq_no % 90) * 1000000 - t AS lag FROM ok)
SELECT service, count(*) AS events, min(lag) AS min_lag_us, max(lag) AS max_lag_us, CAST(sum(lag) AS BIGINT) AS total_lag_us,
quantile_disc(lag, 0.5) AS median_lag_us FROM lag GROUP BY service""",
    "throughput": f"""{JSON} SELECT epoch_us(date_trunc('hour', received_at)) AS bucket_start, stream_id, count(*) AS events,
CAST(sum(strlen(payload)) AS BIGINT) AS bytes FROM ok GROUP BY ALL""",
    "template_catalogue": f"{JSON} {CATALOGUE}",
    "top_templates": f"{JSON} {CATALOGUE} ORDER BY events DESC, signature LIMIT 10",
    "incidents": f"{INCIDENTS} SELECT event_id, signature, service, dedup_count, t AS timestamp FROM incident",
    "prompts": f"{INCIDENTS} SELECT event_id, {PROMPT} AS prompt FROM incident",
    "diagnosis_requests": f"""{INCIDENTS} SELECT event_id, signature, 'gemini-1.5-flash' AS model, 1 AS messages, 'user' AS role,
{PROMPT} AS content, 1 AS temperature_tenths FROM incident""",
    "diagnosis_responses": _responses("seq_no % 8"),
    "rule_diagnosis": f"""{DIAGNOSED} SELECT event_id, signature, root_cause, severity, affected_component, array_to_string(commands, '|') AS fix_commands,
CAST(NULL AS INTEGER) AS confidence_percent, CAST(NULL AS INTEGER) AS tokens_used, '' AS failure FROM diagnosed""",
    "diagnosis_texts": f"""{DIAGNOSED} SELECT event_id, root_cause || chr(10) || 'Fixes: ' || array_to_string(commands, '; ') AS text FROM diagnosed""",
    "table_rule_diagnosis": f"""{INCIDENTS}, ruled AS (SELECT i.*, (SELECT max(n_nationkey) FROM nation
  WHERE contains(lower(message), 'after ' || n_nationkey) OR contains(lower(message), lower(n_name))) AS rule FROM incident i)
SELECT event_id, signature, CASE WHEN rule IS NULL THEN 'Unhandled application error: ' || message ELSE 'trouble in ' || lower(n_name) END AS root_cause,
CASE WHEN rule IS NULL THEN {NAME.format(s='severity')} ELSE 'warn' END AS severity, service AS affected_component,
CASE WHEN rule IS NULL THEN 'kubectl logs -l app=' || service || ' --tail=100' ELSE 'page ' || service || ' of ' || lower(n_name) END AS fix_commands,
CAST(NULL AS INTEGER) AS confidence_percent, CAST(NULL AS INTEGER) AS tokens_used, '' AS failure FROM ruled LEFT JOIN nation ON rule = n_nationkey""",
    "many_rule_diagnosis": f"""{INCIDENTS}, phrases AS (
  SELECT 'after ' || o_orderkey || ' ms' AS phrase, o_orderkey % 1009 AS p, o_orderkey AS k FROM orders
  UNION ALL SELECT ' at 10.0.0.' || (o_custkey % 997) || ':', o_orderkey % 1009, o_orderkey FROM orders),
firsts AS (SELECT phrase, min([lpad(p::VARCHAR, 9, '0'), 'order ' || k || ' of', k::VARCHAR]) AS best FROM phrases GROUP BY phrase),
ruled AS (SELECT i.*, (SELECT min(best) FROM firsts WHERE contains(lower(message), phrase)) AS best FROM incident i)
SELECT event_id, signature, CASE WHEN best IS NULL THEN 'Unhandled application error: ' || message ELSE best[2] || ' ' || service || ': ' || message END AS root_cause,
CASE WHEN best[3]::BIGINT % 2 = 0 THEN 'warn' ELSE {NAME.format(s='severity')} END AS severity,
CASE WHEN best IS NULL THEN service ELSE 'orders' END AS affected_component,
CASE WHEN best IS NULL THEN 'kubectl logs -l app=' || service || ' --tail=100' ELSE 'hold ' || best[3] END AS fix_commands,
CAST(NULL AS INTEGER) AS confidence_percent, CAST(NULL AS INTEGER) AS tokens_used, '' AS failure FROM ruled""",
    "missing_events": f"""WITH {INCIDENT}, asked AS (SELECT seq_no % 4 <> 0 AS has FROM ok WHERE severity >= 4)
SELECT CASE WHEN has THEN '' ELSE 'llm: nil diagnosis request' END AS failure, count(*) AS requests,
CAST(count_if(has) AS BIGINT) AS diagnoses FROM asked GROUP BY has""",
    "stream_dedup_events": f"{BY_USER} {DEDUP_COLUMNS}",
    "stream_dedup_ordered": f"{BY_USER} {DEDUP_COLUMNS}",
    "stream_current_records": f"{BY_USER} {CURRENT.format(also='')}",
    "stream_tracked_count": f"{BY_USER} SELECT count(*) AS tracked FROM ({CURRENT.format(also='')}) WHERE (SELECT max(t) FROM deduped) - last_seen < {6 * HOUR_US}",
    "stream_stats": f"""{JSON} SELECT CAST(5 AS BIGINT) AS batches, count(*) AS ingested, CAST(count_if(failed_step = '') AS BIGINT) AS parsed,
CAST(count_if(failed_step <> '') AS BIGINT) AS errors FROM ev""",
    "stream_responses": _responses("CASE WHEN seq_no % 7 > 4 THEN 0 ELSE seq_no % 8 END"),
    "stream_traces": f"""{TRACE_EVENTS} SELECT 'stacktrace' AS source, severity, count(*) AS events,
CAST(sum(raw_size) AS BIGINT) AS bytes, CAST(sum(len(frames)) AS BIGINT) AS frames FROM ev GROUP BY severity""",
    "stream_dead_letters": f"""{JSON} SELECT source, reason, count(*) AS letters, max(seq_no) AS last_seq FROM ev
WHERE failed_step <> '' GROUP BY source, reason""",
}
