"""The same queries as DuckDB SQL over the registered tables, stated sequentially with plain windows and joins."""

from __future__ import annotations

# ---- event log ------------------------------------------------------------------------------------------------

_EV = """
raw AS (
  SELECT event_id AS seq, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         concat(user_id, '-', (day(ts) - 1) // 7) AS flow
  FROM events
),
ev AS (
  SELECT *, event_type = 'signup' AS is_start,
    CASE WHEN event_type = 'signup' THEN 'processFlow.initiated' ELSE 'task.event' END AS message_name,
    CASE WHEN event_type = 'signup' THEN 'intake' ELSE 'runner' END AS source,
    CASE WHEN event_type = 'signup' THEN concat('dag', user_id % 3) END AS dag_key,
    CASE WHEN event_type = 'view' THEN 'WAITING' WHEN event_type IN ('click', 'purchase') THEN 'COMPLETED'
         WHEN event_type = 'error' THEN 'FAILED' END AS status,
    k % 3 AS b, concat(flow, '-', k % 3, '-', k % 2) AS task,
    concat('a', k % 2) AS action, concat('A', k % 2) AS code,
    event_type = 'error' AND k % 4 = 0 AS retryable,
    CASE WHEN k < 15 THEN 'Failed' ELSE 'Passed' END AS body_status,
    CASE k % 10 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'ERROR_701' WHEN 3 THEN NULL
         ELSE 'COMPLETED' END AS status_code,
    CASE WHEN k % 7 = 0 THEN concat('reason-', k) WHEN k % 7 = 1 THEN '  ' END AS change_reason
  FROM raw
),
body AS (
  SELECT *, concat('{"id":"', task, '","taskFlowResponse":{"href":"/taskFlow/', task,
    '","characteristic":[{"name":"taskStatus","value":"', body_status, '"}]}',
    CASE WHEN status_code IS NULL THEN '' ELSE concat(',"taskStatusCode":"', status_code, '"') END,
    CASE WHEN change_reason IS NULL THEN '' ELSE concat(',"statusChangeReason":"', change_reason, '"') END,
    '}') AS result_json,
    CASE WHEN event_type = 'error' THEN concat('{"retryable":', CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END, '}')
      END AS error_json
  FROM ev
)"""

# Typed verdicts as they come, or out of stored text of which some is unreadable.
_VERDICT = """
verdict AS (
  SELECT *, TRUE AS parsed FROM body
)"""
_VERDICT_TEXT = """
stored AS (
  SELECT * EXCLUDE (result_json, body_status, status_code, change_reason),
    CASE WHEN seq % 11 = 0 THEN '{bad' WHEN seq % 13 = 0 THEN '{}' WHEN seq % 17 = 0 THEN '[]' ELSE result_json END
      AS result_json
  FROM body
),
checked AS (
  SELECT *, json_valid(result_json) AND left(ltrim(result_json), 1) = '{' AS parsed FROM stored
),
verdict AS (
  SELECT *,
    CASE WHEN parsed THEN json_extract_string(result_json, '$.taskFlowResponse.characteristic[0].value') END
      AS body_status,
    CASE WHEN parsed THEN json_extract_string(result_json, '$.taskStatusCode') END AS status_code,
    CASE WHEN parsed THEN json_extract_string(result_json, '$.statusChangeReason') END AS change_reason
  FROM checked
)"""

_DAGS = """
dags(dag_key, b, total) AS (
  VALUES ('dag0', 0, 1), ('dag0', 1, 1), ('dag0', 2, 1), ('dag1', 0, 2), ('dag1', 1, 1), ('dag2', 0, 1)
)"""

_SEEDS = """
starts AS (
  SELECT *, row_number() OVER (PARTITION BY flow ORDER BY seq) AS n FROM ev WHERE is_start
),
o0 AS (
  SELECT flow, s.dag_key, total, seq AS opened FROM starts s JOIN dags d ON d.dag_key = s.dag_key AND d.b = 0
  WHERE n = 1
)"""

_COUNTABLE = """
countable AS (
  SELECT flow, seq, b, status = 'FAILED' AS failed FROM ev
  WHERE NOT is_start AND (status = 'COMPLETED' OR (status = 'FAILED' AND NOT retryable))
)"""


def _count(i: int) -> str:
    return f"""
hit{i} AS (
  SELECT o.flow, o.total, c.seq, c.failed, row_number() OVER (PARTITION BY o.flow ORDER BY c.seq) AS n
  FROM o{i} o JOIN countable c ON c.flow = o.flow AND c.b = {i} AND c.seq > o.opened
),
bar{i} AS (
  SELECT o.flow, {i} AS b, any_value(o.dag_key) AS dag_key, any_value(o.total) AS total,
    any_value(o.opened) AS opened,
    count(*) FILTER (NOT h.failed AND n <= h.total) AS done, count(*) FILTER (h.failed AND n <= h.total) AS bad,
    CASE WHEN count(*) FILTER (n <= h.total) = any_value(o.total) THEN max(h.seq) FILTER (n <= h.total) END AS closed
  FROM o{i} o LEFT JOIN hit{i} h ON h.flow = o.flow GROUP BY o.flow
)"""


def _decide(i: int) -> str:
    return f"""
seen{i} AS (
  SELECT v.*, z.closed, row_number() OVER (PARTITION BY v.flow, v.task ORDER BY v.seq DESC) AS back,
    min(v.seq) OVER (PARTITION BY v.flow, v.task) AS born
  FROM verdict v JOIN bar{i} z ON z.flow = v.flow AND z.closed IS NOT NULL AND v.seq <= z.closed
  WHERE NOT v.is_start
),
row{i} AS (
  SELECT *, CASE WHEN status <> 'COMPLETED' THEN concat('action=', action, ' row.status=', status)
    WHEN lower(body_status) <> 'passed'
      THEN concat('action=', action, ' actionResponse.taskFlowResponse.taskStatus=', body_status) END AS reason
  FROM seen{i} WHERE back = 1 AND b = {i}
),
dec{i} AS (
  SELECT flow, count(*) AS n_rows, arg_min(reason, born) FILTER (reason IS NOT NULL) AS kickout,
    CASE WHEN bool_or(parsed AND (status_code IS NULL OR lower(status_code) = 'error')) THEN 'ERROR'
         WHEN bool_or(lower(status_code) = 'failed') THEN 'FAILED'
         WHEN bool_or(lower(status_code) = 'error_701') THEN 'ERROR_701' ELSE 'Passed' END AS process_status,
    arg_min(change_reason, born) FILTER (parsed AND trim(change_reason) <> '') AS change
  FROM row{i} GROUP BY flow
),
fin{i} AS (
  SELECT z.*, CASE WHEN closed IS NULL THEN 'OPEN' WHEN kickout IS NULL THEN 'CLOSED' ELSE 'FAILED' END AS status,
    kickout, CASE WHEN n_rows IS NULL THEN 'FAILED' ELSE process_status END AS process_status,
    CASE WHEN n_rows IS NULL THEN 'No Task/Action Performed' WHEN change IS NOT NULL THEN change
         WHEN process_status = 'Passed' THEN 'Process Flow Success' ELSE 'Process Flow Failure' END AS change_reason
  FROM bar{i} z LEFT JOIN dec{i} d ON d.flow = z.flow
),
o{i + 1} AS (
  SELECT flow, f.dag_key, d.total, closed AS opened FROM fin{i} f
  JOIN dags d ON d.dag_key = f.dag_key AND d.b = {i + 1} WHERE status = 'CLOSED'
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _barriers(verdict: str = _VERDICT) -> str:
    steps = [s for i in range(3) for s in (_count(i), _decide(i))]
    union = """
barrier AS (
  SELECT * FROM fin0 UNION ALL BY NAME SELECT * FROM fin1 UNION ALL BY NAME SELECT * FROM fin2
)"""
    return _with(_EV, verdict, _DAGS, _SEEDS, _COUNTABLE, *steps, union)


_COUNT_CHAIN = _with(
    _EV,
    _DAGS,
    _SEEDS,
    _COUNTABLE,
    *[
        s
        for i in range(3)
        for s in (
            _count(i),
            f"""
o{i + 1} AS (
  SELECT flow, f.dag_key, d.total, closed AS opened FROM bar{i} f
  JOIN dags d ON d.dag_key = f.dag_key AND d.b = {i + 1} WHERE closed IS NOT NULL
)""",
        )
    ],
)

_ENDS = """
ends AS (
  SELECT flow, closed AS end_seq, x.b, CASE WHEN x.status = 'FAILED' THEN 'failed' ELSE 'completed' END AS state,
    CASE WHEN x.status = 'FAILED' THEN concat('batch ', x.b, ' kickout: ', kickout) END AS message,
    process_status, change_reason
  FROM barrier x LEFT JOIN dags d ON d.dag_key = x.dag_key AND d.b = x.b + 1
  WHERE x.status = 'FAILED' OR (x.status = 'CLOSED' AND d.b IS NULL)
)"""

_TASKS = """
task_row AS (
  SELECT flow, task, arg_max_null(action, seq) AS action, arg_max_null(code, seq) AS code,
    arg_max_null(b, seq) AS b, arg_max_null(status, seq) AS status, arg_max_null(result_json, seq) AS result_json,
    arg_max_null(error_json, seq) AS error_json, min(seq) AS first_seq, max(seq) AS last_seq
  FROM body WHERE NOT is_start GROUP BY flow, task
)"""

_MIXED = """
mixed AS (
  SELECT seq, flow, status,
    CASE WHEN seq % 10 IN (0, 1) THEN 'task.execute' WHEN seq % 10 = 2 THEN 'task.signal'
         WHEN seq % 10 = 3 THEN 'flow.lifecycle' WHEN seq % 10 = 4 THEN 'Task.Event'
         WHEN seq % 10 = 5 THEN NULL ELSE message_name END AS message_name,
    CASE WHEN seq % 10 = 0 THEN 'engine' WHEN seq % 10 = 9 THEN NULL ELSE source END AS source
  FROM ev
)"""

_DEPS = """
deps(dag_key, b, action_pos, dependency) AS (
  VALUES ('dag0', 1, 0, 'a0'), ('dag0', 1, 0, 'a1'), ('dag0', 2, 0, 'a0'),
         ('dag1', 1, 0, 'a0'), ('dag1', 1, 0, 'a1'), ('dag1', 1, 0, 'a9')
),
needed AS (
  SELECT x.flow, x.b, x.opened, d.action_pos, d.dependency
  FROM barrier x JOIN deps d ON d.dag_key = x.dag_key AND d.b = x.b
),
dep_seen AS (
  SELECT x.flow, x.b AS at_b, v.task, v.action, v.status, v.result_json,
    row_number() OVER (PARTITION BY x.flow, x.b, v.task ORDER BY v.seq DESC) AS back,
    min(v.seq) OVER (PARTITION BY x.flow, x.b, v.task) AS born
  FROM barrier x JOIN body v ON v.flow = x.flow AND v.seq <= x.opened WHERE NOT v.is_start
),
dep_found AS (
  SELECT flow, at_b AS b, action AS dependency, arg_max(result_json, born) AS result_json
  FROM dep_seen WHERE back = 1 AND status = 'COMPLETED' GROUP BY ALL
),
dep_row AS (
  SELECT n.*, f.result_json FROM needed n LEFT JOIN dep_found f USING (flow, b, dependency)
)"""

# ---- lines and parts ------------------------------------------------------------------------------------------

_LINES = """
ln AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS flow, concat(l_orderkey, '-', l_linenumber) AS task,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                       ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n,
    l_shipdate AS moved_at, l_linenumber % 3 AS b, concat('n', l_partkey % 10) AS action, concat('N', l_partkey % 10) AS code,
    CASE l_returnflag WHEN 'A' THEN 'COMPLETED' WHEN 'R' THEN 'FAILED' WHEN 'N' THEN 'WAITING' END AS status,
    l_linestatus = 'F' AS timed, l_linestatus, l_returnflag, l_partkey, l_suppkey, l_extendedprice, l_quantity
  FROM lineitem
),
line_task AS (
  SELECT flow, task, arg_max(action, n) AS action, arg_max(code, n) AS code, arg_max(b, n) AS b,
    arg_max(status, n) AS status,
    arg_max_null(CASE WHEN l_returnflag = 'R'
      THEN concat('{"retryable":', CASE WHEN timed THEN 'false' ELSE 'true' END, '}') END, n) AS error_json,
    arg_max_null(moved_at, n) FILTER (timed) AS started_at,
    arg_max_null(CASE WHEN l_returnflag = 'A' THEN moved_at END, n) FILTER (timed) AS finished_at,
    arg_max(CAST(l_quantity AS BIGINT), n) FILTER (timed AND l_partkey % 2 = 0) AS duration_ms,
    arg_min(moved_at, n) AS created_at, arg_max(moved_at, n) AS updated_at
  FROM ln GROUP BY flow, task
)"""

_REGISTRY = """
pt AS (
  SELECT *, lpad(replace(p_brand, 'Brand#', ''), 2, '0') AS code FROM part
),
codes AS (
  SELECT p_name AS name, arg_max(code, p_partkey) AS code, arg_max(p_type, p_partkey) AS type FROM pt GROUP BY p_name
),
dcx_src AS (
  SELECT code AS parent, CASE WHEN p_size % 5 <> 0 THEN p_type ELSE 'DEFAULT' END AS flow_type,
    CASE WHEN p_size % 4 = 0 THEN 'DEFAULT' ELSE concat('M', p_size % 3) END AS modem_type,
    CASE WHEN p_partkey % 13 <> 0 THEN concat('DCX-', p_partkey) END AS dcx, p_partkey
  FROM pt
),
dcx AS (
  SELECT concat(parent, ',', flow_type, ',', modem_type) AS key, arg_max_null(dcx, p_partkey) AS dcx
  FROM dcx_src GROUP BY 1
),
asked AS (
  SELECT CASE WHEN p_brand = 'Brand#13' THEN concat('unknown ', p_name) ELSE p_name END AS name,
    p_type AS flow_type, concat('M', p_size % 3) AS modem_type, count(*) AS lines
  FROM lineitem JOIN pt ON p_partkey = l_partkey GROUP BY ALL
),
names AS (
  SELECT name, CAST(sum(lines) AS BIGINT) AS lines FROM asked GROUP BY name
),
probed AS (
  SELECT a.*, c.code,
    coalesce((SELECT dcx FROM dcx WHERE key = CASE WHEN c.code LIKE '0%' THEN concat(c.code, ',DEFAULT,', a.modem_type)
                                             ELSE concat(c.code, ',', a.flow_type, ',DEFAULT') END),
             (SELECT dcx FROM dcx WHERE key = concat(c.code, ',DEFAULT,DEFAULT'))) AS dcx
  FROM asked a LEFT JOIN codes c ON c.name = a.name
)"""

_SIGNALS = """
waiting AS (
  SELECT concat('ASYNC-', user_id, '-', k) AS txn, seq, ts, flow, task FROM ev WHERE event_type = 'view'
),
reply AS (
  SELECT *, CASE WHEN k % 17 <> 0 THEN concat('ASYNC-', user_id, '-', k) END AS txn FROM ev WHERE event_type = 'click'
)"""

ORACLE: dict[str, str] = {}

ORACLE["route_envelopes"] = _with(_EV, _MIXED) + """
SELECT seq AS arrival_seq, flow AS correlation_id, message_name,
  CASE message_name WHEN 'processFlow.initiated' THEN 'start_flow' WHEN 'task.event' THEN 'apply_event'
    WHEN 'task.signal' THEN 'log_signal' WHEN 'task.execute' THEN 'log_command' ELSE 'log_lifecycle' END AS route
FROM mixed
WHERE message_name IN ('processFlow.initiated', 'task.event', 'task.signal', 'task.execute', 'flow.lifecycle')
  AND NOT (message_name = 'task.execute' AND source IS NOT DISTINCT FROM 'engine')"""

ORACLE["message_inventory"] = _with(_EV, _MIXED) + """
SELECT message_name, source, status, count(*) AS messages FROM mixed GROUP BY ALL"""

ORACLE["message_listing"] = _with(_EV, _MIXED) + """
SELECT flow AS correlation_id, seq AS arrival_seq, message_name, source, status FROM mixed ORDER BY 1, 2"""

ORACLE["conformance_report"] = _with(_EV) + """,
changed AS (
  SELECT seq, message_name, is_start, CASE WHEN seq % 23 <> 0 THEN status END AS status,
    CASE WHEN seq % 29 = 0 THEN 'dagX' ELSE dag_key END AS dag_key,
    CASE WHEN seq % 31 = 0 THEN 'engine' ELSE source END AS source,
    CASE WHEN seq % 37 <> 0 THEN flow END AS flow
  FROM ev
),
ruled AS (
  SELECT seq, message_name, concat_ws(',',
    CASE WHEN flow IS NULL THEN 'missing correlation_id' END,
    CASE WHEN source <> CASE WHEN is_start THEN 'intake' ELSE 'runner' END THEN 'wrong source' END,
    CASE WHEN NOT is_start AND dag_key IS NOT NULL THEN 'forbidden dag_key' END,
    CASE WHEN NOT is_start AND status IS NULL THEN 'missing status' END,
    CASE WHEN is_start AND status IS NOT NULL THEN 'forbidden status' END,
    CASE WHEN NOT is_start THEN 'missing task' END,
    CASE WHEN NOT is_start THEN 'missing execution' END) AS violations
  FROM changed
)
SELECT seq AS arrival_seq, message_name, violations FROM ruled WHERE violations <> ''"""

ORACLE["quarantine_split"] = _with(_EV) + """,
typed AS (
  SELECT *, CASE WHEN seq % 13 = 0 THEN 'DONE' ELSE status END AS sent_status FROM ev
),
logged AS (
  SELECT *, CASE WHEN seq % 17 = 0 THEN '[]' WHEN seq % 11 = 0 THEN left(js, 40) ELSE js END AS txt
  FROM (SELECT *, CAST(json_object('eventId', CAST(seq AS VARCHAR), 'correlationId', flow, 'messageName', message_name,
                              'status', sent_status) AS VARCHAR) AS js FROM typed)
  WHERE seq % 19 <> 0
),
judged AS (
  SELECT *, json_valid(txt) AND left(txt, 1) = '{' AND
    coalesce(sent_status, 'INITIAL') IN ('INITIAL', 'IN_PROGRESS', 'WAITING', 'COMPLETED', 'FAILED', 'CANCELLED') AS ok
  FROM logged
)
SELECT seq AS arrival_seq, CASE WHEN ok THEN 'good' ELSE 'quarantine' END AS outcome,
  CASE WHEN ok THEN flow END AS correlation_id, CASE WHEN ok THEN sent_status END AS status,
  CASE WHEN ok AND NOT is_start THEN b END AS batch_index
FROM judged"""

ORACLE["quarantine_provenance"] = _with(_EV) + """,
typed AS (
  SELECT seq, CASE WHEN seq % 13 = 0 THEN 'DONE' ELSE status END AS sent_status FROM ev WHERE seq % 19 <> 0
)
SELECT 'flow-events' AS topic, seq % 8 AS "partition", seq // 8 AS "offset", CAST(seq % 100 AS VARCHAR) AS key,
  CASE WHEN seq % 17 = 0 THEN 2 WHEN seq % 11 = 0 THEN 40 END AS text_length, CASE WHEN seq % 5 = 0 THEN 2 ELSE 1 END AS deliveries
FROM typed WHERE seq % 17 = 0 OR seq % 11 = 0 OR sent_status = 'DONE'"""

ORACLE["body_verdicts"] = _with(_EV, _VERDICT_TEXT) + """
SELECT seq AS arrival_seq, parsed, body_status, status_code, change_reason FROM verdict WHERE NOT is_start"""

ORACLE["valid_initiations"] = _with(_EV, _DAGS, _SEEDS) + """
SELECT flow AS correlation_id, dag_key, total AS task_total, opened AS opened_seq FROM o0"""

ORACLE["task_event_class"] = _with(_EV) + """
SELECT seq AS arrival_seq,
  CASE status WHEN 'WAITING' THEN 'wait' WHEN 'COMPLETED' THEN 'done' WHEN 'FAILED' THEN 'fail' END AS event_class,
  status = 'COMPLETED' OR (status = 'FAILED' AND NOT retryable) AS countable
FROM ev WHERE NOT is_start"""

ORACLE["task_upsert"] = _with(_LINES) + """
SELECT flow AS correlation_id, task AS task_flow_id, action AS action_name, code AS action_code, b AS batch_index,
  status, concat('{"id":"', task, '"}') AS result_json, error_json, started_at, finished_at, duration_ms, created_at,
  updated_at
FROM line_task"""

ORACLE["task_upsert_events"] = _with(_EV, _TASKS) + """
SELECT flow AS correlation_id, task AS task_flow_id, action AS action_name, code AS action_code, b AS batch_index,
  status, result_json, error_json, first_seq, last_seq FROM task_row"""

ORACLE["waiting_tasks"] = _with(_EV, _TASKS) + """
SELECT flow AS correlation_id, task AS task_flow_id, last_seq FROM task_row WHERE status = 'WAITING'"""

ORACLE["latest_results"] = _with(_EV, _TASKS) + """
SELECT flow AS correlation_id, action AS action_name, arg_max(result_json, first_seq) AS result_json,
  max(first_seq) AS first_seq
FROM task_row WHERE status = 'COMPLETED' GROUP BY ALL ORDER BY first_seq DESC"""

ORACLE["barrier_counts"] = _COUNT_CHAIN + """,
every AS (SELECT * FROM bar0 UNION ALL SELECT * FROM bar1 UNION ALL SELECT * FROM bar2)
SELECT flow AS correlation_id, b AS batch_index, total AS task_total, CAST(done AS INTEGER) AS task_completed,
  CAST(bad AS INTEGER) AS task_failed, CAST(total - done - bad AS INTEGER) AS pending,
  CASE WHEN total = done + bad THEN 'DRAINED' ELSE 'OPEN' END AS status FROM every"""

ORACLE["barrier_lifecycle"] = _barriers() + """
SELECT flow AS correlation_id, b AS batch_index, dag_key, total AS task_total, CAST(done AS INTEGER) AS task_completed,
  CAST(bad AS INTEGER) AS task_failed, CAST(total - done - bad AS INTEGER) AS pending, status, opened AS opened_seq,
  closed AS closed_seq, kickout FROM barrier"""

ORACLE["verify_listing"] = _barriers() + """
SELECT flow AS correlation_id, b AS batch_index, total AS task_total, CAST(done AS INTEGER) AS task_completed,
  CAST(bad AS INTEGER) AS task_failed, status FROM barrier ORDER BY 1, 2"""

ORACLE["task_listing"] = _with(_EV, _TASKS) + """
SELECT flow AS correlation_id, task AS task_flow_id, action AS action_name, code AS action_code, b AS batch_index,
  status FROM task_row ORDER BY 1, 5, 3, 2"""

ORACLE["flow_outcome"] = _barriers() + "," + _TASKS + """
SELECT x.flow AS correlation_id, x.n AS barriers, x.ok AS all_closed, coalesce(t.n, 0) AS tasks
FROM (SELECT flow, count(*) AS n, bool_and(status = 'CLOSED') AS ok FROM barrier GROUP BY flow) x
LEFT JOIN (SELECT flow, count(*) AS n FROM task_row GROUP BY flow) t ON t.flow = x.flow"""

ORACLE["final_state"] = _barriers(_VERDICT_TEXT) + "," + _ENDS + """
SELECT flow AS correlation_id, end_seq, b AS batch_index, state, message, process_status,
  change_reason AS status_change_reason FROM ends"""

_DOCS = """
docs AS (
  SELECT concat(o_orderkey // 5, '-', o_orderkey % 5) AS id, o_orderstatus, o_orderpriority, o_custkey,
    o_orderkey % 2 = 0 AS even
  FROM orders
)"""

ORACLE["final_patch"] = _barriers() + "," + _ENDS + "," + _DOCS + """
SELECT flow AS id, state, concat_ws('|',
  CASE WHEN o.id IS NOT NULL THEN concat('priority=', o_orderpriority) END,
  CASE WHEN o.id IS NOT NULL AND NOT even THEN concat('customer=', o_custkey) END,
  concat('processStatus=', process_status), concat('statusChangeReason=', change_reason)) AS attributes
FROM ends LEFT JOIN docs o ON o.id = flow"""

ORACLE["state_patches"] = _with(_DOCS) + """
SELECT id, CASE o_orderstatus WHEN 'O' THEN 'inProgress' WHEN 'F' THEN 'completed' END AS state
FROM docs WHERE o_orderstatus IN ('O', 'F')"""

ORACLE["task_refs"] = _with(_LINES) + """,
ref AS (
  SELECT flow, task AS id, moved_at, l_partkey, l_suppkey, l_extendedprice, action,
    row_number() OVER (PARTITION BY flow, task ORDER BY moved_at, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM ln WHERE status IN ('COMPLETED', 'FAILED') AND l_partkey % 5 NOT IN (0, 1)
),
old AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS flow, concat(o_orderkey, '-1') AS id FROM orders WHERE o_orderstatus = 'F'
),
fresh AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.flow ORDER BY moved_at, l_partkey, l_suppkey, l_extendedprice) AS n
  FROM ref r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.flow = r.flow AND old.id = r.id)
)
SELECT flow AS correlation_id, CAST(1 AS BIGINT) AS pos, id, '/old' AS href, 'old' AS name, 'TaskFlow' AS role,
  'RelatedEntity' AS type, 'TaskFlow' AS referred_type, 'old' AS flow_ref_type FROM old
UNION ALL
SELECT flow, n + CASE WHEN EXISTS (SELECT 1 FROM old WHERE old.flow = f.flow) THEN 1 ELSE 0 END, id,
  concat('/taskFlow/', id), action, 'TaskFlow', 'RelatedEntity', 'TaskFlow', action FROM fresh f"""

ORACLE["task_flow_refs"] = _with(_LINES) + """,
ref AS (
  SELECT flow, task AS id, moved_at, l_partkey, l_suppkey, l_extendedprice, action,
    row_number() OVER (PARTITION BY flow, task ORDER BY moved_at, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM ln WHERE status IN ('COMPLETED', 'FAILED') AND l_partkey % 5 NOT IN (0, 1)
),
old AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS flow, CASE o_orderstatus WHEN 'F' THEN 'relatedEntity' ELSE 'taskFlow' END AS list,
    concat(o_orderkey, CASE o_orderstatus WHEN 'F' THEN '-1' ELSE '-2' END) AS id FROM orders WHERE o_orderstatus IN ('F', 'O')
),
wanted AS (
  SELECT r.*, list, CASE list WHEN 'taskFlow' THEN action ELSE 'TaskFlow' END AS kind
  FROM ref r, (VALUES ('relatedEntity'), ('taskFlow')) v(list) WHERE k = 1
),
fresh AS (
  SELECT w.*, row_number() OVER (PARTITION BY flow, list ORDER BY moved_at, l_partkey, l_suppkey, l_extendedprice) AS n
  FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.flow = w.flow AND o.list = w.list AND o.id = w.id)
)
SELECT flow AS correlation_id, list, CAST(1 AS BIGINT) AS pos, id, '/old' AS href, 'old' AS referred_type FROM old
UNION ALL
SELECT flow, list, n + CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.flow = f.flow AND o.list = f.list) THEN 1 ELSE 0 END, id,
  concat('/taskFlow/', id), kind FROM fresh f"""

ORACLE["flow_document"] = """
WITH p AS (
  SELECT o_orderkey AS id, 0 AS n, 'initial' AS state, NULL AS href, o_orderpriority AS spec,
    concat('status=', o_orderstatus) AS attributes
  FROM orders
  UNION ALL
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice),
    CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' END,
    CASE WHEN l_linestatus = 'F' THEN concat('/flow/', l_orderkey) END, NULL,
    CASE WHEN l_partkey % 3 = 0 THEN concat('part=', l_partkey, '|line=', l_linenumber) END
  FROM lineitem
)
SELECT id, arg_max(state, n) AS state, arg_max(href, n) AS href, arg_max(spec, n) AS specification,
  arg_max(attributes, n) AS attributes FROM p GROUP BY id"""

ORACLE["appended_related"] = """
SELECT l_orderkey AS id, l_shipdate AS patched_at, CAST(0 AS INTEGER) AS entry_pos,
  concat(l_orderkey, '-', l_linenumber) AS entry_id, l_returnflag AS entry_name
FROM lineitem WHERE l_returnflag <> 'N'"""

ORACLE["action_lookup"] = _with(_REGISTRY) + """
SELECT n.name AS action_name, lines, c.name IS NOT NULL AS known, c.code AS action_code, c.type AS action_type,
  CASE WHEN c.name IS NOT NULL THEN c.code ELSE (SELECT code FROM codes WHERE name = 'red bolt') END AS code_or_default,
  CASE WHEN c.name IS NOT NULL THEN n.name ELSE 'red bolt' END AS name_or_default
FROM names n LEFT JOIN codes c ON c.name = n.name"""

ORACLE["reverse_lookup"] = _with(_REGISTRY) + """
SELECT a.code AS action_code, a.parts, r.name AS action_name
FROM (SELECT code, count(*) AS parts FROM pt GROUP BY code) a
LEFT JOIN (SELECT code, min(name) AS name FROM codes GROUP BY code) r ON r.code = a.code"""

ORACLE["dcx_lookup"] = _with(_REGISTRY) + """
SELECT name AS action_name, flow_type, modem_type, lines, code AS action_code, dcx AS dcx_action_code,
  coalesce(dcx, 'FALLBACK') AS dcx_or_default FROM probed"""

ORACLE["resolved_actions"] = _with(_REGISTRY) + """
SELECT n.name AS action_name, lines, c.code AS action_code,
  coalesce((SELECT dcx FROM dcx WHERE key = concat(c.code, ',DEFAULT,DEFAULT')), 'UNKNOWN') AS dcx_action_code
FROM names n JOIN codes c ON c.name = n.name"""

ORACLE["dcx_membership"] = _with(_REGISTRY) + """
SELECT a.name AS action_name, a.flow_type, a.modem_type, c.code AS action_code
FROM asked a JOIN codes c ON c.name = a.name
WHERE concat(c.code, ',', a.flow_type, ',', a.modem_type) IN (SELECT key FROM dcx)"""

ORACLE["missing_required"] = _with(_REGISTRY) + """
SELECT name AS action_name FROM names WHERE name NOT IN (SELECT name FROM codes)"""

ORACLE["registry_audit"] = _with(_REGISTRY) + """,
nm AS (SELECT CASE WHEN p_partkey % 10 > 1 THEN p_name END AS name FROM part)
SELECT 'action_codes' AS registry, count(*) AS rows_read, count(*) - count(name) AS rows_skipped,
  count(DISTINCT name) AS keys_kept, count(name) - count(DISTINCT name) AS keys_overwritten,
  count(name) > 0 AS ready FROM nm
UNION ALL
SELECT 'dcx_action_codes', count(*), 0, count(DISTINCT concat(parent, ',', flow_type, ',', modem_type)),
  count(*) - count(DISTINCT concat(parent, ',', flow_type, ',', modem_type)), count(*) > 0 FROM dcx_src"""

ORACLE["registry_snapshot"] = _with(_REGISTRY) + """
SELECT 'action_codes' AS registry, p_name AS name, arg_max(code, p_partkey) AS code FROM pt
WHERE p_partkey % 10 > 1 GROUP BY p_name
UNION ALL SELECT 'dcx_action_codes', key, dcx FROM dcx"""

ORACLE["batch_commands"] = _barriers() + "," + _DEPS + "," + _REGISTRY + """,
acts(dag_key, b, pos, name, mode, flow_type, modem_type) AS (
  VALUES ('dag0', 0, 0, 'a0', 'SYNC', 'DEFAULT', 'DEFAULT'), ('dag0', 1, 0, 'a1', 'ASYNC', 'DEFAULT', 'DEFAULT'),
    ('dag0', 2, 0, 'a0', NULL, 'SMALL', 'M1'), ('dag1', 0, 0, 'a0', 'SYNC', 'DEFAULT', 'DEFAULT'),
    ('dag1', 0, 1, 'a1', NULL, 'DEFAULT', 'M2'), ('dag1', 1, 0, 'a1', NULL, 'LARGE', 'DEFAULT'),
    ('dag2', 0, 0, 'a9', NULL, 'DEFAULT', 'DEFAULT')
),
cmd_codes AS (
  SELECT concat('a', p_partkey % 2) AS name, arg_max(code, p_partkey) AS code FROM pt GROUP BY 1
),
doc AS (
  SELECT x.flow, x.b, arg_max(CASE WHEN e.is_start THEN 'initial' ELSE 'inProgress' END, e.seq) AS state,
    arg_max(e.task, e.seq) FILTER (NOT e.is_start) AS task, arg_max(e.dag_key, e.seq) FILTER (e.is_start) AS dag_key
  FROM barrier x JOIN ev e ON e.flow = x.flow AND e.seq <= x.opened AND (e.is_start OR e.status = 'COMPLETED')
  GROUP BY x.flow, x.b
),
dep_map AS (
  SELECT flow, b, action_pos, string_agg(concat(dependency, '=', result_json), '|' ORDER BY dependency) AS txt
  FROM dep_row WHERE result_json IS NOT NULL GROUP BY ALL
)
SELECT sha256(concat_ws('|', x.flow, 'task.execute', x.b, a.pos, x.opened)) AS event_id,
  (SELECT ts FROM ev WHERE ev.seq = x.opened) AS event_time,
  x.flow AS correlation_id, 'task.execute' AS message_name, 'COMMAND' AS message_type,
  'engine' AS source, 'EXECUTE' AS intent, x.dag_key, x.b AS batch_index, x.total AS batch_total,
  a.name AS action_name, k.code AS action_code,
  coalesce((SELECT dcx FROM dcx WHERE key = CASE WHEN k.code LIKE '0%' THEN concat(k.code, ',DEFAULT,', a.modem_type)
                                            ELSE concat(k.code, ',', a.flow_type, ',DEFAULT') END),
           (SELECT dcx FROM dcx WHERE key = concat(k.code, ',DEFAULT,DEFAULT'))) AS dcx_action_code,
  a.mode AS execution_mode, coalesce(m.txt, '') AS dependency_results,
  concat('{"id":"', x.flow, '","state":"', p.state, '"', CASE WHEN p.task IS NULL THEN '' ELSE concat(',"href":"/taskFlow/', p.task, '"') END,
    ',"processFlowSpecification":"', p.dag_key, '"}') AS process_flow,
  x.opened AS command_seq, a.pos + 1 AS emit_pos
FROM barrier x JOIN doc p ON p.flow = x.flow AND p.b = x.b JOIN acts a ON a.dag_key = x.dag_key AND a.b = x.b JOIN cmd_codes k ON k.name = a.name
LEFT JOIN dep_map m ON m.flow = x.flow AND m.b = x.b AND m.action_pos = a.pos"""

ORACLE["dependency_results"] = _barriers() + "," + _DEPS + """
SELECT flow AS correlation_id, b AS batch_index, action_pos, dependency, result_json FROM dep_row
WHERE result_json IS NOT NULL"""

ORACLE["missing_dependencies"] = _barriers() + "," + _DEPS + """
SELECT flow AS correlation_id, b AS batch_index, action_pos, dependency FROM dep_row WHERE result_json IS NULL"""

ORACLE["lifecycle_rows"] = _barriers() + "," + _ENDS + """
SELECT flow AS correlation_id, 'flow.lifecycle' AS message_name, 'engine' AS source, dag_key,
  'INITIAL' AS status, NULL AS error_message, CAST(NULL AS BOOLEAN) AS error_retryable, opened AS lifecycle_seq,
  0 AS emit_pos FROM barrier WHERE b = 0
UNION ALL
SELECT flow, 'flow.lifecycle', 'engine', NULL, upper(state), message,
  CASE WHEN state = 'failed' THEN FALSE END, end_seq, 1 FROM ends"""

ORACLE["catalogue_steps"] = _with(_EV, _DAGS) + """
SELECT d.dag_key, s.n AS initiations, d.b AS batch_index, d.total AS task_total, x.b IS NOT NULL AS has_next,
  x.total AS next_total
FROM dags d JOIN (SELECT dag_key, count(*) AS n FROM ev WHERE is_start GROUP BY dag_key) s ON s.dag_key = d.dag_key
LEFT JOIN dags x ON x.dag_key = d.dag_key AND x.b = d.b + 1"""

ORACLE["initiations_from_notifications"] = """
SELECT o_orderkey AS arrival_seq, CAST(o_orderkey AS VARCHAR) AS correlation_id, '1.0' AS schema_version,
  'EVENT' AS message_type, 'processFlow.initiated' AS message_name, 'intake' AS source,
  o_orderpriority AS dag_key, o_orderstatus AS flow_state
FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 19 <> 0 AND o_orderkey % 17 <> 0
  AND o_orderpriority IS NOT NULL"""

ORACLE["signals_from_notifications"] = _with(_EV, _SIGNALS) + """
SELECT seq AS arrival_seq, flow AS correlation_id, 'SIGNAL' AS message_type, 'task.signal' AS message_name,
  'intake' AS source, txn AS transaction_id,
  CASE WHEN k % 2 = 0 THEN 'TaskFinalAsyncResponseSend' ELSE 'taskfinalasyncresponsesend' END AS external_type,
  CASE WHEN k % 3 <> 0 THEN 'desk' ELSE 'UNKNOWN' END AS reporting_system
FROM reply WHERE txn IS NOT NULL"""

ORACLE["signals_correlated"] = _with(_EV, _SIGNALS) + """,
pick AS (
  SELECT r.txn, r.seq AS reply_seq, r.ts AS reply_ts, w.seq AS waiting_seq, w.ts, w.flow, w.task,
    row_number() OVER (PARTITION BY r.seq ORDER BY w.seq DESC) AS back
  FROM reply r JOIN waiting w ON w.txn = r.txn AND w.seq <= r.seq
)
SELECT txn AS transaction_id, reply_seq, waiting_seq, flow AS correlation_id, task AS task_flow_id
FROM pick WHERE back = 1"""

_KEYS = """
wanted AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS flow, concat(o_orderkey, '-', o_custkey % 7 + 1) AS task FROM orders
)"""

ORACLE["recent_first_lookup"] = _with(_LINES, _KEYS) + """
SELECT t.flow AS correlation_id, t.task AS task_flow_id, t.status, CAST(created_at AS DATE) AS created_date,
  CAST(created_at AS DATE) AS day, CASE WHEN created_at >= DATE '2000-01-01' THEN 'recent' ELSE 'older' END AS phase
FROM wanted w JOIN line_task t ON t.flow = w.flow AND t.task = w.task"""

ORACLE["existing_rows"] = _with(_LINES, _KEYS) + """
SELECT flow AS correlation_id, task AS task_flow_id FROM wanted
WHERE (flow, task) IN (SELECT flow, task FROM line_task)"""

ORACLE["flow_rows"] = _with(_LINES) + """
SELECT flow AS correlation_id, task AS task_flow_id, status, b AS batch_index FROM line_task
WHERE flow IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')"""

ORACLE["retained_rows"] = _with(_EV, _TASKS) + """
SELECT t.flow AS correlation_id, t.task AS task_flow_id, t.action AS action_name, t.b AS batch_index, t.status,
  CAST(e.ts AS DATE) AS created_date
FROM task_row t JOIN ev e ON e.seq = t.first_seq WHERE CAST(e.ts AS DATE) >= DATE '2024-01-30' - INTERVAL 20 DAYS"""

_STORED = """
kept AS (
  SELECT x.*, o.ts AS opened_at, z.ts AS closed_at, CAST(o.ts AS DATE) AS day
  FROM barrier x JOIN ev o ON o.seq = x.opened LEFT JOIN ev z ON z.seq = x.closed
),
asked_for AS (
  SELECT DISTINCT flow, b FROM ev WHERE event_type = 'purchase'
)"""

ORACLE["barrier_table"] = _barriers() + "," + _STORED + """
SELECT flow AS correlation_id, b AS batch_index, dag_key, total AS task_total, CAST(done AS INTEGER) AS task_completed,
  CAST(bad AS INTEGER) AS task_failed, status, opened_at, closed_at, opened_at AS created_at, day AS created_date FROM kept"""

ORACLE["barrier_recent_first"] = _barriers() + "," + _STORED + """
SELECT k.flow AS correlation_id, k.b AS batch_index, status, day AS created_date,
  CASE WHEN day >= DATE '2024-01-20' THEN 'recent' ELSE 'older' END AS phase
FROM kept k JOIN asked_for a ON a.flow = k.flow AND a.b = k.b"""

ORACLE["barrier_exists"] = _barriers() + "," + _STORED + """
SELECT flow AS correlation_id, b AS batch_index, (flow, b) IN (SELECT (flow, b) FROM kept) AS there FROM asked_for"""

ORACLE["flow_barriers"] = _barriers() + "," + _STORED + """
SELECT flow AS correlation_id, b AS batch_index, status, opened AS opened_seq, day AS created_date FROM kept
WHERE flow IN (SELECT flow FROM ev WHERE user_id % 7 = 0)"""

ORACLE["result_characteristics"] = _with(_EV) + """,
attr AS (
  SELECT seq, 0 AS pos, 'type' AS name, event_type AS value FROM raw
  UNION ALL SELECT seq, 1, 'k', CAST(k AS VARCHAR) FROM raw
  UNION ALL SELECT seq, 2, 'note', CASE WHEN value > 10 THEN CAST(CAST(round(value, 0) AS BIGINT) AS VARCHAR) END FROM raw
)
SELECT seq AS arrival_seq, pos, name, value, CASE WHEN value IS NOT NULL THEN 'String' END AS value_type,
  CASE WHEN value IS NULL THEN concat('{"name":"', name, '"}')
       ELSE concat('{"name":"', name, '","value":"', value, '","valueType":"String"}') END AS json
FROM attr"""

ORACLE["dedup_events"] = _with(_EV) + """
SELECT CAST(seq AS VARCHAR) AS event_id, seq AS arrival_seq, flow AS correlation_id, status, k FROM ev"""

# ---- streaming twins ------------------------------------------------------------------------------------------

ORACLE["stream_quarantine"] = ORACLE["quarantine_split"]
ORACLE["stream_task_table"] = ORACLE["task_upsert_events"]
_ON_TIME = """
newest AS (
  SELECT max(ts) FILTER (day(ts) >= 16) AS most FROM ev
),
timed AS (
  SELECT ev.*, day(ts) < 16 AND ts < most - INTERVAL 16 DAYS AS is_late FROM ev, newest
)"""
ORACLE["stream_dedup"] = _with(_EV, _ON_TIME) + """
SELECT CAST(seq AS VARCHAR) AS event_id, flow AS correlation_id, status FROM timed WHERE NOT coalesce(is_late, FALSE)"""
ORACLE["stream_late"] = _with(_EV, _ON_TIME) + """
SELECT CAST(seq AS VARCHAR) AS event_id, flow AS correlation_id, CAST(2 AS BIGINT) AS deliveries FROM timed WHERE is_late"""
ORACLE["stream_signals"] = _with(_EV, _SIGNALS) + """,
pick AS (
  SELECT r.txn, r.seq AS reply_seq, w.seq AS waiting_seq, w.flow, w.task,
    row_number() OVER (PARTITION BY r.seq ORDER BY w.seq DESC NULLS LAST) AS back
  FROM reply r LEFT JOIN waiting w ON w.txn = r.txn AND w.seq <= r.seq AND w.ts <= r.ts WHERE r.txn IS NOT NULL
)
SELECT txn AS transaction_id, reply_seq, waiting_seq, flow AS correlation_id, task AS task_flow_id FROM pick WHERE back = 1"""
ORACLE["stream_barriers"] = ORACLE["barrier_lifecycle"]
ORACLE["stream_commands"] = ORACLE["batch_commands"]
ORACLE["stream_lifecycle"] = ORACLE["lifecycle_rows"]
