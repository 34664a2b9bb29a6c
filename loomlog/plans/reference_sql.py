"""DuckDB twins of the engine's queries, over the same derived log."""

from __future__ import annotations

_LOG = """g AS (SELECT event_id, ts, user_id, event_type, value, props,
  CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) + INTERVAL '12' HOUR
    OR lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, CAST(SUM(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sess FROM g),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, sess ORDER BY event_id) AS rn FROM s),
log AS (SELECT c.event_id + 1 AS position, c.event_id, p.event_id AS parent_id,
  concat('u', c.user_id, '-', c.sess) AS correlation_id, concat('activity:', c.event_type) AS event_type,
  c.props AS payload, c.ts AS created_at, c.value, 'User' AS aggregate_type, c.user_id AS aggregate_id,
  ROW_NUMBER() OVER (PARTITION BY c.user_id ORDER BY c.event_id) AS version,
  CASE WHEN p.event_id IS NULL THEN NULL ELSE concat('on_', p.event_type, '_', c.rn % 2) END AS reactor_id,
  c.event_type <> 'view' AS persistent
  FROM r c LEFT JOIN r p ON p.user_id = c.user_id AND p.sess = c.sess AND c.rn > 1 AND p.rn = CAST(floor(c.rn / 2) AS BIGINT))"""
_EXEC = """executions AS (SELECT c.parent_id AS event_id, c.reactor_id, c.correlation_id, p.created_at AS started_at,
  CASE WHEN c.event_type = 'activity:error' THEN 'error' WHEN c.event_type = 'activity:view' THEN 'running' ELSE 'completed' END AS status,
  CASE WHEN c.event_type = 'activity:view' THEN NULL ELSE c.created_at END AS completed_at,
  CASE WHEN c.event_type = 'activity:error' THEN concat('boom-', c.position % 5) END AS error,
  CAST(c.position % 3 AS INT) AS attempts, c.position, c.event_type AS child_type
  FROM log c JOIN log p ON c.parent_id = p.event_id),
logs AS (SELECT event_id, reactor_id, correlation_id, ['debug', 'info', 'warn'][position % 3 + 1] AS level, child_type AS message, position FROM executions)"""
_STATES = """states AS (SELECT position, event_id, aggregate_type, aggregate_id, version, created_at, correlation_id,
  count(*) OVER w AS n_events, count(*) FILTER (event_type = 'activity:error') OVER w AS n_errors,
  round(CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER w AS DOUBLE), 2) AS total, event_type AS last_type,
  bool_or(event_type = 'activity:purchase') OVER w AS bought
  FROM log WHERE persistent WINDOW w AS (PARTITION BY aggregate_id ORDER BY position ROWS UNBOUNDED PRECEDING))"""
_ORDERS = """o AS (SELECT o_orderkey AS aggregate_id, 0 AS k, 0 AS ln, CAST(0 AS BIGINT) AS pk, CAST(0 AS BIGINT) AS sk,
    o_totalprice AS amt, o_orderdate AS ts, 'order_placed' AS event_type FROM orders
  UNION ALL SELECT l_orderkey, 1, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
    CASE WHEN l_returnflag = 'R' THEN 'line:returned' ELSE 'line:shipped' END FROM lineitem),
ol AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY aggregate_id ORDER BY k, ln, pk, sk, amt, ts, event_type) AS version FROM o),
os AS (SELECT aggregate_id, version, event_type AS status, coalesce(last_value(CASE WHEN event_type = 'order_placed' THEN amt END IGNORE NULLS) OVER w, 0.0) AS total,
  count(*) FILTER (event_type = 'line:returned') OVER w AS returned
  FROM ol WINDOW w AS (PARTITION BY aggregate_id ORDER BY version ROWS UNBOUNDED PRECEDING))"""
_DEPTH = """depth(event_id, root_id, depth) AS (SELECT event_id, event_id, CAST(0 AS BIGINT) FROM log WHERE parent_id IS NULL
  UNION ALL SELECT l.event_id, d.root_id, d.depth + 1 FROM log l JOIN depth d ON l.parent_id = d.event_id)"""
_ROUTES = """routes AS (SELECT * FROM (VALUES ('bill', 1, 0, 3, 0), ('alert', 10, 60, 1, 1), ('enrich', 20, 0, 1, 2), ('audit', 10, 0, 1, 3))
    t(reactor, priority, delay_s, max_attempts, registered)),
routed AS (SELECT l.*, reactor, priority, delay_s, registered, NOT (reactor = 'bill' AND NOT value > 20) AS fired FROM log l JOIN routes ON
  reactor IN ('enrich', 'audit') OR (reactor = 'bill' AND event_type = 'activity:purchase')
  OR (reactor = 'alert' AND event_type IN ('activity:error', 'activity:signup')))"""
_NOW = "(SELECT max(created_at) FROM log)"
_HALF = "(SELECT max(position) // 2 FROM log)"
_SHOWN = "position, event_id, event_type, correlation_id, created_at"
_FINAL = "n_events, n_errors, total, last_type, bought"
_EDGES = "(SELECT p.event_type AS parent_type, c.reactor_id, c.event_type, c.position FROM log c JOIN log p ON c.parent_id = p.event_id WHERE c.reactor_id IS NOT NULL)"


def _q(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((_LOG, *parts))} {body}"


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return (
        f"(SELECT concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', CAST(('0x' || h[17:17])::INT % 4 + 1 AS BIGINT), 1), h[18:20], '-', h[21:32]) FROM (SELECT {h} AS h))"
    )


def _hidden() -> str:
    names = ", ".join(f"'on_{t}_{i}'" for t in ("view", "click", "error", "purchase") for i in (0, 1))
    return f"""SELECT DISTINCT x.* FROM (WITH e AS (SELECT DISTINCT parent_type, reactor_id, event_type FROM {_EDGES}),
      gone AS (SELECT event_type FROM e GROUP BY 1 HAVING bool_and(reactor_id IN ({names}))),
      v AS (SELECT * FROM e WHERE reactor_id NOT IN ({names}) AND parent_type NOT IN (SELECT * FROM gone) AND event_type NOT IN (SELECT * FROM gone))
      SELECT parent_type AS source, reactor_id AS target FROM v UNION SELECT reactor_id, event_type FROM v) x"""


def _flow(where: str = "") -> str:
    e = _EDGES if not where else f"(SELECT * FROM {_EDGES} e WHERE {where})"
    return f"SELECT parent_type AS source, reactor_id AS target FROM {e} UNION SELECT reactor_id, event_type FROM {e}"


_LAST_STATE = "SELECT {cols} FROM states QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY version DESC) = 1"

ORACLES = {
    "load_from_page": _q(f"SELECT {_SHOWN} FROM log WHERE position > 500 ORDER BY position LIMIT 50"),
    "load_stream_after": _q("SELECT position, aggregate_id, version, event_type FROM log WHERE aggregate_id = 8 AND version > 3"),
    "latest_position": _q("SELECT coalesce(max(position), 0) AS position FROM log"),
    "get_event": _q("SELECT position, event_type AS name, '{ k: ' || (payload->>'$.k') || ' }' AS summary, payload FROM log WHERE position = 500"),
    "events_from_seq": _q(f"SELECT {_SHOWN} FROM log WHERE position >= 500 ORDER BY position LIMIT 500"),
    "list_events_page": _q(f"SELECT {_SHOWN} FROM log WHERE position < 900 AND created_at BETWEEN '2024-01-02' AND '2024-02-01' ORDER BY position DESC LIMIT 200"),
    "list_events_search": _q(f"SELECT {_SHOWN} FROM log WHERE contains(lower(event_type), 'purch') OR contains(lower(payload), 'purch') OR contains(correlation_id, 'purch') ORDER BY position DESC LIMIT 100"),
    "event_cache_recent": _q(f"SELECT {_SHOWN} FROM log ORDER BY position DESC LIMIT 300"),
    "search_count": _q("""SELECT event_type, count(*) AS n FROM log WHERE contains(lower(payload), 'k": 7') GROUP BY 1"""),
    "pointer_positions": """SELECT pointer_name, log_partition, arg_max(active, CASE WHEN staged IS NULL THEN struct_pack(u := updated_at, a := active) END) AS active,
        max(updated_at) AS updated_at, count(*) FILTER (staged IS NOT NULL) AS n_staged_runs FROM pointer_status GROUP BY ALL""",
    "append_idempotent": _q(f"SELECT position, event_id, aggregate_id, version FROM log WHERE position > {_HALF}"),
    "append_conflicts": _q(f"SELECT aggregate_id, 'activity:view' AS event_type FROM log GROUP BY aggregate_id HAVING max(position) <= {_HALF}"),
    "append_conflicts_recent": _q("SELECT aggregate_id, 'activity:view' AS event_type FROM log GROUP BY aggregate_id HAVING max(position) <= (SELECT max(position) * 19 // 20 FROM log)"),
    "snapshot_every_10": _q(f"SELECT aggregate_id, version, {_FINAL} FROM states WHERE version % 10 = 0", _STATES),
    "load_snapshot": _q("SELECT aggregate_id, max(version) AS version, arg_max(n_events, version) AS n_events, arg_max(last_type, version) AS last_type FROM states WHERE version % 10 = 0 GROUP BY 1", _STATES),
    "hydrate_default_value": _q(_LAST_STATE.format(cols=f"aggregate_id, {_FINAL}"), _STATES),
    "snapshot_policy": _q("""SELECT aggregate_id, version, n_events, last_type FROM (SELECT *, CASE WHEN version >= 7 AND bool_or(version = 7) OVER (PARTITION BY aggregate_id) THEN 7 ELSE 0 END AS taken FROM states)
        WHERE version > taken AND (version - taken) % 10 = 0""", _STATES),
    "hydrate_from_snapshot": _q(_LAST_STATE.format(cols=f"aggregate_id, {_FINAL}"), _STATES),
    "aggregate_fold_user": _q(_LAST_STATE.format(cols=f"aggregate_id, {_FINAL}"), _STATES),
    "aggregate_fold_user_running": _q(f"SELECT position, aggregate_id, {_FINAL} FROM states", _STATES),
    "aggregate_fold_order": f"WITH {_ORDERS} SELECT * FROM os",
    "aggregate_fold_order_final": f"WITH {_ORDERS} SELECT aggregate_id, status, total, returned FROM os QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY version DESC) = 1",
    "fold_longest_streak": _q("""SELECT u.aggregate_id, CAST(coalesce(max(c), 0) AS INTEGER) AS longest_streak FROM (SELECT DISTINCT aggregate_id FROM log WHERE persistent) u LEFT JOIN
        (SELECT aggregate_id, count(*) AS c FROM (SELECT aggregate_id, event_type, row_number() OVER (PARTITION BY aggregate_id ORDER BY position)
          - row_number() OVER (PARTITION BY aggregate_id, event_type ORDER BY position) AS isl FROM log WHERE persistent)
         WHERE event_type = 'activity:error' GROUP BY aggregate_id, isl) x USING (aggregate_id) GROUP BY 1"""),
    "state_as_of": _q(f"SELECT aggregate_id, {_FINAL} FROM states WHERE created_at <= '2024-01-10' QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY version DESC) = 1", _STATES),
    "transition_guard": _q("""SELECT position, aggregate_id, from_type, n_errors FROM (SELECT *, coalesce(lag(last_type) OVER (PARTITION BY aggregate_id ORDER BY position), 'none') AS from_type FROM states)
        WHERE last_type = 'activity:error' AND from_type <> 'activity:error'""", _STATES),
    "timeline_islands": _q("""SELECT correlation_id, min(position) AS first_position, max(position) AS last_position, count(*) AS n_events,
        arg_min(event_type, position) FILTER (reactor_id IS NULL) AS root_type FROM (SELECT *, sum(new) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS isl FROM
          (SELECT *, CASE WHEN lag(correlation_id) OVER (ORDER BY position) = correlation_id THEN 0 ELSE 1 END AS new FROM log)) GROUP BY correlation_id, isl"""),
    "timeline_previous": _q("""SELECT correlation_id, position, n_events, lag(position) OVER w AS prev_position, lag(n_events) OVER w AS prev_n_events FROM states
        WINDOW w AS (PARTITION BY correlation_id ORDER BY position)""", _STATES),
    "scrubber_steps": _q("SELECT correlation_id, position, lag(position) OVER w AS previous, lead(position) OVER w AS next FROM log WINDOW w AS (PARTITION BY correlation_id ORDER BY position)"),
    "list_correlations": _q("""SELECT correlation_id, count(*) AS event_count, min(created_at) AS first_ts, max(created_at) AS last_ts,
        coalesce(arg_min(event_type, position) FILTER (parent_id IS NULL), '') AS root_event_type,
        correlation_id IN (SELECT correlation_id FROM executions WHERE status = 'error') AS has_errors FROM log GROUP BY correlation_id""", _EXEC),
    "list_correlations_page": _q("""SELECT * FROM (SELECT correlation_id, count(*) AS event_count, min(created_at) AS first_ts, max(created_at) AS last_ts,
        coalesce(arg_min(event_type, position) FILTER (parent_id IS NULL), '') AS root_event_type,
        correlation_id IN (SELECT correlation_id FROM executions WHERE status = 'error') AS has_errors FROM log GROUP BY correlation_id)
        WHERE contains(lower(root_event_type), 'purchase') ORDER BY last_ts DESC, correlation_id LIMIT 50""", _EXEC),
    "reactor_outcomes": _q("""SELECT correlation_id, reactor_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'running') THEN 'running' ELSE 'completed' END AS status,
        coalesce(string_agg(DISTINCT error, '; ' ORDER BY error), '') AS errors, CAST(sum(attempts) AS BIGINT) AS attempts, min(started_at) AS started_at,
        max(completed_at) FILTER (status = 'completed') AS completed_at, count(DISTINCT event_id) AS n_events FROM executions GROUP BY ALL""", _EXEC),
    "reactor_outcome_events": _q("SELECT DISTINCT correlation_id, reactor_id, event_id FROM executions", _EXEC),
    "reactor_outcomes_page": _q("""SELECT reactor_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'running') THEN 'running' ELSE 'completed' END AS status,
        coalesce(string_agg(DISTINCT error, '; ' ORDER BY error), '') AS errors, CAST(sum(attempts) AS BIGINT) AS attempts, min(started_at) AS started_at,
        max(completed_at) FILTER (status = 'completed') AS completed_at, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS event_ids FROM executions
        WHERE correlation_id = 'u8-1' GROUP BY reactor_id""", _EXEC),
    "reactor_dependencies": _q("""SELECT coalesce(i.reactor_id, o.reactor_id) AS reactor_id, coalesce(ins, '') AS input_event_types, coalesce(outs, '') AS output_event_types FROM
        (SELECT x.reactor_id, string_agg(DISTINCT l.event_type, ',' ORDER BY l.event_type) AS ins FROM executions x JOIN log l USING (event_id) GROUP BY 1) i FULL JOIN
        (SELECT reactor_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS outs FROM log WHERE reactor_id IS NOT NULL GROUP BY 1) o ON i.reactor_id = o.reactor_id""", _EXEC),
    "reactor_logs_filtered": _q("SELECT event_id, reactor_id, level, message, position FROM logs WHERE level IN ('info', 'warn') AND (contains(message, 'error') OR contains(reactor_id, 'error'))", _EXEC),
    "reactor_logs_by_correlation": _q("SELECT event_id, reactor_id, level, message, position FROM logs WHERE event_id IN (SELECT event_id FROM log WHERE correlation_id = 'u8-1')", _EXEC),
    "reactor_descriptions": _q("SELECT correlation_id, reactor_id, arg_max('saw ' || child_type, position) AS description FROM executions GROUP BY ALL", _EXEC),
    "reactor_description_snapshots": _q("SELECT correlation_id, reactor_id, event_id, position, 'saw ' || child_type AS description FROM executions WHERE correlation_id = 'u8-1'", _EXEC),
    "aggregate_timeline": _q("SELECT s.position, 'User:' || s.aggregate_id AS aggregate_key, n_events, last_type, coalesce(l.event_type, '') AS event_type FROM states s LEFT JOIN log l USING (event_id)", _STATES),
    "aggregate_lifecycle": _q("SELECT s.position, l.event_type, l.created_at, n_events FROM states s JOIN log l USING (event_id) WHERE s.aggregate_id = 8 ORDER BY s.position LIMIT 100", _STATES),
    "aggregate_keys": _q("SELECT DISTINCT 'User:' || aggregate_id AS aggregate_key FROM log WHERE persistent"),
    "waterfall": _q(f"""SELECT correlation_id, event_id, reactor_id, status, epoch_us(started_at) - epoch_us(t0) AS offset_us, epoch_us(e) - epoch_us(started_at) AS width_us,
        epoch_us(t1) - epoch_us(t0) AS extent_us FROM (SELECT *, min(started_at) OVER w AS t0, max(e) OVER w AS t1 FROM
          (SELECT *, coalesce(completed_at, {_NOW}) AS e FROM executions) WINDOW w AS (PARTITION BY correlation_id))""", _EXEC),
    "observability_stream": _q("""SELECT 'event_dispatched' AS stream_type, correlation_id, event_id, CAST(NULL AS VARCHAR) AS reactor_id, created_at AS at FROM log
        UNION ALL SELECT 'effect_started', correlation_id, event_id, reactor_id, started_at FROM executions
        UNION ALL SELECT CASE status WHEN 'error' THEN 'effect_failed' ELSE 'effect_completed' END, correlation_id, event_id, reactor_id, completed_at FROM executions WHERE status <> 'running'""", _EXEC),
    "display_projection": _q("SELECT position, event_type AS name, '{ k: ' || (payload->>'$.k') || ' }' AS summary, reactor_id FROM log"),
    "lineage_tree": _q("""SELECT position, event_id, parent_id, (SELECT min(position) FROM log WHERE parent_id IS NULL AND correlation_id = (SELECT correlation_id FROM log WHERE position = 500)) AS root_position
        FROM log WHERE correlation_id = (SELECT correlation_id FROM log WHERE position = 500)"""),
    "lineage_flow": _q("SELECT position, event_id, parent_id, event_type FROM log WHERE correlation_id = 'u8-1'"),
    "tree_roots": _q("SELECT position, event_id, correlation_id FROM log WHERE parent_id IS NULL OR parent_id NOT IN (SELECT event_id FROM log)"),
    "tree_edges": _q("SELECT c.event_id, c.parent_id, p.position AS parent_position, p.event_type AS parent_type, c.reactor_id FROM log c JOIN log p ON c.parent_id = p.event_id"),
    "lineage_depth": _q("SELECT * FROM depth", _DEPTH, recursive=True),
    "subtree": _q("""SELECT event_id, parent_id, CAST(depth AS INTEGER) AS level FROM depth JOIN log USING (event_id)
        WHERE correlation_id = (SELECT correlation_id FROM log GROUP BY 1 ORDER BY count(*) DESC, min(position) LIMIT 1)""", _DEPTH, recursive=True),
    "children_by_reactor": _q("SELECT parent_id, coalesce(reactor_id, '') AS reactor_id, count(*) AS n_children, min(position) AS first_position FROM log WHERE parent_id IS NOT NULL GROUP BY ALL"),
    "critical_path": _q("""SELECT l.correlation_id, l.event_id AS leaf_id, d.depth AS hops, epoch_us(l.created_at) - epoch_us(r.created_at) AS span_us
        FROM depth d JOIN log l USING (event_id) JOIN log r ON r.event_id = d.root_id
        QUALIFY row_number() OVER (PARTITION BY l.correlation_id ORDER BY epoch_us(l.created_at) - epoch_us(r.created_at) DESC, l.position) = 1""", _DEPTH, recursive=True),
    "flow_nodes": _q("""SELECT 'event' AS kind, event_type AS node, count(*) AS n FROM log GROUP BY 2 UNION ALL
        SELECT 'reactor', node, coalesce(n, 0) FROM (SELECT DISTINCT reactor_id AS node FROM executions) LEFT JOIN (SELECT reactor_id AS node, count(*) AS n FROM log GROUP BY 1) USING (node)""", _EXEC),
    "flow_edges": _q(_flow()),
    "flow_edges_hidden": _q(_hidden()),
    "visible_at_seq": _q(_flow(f"position <= {_HALF}")),
    "route_reactors": _q("SELECT event_id, reactor, priority, fired FROM routed", _ROUTES),
    "dequeue_order": _q(f"""SELECT event_id, reactor AS reactor_id, priority, created_at + to_seconds(delay_s) AS execute_at,
        row_number() OVER (PARTITION BY correlation_id ORDER BY priority, position, registered) AS nth FROM routed WHERE created_at + to_seconds(delay_s) <= {_NOW}""", _ROUTES),
    "earliest_pending": _q("SELECT reactor AS reactor_id, min(created_at + to_seconds(delay_s)) AS earliest_at FROM routed GROUP BY 1", _ROUTES),
    "projections_by_priority": "SELECT * FROM (VALUES ('bill', 1, CAST(1 AS BIGINT)), ('enrich', 20, 2), ('alert', NULL, 3), ('audit', NULL, 4)) t(reactor, priority, nth)",
    "extract_values": _q("SELECT event_id, CAST(payload->>'$.k' AS BIGINT) AS k FROM log WHERE CAST(payload->>'$.k' AS BIGINT) > 50"),
    "extract_fields": """SELECT seq, event_type, CASE WHEN event_type = 'claim:settled' THEN TRY_CAST(payload->>'$.claim_no' AS BIGINT) END AS claim_no, TRY_CAST(payload->>'$.amount' AS DOUBLE) AS amount
        FROM (SELECT seq, event_type, CASE WHEN json_valid(payload) THEN payload END AS payload FROM stored_events) WHERE event_type IN ('claim:settled', 'refund:paid')""",
    "ephemeral_gate": _q("SELECT event_type, count(*) AS n_routed, count(*) FILTER (persistent) AS n_folded FROM log GROUP BY ALL"),
    "attempt_gate": """SELECT CASE WHEN coalesce(attempts, 0) <= 3 THEN 'process' ELSE 'park' END AS outcome, attempts, count(*) AS n
        FROM (SELECT DISTINCT ON (outcome_no) * FROM reactor_outcomes) GROUP BY ALL""",
    "hop_gate": _q("SELECT CASE WHEN depth < 3 THEN 'run' ELSE 'park' END AS outcome, depth AS hops, count(*) AS n FROM depth GROUP BY ALL", _DEPTH, recursive=True),
    "cancel_gate": _q(f"""SELECT event_id, correlation_id FROM log WHERE correlation_id NOT IN (SELECT correlation_id FROM log
        WHERE event_type = 'activity:error' AND parent_id IS NULL AND created_at >= {_NOW} - INTERVAL 3 DAY)"""),
    "cancelled_executions": _q(f"""SELECT event_id, reactor_id, 'cancelled' AS reason FROM executions WHERE correlation_id IN (SELECT correlation_id FROM log
        WHERE event_type = 'activity:error' AND parent_id IS NULL AND created_at >= {_NOW} - INTERVAL 3 DAY)""", _EXEC),
    "emitted_event_ids": _q(f"""SELECT {_uuid5("concat(event_id, '-', reactor_id, '-child-', i)")} AS event_id, CAST(event_id AS VARCHAR) AS parent_id, 'n' || i AS payload, CAST(3 AS BIGINT) AS hops,
        reactor_id AS by_reactor FROM (SELECT *, unnest(range(attempts + 1)) AS i FROM executions)""", _EXEC),
    "idempotency_keys": _q(f"""SELECT event_id, reactor_id, {_uuid5("concat(event_id, '-', reactor_id)")} AS idempotency_key FROM executions""", _EXEC),
    "settle_generations": _q("""SELECT CAST(g AS BIGINT) AS hops, CAST(k - g AS VARCHAR) AS left_over, count(*) AS n FROM (SELECT event_id % 4 AS k FROM log WHERE event_type = 'activity:purchase') x, range(4) t(g)
        WHERE g <= k GROUP BY ALL"""),
    "retry_schedule": _q("""SELECT event_id, reactor_id, CAST(a AS INTEGER) AS attempt, CAST([0, 10, 10, 20][a + 1] AS BIGINT) AS wait_s, CAST([0, 10, 20, 40][a + 1] AS BIGINT) AS offset_s,
        started_at + to_seconds([0, 10, 20, 40][a + 1]) AS run_at, a = 3 AS dead_after FROM executions, range(4) t(a) WHERE status = 'error'""", _EXEC),
    "timed_out": _q(f"SELECT event_id, reactor_id, status, position FROM executions WHERE coalesce(completed_at, {_NOW}) - started_at > INTERVAL 900 SECOND", _EXEC),
    "dlq_terminal_events": _q(f"""SELECT {_uuid5("concat(event_id, '-', reactor_id, '-dlq')")} AS event_id, event_id AS parent_id,
        CASE WHEN reactor_id = 'on_click_0' THEN 'click_failed' ELSE 'reactor_dlq' END AS event_type, reactor_id, error, CAST(attempts + 1 AS BIGINT) AS attempts, 'failed' AS reason
        FROM executions WHERE status = 'error'""", _EXEC),
    "dlq_by_error": _q("SELECT error, count(*) AS n FROM executions WHERE status = 'error' GROUP BY 1", _EXEC),
    "dlq_by_reason": _q("SELECT 'failed' AS reason, reactor_id, count(*) AS n, count(DISTINCT correlation_id) AS workflows FROM executions WHERE status = 'error' GROUP BY ALL", _EXEC),
    "dlq_requeue": _q("SELECT event_id AS parent_id, reactor_id, CAST(0 AS BIGINT) AS attempts, 'pending' AS status FROM executions WHERE error = 'boom-3'", _EXEC),
    "resolve_last_status": _q("SELECT event_id, reactor_id, arg_max(status, position) AS status FROM executions GROUP BY ALL", _EXEC),
    "journal_replay": _q("""SELECT event_id, reactor_id, seq, entry FROM (SELECT event_id, reactor_id, row_number() OVER (PARTITION BY event_id, reactor_id ORDER BY position) AS seq, child_type AS entry FROM executions) j
        WHERE NOT EXISTS (SELECT 1 FROM executions x WHERE x.event_id = j.event_id AND x.reactor_id = j.reactor_id AND x.status = 'completed')""", _EXEC),
    "same_batch_join": """WITH l AS (SELECT l_orderkey AS batch_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_partkey, l_linestatus FROM lineitem)
        SELECT batch_id, count(*) AS batch_size, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY i) AS parts FROM l GROUP BY 1 HAVING bool_and(l_linestatus = 'F')""",
    "journal_cleared": _q("""SELECT reactor_id, count(*) AS n FROM executions j WHERE NOT EXISTS (SELECT 1 FROM executions x WHERE x.event_id = j.event_id AND x.reactor_id = j.reactor_id AND x.status = 'completed')
        AND (SELECT arg_max(status, position) FROM executions x WHERE x.event_id = j.event_id AND x.reactor_id = j.reactor_id AND x.status IN ('completed', 'error')) IS DISTINCT FROM 'error' GROUP BY 1""", _EXEC),
    "convergence_gate": _q("""SELECT correlation_id, max(first_at) AS opened_at FROM (SELECT correlation_id, event_type, min(position) AS first_at FROM log
        WHERE event_type IN ('activity:view', 'activity:click', 'activity:purchase') GROUP BY ALL) GROUP BY 1 HAVING count(*) = 3"""),
    "wait_terminal": _q("""SELECT l.correlation_id, first_at AS terminal_position, first_type AS terminal_type, count(*) FILTER (position < first_at) AS events_before FROM log l JOIN
        (SELECT correlation_id, min(position) AS first_at, arg_min(event_type, position) AS first_type FROM log WHERE event_type IN ('activity:purchase', 'activity:error') GROUP BY 1) USING (correlation_id) GROUP BY ALL"""),
    "batch_demultiplex": _q("""SELECT event_id, aggregate_id AS user_id, CASE WHEN aggregate_id % 2 = 0 THEN count(*) OVER (PARTITION BY aggregate_id) END AS answer,
        CASE WHEN aggregate_id % 2 <> 0 THEN 'missing result for ' || aggregate_id END AS error FROM log"""),
    "describe_all": _q("""SELECT event_id, 'bill' AS reactor_id, 'events: ' || n_events AS description FROM states UNION ALL SELECT event_id, 'alert', 'errors: ' || n_errors FROM states""", _STATES),
    "concat_logs": _q("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM log UNION ALL SELECT event_type FROM stored_events) GROUP BY 1"),
    "type_names": _q("""SELECT DISTINCT event_type, split_part(event_type, ':', 1) AS prefix, split_part(event_type, ':', 2) AS short_name,
        upper(split_part(event_type, ':', 2)[1:1]) || split_part(event_type, ':', 2)[2:] AS title FROM log"""),
    "durable_names": """WITH n AS (SELECT DISTINCT lower(c_mktsegment) AS w FROM customer), m AS (SELECT w, upper(w[1:1]) || w[2:] AS t FROM n)
        SELECT 'Http' || t || 'DoneV' AS name, 'http_' || w || '_done_v' AS snake, 'http' || t || 'DoneV' AS camel, 'Http' || t || 'DoneV' AS pascal,
          'HTTP_' || upper(w) || '_DONE_V' AS screaming, 'http-' || w || '-done-v' AS kebab FROM m""",
    "captured_states": _q("""SELECT position, 'User:' || aggregate_id AS aggregate_key, '{"n_events":' || n_events || ',"n_errors":' || n_errors || ',"last_type":"' || last_type || '"}' AS state FROM states""", _STATES),
    "display_labels": _q("""SELECT position, CASE WHEN position % 101 / 100 > 0.6 THEN 'positive' WHEN position % 101 / 100 < 0.4 THEN 'negative' ELSE 'neutral' END || ' (' || printf('%.2f', position % 101 / 100) || ')' AS label,
        printf('%.0f', (1 - position % 101 / 100) * 100) || '% original' AS percent, payload[1:5] || CASE WHEN length(payload) > 5 THEN '…' ELSE '' END AS cut FROM log"""),
    "state_at_ephemeral": _q("""SELECT position, aggregate_id, n_events, last_type FROM (SELECT l.position, l.aggregate_id, s.n_events, s.last_type FROM log l ASOF LEFT JOIN states s
        ON l.aggregate_id = s.aggregate_id AND l.position >= s.position WHERE NOT l.persistent)""", _STATES),
    "duration_labels": _q("""SELECT position, ms, CASE WHEN ms < 1 THEN '<1ms' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', (ms + 50) // 100 / 10) ELSE printf('%.1fm', (ms + 3000) // 6000 / 10) END AS bar,
        CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', (ms + 50) // 100 / 10) WHEN floor(ms / 1000 % 60 + 0.5) > 0
          THEN concat(ms // 60000, 'm ', CAST(floor((ms / 1000) % 60 + 0.5) AS BIGINT), 's') ELSE concat(ms // 60000, 'm') END AS node,
        CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', (ms + 50) // 100 / 10) WHEN ms < 3600000 THEN printf('%.1fm', (ms + 3000) // 6000 / 10) ELSE printf('%.1fh', (ms + 180000) // 360000 / 10) END AS range FROM (SELECT position, (epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS ms
        FROM executions WHERE completed_at IS NOT NULL)""", _EXEC),
    "progress_fraction": _q("SELECT correlation_id, round(count(*) FILTER (status = 'completed') / count(*), 6) AS fraction FROM executions GROUP BY 1", _EXEC),
    "state_json_diff": _q("""SELECT position, array_to_string(list_filter([
          CASE WHEN bought AND pb IS NULL THEN '+bought' WHEN bought AND NOT pb THEN '+bought' END,
          CASE WHEN pt IS NULL THEN '+last_type' WHEN pt <> last_type THEN '~last_type' END,
          CASE WHEN pt IS NULL THEN '+n_errors' WHEN pe <> n_errors THEN '~n_errors' END], lambda x: x IS NOT NULL), ',') AS diff
        FROM (SELECT *, lag(bought) OVER w AS pb, lag(last_type) OVER w AS pt, lag(n_errors) OVER w AS pe FROM states WINDOW w AS (PARTITION BY aggregate_id ORDER BY position))""", _STATES),
    "pending_depth": _q("SELECT count(*) FILTER (status = 'running') AS pending FROM executions", _EXEC),
    "failure_rate": _q(f"""SELECT round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, count(*) AS ended FROM executions
        WHERE completed_at > {_NOW} - INTERVAL 1 DAY""", _EXEC),
    "active_workflows": _q(f"SELECT count(DISTINCT correlation_id) AS active FROM log WHERE created_at > {_NOW} - INTERVAL 1 DAY"),
    "latency_percentiles": _q("""SELECT reactor_id, round(quantile_cont(us, 0.5), 3) AS p50, round(quantile_cont(us, 0.95), 3) AS p95, round(quantile_cont(us, 0.99), 3) AS p99 FROM
        (SELECT reactor_id, CAST(epoch_us(completed_at) - epoch_us(started_at) AS DOUBLE) AS us FROM executions WHERE completed_at IS NOT NULL) GROUP BY 1""", _EXEC),
    "payload_size_alert": "SELECT seq AS event_id, event_type, length(payload) AS size FROM stored_events WHERE length(payload) > 400",
    "stale_executions": _q(f"SELECT event_id, reactor_id, position FROM executions WHERE status = 'running' AND started_at < {_NOW} - INTERVAL 3 MINUTE", _EXEC),
    "queue_status": _q("SELECT correlation_id, count(*) FILTER (status = 'running') AS pending, count(*) FILTER (status = 'error') AS dead_lettered FROM executions GROUP BY 1", _EXEC),
    "retention_archive": _q("""SELECT side, event_type, count(*) AS n, any_value(n_side) AS n_side FROM (SELECT *, count(*) OVER (PARTITION BY side) AS n_side FROM
        (SELECT CASE WHEN created_at < '2024-01-15' THEN 'archive' ELSE 'keep' END AS side, event_type FROM log)) GROUP BY side, event_type"""),
}

from loomlog.plans.data_problems_sql import _id  # noqa: E402

ORACLES["stored_correlations"] = f"SELECT * FROM (SELECT {_id('correlation_id')} AS correlation_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM stored_events GROUP BY 1) WHERE correlation_id IS NOT NULL"

ORACLES["typed_events"] = """SELECT CASE WHEN json_valid(payload) THEN payload->>'$.handler' END AS handler, count(*) AS n,
    max(CASE WHEN json_valid(payload) AND json_type(payload, '$.claim_no') IN ('UBIGINT', 'BIGINT') THEN CAST(payload->>'$.claim_no' AS BIGINT) END) AS max_claim FROM stored_events WHERE event_type = 'claim:settled' GROUP BY 1"""
ORACLES["aggregate_fold_user_split"] = ORACLES["aggregate_fold_user_running"]

_COMMITS = "WITH c AS (SELECT DISTINCT ON (event_id) * FROM intent_commits), i AS (SELECT event_id, unnest(intents) AS i FROM c)"
_MOVED = _COMMITS + """, q AS (SELECT event_id, i.reactor_id AS reactor_id, i.execute_at AS execute_at, greatest(coalesce(i.timeout_seconds, 900), 1) AS timeout_seconds,
      coalesce(i.max_attempts, 1) AS max_attempts, coalesce(i.priority, 10) AS priority, coalesce(i.hops, 0) AS hops FROM i WHERE i IS NOT NULL),
    m AS (SELECT DISTINCT ON (event_id, reactor_id) *, CASE WHEN priority = 1 THEN 'complete' WHEN max_attempts = 5 AND hops > 5 THEN 'dead_letter' WHEN max_attempts = 5 THEN 'retry' ELSE 'pending' END AS status FROM q)"""
_OBJECT = "CASE WHEN json_valid(reactor_descriptions) AND json_type(reactor_descriptions) = 'OBJECT' THEN reactor_descriptions END"
ORACLES |= {
    "commit_intents": f"""{_COMMITS} SELECT i.reactor_id AS reactor_id, coalesce(i.priority, 10) AS priority, count(*) AS n, min(i.execute_at) AS earliest_at,
        max(coalesce(i.hops, 0)) AS max_hops, max(greatest(coalesce(i.timeout_seconds, 900), 1)) AS longest_timeout FROM i WHERE i IS NOT NULL GROUP BY ALL""",
    "commit_descriptions": f"""{_COMMITS} SELECT correlation_id, reactor_id, checkpoint AS at, description FROM
        (SELECT correlation_id, checkpoint, k AS reactor_id, reactor_descriptions->>('$."' || k || '"') AS description FROM (SELECT *, unnest(json_keys({_OBJECT})) AS k FROM c))
        QUALIFY row_number() OVER (PARTITION BY correlation_id, reactor_id ORDER BY checkpoint DESC NULLS LAST, description DESC NULLS LAST) = 1""",
    "queue_statuses": f"{_MOVED} SELECT reactor_id, status, count(*) AS n, max(CASE WHEN status = 'pending' THEN 0 ELSE max_attempts END) AS most_attempts FROM m GROUP BY ALL",
    "queue_pending": f"""{_MOVED} SELECT reactor_id, count(*) FILTER (status IN ('pending', 'retry')) AS n_pending, min(execute_at) FILTER (status IN ('pending', 'retry')) AS earliest_at,
        count(*) FILTER (status = 'dead_letter') AS n_dead FROM m GROUP BY ALL HAVING n_pending + n_dead > 0""",
    "queue_reclaim": f"""{_MOVED} SELECT event_id, reactor_id, execute_at FROM m WHERE status IN ('pending', 'retry') AND execute_at + to_seconds(timeout_seconds) < (SELECT max(execute_at) FROM m)""",
    "commit_parked": f"{_COMMITS} SELECT coalesce(park_reason, 'none') AS park_reason, count(*) AS n FROM c GROUP BY 1",
    "commit_projection_failures": f"{_COMMITS} SELECT split_part(f, ':', 1) AS projection, count(*) AS n FROM (SELECT unnest(projection_failures) AS f FROM c) GROUP BY 1",
    "commit_checkpoint": "SELECT coalesce(max(checkpoint), 0) AS checkpoint FROM intent_commits",
    "stateful_filter": _q("SELECT event_id, correlation_id, n_errors FROM states WHERE last_type = 'activity:purchase' AND n_errors >= 3", _STATES),
    "flow_selection": _q("SELECT position, event_id, event_type FROM log WHERE reactor_id = 'on_error_1'"),
    "stored_outcomes": """SELECT reactor_id, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (status = 'error') AS n_errors, min(started_at) AS first_start,
        max(completed_at) FILTER (status = 'completed') AS last_end FROM (SELECT DISTINCT ON (outcome_no) * FROM reactor_outcomes) GROUP BY 1""",
}

from loomlog.plans.data_problems_sql import _WALK  # noqa: E402

ORACLES["hop_gate_stored"] = f"""{_WALK} SELECT CASE WHEN depth < 50 THEN 'run' ELSE 'park' END AS outcome, count(*) AS n, CAST(max(depth) AS BIGINT) AS most_hops FROM every WHERE depth >= 0 GROUP BY 1"""


def _after(field: str, *rules: tuple[str, int, str]) -> str:
    """A field's text after the declared steps: rules of (prefix, last version the step applies to, text then)."""
    cases = " ".join(f"WHEN prefix = '{p}' AND v <= {v} THEN {x}" for p, v, x in rules)
    return f"CASE {cases} ELSE doc->>'$.{field}' END" if rules else f"doc->>'$.{field}'"


def _moved(old: str, new: str) -> str:
    """Of a renamed field the old one's text, where it has one or is null there, else what the new name had."""
    return f"CASE WHEN json_exists(doc, '$.{old}') THEN doc->>'$.{old}' ELSE doc->>'$.{new}' END"


_FIELDS = {
    "channel": _after("channel", ("order", 0, "NULL"), ("badge", 0, "NULL"), ("meter", 0, "NULL")),
    "meta_channel": _after("meta.channel", ("badge", 0, _moved("channel", "meta.channel")), ("meter", 0, _moved("channel", "meta.channel"))),
    "temp": _after("temp", ("claim", 3, "NULL"), ("crawl", 3, "NULL")),
    "temperature": _after("temperature", ("claim", 3, _moved("temp", "temperature"))),
    "batch": _after("batchNo", ("parcel", 2, "NULL"), ("survey", 2, "NULL")),
    "batch_no": _after("batch_no", ("survey", 2, _moved("batchNo", "batch_no"))),
    "tags": _after("tags", ("claim", 1, "NULL"), ("survey", 3, "NULL"), ("notice", 0, "NULL")),
    "labels": _after("labels", ("survey", 3, _moved("tags", "labels")), ("notice", 0, _moved("tags", "labels")), ("refund", 3, "NULL")),
    "enabled": _after("enabled", ("crawl", 0, "NULL"), ("refund", 0, "NULL")),
    "remark": _after("remark", ("notice", 1, "NULL")),
    "score": _after("score", ("meter", 2, "NULL")),
}
ORACLES["upcast_chain"] = f"""SELECT event_type, count(*) AS n, {', '.join(f"count({x}) AS {n}" for n, x in _FIELDS.items())} FROM (SELECT event_type, split_part(event_type, ':', 1) AS prefix,
  coalesce(schema_version, 0) AS v, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS doc FROM archive_lines) GROUP BY 1"""
