"""DuckDB twins of the p1..p6 queries that SQL can express on whole tables."""

from __future__ import annotations


def _id(c: str) -> str:
    """The canonical text of a spelled id, null for none."""
    t = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    h = f"regexp_replace(translate(lower({t}), '{{}}()-', ''), '^urn:uuid:', '')"
    dashed = f"concat_ws('-', {h}[1:8], {h}[9:12], {h}[13:16], {h}[17:20], {h}[21:32])"
    return (
        f"(CASE WHEN {c} IS NULL OR {t} = '' OR {h} = repeat('0', 32) THEN NULL "
        f"WHEN regexp_full_match({h}, '[0-9a-f]{{32}}') THEN {dashed} ELSE {t} END)"
    )


_FIRST = f"""keyed AS (SELECT *, {_id('id')} AS k, {_id('parent_id')} AS pk FROM stored_events),
first AS (SELECT k, min(seq) AS seq, arg_min(struct_pack(t := ts), seq).t AS ts, arg_min(struct_pack(p := pk), seq).p AS pk
  FROM keyed WHERE k IS NOT NULL GROUP BY k)"""

_WALK = f"""WITH RECURSIVE {_FIRST},
edge AS (SELECT c.k AS id, p.k AS up FROM first c JOIN first p ON c.pk = p.k),
anc(id, a) AS (SELECT id, up FROM edge UNION SELECT anc.id, edge.up FROM anc JOIN edge ON anc.a = edge.id),
onloop AS (SELECT id FROM anc WHERE id = a),
looped AS (SELECT id, min(a) AS top_id FROM anc WHERE a IN (SELECT id FROM onloop) GROUP BY id),
roots AS (SELECT k AS id FROM first WHERE k NOT IN (SELECT id FROM edge)),
rooted AS (SELECT anc.id, max(CASE WHEN a IN (SELECT id FROM roots) THEN a END) AS top_id, count(*) AS depth
  FROM anc WHERE anc.id NOT IN (SELECT id FROM looped) GROUP BY anc.id),
every AS (SELECT id, id AS top_id, 0 AS depth FROM roots UNION ALL SELECT id, top_id, depth FROM rooted
  UNION ALL SELECT id, top_id, -1 FROM looped)"""

_KEYS = f"""rows AS (SELECT 'correlation_id' AS field, {_id('correlation_id')} AS key_value, seq, epoch_us(ts) AS us FROM stored_events
  UNION ALL SELECT 'reactor_id', reactor_id, seq, epoch_us(ts) FROM stored_events)"""

_ORPHANS = f"""WITH {_FIRST},
refs AS (SELECT 'stored_events' AS ref_table, seq AS holder, ts AS t, pk AS ref_id FROM first
  UNION ALL SELECT 'stored_events', seq, ts, pk FROM keyed WHERE k IS NULL
  UNION ALL SELECT 'reactor_outcomes', outcome_no, started_at, {_id('u')} FROM (SELECT outcome_no, started_at, unnest(triggering_event_ids) AS u FROM reactor_outcomes)),
dead AS (SELECT DISTINCT {_id('event_id')} AS k FROM event_tombstones),
states AS (SELECT DISTINCT ref_table, coalesce(strftime(t, '%Y-%m'), 'none') AS period, holder, ref_id,
  CASE WHEN f.k IS NULL THEN CASE WHEN d.k IS NULL THEN 'missing' ELSE 'deleted' END WHEN f.ts > r.t THEN 'late' END AS state
  FROM refs r LEFT JOIN first f ON f.k = r.ref_id LEFT JOIN dead d ON d.k = r.ref_id WHERE r.ref_id IS NOT NULL)"""

ORACLES = {
    "p1_found": f"{_WALK} SELECT id, top_id, CAST(depth AS BIGINT) AS depth FROM every WHERE depth >= 25 OR depth = -1",
    "p1_trees": f"{_WALK} SELECT top_id, count(*) AS n_events, CAST(max(depth) AS BIGINT) AS max_depth FROM every GROUP BY top_id",
    "p1_paths": f"""{_WALK}, paths(id, path) AS (SELECT id, id FROM roots UNION ALL SELECT edge.id, path || '/' || edge.id FROM paths JOIN edge ON edge.up = paths.id)
        SELECT every.id, top_id, CAST(depth AS BIGINT) AS depth, path FROM every LEFT JOIN paths ON paths.id = every.id AND depth >= 0""",
    "p1_descendants": f"""{_WALK} SELECT a AS id, anc.id AS descendant_id, CAST(below.depth - above.depth AS BIGINT) AS distance
        FROM anc JOIN every below ON below.id = anc.id JOIN every above ON above.id = anc.a WHERE below.depth >= 0""",
    "p2_found": f"""WITH {_KEYS} SELECT field, key_value FROM rows WHERE key_value IS NOT NULL GROUP BY ALL
        HAVING count(*) * 20 >= (SELECT count(*) FROM stored_events)""",
    "p2_profiles": f"""WITH {_KEYS}, steps AS (SELECT *, us - lag(us) OVER (PARTITION BY field, key_value ORDER BY seq) AS step
          FROM rows WHERE key_value IS NOT NULL),
        outs AS (SELECT DISTINCT ON (outcome_no) * FROM reactor_outcomes),
        o AS (SELECT 'correlation_id' AS field, {_id('correlation_id')} AS key_value, status FROM outs UNION ALL SELECT 'reactor_id', reactor_id, status FROM outs),
        oc AS (SELECT field, key_value, count(*) AS n, count(*) FILTER (status = 'error') AS e FROM o GROUP BY ALL)
        SELECT s.field, s.key_value, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, greatest(coalesce(max(step), 0), 0) AS longest_pause_us,
          coalesce(any_value(oc.n), 0) AS n_outcomes, coalesce(any_value(oc.e), 0) AS n_errors
        FROM steps s LEFT JOIN oc USING (field, key_value) GROUP BY s.field, s.key_value""",
    "p4_found": f"{_ORPHANS} SELECT * FROM states WHERE state IS NOT NULL",
    "p4_report": f"{_ORPHANS} SELECT ref_table, period, state, count(*) AS n_references FROM states WHERE state IS NOT NULL GROUP BY ALL",
    "p5_found": f"""WITH pos AS (SELECT DISTINCT ON (pointer_name, log_partition) pointer_name, log_partition, active, updated_at
          FROM pointer_status WHERE staged IS NULL ORDER BY pointer_name, log_partition, updated_at DESC, active DESC),
        e AS (SELECT *, {_id('id')} AS k FROM stored_events),
        c AS (SELECT *, row_number() OVER (PARTITION BY k, payload ORDER BY seq) AS nth FROM e)
        SELECT pointer_name, seq FROM c JOIN pos USING (log_partition)
        WHERE (seq > active OR ingested_at > updated_at) AND (k IS NULL OR nth = 1)""",
}

_NEW = "(seq > active OR ingested_at > since) AND seq <= upto AND (ingested_at IS NULL OR horizon IS NULL OR ingested_at <= horizon) AND (k IS NULL OR nth = 1)"
ORACLES["p5_runs"] = f"""WITH pos AS (SELECT DISTINCT ON (pointer_name, log_partition) pointer_name, log_partition, active, updated_at AS since
      FROM pointer_status WHERE staged IS NULL ORDER BY pointer_name, log_partition, updated_at DESC, active DESC),
    e AS (SELECT *, {_id('id')} AS k FROM stored_events), c AS (SELECT *, row_number() OVER (PARTITION BY k, payload ORDER BY seq) AS nth FROM e),
    half AS (SELECT (min(epoch_us(ingested_at)) + max(epoch_us(ingested_at))) // 2 AS us FROM e),
    reach0 AS (SELECT log_partition, max(seq) AS upto, max(ingested_at) AS horizon FROM e, half WHERE ingested_at IS NULL OR epoch_us(ingested_at) <= us GROUP BY 1),
    reach1 AS (SELECT log_partition, max(seq) AS upto, max(ingested_at) AS horizon FROM e GROUP BY 1),
    plan0 AS (SELECT * FROM pos JOIN reach0 USING (log_partition)),
    moved AS (SELECT pointer_name, log_partition, active, since FROM pos UNION ALL SELECT pointer_name, log_partition, greatest(active, upto), coalesce(horizon, since) FROM plan0),
    plan1 AS (SELECT * FROM (SELECT DISTINCT ON (pointer_name, log_partition) * FROM moved ORDER BY pointer_name, log_partition, since DESC, active DESC) JOIN reach1 USING (log_partition))
    SELECT pointer_name, seq FROM c JOIN plan0 USING (log_partition) WHERE {_NEW} UNION SELECT pointer_name, seq FROM c JOIN plan1 USING (log_partition) WHERE {_NEW}"""

_LEAVES = """WITH valid AS (SELECT producer, event_type, CAST(segment_no AS BIGINT) AS segment_no, line_no,
    CASE WHEN json_valid(payload) THEN CASE json_type(payload) WHEN 'OBJECT' THEN payload
      WHEN 'VARCHAR' THEN CASE WHEN json_valid(payload->>'$') AND json_type(payload->>'$') = 'OBJECT' THEN payload->>'$' END END END AS doc FROM archive_lines
    WHERE producer IS NOT NULL AND event_type IS NOT NULL AND segment_no IS NOT NULL),
docs AS (SELECT DISTINCT producer, event_type, segment_no, doc FROM valid WHERE doc IS NOT NULL),
tree AS (SELECT d.producer, d.event_type, d.segment_no, substr(t.fullkey, 3) AS path, t.type, t.value FROM docs d, json_tree(d.doc) t WHERE t.type <> 'OBJECT'),
leaf AS (SELECT DISTINCT * FROM tree WHERE NOT contains(path, '[')),
atom AS (SELECT DISTINCT producer, event_type, segment_no, regexp_replace(path, '\\[.*$', '') AS path, value->>'$' AS atom FROM tree WHERE type NOT IN ('ARRAY', 'NULL')),
segs AS (SELECT *, lag(segment_no) OVER w AS prev FROM (SELECT DISTINCT producer, event_type, segment_no FROM docs) WINDOW w AS (PARTITION BY producer, event_type ORDER BY segment_no)),
fields AS (SELECT producer, event_type, segment_no, path, list_sort(list(DISTINCT CASE type WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string'
    WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END) FILTER (type <> 'NULL')) AS types FROM leaf GROUP BY ALL),
now AS (SELECT f.*, s.prev FROM fields f JOIN segs s USING (producer, event_type, segment_no) WHERE s.prev IS NOT NULL),
old AS (SELECT f.producer, f.event_type, s.segment_no, f.path, f.types, s.prev FROM fields f JOIN segs s ON f.producer = s.producer AND f.event_type = s.event_type AND f.segment_no = s.prev),
d AS (SELECT producer, event_type, segment_no, path, coalesce(n.prev, o.prev) AS prev,
    CASE WHEN o.types IS NULL AND o.prev IS NULL THEN 'added' WHEN n.prev IS NULL THEN 'removed' WHEN len(coalesce(n.types, [])) > 0 AND len(coalesce(o.types, [])) > 0 AND n.types <> o.types THEN 'retyped' END AS change
  FROM now n FULL JOIN old o USING (producer, event_type, segment_no, path)),
pairs AS (SELECT a.producer, a.event_type, a.segment_no, r.path AS old_field, a.path AS field, count(*) AS c
  FROM d a JOIN d r ON a.producer = r.producer AND a.event_type = r.event_type AND a.segment_no = r.segment_no AND a.change = 'added' AND r.change = 'removed'
  JOIN atom x ON x.producer = a.producer AND x.event_type = a.event_type AND x.segment_no = a.segment_no AND x.path = a.path
  JOIN atom y ON y.producer = r.producer AND y.event_type = r.event_type AND y.segment_no = r.prev AND y.path = r.path AND y.atom = x.atom GROUP BY ALL),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY producer, event_type, segment_no, field ORDER BY c DESC, old_field) = 1
  AND row_number() OVER (PARTITION BY producer, event_type, segment_no, old_field ORDER BY c DESC, field) = 1)"""

ORACLES["p6_found"] = f"""{_LEAVES} SELECT producer, segment_no, event_type, field, old_field, 'renamed' AS change FROM best
  UNION ALL SELECT producer, segment_no, event_type, path, '', change FROM d WHERE change IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM best b WHERE b.producer = d.producer AND b.event_type = d.event_type AND b.segment_no = d.segment_no
      AND ((d.change = 'added' AND b.field = d.path) OR (d.change = 'removed' AND b.old_field = d.path)))"""

ORACLES["p6_renames"] = f"""{_LEAVES} SELECT old_field, field FROM best UNION
  SELECT transform->>'$.from', transform->>'$.to' FROM upcasters WHERE transform->>'$.op' = 'rename'"""

_OWN = "CASE field WHEN 'shipments' THEN 'shipment_id' WHEN 'adjustments' THEN 'adj_id' ELSE 'line_id' END"
_HOLDS = "('shipments', 'lines', 'components', 'adjustments')"
#: A JSON text inside a JSON text as the value it spells, else the value itself.
_VALUE = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0}->>'$') AND json_type({0}->>'$') IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN CAST({0}->>'$' AS JSON) ELSE {0} END"
_RID = f"coalesce(json_extract_string(v, '$.' || {_OWN}), filed_as)"
#: g: any value; h: what a record field holds; r: a record.
_RECORDS = f"""WITH RECURSIVE keyed AS (SELECT *, {_id('id')} AS k FROM stored_events),
firsts AS (SELECT k, arg_min(struct_pack(p := payload), seq).p AS payload FROM keyed WHERE k IS NOT NULL GROUP BY k),
commits AS (SELECT DISTINCT coalesce({_id('event_id')}, '') AS k, aggregate_snapshots AS t FROM intent_commits WHERE json_valid(aggregate_snapshots)),
objects AS (SELECT k, {_VALUE.format('CAST(t AS JSON)')} AS o FROM commits),
walk(source, event_id, agg, mode, field, filed_as, around, v) AS (
  SELECT 'stored_events', k, '', 'g', '', '', '', CAST(payload AS JSON) FROM firsts WHERE json_valid(payload)
  UNION ALL SELECT 'intent_commits', k, e.key, CASE WHEN e.key IN {_HOLDS} THEN 'h' ELSE 'g' END, e.key, '', '', CAST(e.value AS JSON)
    FROM (SELECT * FROM objects WHERE json_type(o) = 'OBJECT') x, json_each(x.o) e
  UNION ALL SELECT source, event_id, agg,
    CASE WHEN mode = 'h' THEN CASE WHEN json_type(v) = 'OBJECT' THEN 'r' ELSE 'h' END WHEN json_type(v) = 'OBJECT' AND e.key IN {_HOLDS} THEN 'h' ELSE 'g' END,
    CASE WHEN mode = 'h' THEN field WHEN json_type(v) = 'OBJECT' THEN e.key ELSE '' END,
    CASE WHEN mode <> 'h' OR json_type(v) <> 'OBJECT' THEN '' WHEN filed THEN e.key ELSE field END,
    CASE WHEN mode = 'r' THEN {_RID} ELSE around END,
    CASE WHEN mode = 'h' AND filed THEN {_VALUE.format('CAST(e.value AS JSON)')} ELSE CAST(e.value AS JSON) END
  FROM (SELECT *, mode = 'h' AND json_type(v) = 'OBJECT' AND NOT json_exists(v, '$.' || {_OWN}) AND
      coalesce(list_bool_and(list_transform(json_extract(v, '$.*'), lambda x: json_type({_VALUE.format('x')}) IN ('NULL', 'OBJECT'))), false) AS filed
    FROM walk WHERE json_type(v) IN ('OBJECT', 'ARRAY') OR json_type(v) = 'VARCHAR' AND json_type({_VALUE.format('v')}) <> 'VARCHAR') w,
  json_each(CASE WHEN json_type(v) = 'VARCHAR' THEN json_array({_VALUE.format('v')}) WHEN mode = 'h' AND json_type(v) = 'OBJECT' AND NOT filed THEN json_array(v) ELSE v END) e
  WHERE e.type IN ('OBJECT', 'ARRAY', 'VARCHAR') AND NOT (mode = 'h' AND v = '{{}}'))"""
ORACLES["p3_found"] = f"""{_RECORDS} SELECT source, event_id, agg AS aggregate_key, CASE field WHEN 'shipments' THEN 'shipment' WHEN 'adjustments' THEN 'adjustment' ELSE 'line' END AS kind,
  {_RID} AS record_id, around AS parent_record_id FROM walk WHERE mode = 'r'"""

_LINKS = f"SELECT source, event_id, agg AS aggregate_key, {_RID} AS record_id, around AS parent_record_id"
ORACLES |= {
    "p3_shipments": f"""{_RECORDS} {_LINKS}, v->>'$.carrier' AS carrier, CASE WHEN json_type(v, '$.address') = 'OBJECT' THEN v->>'$.address.zone' END AS "address.zone" FROM walk WHERE mode = 'r' AND field = 'shipments'""",
    "p3_lines": f"""{_RECORDS} {_LINKS}, v->>'$.sku' AS sku, TRY_CAST(v->>'$.qty' AS BIGINT) AS qty, v->>'$.note' AS note FROM walk WHERE mode = 'r' AND field IN ('lines', 'components')""",
    "p3_adjustments": f"""{_RECORDS} {_LINKS}, v->>'$.code' AS code, TRY_CAST(v->>'$.cents' AS BIGINT) AS cents FROM walk WHERE mode = 'r' AND field = 'adjustments'""",
}
