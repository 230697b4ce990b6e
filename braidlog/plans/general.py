"""Queries on drifting schemas (p4) and nested records (p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.operators import drift, nesting
from braidlog.session import cut
from braidlog.sources.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return drift.parsed_lines(table(spark, d, "modern"), "modern").unionByName(drift.parsed_lines(table(spark, d, "legacy"), "legacy"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return cut(drift.file_versions(drift.shapes(_lines(spark, d))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per change of a file's members against the registry."""
    per_file = _versions(spark, d)
    return drift.of_files(drift.changes(drift.known_versions(per_file), table(spark, d, "line_fields")), per_file)


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines of modern and legacy in one table with the registered members."""
    registry = table(spark, d, "line_fields")
    rows = [(r[0], r[1]) for r in registry.select("field_path", "json_type").distinct().collect()]  # the registry: a fixed number of rows
    per_file = _versions(spark, d)
    return drift.consistent_table(_lines(spark, d), per_file, drift.steps(drift.changes(drift.known_versions(per_file), registry)), rows)


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    """Schema versions of each record type, with their fingerprint, use, and what changed since the one before."""
    return drift.versions(_versions(spark, d))


def p4_steps(spark: SparkSession, d: str) -> DataFrame:
    """The migration steps of each version, in order."""
    return drift.steps(drift.changes(drift.known_versions(_versions(spark, d)), table(spark, d, "line_fields")))


def _objects(spark: SparkSession, d: str, beside: str = "") -> DataFrame:
    return nesting.occurrences(table(spark, d, "claude"), "claude", "row_id", "content", beside).unionByName(
        nesting.occurrences(table(spark, d, "modern"), "modern", "row_id", "payload", beside)
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object that is an element of an array, in claude.content and modern.payload."""
    return _objects(spark, d).where("in_array").select("tbl", "row_id", "path")


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    """All occurrences of objects, with line, parent, position and identity."""
    return _objects(spark, d, "archive_path string, line bigint").withColumn("node_id", F.hex("node_id"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claude").select(F.col("content").alias("value")).unionByName(table(spark, d, "modern").select(F.col("payload").alias("value")))


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct object of claude.content and modern.payload once."""
    return nesting.nodes(_texts(spark, d), "value").withColumn("node_id", F.hex("node_id"))


def p5_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct parent-child link of claude.content and modern.payload once."""
    return nesting.bridge(_texts(spark, d), "value").withColumns({"parent_id": F.hex("parent_id"), "child_id": F.hex("child_id")})


QUERIES = {f.__name__: f for f in (p4_found, p4_table, p4_versions, p4_steps, p5_found, p5_objects, p5_nodes, p5_bridge)}

P4_LINES = """
lines AS (
  SELECT 'modern' tbl, archive_path, row_id, type, payload FROM modern
  UNION ALL SELECT 'legacy', archive_path, row_id, type, payload FROM legacy),
ok AS (
  SELECT tbl, archive_path, row_id, p,
    CASE WHEN type IN ('response_item','event_msg') THEN concat_ws('/', type, json_extract_string(p, '$.type')) ELSE type END record_type
  FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON END p FROM lines)
  WHERE p IS NOT NULL AND json_type(p) = 'OBJECT'),
kid AS (
  SELECT tbl, archive_path, record_type, row_id, 'payload.' || k field_path, json_type(p, '$."' || k || '"') t FROM (SELECT *, unnest(json_keys(p)) k FROM ok)
  UNION ALL
  SELECT tbl, archive_path, record_type, row_id, 'payload.item.' || k, json_type(p, '$.item."' || k || '"')
  FROM (SELECT *, unnest(json_keys(p, '$.item')) k FROM ok WHERE json_type(p, '$.item') = 'OBJECT')),
mem AS (
  SELECT * EXCLUDE t, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END kind
  FROM kid WHERE t <> 'NULL'),
grp AS (SELECT tbl, archive_path, record_type, list_sort(list(row_id)) every FROM ok GROUP BY ALL),
seen AS (SELECT tbl, archive_path, record_type, field_path, list_sort(list(row_id)) ids, list_sort(list(DISTINCT kind)) kinds FROM mem GROUP BY ALL),
known AS (
  SELECT g.tbl, g.archive_path, g.record_type, r.field_path, r.json_type, r.required, every, coalesce(ids, []) ids, kinds
  FROM grp g JOIN line_fields r USING (tbl, record_type) LEFT JOIN seen s USING (tbl, archive_path, record_type, field_path)),
alien AS (SELECT * FROM seen s ANTI JOIN line_fields r USING (tbl, record_type, field_path)),
gone AS (
  SELECT *, list_filter(every, lambda x: NOT list_contains(ids, x)) absent FROM known WHERE required AND len(ids) < len(every)),
cand AS (
  SELECT g.tbl, g.archive_path, g.record_type, g.field_path, a.field_path new_path, count(*) OVER (PARTITION BY g.tbl, g.archive_path, g.record_type, g.field_path) k
  FROM gone g JOIN alien a ON g.tbl = a.tbl AND g.archive_path = a.archive_path AND g.record_type = a.record_type AND a.ids = g.absent AND a.kinds = [g.json_type]
    AND regexp_replace(a.field_path, '\\.[^.]*$', '') = regexp_replace(g.field_path, '\\.[^.]*$', '')),
ren AS (SELECT * FROM cand WHERE k = 1)
"""

P4_VERSIONS = """
shp AS (SELECT o.tbl, o.archive_path, o.record_type, o.row_id, coalesce(list({'path': m.field_path, 'kind': m.kind} ORDER BY m.field_path) FILTER (m.field_path IS NOT NULL), []) s
  FROM ok o LEFT JOIN mem m ON o.tbl = m.tbl AND o.archive_path = m.archive_path AND o.row_id = m.row_id WHERE o.record_type IS NOT NULL GROUP BY ALL),
fv AS (SELECT tbl, archive_path, record_type, sha256(array_to_string(list_sort(list(DISTINCT sha256(to_json(s)))), ',')) fingerprint, count(*) n, list_distinct(flatten(list(s))) members FROM shp GROUP BY ALL),
st AS (SELECT tbl, row_id, epoch_us(ingested_at) t0 FROM (SELECT 'modern' tbl, row_id, ingested_at FROM modern UNION ALL SELECT 'legacy', row_id, ingested_at FROM legacy)),
fa AS (SELECT s.tbl, s.archive_path, s.record_type, min(t0) t0 FROM shp s JOIN st USING (tbl, row_id) GROUP BY ALL),
kv AS (SELECT tbl, record_type, fingerprint, sum(n)::BIGINT n_lines, count(*) n_files, min(t0) t0, list_transform(list_sort(any_value(members)), lambda m: m.path || ':' || m.kind) mm FROM fv JOIN fa USING (tbl, archive_path, record_type) GROUP BY ALL),
nv AS (SELECT *, row_number() OVER w version, coalesce(lag(mm) OVER w, []) b FROM kv WINDOW w AS (PARTITION BY tbl, record_type ORDER BY t0, fingerprint))
"""

ORACLE = {
    "p4_versions": f"""WITH {P4_LINES}, {P4_VERSIONS}
SELECT tbl, record_type, version, fingerprint, n_lines, n_files, array_to_string(list_filter(mm, lambda x: NOT list_contains(b, x)), ',') gained, array_to_string(list_filter(b, lambda x: NOT list_contains(mm, x)), ',') lost FROM nv""",
    "p4_found": f"""
WITH {P4_LINES}
SELECT tbl, archive_path, record_type, field_path, 'retyped' change FROM known WHERE len(list_filter(kinds, lambda x: x <> json_type)) > 0
UNION ALL SELECT tbl, archive_path, record_type, field_path, 'renamed' FROM ren
UNION ALL SELECT tbl, archive_path, record_type, field_path, 'missing' FROM gone ANTI JOIN ren USING (tbl, archive_path, record_type, field_path) WHERE len(ids) = 0
UNION ALL SELECT tbl, archive_path, record_type, field_path, 'added' FROM alien a
  WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.tbl = a.tbl AND r.archive_path = a.archive_path AND r.record_type = a.record_type AND r.new_path = a.field_path)
""",
    "p5_found": """
WITH src AS (
  SELECT 'claude' tbl, row_id, 'content' base, content j FROM claude WHERE json_valid(content)
  UNION ALL SELECT 'modern', row_id, 'payload', payload FROM modern WHERE json_valid(payload))
SELECT tbl, row_id, base || replace(substr(t.fullkey, 2), '"', '') path
FROM src, json_tree(src.j) t WHERE t.type = 'OBJECT' AND t.fullkey LIKE '%]'
""",
}
