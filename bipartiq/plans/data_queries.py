"""Queries over the result documents, records and interactions, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartiq.operators import drift, frequency, nested
from bipartiq.session import materialize
from bipartiq.tables import table

#: The lists of result documents that become tables.
LISTS = ["trials[]", "trials[]/epoch_trace[]", "results[]/runs/*/replicates[]", "results[]/challenger/meta/best_s[]"]


def _nodes(spark: SparkSession, folder: str, lists: list[str] = LISTS, with_fields: bool = True) -> DataFrame:
    return nested.shred(table(spark, folder, "result_docs"), "doc_no", "body", lists, with_fields)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder, with_fields=False)
    return nodes.select(
        "doc_no",
        F.regexp_extract("schema_path", r"([^/\[]+)\[\]$", 1).alias("child"),
        nested.parent_path(F.col("path")).alias("parent"),
        "pos",
    )


#: Of every schema path that becomes a table its query and its columns. Parents are rows of the nearest path above.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    LISTS[0]: ("p1_trials", {
        "ants": "int", "run": "int", "seed": "string", "wall_time_s": "double", "time_to_best_s": "double", "final_edges": "int", "theta_feasible": "boolean",
        "missing": "int", "nU": "int", "nV": "int", "U": "array<bigint>", "V": "array<bigint>", "iterations_budget": "int",
        "optimal_edges": "int", "matched_optimal": "boolean", "construction": "string",
    }),
    LISTS[1]: ("p1_epochs", {"t": "int", "edges": "int", "theta_feasible": "boolean", "elapsed_s": "double", "nU": "int", "nV": "int"}),
    "results[]": ("p1_results", {"dataset": "string", "edge_count": "bigint", "status": "string", "verdict": "string"}),
    "results[]/runs/*": ("p1_runs", {"method": "string", "label": "string", "status": "string", "final_edges": "int", "missing": "int", "wall_time_s": "double", "theta_feasible": "boolean"}),
    LISTS[2]: ("p1_replicates", {"replicate": "int", "seed": "string", "method": "string", "final_edges": "int", "wall_time_s": "double", "theta_feasible": "boolean"}),
    "results[]/challenger": ("p1_challengers", {"method": "string", "label": "string", "final_edges": "int", "wall_time_s": "double", "theta_feasible": "boolean"}),
    "results[]/challenger/meta": ("p1_metas", {"ants": "int", "subspecies": "int", "evaporation": "double", "pheromone": "int"}),
    LISTS[3]: ("p1_best_times", {"": "double"}),
}


def _linked(path: str) -> Callable[[SparkSession, str], DataFrame]:
    name, columns = TABLES[path]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        # Tables below a path are walked too, so that their values don't stand among its own.
        wanted = [p for p in TABLES if p.startswith(path)]
        return nested.linked_table(_nodes(spark, folder, wanted), "doc_no", path, columns, list(TABLES))

    run.__name__ = name
    return run


P1_TABLES = {TABLES[path][0]: _linked(path) for path in TABLES}
p1_trials = P1_TABLES["p1_trials"]


def p1_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every object of every document, in the tables of the schema paths found."""
    return nested.shred_all(table(spark, folder, "result_docs"), "doc_no", "body", ("runs",))


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    return nested.schema_paths(p1_nodes(spark, folder), "doc_no")


def p1_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """(child, parent, orphans) of each linked table, and of all nodes: how many rows have a parent without a row."""
    nodes = materialize(_nodes(spark, folder, list(TABLES)), "nodes")
    every = materialize(p1_nodes(spark, folder).select("doc_no", "node_id", "parent_id"), "nodes")
    linked = {path: nested.linked_table(nodes, "doc_no", path, {}, list(TABLES)) for path in TABLES}
    lost = [("nodes", "nodes", nested.orphans(every.filter("parent_id IS NOT NULL"), every, "doc_no"))]
    for path, child in linked.items():
        above, _ = nested.parent_table(path, list(TABLES))
        parent = linked[above] if above else table(spark, folder, "result_docs").select("doc_no", F.lit("").alias("node_id"))
        lost.append((path, above, nested.orphans(child, parent, "doc_no")))
    rows = [df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(c).alias("child"), F.lit(p).alias("parent"), "orphans") for c, p, df in lost]
    return reduce(DataFrame.unionByName, rows)


P1_ORPHANS = "SELECT * FROM (VALUES ('nodes', 'nodes', 0), {}) t(child, parent, orphans)".format(
    ", ".join(f"('{p}', '{nested.parent_table(p, list(TABLES))[0]}', 0)" for p in TABLES)
)


def _valid_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "interactions").select("dataset", "u", "v").filter("u >= 1 AND v >= 1")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    degrees = frequency.two_sided_degrees(_valid_interactions(spark, folder), ["dataset"], "u", "v")
    return degrees.filter("neighbours >= 50").select("dataset", "side", "vertex")


def p3_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.two_sided_degrees(_valid_interactions(spark, folder), ["dataset"], "u", "v")


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.key_profile(_valid_interactions(spark, folder), ["dataset", "v"], "u")


def p3_median_neighbour(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.weighted_percentile(_valid_interactions(spark, folder), ["dataset", "v"], "u", 0.5)


_VALID = "interactions WHERE u >= 1 AND v >= 1"
_DEGREES = f"""
SELECT dataset, 'U' AS side, u AS vertex, count(DISTINCT v) AS neighbours, count(*) AS n_rows FROM {_VALID} GROUP BY dataset, u
UNION ALL
SELECT dataset, 'V', v, count(DISTINCT u), count(*) FROM {_VALID} GROUP BY dataset, v
"""
_PROFILE = f"""
WITH w AS (SELECT dataset, v, u, count(*) AS n FROM {_VALID} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, v ORDER BY n DESC, u) AS place FROM w)
SELECT dataset, v, sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, max(n) AS mode_rows,
  max(CASE WHEN place = 1 THEN u END) AS mode_value
FROM r GROUP BY dataset, v
"""
_MEDIAN = f"""
SELECT dataset, v, u AS percentile FROM (
  SELECT dataset, v, u, row_number() OVER (PARTITION BY dataset, v ORDER BY u) AS place,
    count(*) OVER (PARTITION BY dataset, v) AS n FROM {_VALID})
WHERE place = greatest(ceil(n * 0.5), 1)
"""


def _drift(spark: SparkSession, folder: str) -> drift.Drift:
    return drift.Drift(table(spark, folder, "suite_records"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _drift(spark, folder).changes().select("stream_id", "file_seq", "change", "field", "new_field")


def p4_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """The tree edit script between each file's schema and the one before: operations on objects and fields, with their costs."""
    return _drift(spark, folder).scripts().withColumn("cost", F.round("cost", 6))


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the columns named in problem 4, whatever its file calls them."""
    table_ = _drift(spark, folder).unified()
    typed = {
        "final_edges": ("challenger.final_edges", "bigint"),
        "time_to_best_s": ("challenger.time_to_best_s", "double"),
        "neighbor_scope_limit": ("challenger.meta.neighbor_scope_limit", "string"),
        "accepted_shakes": ("challenger.meta.accepted_shakes", "string"),
    }
    columns = [drift.typed("fields", path, kind).alias(name) for name, (path, kind) in typed.items()]
    return table_.select(
        "rec_id", "family", "stream_id", "file_seq", "line_no", "run_key", "written_at", *columns, F.to_json("fields").alias("fields")
    )


# ---- the same from the JSON functions of SQL, as far as they go -----------------


def _layer(source: str, target: str) -> str:
    """One layer of wrapping off the bodies b: a JSON text of JSON, or a list of one."""
    return f"""{target} AS (SELECT doc_no, CASE WHEN NOT json_valid(b) THEN NULL WHEN json_type(b) = 'VARCHAR' THEN trim(b->>'$', E' \\t\\n\\r\ufeff')
  WHEN json_type(b) = 'ARRAY' AND json_array_length(b) = 1 THEN (b->'$[0]')::VARCHAR ELSE b END AS b FROM {source})"""


def _as_text(source: str, target: str) -> str:
    """Lists x that are written as JSON text; blank texts are none."""
    return f"""{target} AS (SELECT * EXCLUDE (x), CASE WHEN json_type(x) = 'VARCHAR' AND json_valid(x->>'$') THEN (x->>'$')::JSON
  WHEN json_type(x) = 'VARCHAR' AND trim(x->>'$') = '' THEN NULL ELSE x END AS x FROM {source})"""


def _items(source: str, target: str) -> str:
    """(doc_no, parent, child, pos, v) of lists (doc_no, parent, child, x): plain, by integer keys, or a lone value."""
    named = "len(list_filter(json_keys(x), lambda y: NOT regexp_full_match(y, '-?[0-9]+')))"
    return f"""{_as_text(source, target + "1")}, {_as_text(target + "1", target + "2")}, {target} AS (
  SELECT doc_no, parent, child, i - 1 AS pos, a[i] AS v FROM (
    SELECT *, json_extract(x, '$[*]') AS a, unnest(range(1, json_array_length(x)::BIGINT + 1)) AS i FROM {target}2 WHERE json_type(x) = 'ARRAY')
  UNION ALL SELECT doc_no, parent, child, key::INTEGER, json_extract(x, '$."' || key || '"') FROM (
    SELECT *, unnest(json_keys(x)) AS key FROM {target}2 WHERE json_type(x) = 'OBJECT' AND {named} = 0)
  UNION ALL SELECT doc_no, parent, child, 0, x FROM {target}2 WHERE json_type(x) NOT IN ('ARRAY', 'OBJECT') OR (json_type(x) = 'OBJECT' AND {named} > 0))"""


#: The items of the four lists, in ti, ei, pi and si. NaN and infinities are no JSON to SQL and become a number.
P1_CTES = f"""b0 AS (SELECT doc_no, regexp_replace(trim(body, E' \\t\\n\\r\ufeff'), '([:\\[,]\\s*)-?(NaN|Infinity)', '\\1 1e300', 'g') AS b FROM result_docs),
{_layer("b0", "b1")}, {_layer("b1", "b2")}, {_layer("b2", "b3")}, {_layer("b3", "b4")},
d AS MATERIALIZED (SELECT doc_no, b::JSON AS d FROM b4 WHERE json_valid(b) AND json_type(b) = 'OBJECT'),
tl AS (SELECT doc_no, '' AS parent, 'trials' AS child, d->'trials' AS x FROM d), {_items("tl", "ti")},
el AS (SELECT doc_no, 'trials/' || pos AS parent, 'epoch_trace' AS child, v->'epoch_trace' AS x FROM ti), {_items("el", "ei")},
rl AS (SELECT doc_no, '' AS parent, 'results' AS child, d->'results' AS x FROM d), {_items("rl", "ri")},
rr AS (SELECT doc_no, pos, v, unnest(json_keys(v->'runs')) AS name FROM ri WHERE json_type(v->'runs') = 'OBJECT'),
pl AS (SELECT doc_no, 'results/' || pos || '/runs/' || name AS parent, 'replicates' AS child, json_extract(v, '$.runs."' || name || '".replicates') AS x FROM rr), {_items("pl", "pi")},
sl AS (SELECT doc_no, 'results/' || pos || '/challenger/meta' AS parent, 'best_s' AS child, v->'challenger'->'meta'->'best_s' AS x FROM ri), {_items("sl", "si")}"""
P1_FOUND = f"""WITH {P1_CTES} SELECT doc_no, child, parent, pos::INTEGER AS pos FROM (FROM ti UNION ALL FROM ei UNION ALL FROM pi UNION ALL FROM si)
WHERE v IS NOT NULL AND json_type(v) <> 'NULL'"""
#: Where several pairs of a step are borne out for one field, this lists them all and the operator the cheapest choice.
P4_FOUND = """WITH x AS MATERIALIZED (SELECT s.stream_id, s.file_seq, s.run_key, s.line_no, s.rec_id, replace(substr(t.fullkey, 3), '"', '') AS field,
    CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(t.type) END AS type,
    CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (t.atom::VARCHAR)::DOUBLE::VARCHAR ELSE t.value::VARCHAR END AS value
  FROM suite_records s, json_tree(CASE WHEN json_valid(s.body) AND json_type(s.body) = 'OBJECT' THEN s.body END) t
  WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%' AND s.stream_id IS NOT NULL AND s.file_seq IS NOT NULL),
n AS (SELECT stream_id, file_seq, field, type, count(*) AS n FROM x GROUP BY ALL),
f AS MATERIALIZED (SELECT stream_id, file_seq, field, min_by(type, (-n, type)) AS type FROM n GROUP BY ALL),
p AS MATERIALIZED (SELECT stream_id, file_seq, lag(file_seq) OVER (PARTITION BY stream_id ORDER BY file_seq) AS before FROM (SELECT DISTINCT stream_id, file_seq FROM suite_records WHERE file_seq IS NOT NULL)),
b AS (SELECT p.stream_id, p.file_seq, f.field, f.type FROM p JOIN f ON f.stream_id = p.stream_id AND f.file_seq = p.before),
a AS (SELECT p.stream_id, p.file_seq, f.field, f.type FROM p JOIN f ON f.stream_id = p.stream_id AND f.file_seq = p.file_seq WHERE p.before IS NOT NULL),
c AS MATERIALIZED (SELECT stream_id, file_seq, field, CASE WHEN b.type IS NULL THEN 'added' WHEN a.type IS NULL THEN 'removed' ELSE 'type' END AS change
  FROM b FULL JOIN a USING (stream_id, file_seq, field) WHERE b.type IS DISTINCT FROM a.type),
v AS MATERIALIZED (SELECT stream_id, file_seq, run_key, field, max_by(value, (line_no, rec_id)) AS value FROM x WHERE run_key IS NOT NULL GROUP BY ALL),
r AS (SELECT DISTINCT stream_id, file_seq, run_key FROM suite_records WHERE run_key IS NOT NULL),
m AS MATERIALIZED (SELECT p.stream_id, p.file_seq, p.before, o.run_key FROM p JOIN r o ON o.stream_id = p.stream_id AND o.file_seq = p.before JOIN r w ON w.stream_id = p.stream_id AND w.file_seq = p.file_seq AND w.run_key = o.run_key),
vo AS MATERIALIZED (SELECT m.stream_id, m.file_seq, m.run_key, v.field, v.value FROM m JOIN v ON v.stream_id = m.stream_id AND v.file_seq = m.before AND v.run_key = m.run_key
  JOIN c ON c.stream_id = m.stream_id AND c.file_seq = m.file_seq AND c.field = v.field AND c.change = 'removed'),
vn AS MATERIALIZED (SELECT m.stream_id, m.file_seq, m.run_key, v.field, v.value FROM m JOIN v ON v.stream_id = m.stream_id AND v.file_seq = m.file_seq AND v.run_key = m.run_key
  JOIN c ON c.stream_id = m.stream_id AND c.file_seq = m.file_seq AND c.field = v.field AND c.change = 'added'),
e AS (SELECT stream_id, file_seq, vo.field, vn.field AS new_field, count(*) AS n FROM vo JOIN vn USING (stream_id, file_seq, run_key, value) GROUP BY ALL),
k AS MATERIALIZED (SELECT e.* FROM e JOIN (SELECT stream_id, file_seq, field, count(*) AS n FROM vo GROUP BY ALL) o USING (stream_id, file_seq, field, n)
  JOIN (SELECT stream_id, file_seq, field AS new_field, count(*) AS n FROM vn GROUP BY ALL) w USING (stream_id, file_seq, new_field, n))
SELECT stream_id, file_seq, 'renamed' AS change, field, new_field FROM k
UNION ALL SELECT stream_id, file_seq, change, field, '' FROM c
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.stream_id = c.stream_id AND k.file_seq = c.file_seq AND ((c.change = 'removed' AND k.field = c.field) OR (c.change = 'added' AND k.new_field = c.field)))"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, *P1_TABLES.values(), p1_nodes, p1_paths, p1_orphans,
        p3_found, p3_degrees, p3_profile, p3_median_neighbour, p4_found, p4_scripts, p4_unified,
    )
}
SQL = {
    "p1_found": P1_FOUND,
    "p1_orphans": P1_ORPHANS,
    "p4_found": P4_FOUND,
    "p3_found": f"SELECT dataset, side, vertex FROM ({_DEGREES}) WHERE neighbours >= 50",
    "p3_degrees": _DEGREES,
    "p3_profile": _PROFILE,
    "p3_median_neighbour": _MEDIAN,
}
