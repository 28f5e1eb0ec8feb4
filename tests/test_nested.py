import json
import math

from bipartiq.operators import nested
from bipartiq.plans.data_queries import LISTS, p1_found, p1_trials

SCHEMA = "doc_no bigint, family string, dataset string, written_at timestamp, body string"


def found(spark, tmp_path, bodies):
    docs = spark.createDataFrame([(i, None, None, None, b) for i, b in enumerate(bodies)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/result_docs.parquet")
    return sorted(tuple(r) for r in p1_found(spark, str(tmp_path)).collect())


def test_forms_of_lists_and_wraps(spark, tmp_path):
    plain = {"trials": [{"epoch_trace": [{"t": 1}, None, {"t": 2}]}, None, {"epoch_trace": None}]}
    bodies = [
        json.dumps(plain),
        json.dumps(json.dumps(plain)),
        "﻿" + json.dumps(plain, indent=1) + "\n",
        json.dumps(plain)[:-3],
        json.dumps({"trials": {"1": {"epoch_trace": json.dumps([{"t": 1}])}, "0": None}}),
        json.dumps({"trials": {"ants": 3, "epoch_trace": {"t": 9}}, "previous": {"trials": [1]}, "heuristic": {"trials": 1}}),
        '{"results": [{"runs": {"a-b": {"replicates": [1, NaN]}}, "challenger": {"meta": {"best_s": [null, NaN, 2]}}, "baseline": {"meta": {"best_s": [1]}}}]}',
        '{"results": [{"challenger": {"meta": {"best_s": 0.5}}}]}',
        None, "", "  ", "[]", "null", '"text"', "{}", '{"trials": ""}', '{"trials": {}}',
    ]
    rows = found(spark, tmp_path, bodies)
    whole = [("epoch_trace", "trials/0", 0), ("epoch_trace", "trials/0", 2), ("trials", "", 0), ("trials", "", 2)]
    for doc in (0, 1, 2):
        assert [r[1:] for r in rows if r[0] == doc] == whole
    assert [r[1:] for r in rows if r[0] == 4] == [("epoch_trace", "trials/1", 0), ("trials", "", 1)]
    assert [r[1:] for r in rows if r[0] == 5] == [("epoch_trace", "trials/0", 0), ("trials", "", 0)]
    assert [r[1:] for r in rows if r[0] == 6] == [
        ("best_s", "results/0/challenger/meta", 1), ("best_s", "results/0/challenger/meta", 2),
        ("replicates", "results/0/runs/a-b", 0), ("replicates", "results/0/runs/a-b", 1),
    ]
    assert [r[1:] for r in rows if r[0] == 7] == [("best_s", "results/0/challenger/meta", 0)]
    assert {r[0] for r in rows} == {0, 1, 2, 4, 5, 6, 7}


def test_links_and_clashing_columns(spark):
    body = json.dumps({"trials": [{"ants": 5, "dewey": 1, "epoch_trace": [{"t": 1, "edges": 2}, {"t": 2}]}, {"ants": "x"}]})
    docs = spark.createDataFrame([(1, body, "other", "path"), (1, body, "again", "p")], "doc_no bigint, body string, dewey string, path string")
    nodes = nested.shred(docs, "doc_no", "body", LISTS)
    trials = nested.linked_table(nodes, "doc_no", "trials[]", {"ants": "int"}).distinct()
    epochs = nested.linked_table(nodes, "doc_no", "trials[]/epoch_trace[]", {"t": "int", "edges": "int"}).distinct()
    assert sorted(r["ants"] is None for r in trials.collect()) == [False, True]
    joined = epochs.join(trials.select(trials["node_id"].alias("parent_id"), "ants"), "parent_id").collect()
    assert [(r["t"], r["edges"], r["ants"]) for r in sorted(joined, key=lambda r: r["t"])] == [(1, 2, 5), (2, None, 5)]
    assert nodes.count() == 8


def test_empty_table_and_long_document(spark):
    empty = spark.createDataFrame([], "doc_no bigint, body string")
    assert nested.shred(empty, "doc_no", "body", LISTS).count() == 0
    long = json.dumps({"trials": [{"epoch_trace": [{"t": t} for t in range(50)]} for _ in range(2000)]})
    docs = spark.createDataFrame([(1, long)], "doc_no bigint, body string")
    assert nested.shred(docs, "doc_no", "body", LISTS, with_fields=False).count() == 2000 * 51


def test_trials_keep_every_field_beside_nan(spark, tmp_path):
    trial = {
        "ants": 10, "run": 3, "seed": "7", "wall_time_s": float("inf"), "time_to_best_s": float("nan"), "final_edges": 6, "theta_feasible": True, "missing": 1,
        "nU": 2, "nV": 3, "U": [4, 5], "V": [1, 2, 3], "iterations_budget": 9, "optimal_edges": 6, "matched_optimal": True, "construction": {"missing_at_size": [0, 1]},
    }
    docs = spark.createDataFrame([(0, None, None, None, json.dumps({"trials": [trial | {"epoch_trace": [{"t": 1}]}, {"ants": 1}]}))], SCHEMA)
    docs.write.parquet(f"{tmp_path}/result_docs.parquet")
    full, sparse = (r.asDict() for r in p1_trials(spark, str(tmp_path)).orderBy("pos").collect())
    assert math.isnan(full.pop("time_to_best_s")) and json.loads(full.pop("construction")) == trial["construction"]
    assert {k: full[k] for k in full if k in trial} == {k: v for k, v in trial.items() if k not in ("time_to_best_s", "construction")}
    assert sparse["ants"] == 1 and sparse["U"] is None and sparse["construction"] is None


def test_links_lead_to_rows_through_objects(spark, tmp_path):
    body = {"results": [None, {"dataset": "d", "runs": {"aco": {"method": "aco", "replicates": [{"replicate": 1}, None]}, "x": 3},
                               "challenger": {"method": "edges", "meta": {"ants": 5, "best_s": [0.5, None, 1.5]}}}]}
    for _ in range(40):  # wrapped however often
        body = json.dumps(body) if not isinstance(body, str) or len(body) < 5000 else body
    docs = spark.createDataFrame([(7, None, None, None, body), (8, None, None, None, "cut {")], SCHEMA)
    docs.write.parquet(f"{tmp_path}/result_docs.parquet")
    from bipartiq.plans import data_queries as q

    rows = {name: [r.asDict() for r in f(spark, str(tmp_path)).collect()] for name, f in q.P1_TABLES.items()}
    result, run, rep = rows["p1_results"][0], rows["p1_runs"][0], rows["p1_replicates"][0]
    assert (result["parent_id"], result["dataset"], run["name"], run["parent_path"]) == ("", "d", "aco", "results/1")
    assert run["parent_id"] == result["node_id"] and rep["parent_id"] == run["node_id"] and rep["replicate"] == 1
    challenger, meta = rows["p1_challengers"][0], rows["p1_metas"][0]
    assert challenger["parent_id"] == result["node_id"] and meta["parent_id"] == challenger["node_id"] and meta["ants"] == 5
    assert [(r["parent_id"], r["value"]) for r in rows["p1_best_times"]] == [(meta["node_id"], 0.5), (meta["node_id"], 1.5)]
    assert all(r["orphans"] == 0 for r in q.p1_orphans(spark, str(tmp_path)).collect())
    paths = {r["schema_path"]: (r["parent_path"], r["n_nodes"]) for r in q.p1_paths(spark, str(tmp_path)).collect()}
    assert paths == {
        "": (None, 1), "results[]": ("", 1), "results[]/runs": ("results[]", 1), "results[]/runs/*": ("results[]/runs", 1),
        "results[]/runs/*/replicates[]": ("results[]/runs/*", 1), "results[]/challenger": ("results[]", 1), "results[]/challenger/meta": ("results[]/challenger", 1),
    }


def test_lists_of_lists_and_every_node(spark):
    body = json.dumps({"m": [[{"a": 1}, [2, {"b": 3}]], 5], "k": {"0": {"c": 1}, "2": {"c": 2}}, "plain": [1, 2]})
    docs = spark.createDataFrame([(1, body), (2, None), (3, "{}")], "doc_no bigint, body string")
    nodes = [r.asDict() for r in nested.shred_all(docs, "doc_no", "body").collect()]
    assert {n["schema_path"] for n in nodes} == {"", "m[]", "m[][]", "m[][][]", "k[]"}
    ids = {(n["doc_no"], n["node_id"]) for n in nodes}
    assert all((n["doc_no"], n["parent_id"]) in ids for n in nodes if n["parent_id"] is not None)
    assert json.loads(next(n for n in nodes if n["doc_no"] == 1 and not n["schema_path"])["fields"]) == {"plain": [1, 2]}
    assert {n["parent_path"] for n in nodes if n["schema_path"] == "m[][]"} == {"m[]"} and {n["pos"] for n in nodes if n["schema_path"] == "k[]"} == {0, 2}
    assert nested.shred_all(docs.limit(0), "doc_no", "body").count() == 0
