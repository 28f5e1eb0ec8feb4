import json

from pyspark.sql import functions as F

from bipartiq.sources import edges as src
from bipartiq.sources import manifest
from bipartiq.streaming import edges as stream


def test_csv_round_trip_and_dirty_lines(spark, rows, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("u,v,t\n1,2,x\n1,2,y\n\n3\nfour,5,\n6,7,z\n")
    e = src.read_edge_csv(spark, str(path))
    assert rows(e) == [(1, 2), (6, 7)]
    assert rows(src.read_edge_csv(spark, str(path), max_edges=1)) == [(1, 2)]
    out = str(tmp_path / "out")
    src.write_edge_csv(e, out)
    src.append_edges(spark.createDataFrame([(6, 7), (8, 9)], "u bigint, v bigint"), out)
    assert rows(src.read_edge_csv(spark, out)) == [(1, 2), (6, 7), (8, 9)]
    assert spark.read.option("header", True).csv(out).count() == 3


def test_index_and_pairs(spark, rows):
    raw = spark.createDataFrame([("b", "y"), ("a", "y"), ("b", "x"), (None, "x")], "who string, what string")
    e, users, items = src.index_dataset(raw, "who", "what")
    assert rows(e) == [(1, 2), (2, 1), (2, 2)] and rows(users) == [("a", 1), ("b", 2)] and items.count() == 2
    chosen = spark.createDataFrame([(2,)], "u bigint"), spark.createDataFrame([(1,)], "v bigint")
    assert rows(src.existing_pairs(e, *chosen)) == [(2, 1)]


def test_graph_json(spark, rows, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"k": 1, "theta": 2, "U": [{"id": 1, "x": 3}, {"id": 2}], "V": [{"id": 9}], "edges": [{"u": 1, "v": 9, "timestamp": 5}]}))
    g, kt = src.read_graph_json(spark, str(path))
    assert rows(g.edges) == [(1, 9)] and g.vertices().count() == 3 and rows(kt) == [(1, 2)]
    back = json.loads(src.graph_json(g, 1, 2).first()[0])
    assert back == {"k": 1, "theta": 2, "U": [{"id": 1}, {"id": 2}], "V": [{"id": 9}], "edges": [{"u": 1, "v": 9}]}


def test_manifest_and_aliases(spark, rows, tmp_path):
    (tmp_path / "m.txt").write_text("# list\na/x\nab/y\n\nb/z\n")
    (tmp_path / "al.txt").write_text("# names\na/x=Far_Away\n")
    m = manifest.read_manifest(spark, str(tmp_path / "m.txt"))
    assert rows(m) == [("a/x", "a"), ("ab/y", "ab"), ("b/z", "b")]
    joined = m.join(manifest.read_aliases(spark, str(tmp_path / "al.txt")), "dataset", "left")
    assert rows(manifest.remote_names(joined), "remote_name") == [("Far_Away",), ("y",), ("z",)]
    done = spark.createDataFrame([("b/z",)], "dataset string")
    assert rows(manifest.pending(m, done, ["a", "b"]), "dataset") == [("a/x",)]


def test_results_resume(spark, rows, tmp_path):
    path = str(tmp_path / "results")
    assert src.completed(spark, path, ["dataset", "seed"]).count() == 0
    src.append_results(spark.createDataFrame([("a", 1, 5)], "dataset string, seed bigint, edges int"), path)
    src.append_results(spark.createDataFrame([("a", 2, 5)], "dataset string, seed bigint, edges int"), path)
    assert rows(src.completed(spark, path, ["dataset", "seed"])) == [("a", 1), ("a", 2)]


def test_streams(spark, rows, tmp_path):
    source, schema = str(tmp_path / "in"), "u bigint, v bigint, at timestamp"
    data = spark.sql("SELECT id % 5 AS u, id % 3 AS v, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS at FROM range(60)")
    data.write.parquet(source)
    live = spark.readStream.schema(schema).parquet(source)
    q = stream.distinct_edges(live, "at").writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("uniq").count() == 15
    q = stream.windowed_degrees(live, "at", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("deg").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("deg").agg(F.sum("deg")).first()[0] == 60
    q = stream.keep_counts(live, ["u"], str(tmp_path / "counts"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "counts")).groupBy("u").agg(F.sum("n").alias("n"))) == [(u, 12) for u in range(5)]
