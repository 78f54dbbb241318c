"""What one task holds, and how many rows a join makes, does not follow the table."""

from pyspark.sql import functions as F

from weftline.operators import control, graph
from weftline.plans import lexical
from weftline.queries import load
from weftline.sources import graph as view
from weftline.sources import shared

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_tasks_follow_rows(spark, monkeypatch):
    assert [shared.tasks_for(spark, n) for n in (0, 1, 150_000, 3_000_000, 20_000_001)] == [1, 1, 2, spark.sparkContext.defaultParallelism, 21]
    monkeypatch.setattr(shared, "TASK_ROWS", 1_000)
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert f", {shared.tasks_for(spark, 3 * lines)}), REPARTITION_BY_NUM" in plan(view.relations(spark, FOLDER))


def test_pairs_and_snapshots_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    edges = spark.createDataFrame([(f"a{i}", f"b{i % 7}", "X", 0.5) for i in range(400)] * 2, "src string, dst string, relation string, confidence double")
    found = graph.degrees(edges, 800)
    assert "16), REPARTITION_BY_NUM" in plan(found) and sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.degrees(edges).collect()))
    n = shared.tasks_for(spark, view.relation_rows(spark, FOLDER))
    assert f"{n}), REPARTITION_BY_NUM" in plan(load()[0]["compile_snapshot"](spark, FOLDER))


def test_suggestions_hold_no_type_in_a_task(spark):
    rows = [("a", "PR", 5), ("a", "File", 5), (" b ", "PR", 5), ("c", None, 2), ("d", None, 2), ("e", "File", 9), ("e", "PR", 1), ("", "PR", 99), (None, "PR", 99), ("f", "Odd", None), ("f", "Odd", None), ("g", "PR", 4)]
    found = lexical.suggestions(spark.createDataFrame(rows, "label string, type string, degree long"), 9)
    assert "Window" not in plan(found)
    assert [(r.entity, r.type) for r in found.collect()] == [("e", "File"), ("a", "PR"), ("c", None), ("f", "Odd"), ("b", "PR"), ("g", "PR"), ("d", None)]


def test_counted_assignments_are_not_multiplied(spark):
    pods = spark.createDataFrame([("p1", "ready", None), ("p2", "ready", None), ("p3", "ready", None)], "pod_id string, status string, last_heartbeat_at long")
    one = spark.createDataFrame([("p1",)] * 5 + [("p2",)], "pod_id string")
    counted = spark.createDataFrame([("p1", 3), ("p1", 2), ("p2", 1)], "pod_id string, n long")
    want = [("p3", 0), ("p2", 1), ("p1", 5)]
    for rows in (one, counted):
        assert [tuple(r) for r in control.loads(pods, rows, F.lit(0)).collect()] == want
    assert plan(load()[0]["pod_placement"](spark, FOLDER)).count("Aggregate") > plan(control.loads(pods, one, F.lit(0))).count("Aggregate")
