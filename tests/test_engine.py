"""The engine on a small repository: build, ask, ingest, publish."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.engine import Engine
from weftline.plans.build import build
from weftline.sources import landing

DAY = "2026-05-01T00:00:00Z"


def user(name):
    return {"login": name, "id": 1}


PAYLOADS = {
    "repository": [{"id": 1, "name": "tools", "full_name": "acme/tools", "created_at": DAY, "unknown": 3}],
    "pull_request": [
        {"id": 10, "number": 7, "title": "Fix login", "body": "Fixes #12", "user": user("ann"), "created_at": DAY, "updated_at": DAY, "merged_at": DAY},
        {"id": 11, "number": 8, "title": "Tidy", "body": None, "user": user("bob"), "created_at": DAY, "updated_at": None},
    ],
    "issue": [
        {"id": 20, "number": 12, "title": "Login fails", "body": "always", "user": user("cyd"), "created_at": DAY, "updated_at": DAY},
        {"id": 21, "number": 7, "title": "a change, really", "pull_request": {"url": "x"}, "user": user("ann"), "updated_at": DAY},
    ],
    "commit": [{"sha": "abc", "commit": {"message": "closes: #8\n\nlong", "author": {"date": DAY}}, "author": None}],
    "review": [{"pr_number": 7, "id": 1, "user": user("bob")}, {"pr_number": 7, "id": 2, "user": user("ann")}, {"pr_number": 99, "id": 3, "user": user("bob")}],
    "changed_file": [{"pr_number": 7, "filename": "src/login.py"}, {"pr_number": 99, "filename": "lost.py"}],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    for kind, rows in PAYLOADS.items():
        (folder / kind).mkdir()
        (folder / kind / "rows.json").write_text("\n".join(map(json.dumps, rows)))
    read = lambda kind: landing.payload(spark, str(folder), kind)
    return build(read("repository"), read("pull_request"), landing.issues(spark, str(folder)), read("commit"), read("review"), read("changed_file"))


def test_build(tables):
    edges = {(r.src, r.relation, r.dst) for r in tables["relates_to"].collect()}
    assert ("pr:7", "RESOLVES", "ticket:12") in edges and ("commit:abc", "RESOLVES", "pr:8") in edges
    assert ("person:bob", "REVIEWED", "pr:7") in edges and ("person:ann", "REVIEWED", "pr:7") not in edges
    assert ("pr:7", "TOUCHES", "file:src/login.py") in edges and not any("lost" in e[2] for e in edges)
    assert ("commit:abc", "PART_OF", "repo:acme/tools") in edges and ("person:cyd", "REPORTED", "ticket:12") in edges
    labels = {r.id: r.label for r in tables["entity"].collect()}
    assert labels["commit:abc"] == "closes: #8" and labels["pr:7"] == "Fix login" and "ticket:7" not in labels


def test_ask(spark, tables):
    engine = Engine(spark, tables)
    hits = engine.retrieve("who reviewed ann", "2026-06-01").collect()
    # Of the graph arm 0.85 counts. bob is two steps off (0.95 * 0.85) and the file too (0.95 * 0.80), both without a time; the change is one step off but 31 days old.
    by_id = {h.id: h for h in hits}
    assert by_id["person:bob"].score == pytest.approx(0.85 * 0.95 * 0.85) and by_id["person:bob"].vector_score == 0
    assert by_id["file:src/login.py"].score == pytest.approx(0.85 * 0.95 * 0.80)
    assert by_id["pr:7"].score == pytest.approx(0.85 * 0.95 * 0.5 ** (31 / 60))
    order = [h.id for h in hits]
    assert order.index("person:bob") < order.index("file:src/login.py") < order.index("pr:7")
    assert {r.id for r in engine.route("ann").collect()} >= {"person:ann", "pr:7"}
    assert engine.impact("ann").first().id == "pr:7"
    assert {r.id: [c.doc for c in r.citations] for r in engine.impact_report("ann").collect()}["pr:7"] == ["doc:pr:7:0"]
    assert engine.lexical("where is login.py").first().id == "file:src/login.py"
    vectors = spark.createDataFrame([("pr:8", [1.0, 0.0]), ("pr:7", [0.0, 1.0])], "id string, embedding array<double>")
    far = Engine(spark, tables | {"vectors": vectors})
    assert far.route("nothing of it", vector=[0.9, 0.1]).first().id == "pr:8" and far.route("nothing of it", vector=[-1.0, -1.0]).count() == 0
    nodes, edges = engine.subgraph(tables["entity"].where("id = 'pr:7'").select("id"))
    assert {r.id for r in nodes.where("requested").collect()} == {"pr:7"} and edges.count() >= 4
    assert engine.suggestions(2).count() == 2
    cited = engine.citations(tables["entity"].select("id")).collect()
    assert {r.id for r in cited} == {"pr:7", "pr:8", "ticket:12", "commit:abc"}
    assert "Fix login" in engine.context("q", engine.retrieve("who reviewed ann", "2026-06-01")).first().context
    assert engine.lexical("Login fails where").first().id == "ticket:12"


def test_ingest_and_publish(spark, tables, tmp_path):
    engine = Engine(spark, {k: v for k, v in tables.items() if k != "unresolved"})
    new = {
        "entity": spark.createDataFrame([("pr:7", "renamed", "PR", None), ("pr:9", "new", "PR", None)], "id string, label string, type string, ts timestamp"),
        "relates_to": spark.createDataFrame([("person:ann", "pr:9", "AUTHORED", 0.95), ("person:ann", "pr:none", "AUTHORED", 0.95)], "src string, dst string, relation string, confidence double"),
    }
    after = engine.ingest(new)
    after.publish(str(tmp_path / "graph"), 1)
    engine.publish(str(tmp_path / "graph"), 2)
    first = Engine.open(spark, str(tmp_path / "graph"), 1)
    assert first.tables["entity"].where("id = 'pr:7'").first().label == "Fix login"
    assert first.tables["relates_to"].where("dst = 'pr:9'").count() == 1 and first.tables["relates_to"].where("dst = 'pr:none'").count() == 0
    assert Engine.open(spark, str(tmp_path / "graph")).tables["entity"].where("id = 'pr:9'").count() == 0
    with pytest.raises(ValueError):
        Engine.open(spark, str(tmp_path / "graph"), 5)


def test_malformed_rows_fail(spark, tmp_path):
    (tmp_path / "review").mkdir()
    (tmp_path / "review" / "x.json").write_text('{"pr_number": "seven"')
    with pytest.raises(Exception, match="(?i)malformed"):
        landing.payload(spark, str(tmp_path), "review").select(F.col("id")).collect()


def test_statistics_are_taken_while_writing(spark, tables, tmp_path_factory):
    from weftline.plans import persist

    folder = tmp_path_factory.mktemp("again")
    for kind, rows in PAYLOADS.items():
        (folder / kind).mkdir()
        (folder / kind / "rows.json").write_text("\n".join(map(json.dumps, rows)))
    read = lambda kind: landing.payload(spark, str(folder), kind)
    given = {"repository": read("repository"), "pull_requests": read("pull_request"), "issues": landing.issues(spark, str(folder)), "commits": read("commit"), "reviews": read("review"), "files": read("changed_file")}
    counted = persist.build_and_write(given, f"{folder}/graph")
    assert counted["reviews"] == {"rows": 3, "orphans": 1, "self_reviews": 1} and counted["changed_files"] == {"rows": 2, "orphans": 1}
    assert counted["commits"] == {"rows": 1, "without_author": 1} and counted["pull_requests"]["rows"] == 2
    for name in persist.TABLES:
        assert counted[f"written_{name}"]["rows"] == spark.read.parquet(f"{folder}/graph/{name}").count() == tables[name].count()


def test_local_trace_and_linked_seeds(spark, tables):
    engine = Engine(spark, tables)
    rows = engine.local_trace("why does the login always fail?", "acme/tools").orderBy("place").collect()
    first = rows[0]
    assert first.id in ("ticket:12", "pr:7") and first.answer.startswith("In the acme/tools recent history") and f"({first.uri})" in first.answer
    assert first.content.startswith(first.label) and 0 < first.overlap <= 1 and [r.place for r in rows] == list(range(1, len(rows) + 1))
    none = engine.local_trace("zebra quagga", "acme/tools").collect()
    assert {r.answer[:13] for r in none} == {"No text match"}
    named = spark.createDataFrame([("pay_service", "pay_service", "Service", None)], "id string, label string, type string, ts timestamp")
    vectors = spark.createDataFrame([("pay_service", [1.0, 0.0]), ("person:bob", [0.0, 1.0])], "id string, embedding array<double>")
    engine = Engine(spark, tables | {"entity": tables["entity"].unionByName(named), "vectors": vectors})
    assert [r.id for r in engine.linked("who owns PAY_SERVICE?").collect()] == ["pay_service"]
    asked = spark.createDataFrame([("bill_service", [0.05, 1.0]), ("other_service", [1.0, -1.0])], "name string, embedding array<double>")
    assert sorted(r.id for r in engine.linked("bob or ann on bill_service, other_service", asked).collect()) == ["person:ann", "person:bob"]
    assert "person:bob" in {r.id for r in engine.route("bill_service", vectors=asked).collect()}
