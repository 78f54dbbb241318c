"""Windowed extraction, its sweep, and mentions, against whole texts."""

import re

from pyspark.sql import functions as F

from weftline.operators.entities import matches
from weftline.options import Options
from weftline.plans import mentions


def pairs(windows):
    found = matches(windows.select("base", "idx", "content"), "content", r"[A-Z][a-z]+(?: [A-Z][a-z]+)*")
    return found.select("base", "idx", F.col("found").alias("text"), F.lit("Name").alias("type"), "start", "end")


def test_windows_and_sweep_give_whole_spans(spark):
    said = ["the New York City Hall " * 9 + "ends", "  Ann  and\nBob Lee ", "", None, "none here", "Über Alles gut"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(said)], "doc string, content string").repartition(2)
    windows = mentions.word_windows(rows.withColumnRenamed("doc", "base"), 7, 4)
    got = mentions.swept(mentions.placed(windows, pairs(windows))).collect()
    want = [(str(i), m[0], m.start(), m.end()) for i, t in enumerate(said) for m in re.finditer(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*", t or "")]
    assert sorted((r.doc, r.text, r.start, r.end) for r in got) == sorted(want)


def test_parts_that_overlap_are_put_together(spark):
    spans = [("d", "New York", "N", 0, 8), ("d", "York City", "N", 4, 13), ("d", "City Hall", "N", 9, 18), ("d", "York", "N", 4, 8), ("d", "York", "M", 4, 8), ("d", "Next", "N", 18, 22), ("e", "York", "N", 4, 8)]
    got = mentions.swept(spark.createDataFrame(spans, "doc string, text string, type string, start int, end int")).collect()
    assert sorted((r.doc, r.type, r.text, r.start, r.end) for r in got) == [("d", "M", "York", 4, 8), ("d", "N", "New York City Hall", 0, 18), ("d", "N", "Next", 18, 22), ("e", "N", "York", 4, 8)]


def test_mentions_and_resolution(spark):
    rows = [("a", "PR #12 touches order_service, Acme Corp"), ("b", "ORDER_SERVICE and issue #90, pull request 12, #90, Acme Corps"), ("c", None)]
    docs = spark.createDataFrame(rows, "doc string, content string")
    known = spark.createDataFrame([("pr:12",), ("ticket:1",)], "id string")
    made = mentions.document_mentions(docs, pairs, known=known, options=Options(window_words=4, window_overlap=2))
    entity = {r.id: (r.label, r.type, r.new) for r in made["entity"].collect()}
    assert entity["pr:12"] == ("PR #12", "PR", False) and entity["service:order_service"] == ("order_service", "Service", True) and "ticket:90" in entity
    got = {(r.doc, r.entity) for r in made["mentions"].collect()}
    assert {("a", "pr:12"), ("b", "pr:12"), ("a", "service:order_service"), ("b", "service:order_service"), ("b", "ticket:90")} <= got
    vectors = spark.createDataFrame([("Acme Corp", "Name", [1.0, 0.0]), ("Acme Corps", "Name", [1.0, 0.1]), ("order_service", "Service", [0.0, 1.0])], "text string, type string, embedding array<double>")
    made = mentions.document_mentions(docs, pairs, vectors, options=Options(window_words=4, window_overlap=2))
    assert {r.id for r in made["entity"].where("type = 'Name'").collect()} >= {"name:acme corp"}
    assert "name:acme corps" not in {r.id for r in made["entity"].collect()} and ("b", "name:acme corp") in {(r.doc, r.entity) for r in made["mentions"].collect()}
