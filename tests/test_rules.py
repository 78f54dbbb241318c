"""Text and score rules on hand cases, folds and walks on small graphs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.functions import scoring, text, vectors
from weftline.operators import documents, entities, traces
from weftline.plans import retrieval
from weftline.streaming.debounce import bursts, fold


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "strict", "loose"),
    [("Fixes #12", [12], [12]), ("closes: #8", [8], []), ("prefix #3", [], [3]), ("resolved#4", [4], []), ("fix #1 FIXED #1 close #2", [1, 2], [1, 2]), ("see #5", [], [])],
)
def test_closing_references(spark, said, strict, loose):
    assert one(spark, text.closing_numbers(F.lit(said))) == strict
    assert one(spark, text.closing_numbers(F.lit(said), text.CLOSING_LOOSE)) == loose


def test_text_rules(spark):
    assert one(spark, text.tokens(F.lit("The #12 fix-it and A_b ab the"))) == ["#12", "fix-it", "a_b"]
    assert one(spark, text.slug(F.lit("--Ünï x--"))) == "n-x" and one(spark, text.slug(F.lit("!!"), 60, "query")) == "query"
    assert one(spark, text.node_label(F.lit("id"), F.lit(""), F.lit("  first\nsecond"))) == "first"
    assert one(spark, text.node_label(F.lit("id"), F.lit(None).cast("string"))) == "id" and len(one(spark, text.node_label(F.lit("id"), F.lit("x" * 300)))) == 200
    assert one(spark, text.intent(F.lit("Who owns it?")))["marker"] == "who" and one(spark, text.intent(F.lit(" ")))["stage"] == "fallback"
    assert one(spark, text.intent(F.lit("explain it"), F.lit(True)))["intent"] == "semantic" and one(spark, text.intent(F.lit("ann"), F.lit(True)))["stage"] == "named"
    assert one(spark, text.without_comments(F.lit("a<!-- x\n-->b<!-- open"))) == "a b "


def test_scores(spark):
    now, ts = F.lit(dt.datetime(2026, 6, 1)), lambda d: F.lit(d).cast("timestamp")
    assert one(spark, scoring.decay(ts(dt.datetime(2026, 4, 2)), F.lit("PR"), now)) == pytest.approx(0.5)
    assert one(spark, scoring.decay(ts(None), F.lit("PR"), now)) == 1.0 and one(spark, scoring.decay(ts(dt.datetime(1970, 1, 1)), F.lit("PR"), now)) == 1.0
    assert one(spark, scoring.decay(ts(dt.datetime(2020, 1, 1)), F.lit("odd"), now)) == 0.35
    assert one(spark, scoring.edge_price(F.lit("odd"), F.lit(0.5))) == pytest.approx(0.175)
    assert one(spark, vectors.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0] and one(spark, vectors.cosine(F.array(F.lit(3.0)), F.array(F.lit(-1.0)))) == -1.0
    with pytest.raises(Exception, match="wrong width"):
        one(spark, vectors.checked_width(F.array(F.lit(1.0)), 2, F.lit("node x")))


def test_rule_entities_and_references(spark):
    said = ["PR #12 and issue #412, page#42; payment_service, self-service", "#7", None, "x #410 #410 pr9-service", "a_b-svc"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(said)], "doc string, content string")
    got = sorted((r.doc, r.start, r.end, r.text, r.type) for r in entities.extract_entities(rows).collect())
    assert got == [("0", 0, 6, "PR #12", "PR"), ("0", 11, 21, "issue #412", "Ticket"), ("0", 32, 47, "payment_service", "Service"), ("3", 2, 6, "#410", "Ticket"), ("3", 12, 15, "pr9", "PR"), ("4", 0, 7, "a_b-svc", "Service")]
    model = spark.createDataFrame([("0", "PR", "Org", 0, 2), ("0", "and", "Org", 7, 10)], "doc string, text string, type string, start int, end int")
    assert [(r.text, r.score) for r in entities.extract_entities(rows, model).where("type = 'Org'").collect()] == [("and", 0.5)]
    rows = spark.createDataFrame([("d", "pay_service here, and then pay_service; see (pay_service).")], "doc string, content string")
    model = spark.createDataFrame([("d", "(pay_service).", "Service", 43, 57), ("d", " here,", "Place", 11, 17), ("d", "then", "Place", 22, 26), ("d", "here", "Place", 12, 16), ("d", "(a)", "Place", 0, 3)], "doc string, text string, type string, start int, end int")
    got = sorted(((r.text, r.type, r.start, r.end, r.score) for r in entities.extract_entities(rows, model).collect()), key=repr)
    assert got == [("here", "Place", 12, 16, 0.5), ("pay_service", "Service", 0, 11, 1.0), ("then", "Place", 22, 26, 0.5)]
    said = [
        '<a href="https://github.com/acme/tools/issues/5">#5</a> <a href="https://x.y/1">#6</a> github.com/Acme/Tools/pull/9 other/repo#3 acme/tools#4 #8 a#1',
        '<a href="https://github.com/acme/tools/pull/5">#480</a> #480', None, "",
    ]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(said)], "doc string, content string")
    assert {r.doc: r.numbers for r in entities.references(rows, "acme/tools").collect()} == {"0": ["5", "9", "4", "8"], "1": ["480"], "2": [], "3": []}


def test_span_depths_of_deep_and_cyclic_runs(spark):
    rows = [("deep", str(i), str(i - 1) if i else None) for i in range(80)]
    rows += [("cycle", "a", "b"), ("cycle", "b", "c"), ("cycle", "c", "a"), ("cycle", "tail", "a"), ("cycle", "end", "tail"), ("cycle", "self", "self"), ("cycle", "lost", "nowhere"), ("cycle", "root", None), ("cycle", "leaf", "root")]
    got = {(r.run, r.id): r.depth for r in traces.span_depths(spark.createDataFrame(rows, "run string, id string, parent_id string")).collect()}
    assert all(got["deep", str(i)] == i for i in range(80)) and len(got) == len(rows)
    assert {k[1]: v for k, v in got.items() if k[0] == "cycle"} == {"a": 2, "b": 2, "c": 2, "tail": 3, "end": 4, "self": 0, "lost": 0, "root": 0, "leaf": 1}
    assert traces.span_depths(spark.createDataFrame([], "run string, id string, parent_id string")).count() == 0


def test_streamed_state_survives_a_restart(spark, tmp_path):
    from weftline.operators import folds
    from weftline.streaming import ingest

    source, folder = tmp_path / "in", str(tmp_path / "state")
    schema = "id string, label string, type string, ts timestamp, seq long"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/n={n}")

    def fold(last, batch):
        both = batch if last is None else last.withColumn("seq", F.lit(-1).cast("long")).unionByName(batch)
        return folds.upsert_entities(both)

    def go():
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        return {r.id: r.label for r in ingest.run_to_end(stream, folder, ["id"], fold).collect()}

    source.mkdir()
    put([], 0)
    assert go() == {}
    put([(f"a{i}", "first", "x", None, i) for i in range(40)], 1)
    assert go() == {f"a{i}": "first" for i in range(40)}
    put([("a3", "second", "x", None, 50), ("new", "new", "x", None, 51)], 2)  # a new query object, as after a restart
    assert go() == {f"a{i}": "first" for i in range(40)} | {"new": "new"} and go()["a3"] == "first"
    newest = ingest._newest(spark, folder)
    assert len({*newest.values()}) == 2 and sum(n == max(newest.values()) for n in newest.values()) <= 2


def test_windows(spark):
    rows = spark.createDataFrame([("a", "w " * 5), ("b", " "), ("c", "x" * 30), ("d", " " * 30)], "base string, content string")
    got = documents.word_windows(rows, 3, 1).collect()
    assert [(r.base, r.idx, r.begin, r.finish) for r in got] == [("a", 0, 0, 5), ("a", 1, 4, 9), ("c", 0, 0, 30)]
    assert sorted(r.chunk_id for r in documents.char_chunks(rows, 12, 2).collect()) == ["a:0", "c:0", "c:1", "c:2"]


def graph(spark):
    edges = spark.createDataFrame([("a", "b", "AUTHORED", 0.95), ("b", "c", "TOUCHES", 0.8), ("c", "d", "TOUCHES", 0.8)], "src string, dst string, relation string, confidence double")
    entity = spark.createDataFrame([(x, x, "File", None) for x in "abcd"], "id string, label string, type string, ts timestamp")
    return edges, entity


def test_walks(spark):
    edges, entity = graph(spark)
    seeds = entity.where("id = 'a'").select("id")
    assert [(r.id, round(r.score, 4), r.hops) for r in retrieval.best_path_walk(edges, entity, seeds).collect()] == [("b", 0.95, 1), ("c", 0.76, 2)]
    assert {r.id: round(r.score, 4) for r in retrieval.router_walk(edges, entity, seeds).collect()}["c"] == 0.76
    assert [(r.id, r.hops) for r in retrieval.impact(edges, entity, seeds, 3).collect()][:3] == [("b", 1), ("a", 2), ("c", 2)]


def test_trace_versions(spark):
    bad = spark.createDataFrame([(9,)], "schema_version int").select("schema_version", *[F.lit(None).cast(t).alias(n) for n, t in (("query", "string"), ("answer", "string"), ("arm", "string"), ("items", f"array<{traces.ITEM}>"), ("edges", f"array<{traces.EDGE}>"), ("retrievals", f"array<struct<query:string,arm:string,items:array<{traces.ITEM}>,edges:array<{traces.EDGE}>>>"))])
    with pytest.raises(Exception, match="newer version"):
        traces.upgraded(bad).collect()
    empty = traces.upgraded(bad.withColumn("schema_version", F.lit(None).cast("int"))).first()
    assert empty.schema_version == 4 and empty.retrievals == []


def test_bursts(spark):
    times = [0, 90, 180, 270, 360, 450, 540, 630, 900]
    want = fold(times, 120, 600)
    assert [(a, n) for a, _, n in want] == [(0, 7), (630, 1), (900, 1)]
    rows = spark.createDataFrame([(1, t) for t in times] + [(2, 5)], "key long, t long")
    got = sorted((r.key, r.first, r.last, r.n) for r in bursts(rows, 120, 600).collect())
    assert got == [*[(1, *b) for b in want], (2, 5, 5, 1)]


def test_scan_of_keys_that_fail(spark):
    from weftline.operators.scan import fetch_each

    tried = []

    def fetch(key):
        tried.append(key)
        if key == 2:
            raise ValueError("gone")
        return [f'{{"n": {key}}}', "{}"] if key < 4 else []

    got = fetch_each(spark.createDataFrame([(1,), (2,), (3,), (4,)], "key long"), fetch, wait=0).collect()
    assert sorted((r.key, r.payload, r.error) for r in got if r.payload) == [(1, '{"n": 1}', None), (1, "{}", None), (3, '{"n": 3}', None), (3, "{}", None)]
    assert [(r.key, r.error) for r in got if r.error] == [(2, "gone")]
