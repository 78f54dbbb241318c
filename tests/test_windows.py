"""Windows of words and the lines they span, against plain Python, for odd texts and repeated names."""

import random
import re

from pyspark.sql import functions as F

from weftline.functions.text import running
from weftline.operators.documents import word_windows
from weftline.operators.entities import HELD, RULES, matches
from weftline.operators.records import source_windows
from weftline.options import Options
from weftline.plans import mentions


def plain(text, size, overlap):
    words, step = list(re.finditer(r"\S+", text)), size - overlap
    last = max(0, -(-(len(words) - size) // step))
    for i in range(last + 1 if words else 0):
        part = words[i * step : i * step + size]
        begin, finish = part[0].start(), part[-1].end()
        yield i, begin, finish, text[begin:finish], f"p#L{text.count(chr(10), 0, begin) + 1}-L{text.count(chr(10), 0, finish) + 1}"


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 4, 5, 31, 32, 33):
        assert spark.createDataFrame([([*range(n)],)], "a array<int>").select(running("a")).first()[0] == [i * (i + 1) // 2 for i in range(n)]


def test_windows_and_their_lines(spark):
    rng = random.Random(2)
    texts = ["", " \n", "a", "\n\na", "a b\n", *("".join(rng.choice(["a", "Bb", "é", "𝔘"]) + rng.choice([" ", "\n", " \n\n", "\t"]) for _ in range(n)) for n in (2, 3, 4, 7, 8, 61))]
    for size, overlap in ((3, 1), (7, 4), (5, 0), (6, 3), (1, 0)):
        want = sorted(x for t in texts for x in plain(t, size, overlap))
        rows = spark.createDataFrame([("p", t) for t in [*texts, None]], "base string, content string")  # one name for all
        found = word_windows(rows, size, overlap)
        assert sorted(tuple(r)[1:] for r in found.collect()) == [x[:4] for x in want]
        lined = source_windows(rows.withColumnRenamed("base", "path"), size, overlap)
        assert sorted((r.idx, r.content, r.path) for r in lined.collect()) == sorted((x[0], x[3], x[4]) for x in want)
        plan = lined._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan  # no window meets its text again


def test_matches_and_spans_are_not_shuffled_before_the_sweep(spark):
    def model(windows):
        return matches(windows.select("base", "idx", "content"), "content", r"[A-Z][a-z]+ [a-z]+").select("base", "idx", F.col("found").alias("text"), F.lit("Name").alias("type"), "start", "end")

    texts = ["one Two three PR 5 Four five", "six\n Seven eight nine Ten eleven twelve issue #3", "my-SVC x"]
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc string, content string")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(matches(rows, "content", r"\w+")) and "Join" not in plan(mentions.extracted(rows, model, Options(window_words=4, window_overlap=2)))
    got = {(r.text, r.start, r.end) for r in mentions.extracted(rows, model, Options(window_words=4, window_overlap=2)).where("type = 'Name'").collect()}
    assert got == {(m[0], m.start(), m.end()) for t in texts for m in re.finditer(r"[A-Z][a-z]+ [a-z]+", t)}
    for kind, pattern in RULES:  # no match is lost by what is looked for first
        assert not [t for t in ("PR5", "pull requests\n#6", "Pull-Request7", "#8", "Issues #9", "a_svc", "B-Service") if re.search(pattern, t) and not re.search(HELD[kind], t)]
