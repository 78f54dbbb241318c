"""Personal data: spans by pattern, and terms that reveal a protected value by their co-occurrence with it.

DataFrame operations only. **Base spans**: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, found
leftmost and without overlaps for each kind; a match that fails its kind's test is dropped and not tried again.

**Disclosure** (information-theoretic sanitisation): every distinct value found is a protected entity e. Terms are runs of
letters, lower-cased, in texts whose e-mail addresses are blanked; a term's context with a mention are the words that
begin and end within ``REACH`` characters of it and on this side of the next match of its kind. With f(e, t) a term's
occurrences in contexts of e, f(t) its occurrences in the corpus, p(e) the share of all words that lie in contexts of e:

    PMI(e; t) = log2((f(e, t) / f(t)) / p(e)),   IC(e) = -log2 p(e)

A term that has met e in ``MIN_CONTEXTS`` different contexts and whose PMI reaches ``ALPHA`` x IC(e) tells as much as the
value itself. All its occurrences become spans of kind ``term``, but those that overlap a base span. It is generalised to its longest
beginning of ``FORMS`` letters (``berlin`` to ``berli*``) that does not disclose any e so; if there is none it is removed.
Contexts that are equal (copies) count once towards ``MIN_CONTEXTS``. Work is linear in texts and mentions: no pairs of
terms are made, each mention meets the words next to it.

Null texts are empty. Null and repeated ids are kept; equal texts have equal spans. An empty table gives an empty result.
Other columns are not read. Patterns use possessive quantifiers, so that long runs cost linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import materialize

KINDS = ("email", "ip", "card", "phone")
#: The given patterns with possessive quantifiers; a match can only begin where a run of its characters does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{M}]++"
REACH = 64
MIN_CONTEXTS = 3
ALPHA = 0.95
#: Letters that a generalised term keeps.
FORMS = (5, 3)
#: Parts that the rows of one text are dealt over.
SALTS = 64
#: Up to so many terms or texts go to every executor; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Elements of an array that is appended to; longer lists are kept as lists of such blocks.
BLOCK = 256
_NO_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches, in code points: what lies between matches says where they are.

    Lengths are summed in blocks, and blocks' sums between them, since an array that grows by one element is copied.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(F.length(gap).cast("long").alias("gap"), value.alias("value")))
    long = lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0)).cast("long")
    none = F.lit(0).cast("long")

    def put(s: Column, x: Column) -> Column:
        start, end = s["at"] + x["gap"], s["at"] + long(x)
        return F.struct(end.alias("at"), F.array_append(s["found"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("found"))

    def inside(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_NO_SPANS).alias("found")), put, lambda s: s["found"])

    def whole(every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(every) / BLOCK)), lambda b: F.slice(every, b.cast("int") * BLOCK + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, lambda block: F.aggregate(block, none, lambda t, x: t + long(x)))
        before = F.aggregate(sums, F.array(none), lambda t, x: F.array_append(t, F.element_at(t, -1) + x))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), inside))

    every = F.transform(F.array(pairs), whole)[0]  # one evaluation of the pattern, whose result is named in ``whole``
    return F.filter(every, lambda x: x["value"].isNotNull())  # the last gap has no match


def _luhn(digits: Column) -> Column:
    def step(total: Column, at: Column) -> Column:
        d = F.reverse(digits).substr(at, F.lit(1)).cast("int") * (2 - at % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of a kind counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of a kind's spans."""
    found = F.filter(places(text, PATTERNS[kind]), lambda x: passes(kind, x["value"]))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(_NO_SPANS))


def _blanked(text: Column) -> Column:
    """The text without its e-mail addresses."""
    return F.when(text.rlike(HINTS["email"]), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _forms(word: Column) -> Column:
    """A word and the beginnings that it can be generalised to."""
    return F.array_compact(F.array(word, *[F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in FORMS]))


def mentions(texts: DataFrame) -> DataFrame:
    """entity (``kind:value``), before and after: what stands next to each mention of a protected value."""
    found = []
    for kind in KINDS:
        text = F.col("text") if kind == "email" else _blanked(F.col("text"))
        cut = texts.where(F.col("text").rlike(HINTS[kind])).select(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("values"))
        # Both sides are cut before the rows are exploded: no text goes further.
        left = F.transform("gaps", lambda g: F.substring(g, -(REACH + 1), REACH + 1))
        right = F.transform(F.slice("gaps", 2, 1 << 30), lambda g: F.substring(g, 1, REACH + 1))
        rows = cut.select(F.explode(F.filter(F.arrays_zip(left.alias("before"), F.col("values").alias("value"), right.alias("after")), lambda x: x["value"].isNotNull())).alias("m")).select("m.*")
        rows = rows.where(passes(kind, F.col("value")))
        value = F.lower("value") if kind == "email" else F.regexp_replace("value", "[^0-9.]" if kind == "ip" else "[^0-9]", "")
        found.append(rows.select(F.concat(F.lit(f"{kind}:"), value).alias("entity"), _blanked(F.col("before")).alias("before"), _blanked(F.col("after")).alias("after")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # A word that the reach cuts is left out.
    edge = lambda side, pattern: F.when(F.length(side) > REACH, F.regexp_replace(side, pattern, "")).otherwise(F.col(side))
    return rows.select("entity", edge("before", r"^[\p{L}\p{M}]+").alias("before"), edge("after", r"[\p{L}\p{M}]+$").alias("after"))


def _small(frame: DataFrame) -> DataFrame:
    """A written frame, broadcast if it is small enough."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def revealing_terms(texts: DataFrame, alpha: float = ALPHA, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """term, entity (that it reveals most), disclosure (PMI / IC) and form (what it is generalised to; null: removed). texts: column text."""
    near = materialize(mentions(texts), "pii-mentions")
    words = near.select("entity", F.xxhash64("before", "after").alias("context"), F.explode(F.concat(_words(F.col("before")), _words(F.col("after")))).alias("word"))
    around = words.groupBy("entity").agg(F.count(F.lit(1)).alias("reach"))
    met = words.select("entity", "context", F.explode(_forms(F.col("word"))).alias("form")).groupBy("entity", "form", "context").agg(F.count(F.lit(1)).alias("n"))
    met = met.groupBy("entity", "form").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= min_contexts)
    met = materialize(met.join(around, "entity"), "pii-met")

    every = texts.select(_words(_blanked(F.col("text"))).alias("words"))
    total = every.agg(F.sum(F.size("words"))).first()[0] or 0
    forms = every.select(F.explode("words").alias("word")).select(F.explode(_forms(F.col("word"))).alias("form"))
    wanted = materialize(met.select("form").distinct(), "pii-forms")
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:
        counts = forms.join(F.broadcast(wanted), "form").groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    else:  # counted first, so that a frequent word is a row for each task
        counts = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).join(wanted, "form")
    share = F.least(F.col("both") / F.col("n"), F.lit(1.0))
    known = -F.log2(F.col("reach") / F.lit(max(total, 1)))
    # Were all words in contexts of one value, it would have no information to disclose.
    disclosure = F.when(known > 0, 1 + F.log2(share) / known).otherwise(F.lit(0.0))
    judged = materialize(met.join(counts, "form").select("entity", "form", disclosure.alias("disclosure")).where(F.col("disclosure") >= alpha), "pii-judged")

    terms = judged.where(~F.col("form").endswith("*")).groupBy(F.col("form").alias("term")).agg(F.max_by("entity", F.struct("disclosure", "entity")).alias("entity"), F.max("disclosure").alias("disclosure"))
    open_forms = judged.where(F.col("form").endswith("*")).select("form").distinct()
    steps = terms.select("term", F.explode(F.slice(_forms(F.col("term")), 2, len(FORMS))).alias("form")).join(open_forms, "form", "left_anti")
    best = steps.groupBy("term").agg(F.max_by("form", F.length("form")).alias("form"))
    return materialize(terms.join(best, "term", "left"), "pii-terms")


def _term_spans(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """digest, salt and the spans of revealing terms, for the texts that hold any. documents: text, digest, salt."""
    listed = _small(terms.select(F.col("term").alias("word")))
    hits = documents.select("digest", "salt", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).join(listed, "word").select("digest", "salt").distinct()
    hits = _small(materialize(hits, "pii-hits"))
    found = documents.join(hits, ["digest", "salt"], "left_semi").select("digest", "salt", F.explode(places(F.col("text"), WORD)).alias("m"))
    found = found.select("digest", "salt", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.lower("m.value").alias("word"))
    found = found.join(_small(terms.withColumnRenamed("term", "word")), "word").groupBy("digest", "salt", "start", "end", "word", "form").agg(F.lit(1))
    return found.groupBy("digest", "salt").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "form"))).alias("terms"))


def _cuts(spans: list[tuple[str, Column]]) -> Column:
    """What is cut out of a text: (start, end, by) in order; of spans that overlap the first, then the longer, counts."""
    kind = "array<struct<start:bigint,end:bigint,by:string>>"

    def part(name: str, spans_of: Column) -> Column:
        by = lambda x: F.lit(f"[{name}]") if name != "term" else F.coalesce(x["form"], F.lit("[term]"))
        return F.transform(spans_of, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), by(x).alias("by")))

    every = F.concat(*[part(name, spans_of) for name, spans_of in spans])
    ordered = F.transform(F.array_sort(every), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["by"].alias("by")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("kept"))
    put = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)

    def apart(every: Column) -> Column:
        clash = F.exists(F.zip_with(every, F.slice(every, 2, 1 << 30), lambda x, y: F.coalesce(y["start"] < x["end"], F.lit(False))), lambda x: x)
        return F.when(clash, F.aggregate(every, zero, put, lambda s: s["kept"])).otherwise(every)

    return F.transform(F.array(ordered), apart)[0]


def _replaced(text: Column, cuts: Column) -> Column:
    """The text with every cut replaced."""
    after = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda x: x["end"]))
    part = lambda at, x: F.concat(text.substr((at + 1).cast("int"), F.coalesce(x["start"] - at, F.lit(1 << 30)).cast("int")), F.coalesce(x["by"], F.lit("")))
    return F.concat_ws("", F.zip_with(after, cuts, part))


def find_personal_data(documents: DataFrame, alpha: float = ALPHA, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """doc_id, an array of (start, end, value) for each kind of ``KINDS``, ``term`` (array of start, end, word, form) and clean_text.

    In clean_text base spans are ``[kind]``, terms their general form or ``[term]``; of spans that overlap the first, then the longer, counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    terms = revealing_terms(rows.select("text"), alpha, min_contexts)
    keyed = rows.withColumns({"digest": F.sha2("text", 256), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    more = _term_spans(keyed.select("text", "digest", "salt"), terms)
    found = keyed.withColumns({k: base_spans(F.col("text"), k) for k in KINDS}).join(more, ["digest", "salt"], "left")
    base = F.concat(*[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS])
    found = found.withColumns({"base": base, "terms": F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,word:string,form:string>>"))})
    found = found.withColumn("term", F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    found = found.withColumn("cuts", _cuts([(k, F.col(k)) for k in (*KINDS, "term")]))
    return found.select("doc_id", *KINDS, "term", _replaced(F.col("text"), F.col("cuts")).alias("clean_text"))


def span_text(spans: dict[str, Column]) -> Column:
    """``kind:start:end`` of arrays of spans, joined by commas; spans: by kind."""

    def part(kind: str, spans_of: Column) -> Column:
        return F.transform(spans_of, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*[part(kind, spans_of) for kind, spans_of in spans.items()]), ",")
