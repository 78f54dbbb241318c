"""Text rules as column expressions: tokens, overlap, slugs, references, labels, excerpts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.options import QUESTION_WORDS, RELATIONAL_MARKERS, SEMANTIC_MARKERS, STOP_WORDS

# The languages that the rules accept.
TOKEN = r"[a-z0-9#][a-z0-9_#-]{2,}"
CLOSING_STRICT = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s*#(\d+)"
CLOSING_LOOSE = r"(?i)(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s+#(\d+)"
SOURCE_SUFFIXES = (
    "py", "pyi", "js", "jsx", "ts", "tsx", "go", "rs", "java", "kt", "c", "h", "cpp", "hpp", "cs", "rb", "php", "swift", "scala", "sh", "sql", "md", "rst",
    "txt", "toml",
)
EXCLUDED_FOLDERS = (
    ".git", ".venv", "venv", "node_modules", "vendor", "dist", "build", "__pycache__", ".next", "coverage", ".ssh", "secrets", "credentials",
)


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def running(name: str) -> Column:
    """The sums of an array column of integers up to each place. The reach doubles, so that n places take n log n steps and no shuffle."""
    reach = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.greatest(F.size(name) - 1, F.lit(1)))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(reach, F.col(name), lambda sums, d: F.transform(sums, lambda x, i: F.when(i < d, x).otherwise(x + F.get(sums, i - d))))


def tokens(text: Column, more_stop_words: Sequence[str] = ()) -> Column:
    """Distinct lower-cased tokens of three characters or more, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))
    return F.array_except(found, _strings([*STOP_WORDS, *more_stop_words]))


def question_tokens(text: Column) -> Column:
    return tokens(text, QUESTION_WORDS)


def overlap(item_tokens: Column, answer_tokens: Column) -> Column:
    """Share of the item's tokens that the answer holds; 0 if either has none."""
    either_empty = (F.size(item_tokens) == 0) | (F.size(answer_tokens) == 0)
    return F.when(either_empty, 0.0).otherwise(F.size(F.array_intersect(item_tokens, answer_tokens)) / F.size(item_tokens))


def is_used(score: Column, threshold: float) -> Column:
    return score >= threshold


def fate(score: Column, threshold: float) -> Column:
    """used, ignored, or unclassified where nothing was measured."""
    return F.when(score.isNull(), "unclassified").when(score >= threshold, "used").otherwise("ignored")


def slug(text: Column, limit: int | None = None, empty: str = "x") -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    if limit:
        dashed = F.regexp_replace(F.substring(dashed, 1, limit), r"-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(empty))


def entity_node_id(kind: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("entity"), slug(kind), slug(text))


def closing_numbers(text: Column, pattern: str = CLOSING_STRICT) -> Column:
    """Distinct numbers that a text says it closes, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.cast("long")))


def document_text(title: Column, body: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n\n", blank(title), blank(body))


def node_label(node_id: Column, *fields: Column, limit: int = 200) -> Column:
    """First line of the first field that is not empty, at most ``limit`` characters with an ellipsis, else the id."""
    text = F.trim(F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], node_id))
    first = F.trim(F.regexp_extract(text, r"^[^\r\n]*", 0))
    short = F.when(F.length(first) > limit, F.concat(F.rtrim(F.substring(first, 1, limit - 1)), F.lit("…"))).otherwise(first)
    return F.when(first == "", node_id).otherwise(short)


def one_line(text: Column, limit: int) -> Column:
    """White space collapsed, at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def without_comments(text: Column) -> Column:
    """Text without HTML comments, an unclosed one to the end."""
    return F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", " ")


def first_marker(query: Column, markers: Sequence[str]) -> Column:
    """The first of the markers that is part of the query."""
    low = F.lower(query)
    return F.get(F.filter(_strings(markers), lambda m: F.contains(low, m)), F.lit(0))


def intent(query: Column, named: Column | None = None) -> Column:
    """Struct of intent, stage and marker: relational words first, then semantic ones, then a named node, else semantic."""
    relational, semantic = first_marker(query, RELATIONAL_MARKERS), first_marker(query, SEMANTIC_MARKERS)
    row = lambda i, stage, m: F.struct(F.lit(i).alias("intent"), F.lit(stage).alias("stage"), m.alias("marker"))
    none = F.lit(None).cast("string")
    return (
        F.when(F.trim(F.coalesce(query, F.lit(""))) == "", row("semantic", "fallback", none))
        .when(relational.isNotNull(), row("relational", "marker", relational))
        .when(semantic.isNotNull(), row("semantic", "marker", semantic))
        .when(F.lit(False) if named is None else named, row("relational", "named", none))
        .otherwise(row("semantic", "fallback", none))
    )


def eligible_source(path: Column, kind: Column, mode: Column, size: Column) -> Column:
    """Whether a file of a repository may be read: a plain text-like file of bounded size outside private places."""
    low = F.lower(path)
    parts, name = F.split(low, "/"), F.regexp_extract(low, r"[^/]*$", 0)
    return (
        (kind == "blob") & mode.isin("100644", "100755") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")
        & (F.size(F.array_intersect(parts, _strings(EXCLUDED_FOLDERS))) == 0) & ~name.rlike(r"^(\.env|id_rsa|id_ed25519)") & ~name.rlike("secret|credential")
        & F.regexp_extract(name, r".\.([^.]+)$", 1).isin(*SOURCE_SUFFIXES) & (size > 0) & (size <= 128 * 1024)
    )


def safe_url(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")
