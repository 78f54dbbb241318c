"""Registered queries of the corpus operators. Each takes (spark, folder of tables) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import centroids, collocations, lm, media, mixing, neardup, packing, pii, quality, sharding, topk, toxicity, urlfilter
from weftline.llm._spark import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents", "doc_id", "source"))
    return mixed.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("block_slot"), F.col("mix_position").alias("position"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf_dir, "pages", "page_id", "url"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.id_remainder("doc_id", 7) == 2
    scored = lm.score_documents(read(spark, sf_dir, "documents", "doc_id", "text"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = quality.id_remainder("doc_id", 4) == 2
    scored = toxicity.toxic_scores(documents, labels, ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", "cosines", "evidence_labels")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = quality.id_remainder("doc_id", 3) == 1
    scored = quality.classify(documents, quality.train(documents, labels, ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents", "lang", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = {k: F.col(k) for k in pii.KINDS}
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(base | {"term": F.col("term")}).alias("spans")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard": op2_shard,
    "op3_top_k": op3_top_k,
    "op4_url_filter": op4_url_filter,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_pack": op8_pack,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
    "op11_collocations": op11_collocations,
    "op12_centroids": op12_centroids,
    "op13_personal_data": op13_personal_data,
}

def _centroid_sql(rounds: int = 3, k: int = 16) -> str:
    """Every distance worked out anew in each round."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = f"SELECT v.rid, v.q, v.vec_id, arg_min(c.c, struct_pack(d := {distance}, c := c.c)) AS c, min({distance}) AS d FROM v, {{0}} c GROUP BY ALL"
    steps = [f"""v AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT q, (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1)::INTEGER AS c FROM v QUALIFY c < {k}
        )"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(f'c{r}')})")
        if r < rounds:
            mean = "list(((s - ((s % n) + n) % n) // n) ORDER BY pos)::BIGINT[]"
            steps.append(f"""c{r + 1} AS MATERIALIZED (
            SELECT coalesce(m.q, o.q) AS q, o.c FROM c{r} o LEFT JOIN (
                SELECT c, {mean} AS q FROM (SELECT c, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS pos FROM a{r}) GROUP BY c, pos) GROUP BY c
            ) m USING (c))""")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
        FROM (SELECT rid, vec_id, c, d FROM a{rounds}) JOIN c{rounds} USING (c)
    """


ORACLE_SQL: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, len(embedding) AS width FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.width = b.width
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
        QUALIFY rank <= 5
    """,
    "op4_url_filter": r"""
        WITH p AS (
            SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
            FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
        ), r(verdict, h, q) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), hit AS (
            SELECT p.host, p.path, arg_max(r.h || r.q, length(r.h || r.q)) AS rule, arg_max(r.verdict, length(r.h || r.q)) AS verdict
            FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
            GROUP BY ALL
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (host, path)
    """,
    "op11_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
        ), sizes AS (
            SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
        ), f AS MATERIALIZED (
            SELECT lang, k, phrase, count(*) AS a FROM (
                SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
                FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
            ) GROUP BY ALL HAVING count(*) >= 100
        ), c AS (
            SELECT f.*, cut, string_split(phrase, ' ') AS ws FROM f, (SELECT unnest(range(1, 5)) AS cut) WHERE cut < f.k
        ), s AS (
            SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM c JOIN sizes USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(ws, 1, cut), ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(ws, cut + 1, c.k), ' ')
        ), best AS (
            SELECT lang, phrase, k, a, n, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, cut := cut)) AS b FROM s GROUP BY ALL
        ), kept AS (
            SELECT * FROM best WHERE NOT EXISTS (
                SELECT 1 FROM f g WHERE g.lang = best.lang AND g.k > best.k AND 100 * g.a >= 100 * best.a AND contains(' ' || g.phrase || ' ', ' ' || best.phrase || ' '))
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM kept QUALIFY rank <= 2000
    """,
    "op12_centroids": _centroid_sql(),
}
