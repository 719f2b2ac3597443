"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from duskwatch.llm import (
    bpe,
    clustering,
    cotraining,
    debruijn,
    decontaminate,
    exact_search,
    html_text,
    licenses,
    quality_rules,
    sharding,
    simhash,
    suffix_array,
    whitening,
)
from duskwatch.llm.catalog import query
from duskwatch.llm.common import small_batches


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_extraction")
def op1(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op2_debruijn_dedup")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return debruijn.deduplicate(docs, keep_first=False).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return cotraining.classify(docs, labels).select("doc_id", "p_text", "p_meta", "p_good", "kept")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path(VOCABULARY)
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_license_scan")
def op5(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_sharding")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_simhash_near_dedup")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicate_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op9_quality_rules")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "anomaly",
    )


@query("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    small_batches(spark)  # whole texts, unzipped on both sides of the Python workers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_array.deduplicate(docs, keep_first=False).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeat"),
    )


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs.select("doc_id", "text"), items).drop("_k1", "_k2")


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(
        "vec_id",
        "component",
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


@query(
    "op12_exact_top_k",
    f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda v: floor({exact_search.SCALE} * CAST(v AS DOUBLE))) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
        FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
)
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_search.top_k(rows.where(F.col("vec_id") % 100 == 0), rows)


def _lloyd_sql() -> str:
    """Plain rounds of assignment and update."""
    parts = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({clustering.SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id)) - 1 AS INTEGER) AS cluster, x AS c FROM kept
        QUALIFY row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id)) <= {clustering.CLUSTERS})""",
    ]
    for r in range(clustering.ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min({{'d': d, 'c': cluster}}) AS best FROM (SELECT vec_id, x, cluster,
            CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY vec_id)"""
        )
        if r < clustering.ROUNDS:
            parts.append(
                f"""m{r} AS (SELECT cluster, list(v ORDER BY place) AS c FROM (SELECT cluster, place, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS v
                FROM (SELECT best.c AS cluster, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{r}) GROUP BY ALL) GROUP BY cluster),
                c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"""
            )
    last = f"a{clustering.ROUNDS}"
    return f"""WITH {", ".join(parts)} SELECT vec_id, best.c AS cluster, best.d AS distance,
    CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{clustering.ROUNDS} ON cluster = best.c"""


@query("op13_centroid_clustering", _lloyd_sql())
def op13(spark, sf_dir):
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
