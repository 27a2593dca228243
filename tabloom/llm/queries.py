"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import table
from tabloom.llm.merkle_sql import manifest_sql


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.toxicity import toxicity
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.ngram_join import jaccard_components
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, 5, 75).select("doc_id", "n_shingles", "component_id")


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.decontaminate import benchmark_hits, digest
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(benchmark_hits(docs, table(spark, sf_dir, "benchmark"), 10))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.packing import digest, pack
    return digest(pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(),
                       ranks=vocabulary("byte_bpe_50k.tiktoken"), with_ids=False))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.pitman_yor import corpus_scores
    out = corpus_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.top_products import top_products
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20, 20, 64)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.warc import derive, page_responses, summary
    return summary(derive(page_responses(table(spark, sf_dir, "pages"), ("page_id",)), ("page_id",)))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.suffix_dedup import digest, remove_repeats
    return digest(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 100))


def op9_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.extract import extract_text
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), 1024)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.merkle import check
    return check(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.lang_spans import languages
    return languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.periodic import digest, periodic_runs, with_repeats
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(periodic_runs(with_repeats(docs), least=24, times=3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_toxicity": op1_pu_toxicity,
    "op2_token_combinations": op2_token_combinations,
    "op3_wu_manber": op3_wu_manber,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_norm_buckets": op6_norm_buckets,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_suffix_array": op8_suffix_array,
    "op9_block_tree": op9_block_tree,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_spans": op12_language_spans,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op11_merkle_manifest": manifest_sql(),
    "op6_norm_buckets": """
        WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
