"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity lies below the reject threshold of the training fold.

    Each text is scored once; the threshold follows from the scores as kept.
    Null and empty texts have the score of the bias alone.  Without a toxic
    label to learn from, all stay.
    """
    small_batches(spark)
    from tabloom.llm import toxicity as T
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~T.held_out())
    members, prior = T.train(docs, labels)
    scored, scores = T.kept_scores(docs, members, prior, column="toxicity of the text")
    least = T.reject_threshold(scores, labels, "toxicity of the text")
    return scored.where(F.col("toxicity of the text") < least).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; texts without words all stay."""
    small_batches(spark)
    from tabloom.llm.ngram_join import drop_near_duplicates
    return drop_near_duplicates(docs, 5, 75)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur earlier; a text may become empty, a null one stays null."""
    small_batches(spark)
    from tabloom.llm.suffix_dedup import without_repeats
    return without_repeats(docs, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item; null and empty texts stay."""
    small_batches(spark)
    from tabloom.llm.decontaminate import benchmark_hits
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), 10)
    return hits.where(F.size("hits") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids along the Hilbert curve; a null text is an empty one."""
    small_batches(spark)
    from tabloom.llm.packing import digest, pack
    from tabloom.llm.queries import vocabulary
    return digest(pack(docs.select("doc_id", "text"), vocabulary(), ranks=vocabulary("byte_bpe_50k.tiktoken"), with_ids=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", remove_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained classifiers, links and tokenization are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
