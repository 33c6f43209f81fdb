"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a frame; the runner writes
it and the next stage reads it back.  All but the last return the columns of
``documents``; ``n_chars`` follows the text where a stage cuts it.  The key of
a document is its ``doc_id``, and rows that share one are judged each by its
own text; rows without one are kept by the stages that
compare documents, since they cannot be named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard, quality, repeats, sampled_pieces
from sluice.llm.bloom import bloom_filter, may_be_in
from sluice.llm.common import saved, small_batches, table
from sluice.llm.pieces import load_pieces
from sluice.semantics import pin_session

#: Words of a passage that may stand only once.
PASSAGE = 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.kept(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: that with the smallest id (of one id, hash of the text); of repeated rows one."""
    small_batches(spark)
    others = saved(jaccard.copies(docs), "others")
    key, digest = docs["doc_id"], jaccard.digest("text")
    asked = may_be_in(bloom_filter(others.select("copy_key", "copy_digest")), key, digest)
    left = docs.filter(asked).join(others, (key == others["copy_key"]) & (digest == others["copy_digest"]), "left_anti")
    # texts that are no copies never move
    kept = docs.filter(~asked).union(left).select(*docs.columns)
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(kept.filter("doc_id IS NULL"))


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings and the passages of over 50 words that stand anywhere else, too."""
    small_batches(spark)
    return counted(repeats.without_repeats(docs, words=PASSAGE))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that windows of the benchmark hit."""
    small_batches(spark)
    return counted(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with sampled pieces, and whether the pieces give the text back."""
    small_batches(spark)
    pieces = load_pieces()
    decoded = sampled_pieces.decode_pieces(sampled_pieces.encode_sampled(docs, pieces), pieces)
    return decoded.withColumn("lossless", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Sampled segmentations have no SQL counterpart; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(pin_session(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
