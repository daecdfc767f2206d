"""A corpus made fit for training: five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of near-duplicates one document stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: what the scan finds is replaced by a mark; all documents stay.
5. tokens: the ids of each text, and proof that they decode to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm import bpe, decontam, quality, secrets, simhash
from tidepanel.llm.common import fresh_name, shared_dir, small, stored, table

#: SQL can express neither the classifier nor the merges.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores below the threshold go; a score on the threshold stays. Each row is scored by its
    text alone, so equal texts share their fate, whatever their ids; null and empty texts have the base rate's score.
    Ids that are null or repeat are never learnt from more than once. All columns are kept; no rows give none."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    score = fresh_name(docs, "score")
    return quality.score(docs, weights, out=score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts and of groups of near-duplicates the row with the least id stays, rows without an id after all
    others; null and empty texts are equal. Rows are told apart by a number of their own, so what shares an id or has none
    stays or goes each for itself. All columns are kept; no rows give none."""
    return simhash.one_of_each(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go, and no others: rows are told apart by their texts, as
    SHA-256, not by their ids. Null and empty texts stay. All columns are kept; no rows give none."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    name = fresh_name(docs, "digest")
    found = decontam.contamination(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark"), key="digest")
    leaked = stored(found.where(F.size("hits") > 0).select(F.col("key").alias(name)).distinct(), "leaked")
    leaked = small(leaked, F.lit(48))
    return docs.join(leaked, digest == leaked[name], "left_anti")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones and those without an id too; of a text with findings these are replaced by a mark,
    a private key as a whole, and ``n_chars`` is counted again. Null texts stay null. All columns are kept."""
    blob, found = fresh_name(docs, "blob_id"), fresh_name(docs, "found")
    out = secrets.scan(docs, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}", keep=tuple(docs.columns), blob=blob, out=found)
    text = secrets.redacted(F.col("text"), F.col(found))
    out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", text).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids`` and ``round_trip``, whether the ids decode to the text, of
    each row, repeated ones and those without an id too. Null and empty texts have no ids; other columns are left out."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return whole.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality", good), ("near_duplicates", single), ("decontamination", unleaked), ("secrets", redacted), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
