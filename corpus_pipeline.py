"""A corpus from documents to sampled segmentations, in stages that are each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of documents, but for the last.
Every stage handles nulls, empty and very long texts, repeated rows and empty tables as its operator's docstring says. Columns of any
name pass all stages but the last: they travel in one struct. SQL can't express the stages (mixture inference, MinHash, hash-ordered
queues, sampling), so ORACLE_SQL is None; each is tested against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import language_id, line_dedup, mixing, near_dedup, segment_sampling
from quillsift.llm.common import drop, materialise, row_of

#: A document without a language of this share at least has no main language.
MAIN_LANGUAGE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a main language. A table without labels teaches nothing: then all stay that
    have a letter in a text of any script."""
    model = language_id.learn(docs.where(~language_id.held_out("doc_id")))
    if not model.langs:
        return docs
    found = language_id.identify(docs.select(row_of(docs).alias("row"), "text"), model, columns=("row",))
    return found.where((F.col("lang_pred") != language_id.UND) & (F.col("mixture")[0]["share"] >= MAIN_LANGUAGE)).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from texts, and keeps all rows; n_chars follows. A null text stays null."""
    found = line_dedup.drop_repeated_lines(docs.select(row_of(docs).alias("row"), "doc_id", "text"))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays, and all without words."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents not taken go, those taken twice stand twice."""
    return mixing.mixed_rows(docs)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segment_sampling.shown(segment_sampling.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2, columns=("doc_id", "source")))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("segment_sampling", sample_segmentations),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and deleted once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
