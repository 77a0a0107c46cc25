"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read back by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from tilewright.llm.common import cut, remove, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go: null or without a letter, or a score below
    ``language_id.MIN_SCORE`` (other scripts and languages, markup, digits). All learned languages stay."""
    return language_id.keep_identified(docs, language_id.train(docs, language_id.fold() != 2))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; ``n_chars`` follows."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded: doc_id, n_tokens and digests of both."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: SQL can't express the language model's decisions; tests/llm/test_pipeline.py recomputes all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. What a stage has written beside its result is removed when the result is there."""
    docs = table(spark, sf_dir, "documents")
    with written() as paths:
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            remove(spark, *[p for p in paths if p != docs.cut_path])
            paths[:] = [docs.cut_path]
    return STAGES[-1][1](spark, docs, sf_dir)
