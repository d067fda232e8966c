"""A training corpus from raw documents, in five stages: rules, line dedup, near-dedup, mixture, packing.

Each stage works on the table that the one before left. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import line_dedup, line_rules, mixing, packing, shared, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the rules learn from those with labels."""
    field = line_rules.train(docs.select("doc_id", "text"), shared.table(spark, sf_dir, "labels"), spark)
    return line_rules.judge(docs, field, keep_columns=True).where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; documents stay, with what is left of their text."""
    return line_dedup.dedup_lines(docs, spark).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return simhash.keep_first(docs, spark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs, spark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in a sequence of at most 2048 ids."""
    import public_tokenizers

    return packing.pack_texts(docs, spark, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can't express the first stage's field; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each written as Parquet and reread as the next one's input."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), spark, f"stage-{name.replace(' ', '-')}")
    return docs
