"""The corpus pipeline: documents through classifier, host rules, line and near deduplication into packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of their input, also where they bear a name that an operator uses.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import line_dedup, near_texts, packing, quality_model, quality_rules
from furrow.llm.common import read, small_batches
from furrow.session import prepare, scratch_path


def _wrapped(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator uses, and the whole row aside."""
    return docs.select(F.struct(*docs.columns).alias("__row"), *used)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled ones among `docs`; where these do not have both
    labels there is nothing to learn from, and all documents stay."""
    small_batches(prepare(spark))
    model = quality_model.trained(docs, read(spark, sf_dir, "labels"))
    if not quality_model.learnt(model):
        return docs
    return quality_model.scored(_wrapped(docs, "text", "n_chars"), model).where("predicted = 1").select("__row.*")


def host_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that pass them."""
    small_batches(prepare(spark))
    return quality_rules.judged(quality_rules.measured(_wrapped(docs, "text", "source"))).where("kept").select("__row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller id holds; n_chars follows the text."""
    small_batches(prepare(spark))
    rows = line_dedup.deduplicated(_wrapped(docs, "doc_id", "text"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*(new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more of five-word shingles connect: the one with the smallest id."""
    small_batches(prepare(spark))
    return near_texts.deduplicated(docs).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 1024 tokens."""
    small_batches(prepare(spark))
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", host_rules),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_duplicates),
    ("best-fit packing", packed_sequences),
]

#: SQL has no form of the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
