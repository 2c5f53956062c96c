"""A training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and is one of the operators of
``leadloom.llm``; all but the last return the columns that they are given, those
of ``documents`` at least.  Between stages the rows are a Parquet table in the
shared folder.  Empty tables give empty ones, repeated rows and rows without an
id are judged like all others, and further columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import line_dedup, near_dedup, packing, quality_rules, substring_dedup
from leadloom.llm.common import materialize, read_table


#: The columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all further columns in one, so that none clashes with those that an operator makes."""
    rest = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*COLUMNS, F.struct(F.lit(0).alias("_"), *rest).alias("_further"))


def _back(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.select(*[F.col(c) if c in COLUMNS else F.col("_further")[c].alias(c) for c in docs.columns])


def _counted(cleaned: DataFrame) -> DataFrame:
    """With the length of the texts that lost a part."""
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go; a null text has no words and goes."""
    return _back(quality_rules.judge(_aside(docs), read_table(spark, sf_dir, "labels")).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites go; every document stays."""
    return _back(_counted(line_dedup.dedup_lines(_aside(docs))), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Rows without an id or without words stay; rows that share an id stay or go together.
    """
    judged = near_dedup.near_documents(docs)
    gone = materialize(judged.where("doc_id is not null and n_shingles > 0 and not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds go; every document stays."""
    return _back(_counted(substring_dedup.dedup_substrings(_aside(docs))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of up to 2,048 tokens."""
    return packing.digests(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned rules, the shingle links or the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
