"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again before the next stage. All stages but the
last return the columns of ``documents``; the last adds ``copy``.

Cases. Rows with a null id pass the first three stages unchanged and are judged by
their text in the others. Null and empty texts have the quality of a text without
features; they have no lines, no near duplicates and no benchmark words, and size 0
in the mix. Rows that are equal in id and text are one document for the lines, and
one of them passes the near-duplicate stage. Empty tables give no rows. Columns
beside doc_id, text, source and n_chars travel untouched, whatever their names;
n_chars follows the text, and a column called ``copy`` is replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from gridloom.llm._run import read, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, one of each stays; so do documents that have no word left of those they had."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Stages 1 to 3 learn a model or hash at random; SQL has no form of them.
ORACLE_SQL = None
