"""The corpus pipeline: four stages over ``documents``, each written and read again.

Rejected documents go, one document of each group of near-duplicates stays,
documents with a benchmark item go, and the sources of the rest are mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontamination, mixing, near_copies, near_dups, quality
from kinfold.llm.common import written
from kinfold.session import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score under 0.7 go; all columns and rows of the others stay as they are.

    Null and empty texts are scored like any other; without labels of both kinds
    nothing goes. An empty table gives an empty one.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8's fingerprints, grid join, components and choice of rows, over links of similarity 0.8 of five-word shingles.

    The grid finds those within four bits, MinHash bands the rest; the exact
    similarity decides.

    Of each group the document with the smallest doc_id stays, of its repeated
    rows one; rows without an id stay; empty texts are copies of each other. An
    empty table gives an empty one.
    """
    return near_dups.deduplicate(docs, near_copies.same_texts)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a passage that is a benchmark item, or nearly one, go.

    Null and empty texts hold none and stay, as do repeated rows without one. An
    empty table gives an empty one.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every document with the words the mix takes of it, its text and its source.

    Null texts have no words, null sources are one source; repeated rows are each
    mixed. An empty table gives an empty one.
    """
    return mixing.mix(docs, keep=("source", "lang", "text", "n_chars"))


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mix", mix_sources),
]
#: The classifier and the fingerprints can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
