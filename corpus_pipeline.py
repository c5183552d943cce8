"""Pipeline over ``documents``: filter, deduplicate, clean and pack training text.

Every stage takes all rows its predecessor kept and, but for the last, returns
the columns of ``documents``. Stages are written and read again between steps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from querytally.llm.importance import sampled_documents
from querytally.llm.near_duplicates import first_of_each_group
from querytally.llm.packing import packed_documents
from querytally.llm.quality_rules import good_documents
from querytally.llm.repeats import cleaned_documents
from querytally.session import table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules and the risk-controlled cutoffs accept."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark, docs, sf_dir):
    """Documents that importance resampling takes."""
    return sampled_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document, the one with the smallest id, of every group of near-duplicates."""
    return first_of_each_group(docs)


def repeat_removal(spark, docs, sf_dir):
    """Documents without the strings of 200 bytes that occur elsewhere too; n_chars follows the text."""
    return cleaned_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark, docs, sf_dir):
    """Pieces of the remaining texts, placed in sequences of 2048 tokens."""
    return packed_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules), ("quality classifier", quality_classifier), ("near-duplicates", near_dedup),
    ("repeat removal", repeat_removal), ("packing", packing)]

# packing places pieces by a search over tokenizer output, which SQL does not express
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
