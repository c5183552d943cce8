"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import table
from . import exact_copies, filter_audit, link_graph, quality_rules
from .bpe import encoding_digests
from .conversation_repair import damaged, repair_digests
from .fingerprints import edited_fingerprints
from .importance import resampled
from .languages import identified
from .near_duplicates import near_duplicates
from .packing import packed_documents
from .registry import query
from .repeats import removal_digests
from .token_counts import token_counts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe_rank_array")
def op5(spark, directory):
    return encoding_digests(table(spark, directory, "documents"), TOKENIZER)


@query("op8_token_counts")
def op8(spark, directory):
    counts = token_counts(table(spark, directory, "documents"), TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op10_quality_rules", quality_rules.ORACLE)
def op10(spark, directory):
    return quality_rules.quality_verdicts(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("quality_rules_one_stratum", quality_rules.ONE_STRATUM_ORACLE)
def quality_rules_one_stratum(spark, directory):
    """op10 with all languages as one stratum and more risk: cutoffs are certified from a few hundred labels on."""
    docs = table(spark, directory, "documents").withColumn("all", F.lit("all"))
    return quality_rules.quality_verdicts(docs, table(spark, directory, "labels"), stratum="all", risk=quality_rules.WIDE_RISK)


@query("op2_vector_packing")
def op2(spark, directory):
    return packed_documents(table(spark, directory, "documents"), TOKENIZER)


@query("op1_language_mixture")
def op1(spark, directory):
    return identified(table(spark, directory, "documents"))


@query("op3_link_graph", link_graph.ORACLE)
def op3(spark, directory):
    return link_graph.judged(spark, table(spark, directory, "pages"))


@query("op6_one_permutation")
def op6(spark, directory):
    return edited_fingerprints(table(spark, directory, "documents"))


@query("op4_minhash_components")
def op4(spark, directory):
    return near_duplicates(table(spark, directory, "documents"), shingle=3, percent=85)


@query("op7_importance_resampling")
def op7(spark, directory):
    return resampled(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op9_repeated_suffixes")
def op9(spark, directory):
    return removal_digests(table(spark, directory, "documents"))


@query("op11_filter_audit", filter_audit.ORACLE)
def op11(spark, directory):
    return filter_audit.filter_audit(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op12_exact_copies", exact_copies.ORACLE)
def op12(spark, directory):
    return exact_copies.exact_copies(table(spark, directory, "documents"))


@query("op13_conversation_repair")
def op13(spark, directory):
    return repair_digests(damaged(table(spark, directory, "conversations")))
