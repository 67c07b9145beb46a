"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from slackframe.llm import decontaminate, jaccard, langid, linededup, mixing, mixlm, pieces, quality, surrogates, tokenfiles
from slackframe.llm.common import read_table

ORACLE: dict[str, str] = {"op1_line_chunk_dedup": linededup.REPORT_SQL, "op8_host_quality": quality.REPORT_SQL}


def op1_line_chunk_dedup(spark, sf_dir):
    return linededup.report(read_table(spark, sf_dir, "documents"))


def op2_longest_match_counts(spark, sf_dir):
    return pieces.count_tokens(read_table(spark, sf_dir, "documents"), pieces.standard_pieces())


def op3_rank_order_language(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op4_word_aligned_token_files(spark, sf_dir):
    return tokenfiles.round_trip(read_table(spark, sf_dir, "documents"))


def op5_keyed_surrogates(spark, sf_dir):
    return surrogates.report(read_table(spark, sf_dir, "documents"))


def op6_jaccard_classes(spark, sf_dir):
    return jaccard.report(read_table(spark, sf_dir, "documents"))


def op7_context_mixing(spark, sf_dir):
    return mixlm.report(read_table(spark, sf_dir, "documents"))


def op8_host_quality(spark, sf_dir):
    return quality.report(read_table(spark, sf_dir, "documents"))


def op9_pivotal_mix(spark, sf_dir):
    return mixing.taken(read_table(spark, sf_dir, "documents"))


def op10_template_leaks(spark, sf_dir):
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_chunk_dedup": op1_line_chunk_dedup,
    "op2_longest_match_counts": op2_longest_match_counts,
    "op3_rank_order_language": op3_rank_order_language,
    "op4_word_aligned_token_files": op4_word_aligned_token_files,
    "op5_keyed_surrogates": op5_keyed_surrogates,
    "op6_jaccard_classes": op6_jaccard_classes,
    "op7_context_mixing": op7_context_mixing,
    "op8_host_quality": op8_host_quality,
    "op9_pivotal_mix": op9_pivotal_mix,
    "op10_template_leaks": op10_template_leaks,
}
