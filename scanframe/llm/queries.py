"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanframe.llm import ann, exact_dedup, extraction, langid, mixing, packing, pii, simhash, substrings, tokens, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": ann.op1_multi_index,
    "op2_pii_spans": pii.op2_pii_spans,
    "op3_url_filter": urls.op3_url_filter,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_language_id": langid.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_simhash_bk": simhash.op10_simhash_bk,
    "op11_html_extraction": extraction.op11_html_extraction,
    "op12_whitening": whitening.op12_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": urls.SQL,
    "op5_substring_dedup": substrings.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
}
