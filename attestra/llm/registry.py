"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import divergence, langid, licenses, mixing, neardup, packing, simhash, substrings, suffixes, topk, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.query,
        "op2_best_fit_packing": packing.query,
        "op3_language_id": langid.query,
        "op4_substring_dedup": substrings.query,
        "op5_embedding_neardup": neardup.query,
        "op6_toxicity": toxicity.query,
        "op7_topk_products": topk.query,
        "op8_suffix_dedup": suffixes.query,
        "op9_source_mix": mixing.query,
        "op10_simhash": simhash.query,
        "op11_source_divergence": divergence.query,
        "op12_url_filter": urls.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": substrings.SQL,
        "op5_embedding_neardup": neardup.SQL,
        "op7_topk_products": topk.SQL,
        "op11_source_divergence": divergence.SQL,
        "op12_url_filter": urls.SQL,
    }
