"""The queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontaminate, exact_dedup, html_extract, langid, lexical_search, packing, quality, simhash_dedup, suffix_dedup, token_count, toxicity, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality": quality.op3_quality,
    "op4_langid": langid.op4_langid,
    "op5_token_count": token_count.op5_token_count,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_vector_search": vector_search.op11_vector_search,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op11_vector_search": vector_search.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
