"""Registered queries of this subpackage, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm import alignment, decontam, fingerprint, htmlextract, linededup, packing, prefixtrie, simhash, substring, tokens, toxicity, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_line_dedup": linededup.op10_line_dedup,
        "op11_html_extraction": htmlextract.op11_html_extraction,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_conversation_prefix_trie": prefixtrie.op13_conversation_prefix_trie,
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_url_filters": urlfilter.op2_url_filters,
        "op3_packing": packing.op3_packing,
        "op4_document_fingerprints": fingerprint.op4_document_fingerprints,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_warc_archive": warc.op6_warc_archive,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring.OP1_SQL,
        "op2_url_filters": urlfilter.op2_sql(),
        "op6_warc_archive": warc.OP6_SQL,
        "op9_benchmark_decontamination": decontam.OP9_SQL,
        "op10_line_dedup": linededup.OP10_SQL,
        "op13_conversation_prefix_trie": prefixtrie.OP13_SQL,
    }
