"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontam, filter_audit, html_text, licenses, oracles, packing, quality, secrets, simhash, token_counts, tokens_io, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        secrets.op1_secret_scans,
        packing.op2_best_fit_packing,
        licenses.op3_license_scans,
        tokens_io.op4_token_binary_output,
        simhash.op5_simhash_near_dedup,
        quality.op6_quality_rules,
        toxicity.op7_toxicity,
        html_text.op8_html_extraction,
        decontam.op9_benchmark_decontamination,
        chat.op10_chat_formatting,
        alignment.op11_cross_tokenizer_alignment,
        filter_audit.op12_filter_interaction_audit,
        token_counts.op13_token_counts,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": oracles.OP6, "op12_filter_interaction_audit": oracles.OP12}
