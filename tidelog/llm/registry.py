"""Queries of this subpackage, and DuckDB statements where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, language_id, line_quality, mixing, packing, quote_links, secret_index, simhash, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_warc_salvage": warc.op1,
        "op2_vector_best_fit": packing.op2,
        "op3_quotation_linking": quote_links.op3,
        "op4_ball_simhash": simhash.op4,
        "op5_source_mixing": mixing.op5,
        "op6_family_language": language_id.op6,
        "op7_line_first_quality": line_quality.op7,
        "op8_extendible_dedup": exact_dedup.op8,
        "op9_trigram_secrets": secret_index.op9,
        "op10_suffix_levels": suffix_dedup.op10,
    }


def oracle_sql() -> dict:
    return {
        "op3_quotation_linking": quote_links.ORACLE_OP3,
        "op7_line_first_quality": line_quality.ORACLE_OP7,
        "op8_extendible_dedup": exact_dedup.ORACLE_OP8,
        "op9_trigram_secrets": secret_index.ORACLE_OP9,
    }
