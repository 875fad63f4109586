"""The queries of the operators, one for each, over their whole tables."""

from __future__ import annotations

from quern.llm import decontaminate, langid, linededup, packing, perplexity, quotation, simhash, substring, tokenbin, toxicity


def queries() -> dict:
    return {
        "op1_cnn_toxicity": toxicity.query,
        "op2_ngram_perplexity": perplexity.query,
        "op3_bitmask_langid": langid.query,
        "op4_genetic_packing": packing.query,
        "op5_template_line_dedup": linededup.query,
        "op6_bitplane_tokens": tokenbin.query,
        "op7_line_hash_dedup": substring.query,
        "op8_wu_manber_leaks": decontaminate.query,
        "op9_simhash_groups": simhash.query,
        "op10_quotation_threads": quotation.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_line_hash_dedup": substring.SQL, "op8_wu_manber_leaks": decontaminate.SQL}
