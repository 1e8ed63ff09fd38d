"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from textloom.llm import conversations, decontaminate, exact_dedup, language, licenses, minhash, packing, quality, runs, simhash, substring_dedup, toxicity, warc

QUERIES = {
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op6_license_paragraphs": licenses.op6_license_paragraphs,
    "op5_simhash_vantage": simhash.op5_simhash_vantage,
    "op1_spaced_seed_decontamination": decontaminate.op1_spaced_seed_decontamination,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op9_warc_dictionary": warc.op9_warc_dictionary,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op7_language_compression": language.op7_language_compression,
    "op4_toxicity_boosted_trees": toxicity.op4_toxicity_boosted_trees,
    "op10_quality_discriminant": quality.op10_quality_discriminant,
    "op11_minhash_hamming": minhash.op11_minhash_hamming,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}


def oracles() -> dict[str, str]:
    """Made when asked for: the licence query's SQL holds weights that are trained then."""
    return {
        "op1_spaced_seed_decontamination": decontaminate.ORACLE_SQL,
        "op2_exact_dedup": exact_dedup.ORACLE_SQL,
        "op6_license_paragraphs": licenses.oracle_sql(),
        "op9_warc_dictionary": warc.ORACLE_SQL,
        "op11_minhash_hamming": minhash.ORACLE_SQL,
        "op12_periodic_runs": runs.ORACLE_SQL,
        "op13_conversation_repair": conversations.ORACLE_SQL,
    }
