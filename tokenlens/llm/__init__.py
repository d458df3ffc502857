"""Training-data operators. QUERIES and ORACLE hold one query per operator and its DuckDB SQL."""

from . import (chat_format, exact_dedup, jaccard_join, language_id, line_dedup, line_frequency, mixing, packing, repeats, spelling_variants,
               token_alignment, toxicity, warc)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_ngram_jaccard": jaccard_join.op3_ngram_jaccard,
    "op4_repeated_strings": repeats.op4_repeated_strings,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_quality_rules": line_frequency.op8_quality_rules,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_language_id": language_id.op11_language_id,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLE = {
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_quality_rules": line_frequency.ORACLE_SQL,
    "op9_chat_format": chat_format.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
}
