"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from . import best_fit, chat, decontaminate, hard_negatives, line_dedup, lm_score, ngram_join, packing, quality_crf, quality_rules, ranked_search, suffix_dedup, token_file

QUERIES = {
    "op1_token_file": token_file.op1_token_file,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality_crf": quality_crf.op5_quality_crf,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_chat_format": chat.op7_chat_format,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLE_SQL = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
