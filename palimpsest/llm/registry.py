"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from palimpsest.llm import alignment, bpe, chat, chosenpath, jaccard, language, lm, mixing, pii, quality, toxicity, vafile, whitening

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_bpe": bpe.op2_bpe,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language": language.op4_language,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_lm_score": lm.op6_lm_score,
    "op7_vafile": vafile.op7_vafile,
    "op8_pii": pii.op8_pii,
    "op9_chat": chat.op9_chat,
    "op10_mixing": mixing.op10_mixing,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_chosen_path": chosenpath.op12_chosen_path,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": jaccard.ORACLE_OP1,
    "op7_vafile": vafile.ORACLE_OP7,
    "op9_chat": chat.ORACLE_OP9,
    "op12_chosen_path": chosenpath.ORACLE_OP12,
}
