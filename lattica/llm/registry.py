"""Queries of the text operators and their SQL."""

from lattica.llm import chat, decontam, html, langid, merkle, mixing, phrases, pii, quality, sharding, simhash, suffixdedup, windows

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_suffix_dedup": suffixdedup.op2_suffix_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality": quality.op7_quality,
    "op8_window_dedup": windows.op8_window_dedup,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_html": html.op10_html,
    "op11_merkle": merkle.op11_merkle,
    "op12_chat": chat.op12_chat,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op8_window_dedup": windows.ORACLE,
    "op9_decontamination": decontam.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_chat": chat.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
