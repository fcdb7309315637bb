"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from lociq.llm import contamination, fingerprint, jaccard, lm, mixing, phrases, pieces, pii, secrets, substrings, toxicity, turns, urls

QUERIES = {
    "op1_sentencepiece": pieces.op1,
    "op2_iblt_fingerprint": fingerprint.op2,
    "op3_substring_dedup": substrings.op3,
    "op4_decontamination": contamination.op4,
    "op5_lm_score": lm.op5,
    "op6_url_filter": urls.op6,
    "op7_pii": pii.op7,
    "op8_secret_scan": secrets.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_toxicity": toxicity.op10,
    "op11_source_mixing": mixing.op11,
    "op12_collocations": phrases.op12,
    "op13_conversation_repair": turns.op13,
}

ORACLES = {
    "op3_substring_dedup": substrings.ORACLE,
    "op4_decontamination": contamination.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op12_collocations": phrases.ORACLE,
}
