"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusmill.llm import bpe, decontaminate, language, linededup, ngramjoin, quality, secrets, spandedup, tokencount, toxicity

QUERIES = {
    "op1_ngram_join": ngramjoin.query,
    "op2_toxicity": toxicity.query,
    "op3_secrets": secrets.query,
    "op4_bpe": bpe.query,
    "op5_token_counts": tokencount.query,
    "op6_quality": quality.query,
    "op7_span_dedup": spandedup.query,
    "op8_line_dedup": linededup.query,
    "op9_language": language.query,
    "op10_decontaminate": decontaminate.query,
}

ORACLES = {
    "op1_ngram_join": ngramjoin.ORACLE,
    "op7_span_dedup": spandedup.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
