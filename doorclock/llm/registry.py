"""Queries of the training-data operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from doorclock.llm import (
    divergence,
    embeddings,
    language,
    minhash,
    mixing,
    phrases,
    pieces,
    quality,
    secret_scan,
    substrings,
    tokens,
    urls,
    warc,
)

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_sentencepiece": pieces.query,
    "op3_minhash_dedup": minhash.query,
    "op4_mixing": mixing.query,
    "op5_url_filters": urls.query,
    "op6_token_counts": tokens.query,
    "op7_warc_fixity": warc.query,
    "op8_language_id": language.query,
    "op9_substring_dedup": substrings.query,
    "op10_embedding_dedup": embeddings.query,
    "op11_source_divergence": divergence.query,
    "op12_phrase_collocation": phrases.query,
    "op13_secret_scan": secret_scan.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_url_filters": urls.ORACLE_SQL,
    "op7_warc_fixity": warc.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_phrase_collocation": phrases.ORACLE_SQL,
    "op13_secret_scan": secret_scan.ORACLE_SQL,
}
