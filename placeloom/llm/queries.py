"""Queries of this subpackage for the driver."""

from __future__ import annotations

from . import decontam, embed, html, langid, license, mix, ngram_join, pii, tokens, toxicity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_html_main_text": html.op2_html_main_text,
    "op3_license_scan": license.op3_license_scan,
    "op4_embedding_near_dedup": embed.op4_embedding_near_dedup,
    "op5_token_shards": tokens.op5_token_shards,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_mix_sources": mix.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
}

#: The others have no SQL form (trained models, a parser, a tokenizer, keyed hashes of Spark) and
#: are tested against brute force, labelled pages, exact round trips or held-out accuracy.
ORACLE_SQL = {
    "op3_license_scan": license.op3_sql(),
    "op4_embedding_near_dedup": embed.OP4_SQL,
    "op7_decontaminate": decontam.OP7_SQL,
    "op8_mix_sources": mix.OP8_SQL,
    "op10_ngram_jaccard_join": ngram_join.OP10_SQL,
}
