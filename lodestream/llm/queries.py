"""The operators' queries and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from lodestream.llm import bpe, conversations, fingerprints, importance, language_id, minhash, mixing, quality_model, quality_rules, suffix_dedup, token_codes, url_filters, warc

QUERIES = {
    f.__name__: f
    for f in (
        language_id.op1_language_id,
        warc.op2_warc,
        quality_model.op3_quality_classifier,
        quality_rules.op4_quality_rules,
        token_codes.op5_token_codes,
        minhash.op6_minhash_dedup,
        bpe.op7_bpe_roundtrip,
        suffix_dedup.op8_suffix_dedup,
        fingerprints.op9_fingerprints,
        mixing.op10_mix_sources,
        conversations.op11_conversation_repair,
        importance.op12_importance_resampling,
        url_filters.op13_url_filters,
        quality_rules.rules_ablations,
    )
}
SQL = {
    "op2_warc": warc.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_minhash_dedup": minhash.SQL,
    "op8_suffix_dedup": suffix_dedup.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op13_url_filters": url_filters.SQL,
    "rules_ablations": quality_rules.ABLATIONS_SQL,
}
