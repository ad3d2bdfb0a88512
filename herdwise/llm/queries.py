"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, chat, decontaminate, fingerprints, jaccard, language, merkle, mixing, repeats, secrets, simhash, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
        "op3_chat_format": chat.op3_chat_format,
        "op4_language_id": language.op4_language_id,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
        "op7_substring_dedup": repeats.op7_substring_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_jaccard_join": jaccard.op11_jaccard_join,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": decontaminate.OP2_SQL, "op3_chat_format": chat.OP3_SQL, "op10_mix_sources": mixing.OP10_SQL, "op11_jaccard_join": jaccard.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL}
