"""The queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import html_text, language_id, lm_score, media, minhash, mixing, packing, pu_quality, quality_rules, token_count

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_media_packets": media.query,
    "op3_lm_score": lm_score.query,
    "op4_minhash_dedup": minhash.query,
    "op5_source_mix": mixing.query,
    "op6_pu_quality": pu_quality.query,
    "op7_quality_rules": quality_rules.query,
    "op8_token_count": token_count.query,
    "op9_best_fit_packing": packing.query,
    "op10_html_text": html_text.query,
    "quality_rule_ablations": quality_rules.ablation_query,
    "media_cues": media.cue_query,
}
SQL = {
    "op3_lm_score": lm_score.SQL,
    "op4_minhash_dedup": minhash.SQL,
    "op5_source_mix": mixing.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "quality_rule_ablations": quality_rules.ABLATION_SQL,
}
