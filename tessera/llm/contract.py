"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from ..shipping import ship
from . import chat_format, decontaminate, license_scan, line_dedup, lm_score, mix_sources, near_dedup, quality_rules, repair, resample, shard, token_counts, toxicity

_QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_extendible_shards": shard.op2_extendible_shards,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_mix_sources": mix_sources.op5_mix_sources,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_target_resampling": resample.op11_target_resampling,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_conversation_repair": repair.op13_conversation_repair,
}


def _shipped(run):
    def query(spark, sf_dir):
        ship(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {name: _shipped(run) for name, run in _QUERIES.items()}

ORACLES: dict[str, str] = {
    "op2_extendible_shards": shard.OP2_SQL,
    "op5_mix_sources": mix_sources.OP5_SQL,
    "op6_license_scan": license_scan.OP6_SQL,
    "op11_target_resampling": resample.OP11_SQL,
    "op12_chat_format": chat_format.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
