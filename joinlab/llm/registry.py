"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from joinlab.llm import (
    exact_dedup,
    license_scan,
    line_dedup,
    mixing,
    mpeg_audio,
    packing,
    rule_ensemble,
    simhash,
    substring_dedup,
    url_filter,
)

QUERIES = {
    "op1_media_columns": mpeg_audio.op1_media_columns,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_pack_on_curve": packing.op6_pack_on_curve,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_quality_rules": rule_ensemble.op9_quality_rules,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
}
