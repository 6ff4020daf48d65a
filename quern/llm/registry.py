"""Queries of the corpus operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm import license_scan, line_dedup, merkle, mixing, near_dup, packing, pii, quality, spotsigs, substring, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_pii_pseudonyms": pii.op1,
        "op2_toxicity": toxicity.op2,
        "op3_minhash_near_dedup": near_dup.op3,
        "op4_best_fit_packing": packing.op4,
        "op5_warc_writer": warc.op5,
        "op6_quality_rules": quality.op6,
        "op7_line_dedup": line_dedup.op7,
        "op8_spotsigs_fingerprints": spotsigs.op8,
        "op9_mixing": mixing.op9,
        "op10_license_scan": license_scan.op10,
        "op11_merkle_manifest": merkle.op11,
        "op12_substring_dedup": substring.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_minhash_near_dedup": near_dup.OP3_SQL,
        "op5_warc_writer": warc.OP5_SQL,
        "op6_quality_rules": quality.OP6_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op10_license_scan": license_scan.OP10_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
        "op12_substring_dedup": substring.OP12_SQL,
    }
