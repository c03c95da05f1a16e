"""Queries and oracle SQL of all operators of this package."""

from __future__ import annotations

from webweft.llm import ann, bpe, collocations, decontaminate, deleted_lm, hard_negatives, imatch, license_scan, line_dedup, packing, quality, simhash, suffix_dedup

MODULES = (simhash, suffix_dedup, bpe, packing, quality, deleted_lm, ann, imatch, line_dedup, license_scan, hard_negatives, collocations, decontaminate)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
