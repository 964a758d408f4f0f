"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from siltstone.llm import leakage, names, residue, site_lines, tokens, truncation, wrappers
from siltstone.plans.catalog import Query, shipped

QUERIES: dict[str, Query] = {
    name: shipped(plan)
    for name, plan in {
        "p1_found": wrappers.p1_found,
        "p1_body": wrappers.p1_body,
        "p2_found": site_lines.p2_found,
        "p2_report": site_lines.p2_report,
        "p2_clean": site_lines.p2_clean,
        "p3_found": residue.p3_found,
        "p6_found": names.p6_found,
        "p6_entities": names.p6_entities,
        "p8_ids": tokens.p8_ids,
        "p8_stats": tokens.p8_stats,
        "p9_found": leakage.p9_found,
        "p9_items": leakage.p9_items,
        "p10_found": truncation.p10_found,
        "p10_sources": truncation.p10_sources,
    }.items()
}
SQL: dict[str, str] = {"p2_found": site_lines.P2_SQL, "p2_clean": site_lines.P2_CLEAN_SQL, "p9_found": leakage.P9_SQL, "p9_items": leakage.P9_ITEMS_SQL}
