"""Named queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quirework.llm import defects, leaks, neardup, overlaps, pieces, pii, sentences, splits, tokens


def queries() -> dict:
    return {
        "p1_found": splits.p1_found,
        "p1_splits": splits.p1_splits,
        "p1_check": splits.p1_check,
        "p2_found": neardup.p2_found,
        "p2_classes": neardup.p2_classes,
        "p3_found": overlaps.p3_found,
        "p3_report": overlaps.p3_report,
        "p4_found": pieces.p4_found,
        "p4_pieces": pieces.p4_pieces,
        "p4_check": pieces.p4_check,
        "p5_found": defects.p5_found,
        "p6_found": pii.p6_found,
        "p6_redacted": pii.p6_redacted,
        "p6_check": pii.p6_check,
        "p7_ids": tokens.p7_ids,
        "p8_found": leaks.p8_found,
        "p8_items": leaks.p8_items,
        "p8_clean": leaks.p8_clean,
        "p9_found": sentences.p9_found,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_check": splits.P1_CHECK_SQL,
        "p2_found": neardup.P2_FOUND_SQL,
        "p2_classes": neardup.P2_CLASSES_SQL,
        "p3_found": overlaps.P3_FOUND_SQL,
        "p3_report": overlaps.P3_REPORT_SQL,
        "p4_found": pieces.P4_FOUND_SQL,
        "p4_check": pieces.P4_CHECK_SQL,
        "p6_check": pii.P6_CHECK_SQL,
        "p8_found": leaks.P8_FOUND_SQL,
        "p8_items": leaks.P8_ITEMS_SQL,
        "p8_clean": leaks.P8_CLEAN_SQL,
    }
