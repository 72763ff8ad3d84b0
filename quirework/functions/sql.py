"""The text functions for SQL: temporary functions of a session, all within Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quirework.functions.text import SPACE

_S = SPACE.replace("\\", "\\\\")
_STRIP = f"regexp_replace(t, '(?U)\\\\A{_S}+|{_S}+\\\\z', '')"
_PARTS = "filter(transform(split(t, '{by}', -1), p -> {strip}), p -> p <> '')"
FUNCTIONS = {
    "quire_strip": ("STRING", _STRIP),
    "quire_words": ("INT", f"size(filter(split(t, '(?U){_S}+', -1), w -> w <> ''))"),
    "quire_key": ("STRING", "trim(regexp_replace(lower(t), '[^a-z0-9 ]', ''))"),
    "quire_lines": ("ARRAY<STRING>", _PARTS.format(by="\\\\n", strip=_STRIP.replace("(t,", "(p,"))),
    "quire_paragraphs": ("ARRAY<STRING>", _PARTS.format(by=f"(?U)\\\\n{_S}*\\\\n", strip=_STRIP.replace("(t,", "(p,"))),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions; each takes one text."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
