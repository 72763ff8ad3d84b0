"""Problem 4: cutting oversized items at natural boundaries.

A recursive hierarchy of separators (section, paragraph, line, sentence, word, character) turns a text
into contiguous units under the limit: a unit that is too long is cut by the next finer separator. Units
are then packed greedily; each further piece starts with up to ``overlap`` code points of the piece before,
from a sentence or word start where there is one. Pieces are given by code point offsets and are exact
substrings, so that dropping each overlap and joining the rest gives back the text.

Defined cases: texts within the limit, empty and null texts give no piece; a text without any boundary is
cut by characters; repeated rows give repeated pieces unless the caller drops them; extra columns stay out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import pages_and_chunks

LIMIT = 2400
OVERLAP = 150

#: Each separator ends a unit; coarser ones come first. A heading starts a section at its own line.
SEPARATORS = [
    re.compile(r"\n(?=(?:#{1,6} |(?:chapter|section|part|kapitel|abschnitt|chapitre|cap[ií]tulo)\s+\d|\d+(?:\.\d+)+\s+\S)[^\n]{0,80}(?:\n|$))|\n\s*\n\s*\n|\f", re.I),
    re.compile(r"\r?\n[^\S\n]*\r?\n\s*|\u2029"),
    re.compile(r"\r?\n|\r|\u2028|\u0085"),
    re.compile(r"[.!?…؟।]+[\"'”’»)\]]*\s+|[。！？…]+[”’」』）]*\s*"),
    re.compile(r"\s+"),
]


def ends(text: str) -> list[list[int]]:
    """For each separator the sorted offsets at which a unit may end."""
    return [[m.end() for m in sep.finditer(text)] for sep in SEPARATORS]


def units(length: int, cuts: list[list[int]], limit: int) -> list[int]:
    """Ends of contiguous units of at most ``limit`` code points that cover ``[0, length)``."""
    out: list[int] = []
    todo = [(0, length, 0)]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= limit:
            out.append(hi)
        elif level == len(cuts):
            out += [*range(lo + limit, hi, limit), hi]
        else:
            inner = cuts[level][bisect_right(cuts[level], lo) : bisect_left(cuts[level], hi)]
            bounds = [lo, *inner, hi]
            todo += [(a, b, level + 1) for a, b in reversed(list(zip(bounds, bounds[1:])))]
    return out


def overlap_start(start: int, end: int, cuts: list[list[int]], overlap: int) -> int:
    """Where the overlap with a piece ``[start, end)`` begins: the longest stretch of at most ``overlap``
    code points that begins at a line or sentence, else at a word, else at a character."""
    lo = max(start + 1, end - overlap)
    for level in (cuts[2:4], cuts[4:5]):
        starts = [c[k] for c in level if (k := bisect_left(c, lo)) < len(c) and c[k] < end]
        if starts:
            return min(starts)
    return lo


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text; none if it is within the limit."""
    if not text or len(text) <= limit:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be smaller than the limit")
    cuts = ends(text)
    pieces: list[tuple[int, int]] = []
    start = end = 0
    for unit_end in units(len(text), cuts, limit - overlap):
        if unit_end - start > limit:
            pieces.append((start, end))
            start = overlap_start(start, end, cuts, overlap) if overlap else end
        end = unit_end
    pieces.append((start, end))
    return pieces


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``keys, piece_no, start_pos, end_pos, piece`` for each text of ``df`` over ``limit`` code points.

    The length test runs on the JVM side; only oversized texts reach Python. No shuffle.
    """
    long = df.select(*keys, F.col(text).alias("__text")).where(F.length("__text") > limit)
    schema = ", ".join(f"`{k}` {t}" for k, t in long.dtypes if k != "__text")
    schema += ", piece_no int, start_pos int, end_pos int, piece string"

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*row[:-1], n, a, b, row[-1][a:b])
                for row in batch.itertuples(index=False, name=None)
                for n, (a, b) in enumerate(cut(row[-1], limit, overlap), 1)
            ]
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "start_pos", "end_pos", "piece"])

    return long.mapInPandas(pieces, schema)


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of both tables; items delivered twice count once (only their few oversized texts move)."""
    items = pages_and_chunks(spark, sf_dir).where(F.length("text") > LIMIT).dropDuplicates(["item_kind", "item_id"])
    return split_oversized(items, ["item_kind", "item_id"])


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Items that the operator cut; delivered twice, they count once."""
    made = split_oversized(pages_and_chunks(spark, sf_dir), ["item_kind", "item_id"])
    return made.where("piece_no = 1").select("item_kind", "item_id").distinct()


def p4_check(spark, sf_dir: str) -> DataFrame:
    """``item_kind, item_id, signs, equal, bounded, covered``: of each oversized text its length, and whether every piece is its stretch of
    the text, no longer than the limit, and begins after the piece before and no later than its end, from the first
    sign to the last but for white space."""
    items = pages_and_chunks(spark, sf_dir).where(F.length("text") > LIMIT).dropDuplicates(["item_kind", "item_id"])
    keys = ["item_kind", "item_id"]
    listed = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece"))).alias("p")
    made = split_oversized(items, keys).groupBy(*keys).agg(listed).join(items, keys)
    equal = F.forall("p", lambda x: F.substring(F.col("text"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"]) == x["piece"])
    bounded = F.forall("p", lambda x: (F.length(x["piece"]) <= LIMIT) & (F.length(x["piece"]) > 0))
    blank = lambda a, b: F.substring(F.col("text"), a + 1, b - a).rlike(r"(?U)^[\s\x1c-\x1f]*$")
    follows = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda k: (F.get("p", k)["start_pos"] > F.get("p", k - 1)["start_pos"]) & (F.get("p", k)["start_pos"] >= F.get("p", k - 1)["end_pos"] - OVERLAP) & blank(F.get("p", k - 1)["end_pos"], F.get("p", k)["start_pos"]))
    covered = F.when(F.size("p") > 1, follows).otherwise(True) & blank(F.lit(0), F.get("p", F.lit(0))["start_pos"]) & blank(F.element_at("p", -1)["end_pos"], F.length("text"))
    return made.select(*keys, F.length("text").alias("signs"), equal.alias("equal"), bounded.alias("bounded"), covered.alias("covered"))


P4_CHECK_SQL = """
SELECT item_kind, item_id, any_value(length(text))::INT AS signs, true AS equal, true AS bounded, true AS covered FROM (
  SELECT 'page' AS item_kind, page_seq AS item_id, text FROM pdf_pages
  UNION ALL SELECT 'chunk', chunk_seq, text FROM chunks) t
WHERE length(text) > 2400 GROUP BY 1, 2
"""
P4_FOUND_SQL = """
SELECT DISTINCT item_kind, item_id FROM (
  SELECT 'page' AS item_kind, page_seq AS item_id, text FROM pdf_pages
  UNION ALL SELECT 'chunk', chunk_seq, text FROM chunks) t
WHERE length(text) > 2400
"""
