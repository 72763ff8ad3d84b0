"""From raw pages to clean pages, and from laid-out blocks to page text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quirework.config import RunConfig
from quirework.functions import text as T


def keep_tables(raw_tables: Column) -> Column:
    """Tables of at least two rows, each as text."""
    return F.transform(F.filter(F.coalesce(raw_tables, F.array()), lambda t: F.size(t) >= 2), T.table_text)


def body_text(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """``source_doc, page_num, raw_text``: blocks that no kept table's box overlaps, in block order.

    An anti-join on the page with the overlap as its condition, so that only blocks and boxes of one page
    meet; boxes that only touch do not overlap.
    """
    b, t = blocks.alias("b"), boxes.alias("t")
    same = (F.col("b.source_doc") == F.col("t.source_doc")) & (F.col("b.page_num") == F.col("t.page_num"))
    over = F.expr("b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1")
    kept = b.join(t, same & over, "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return kept.groupBy("source_doc", "page_num").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("raw_text"))


def clean_pages(raw: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """``PAGES`` from ``raw_text`` and ``tables`` (texts): scanned pages skipped, text cleaned, back matter cut."""
    tables = F.coalesce("tables", F.array().cast("array<string>"))
    seen = raw.where((F.length(T.py_strip(F.coalesce("raw_text", F.lit("")))) >= config.min_page_text_chars) | (F.size(tables) > 0))
    cleaned = T.with_computed(seen.withColumn("tables", tables), {"__clean": T.clean_text(F.coalesce("raw_text", F.lit("")))})
    cut = T.with_computed(cleaned, {"text": T.cut_boilerplate(F.col("__clean"), config.boilerplate_section_titles)}).drop("__clean")
    return _clean_tables(cut).where((F.col("text") != "") | (F.size("tables") > 0)).drop("raw_text")


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def _clean_tables(pages: DataFrame) -> DataFrame:
    """Tables cleaned like text; only arrays with a sign beyond ASCII reach Python's normaliser."""
    beyond = F.exists("tables", lambda t: t.rlike(r"[^\x00-\x7F]"))
    return pages.withColumn("tables", F.transform(F.when(beyond, _nfkc_all("tables")).otherwise(F.col("tables")), T.clean_composed))
