"""Expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of Unicode letters and digits.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text in order; a null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def pages_and_chunks(spark, sf_dir: str, *, tables: bool = True) -> DataFrame:
    """``item_kind, item_id, text`` of both text tables; rows delivered twice are still twice."""
    pages = spark.read.parquet(f"{sf_dir}/pdf_pages.parquet").select(
        F.lit("page").alias("item_kind"), F.col("page_seq").alias("item_id"), "text"
    )
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    if not tables:
        chunks = chunks.where(~F.coalesce("is_table", F.lit(False)))
    return pages.unionByName(
        chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_seq").alias("item_id"), "text")
    )


#: Rows of one key beyond which ``spread_join`` salts it.
HOT_ROWS = 2048


def spread_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, hot: int = HOT_ROWS) -> DataFrame:
    """The inner join on ``key``. The rows of a key with many on the left are spread over salts by ``salt_by``, and
    those on the right repeated for each, so that no task makes the whole product of a hot key."""
    salts = left.groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("__salts"))
    if salts.isEmpty():
        return left.join(right, key)
    one = left.join(salts, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(salt_by), "__salts"), F.lit(0)).cast("int")).drop("__salts")
    many = right.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return one.join(many, [key, "__salt"]).drop("__salt")
