"""Train, validation and test splits by document, with a record-level fallback for fewer than three documents."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import RunConfig

NAMES = ["train", "val", "test"]
#: Documents up to which the seeded shuffle runs on the driver; beyond it ``seeded`` is an error.
SHUFFLED_ON_DRIVER = 1_000_000


def sizes(n: int, config: RunConfig, clamp: bool = True) -> tuple[int, int, int]:
    """Documents or records in train, val and test. Halves round to even."""
    test, val = max(1, round(n * config.test_ratio)), max(1, round(n * config.val_ratio))
    train = n - val - test
    return (max(1, train) if clamp else train), val, test


def _by_rank(rank, counts: tuple[int, int, int]):
    return F.when(rank < counts[0], "train").when(rank < counts[0] + counts[1], "val").otherwise("test")


def split_documents(docs: DataFrame, config: RunConfig = RunConfig(), mode: str = "hash") -> DataFrame:
    """``source_doc, split`` of distinct documents.

    ``hash`` orders them by md5 of seed and name, which any engine reproduces; ``seeded`` by a seeded shuffle of
    the sorted names on the driver. More than ``SHUFFLED_ON_DRIVER`` documents are an error there, never another order.
    """
    config.check_ratios()
    names = docs.select("source_doc").distinct()
    n = names.count()
    if mode == "seeded":
        if n > SHUFFLED_ON_DRIVER:
            raise ValueError(f"a seeded split takes at most {SHUFFLED_ON_DRIVER:,} documents, not {n:,}; use mode='hash'")
        ordered = sorted((r[0] for r in names.collect()), key=lambda s: s.encode())
        random.Random(config.split_seed).shuffle(ordered)
        ranked = docs.sparkSession.createDataFrame(list(enumerate(ordered)), "rank int, source_doc string")
    else:
        ranked = _ranks(names, F.md5(F.concat(F.lit(str(config.split_seed)), F.lit("|"), "source_doc")), "source_doc")
    return ranked.select("source_doc", _by_rank(F.col("rank"), sizes(n, config)).alias("split"))


def _ranks(df: DataFrame, key, tie: str) -> DataFrame:
    """Ranks from 0 by a hex key. Rows are bucketed by the first digits of the key; ranks are counted within a
    bucket and moved by the sizes of the buckets before, so that no single task sorts everything."""
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3))
    counts = keyed.groupBy("__bucket").count()  # 4,096 rows at most
    moved = counts.select("__bucket", F.coalesce(F.sum("count").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", tie)) - 1
    return keyed.withColumn("__row", inner).join(F.broadcast(moved), "__bucket").withColumn("rank", F.col("__row") + F.col("__offset")).drop("__key", "__bucket", "__row", "__offset")


def split_rows(records: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """``record_seq, split`` by a hash order of records; fewer than ten all train."""
    config.check_ratios()
    n = records.count()
    if n < 10:
        return records.select("record_seq", F.lit("train").alias("split"))
    ranked = _ranks(records.select("record_seq"), F.md5(F.concat(F.lit(str(config.split_seed)), F.lit("|"), F.col("record_seq").cast("string"))), "record_seq")
    return ranked.select("record_seq", _by_rank(F.col("rank"), sizes(n, config, clamp=False)).alias("split"))


def split_records(records: DataFrame, config: RunConfig = RunConfig(), mode: str = "hash") -> DataFrame:
    """``records`` with their ``split``."""
    if records.select("source_doc").distinct().limit(3).count() >= 3:
        return records.join(split_documents(records, config, mode), "source_doc")
    return records.join(split_rows(records, config), "record_seq")


def split_counts(records: DataFrame) -> DataFrame:
    """``split, n`` for all three names, also those without records."""
    names = records.sparkSession.createDataFrame([(s,) for s in NAMES], "split string")
    return names.join(records.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))
