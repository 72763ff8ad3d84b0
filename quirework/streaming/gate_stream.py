"""The gate over a stream of records: row checks, and dedup by state kept for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirework.config import RunConfig
from quirework.functions.tokens import Counter, word_counter
from quirework.operators.gate import row_checks


def first_accepted(records: DataFrame, config: RunConfig = RunConfig(), count: Counter = word_counter) -> DataFrame:
    """The accepted rows of a stream: of each key the row with the smallest ``record_seq`` of the first batch that has one.

    Row checks run before any shuffle, so only rows that pass reach the state, which holds one flag for each key and
    is spread over tasks by key. A batch that is run again gives the same rows.
    """
    passing = row_checks(records, config, count).where("__early IS NULL AND __late IS NULL").drop("__early", "__late")
    columns = passing.columns

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            own = frame.nsmallest(1, "record_seq")
            best = own if best is None else pd.concat([best, own]).nsmallest(1, "record_seq")
        if best is not None and not state.exists:
            state.update((True,))
            yield best[columns]

    grouped = passing.groupBy("q_norm", "a_norm")
    return grouped.applyInPandasWithState(keep, passing.schema, "claimed boolean", "append", GroupStateTimeout.NoTimeout)


def gate_stream(records: DataFrame, accepted_dir: str, checkpoint: str, config: RunConfig = RunConfig(), count: Counter = word_counter) -> StreamingQuery:
    """Writes the accepted rows to ``accepted_dir``; ``checkpoint`` holds the state, in a store on disk."""
    spark = records.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = first_accepted(records, config, count).writeStream.format("parquet").outputMode("append")
    return stream.option("path", accepted_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
