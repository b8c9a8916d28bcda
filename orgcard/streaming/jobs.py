"""Incremental forms: arriving pages to results, arriving rows to snapshots."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from orgcard.sources.dims import CACHE_DAYS
from orgcard.sources.results import write_batch


def upsert_stream(
    arriving: DataFrame, to_results: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Turn each micro-batch into result rows and store it under its own batch number.

    The checkpoint is the resume offset; a batch that is replayed replaces itself.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(to_results(batch), path, batch_id)

    return (
        arriving.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def first_in_window(arriving: DataFrame, key: str, time: str, days: int = CACHE_DAYS) -> DataFrame:
    """(key, time) of the rows that pass: the first of a key, then the first that comes ``days`` after the last passed one.

    Micro-batches must follow each other in time; within one, rows may come in any order. The state of a key is the time
    that passed last, dropped when the watermark shows that the period is over and any row would pass. Rows without a time
    have no place in a period and do not pass; a null key is a key of its own.
    """
    period = timedelta(days=days)

    def step(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = pd.concat([f[time] for f in frames]).sort_values(ignore_index=True)
        passed, at = [], 0 if last is None else times.searchsorted(pd.Timestamp(last) + period)
        while at < len(times):  # one step for each row that passes
            passed.append(times[at])
            at = times.searchsorted(passed[-1] + period)
        if passed:
            last = passed[-1].to_pydatetime()
        state.update((last,))
        expiry = int((last + period).replace(tzinfo=timezone.utc).timestamp() * 1000)
        if expiry > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expiry)
        if passed:
            yield pd.DataFrame({key: [keys[0]] * len(passed), time: passed})

    arriving = arriving.where(F.col(time).isNotNull())
    timed = arriving.select(key, F.col(time).cast("timestamp_ntz").alias(time), F.col(time).cast("timestamp").alias("_at"))
    types = dict(timed.dtypes)
    return timed.withWatermark("_at", "0 seconds").groupBy(key).applyInPandasWithState(
        step, f"{key} {types[key]}, {time} timestamp_ntz", "last timestamp_ntz", "append", GroupStateTimeout.EventTimeTimeout
    )


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
