"""Stateful streams: the batch operators' step functions over micro-batches, and windowed bars."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions.times import utc_micros
from newsloom.operators.market import prints


def fold_stream(stream: DataFrame, *, keys: Sequence[str], order: Sequence[str], step: Callable, out: str, state: str, idle_ms: int | None = None) -> DataFrame:
    """Sequential fold per key over a stream; rows of a micro-batch are taken in ``order``.

    ``step(state tuple or None, row dict)`` gives ``(state tuple, result tuple or
    None)``. A key that is idle for ``idle_ms`` is forgotten; choose it longer than
    what the step remembers. Idle keys are looked for in every micro-batch, also
    in ones without data, so a query that runs until no data is left (trigger
    ``availableNow``) must leave it unset.
    """
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        now = held.get if held.exists else None
        got = []
        for row in rows.to_dict("records"):
            now, result = step(now, row)
            if result is not None:
                got.append(result)
        if now is not None:
            held.update(now)
            if idle_ms is not None:
                held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(got, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def cooled_down_stream(stream: DataFrame, *, keys: Sequence[str], time: str, id_col: str, cooldown: int, idle_ms: int | None = None) -> DataFrame:
    """Rows that pass: at least ``cooldown`` after the last row of the key that passed."""

    def step(last, row):
        if last is None or row[time] - last[0] >= cooldown:
            return (row[time],), (row[id_col],)
        return last, None

    return fold_stream(stream.where(F.col(time).isNotNull()), keys=keys, order=[time, id_col], step=step, out=f"{id_col} bigint", state="t bigint", idle_ms=idle_ms)


def repeats_dropped_stream(stream: DataFrame, *, keys: Sequence[str], time: str, id_col: str, state: str, within: int, idle_ms: int | None = None) -> DataFrame:
    """Rows in another state than the last kept one of the key, or ``within`` later than it."""

    def step(last, row):
        if last is None or last[1] != row[state] or row[time] - last[0] >= within:
            return (row[time], row[state]), (row[id_col],)
        return last, None

    return fold_stream(stream.where(F.col(time).isNotNull()), keys=keys, order=[time, id_col], step=step, out=f"{id_col} bigint", state="t bigint, s string", idle_ms=idle_ms)


def first_seen_stream(stream: DataFrame, *, key: str, time: str, id_col: str, source: str, idle_ms: int | None = None) -> DataFrame:
    """Each story with its key's first source and its lag behind it, as the stream delivers them."""

    def step(first, row):
        dup = first is not None
        first = first or (row[time], row[source])
        return first, (row[id_col], dup, first[1], row[time] - first[0])

    return fold_stream(stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()), keys=[key], order=[time, id_col], step=step, out=f"{id_col} bigint, dup boolean, first_src string, behind_ns bigint", state="t bigint, s string", idle_ms=idle_ms)


def deduplicated_stream(stream: DataFrame, *, keys: Sequence[str], time_ns: str, horizon: str = "1 day") -> DataFrame:
    """First row per key within the horizon; state is bounded by the watermark."""
    return stream.withColumn("_ts", utc_micros(F.col(time_ns))).withWatermark("_ts", horizon).dropDuplicatesWithinWatermark(list(keys)).drop("_ts")


def minute_bars_stream(tape: DataFrame, *, late: str = "1 minute") -> DataFrame:
    """Final OHLCV bars, one per ticker and minute, once the watermark has passed the minute."""
    at = F.struct("ts_ns", "print_id")
    t = prints(tape).withColumn("_ts", utc_micros(F.col("ts_ns"))).withWatermark("_ts", late)
    bars = t.groupBy("ticker", F.window("_ts", "1 minute").alias("w")).agg(
        F.min_by("px_e4", at).alias("open_e4"), F.max("px_e4").alias("high_e4"), F.min("px_e4").alias("low_e4"), F.max_by("px_e4", at).alias("close_e4"), F.sum(F.col("shares").cast("long")).alias("volume"), F.count(F.lit(1)).alias("n_prints")
    )
    return bars.select("ticker", (F.unix_micros("w.start") * 1000).alias("minute_ns"), *(c for c in bars.columns if c not in ("ticker", "w")))
