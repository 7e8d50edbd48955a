"""Market data: sessions, bars, ladders, books, baselines. Money is integer 1e-4 dollars until the last division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.times import eastern_date, eastern_minute, volume_fraction
from newsloom.operators.ordered import asof_join, with_running_sum

MINUTE = 60_000_000_000


def prints(tape: DataFrame) -> DataFrame:
    """Prints that count for volume and price: known ticker and time, printable, price and size above 0."""
    return tape.where("ticker is not null and ts_ns is not null and printable and px_e4 > 0 and shares > 0")


def session_rollup(t: DataFrame, *, cross: str | None = None) -> DataFrame:
    """Per ticker and Eastern day: open, high, low, last, pre-market high, volume, notional, prints, VWAP.

    The open is the first print from 09:30 to 16:00 and null without one. Ties
    in time go by print_id. With a column ``cross`` (O opening, C closing, else null)
    the opening cross sets the open, and ``close_e4`` is the price of the closing cross.
    """
    x = t.withColumns({"day": eastern_date(F.col("ts_ns")), "minute": eastern_minute(F.col("ts_ns"))})
    at = F.struct("ts_ns", "print_id")
    rth = F.col("minute").between(570, 959)
    opening = F.min_by("px_e4", F.when(rth, at))
    closing = []
    if cross:
        opening = F.coalesce(F.max_by("px_e4", F.when(F.col(cross) == "O", at)), opening)
        closing = [F.max_by("px_e4", F.when(F.col(cross) == "C", at)).alias("close_e4")]
    return x.groupBy("ticker", "day").agg(
        opening.alias("open_e4"),
        *closing,
        F.max("px_e4").alias("high_e4"),
        F.min("px_e4").alias("low_e4"),
        F.max_by("px_e4", at).alias("last_e4"),
        F.max_by("px_e4", F.when(rth, at)).alias("rth_last_e4"),
        F.max(F.when(F.col("minute") < 570, F.col("px_e4"))).alias("pm_high_e4"),
        F.sum(F.col("shares").cast("long")).alias("volume"),
        F.sum(F.col("px_e4").cast("long") * F.col("shares")).alias("notional_e4"),
        F.count(F.lit(1)).alias("n_prints"),
        F.max("ts_ns").alias("last_ns"),
    )


def vwap(notional_e4: Column, volume: Column) -> Column:
    """Dollars; 0 without volume."""
    return F.when(volume > 0, F.round(notional_e4 / volume / 10000, 6)).otherwise(0.0)


def spread_pct(bid: Column, ask: Column) -> Column:
    """Spread over mid in percent; 0 for one-sided or crossed quotes."""
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2) * 100).otherwise(0.0)


def quote_valid(bid: Column, ask: Column) -> Column:
    """Both sides are there and not crossed."""
    return F.coalesce((bid > 0) & (ask >= bid), F.lit(False))


def halted(state: Column) -> Column:
    """Whether a trading state (T trading, H halted, P paused, Q quotation only) is known and not trading."""
    return F.coalesce((state != "T") & (state != ""), F.lit(False))


def minute_bars(t: DataFrame) -> DataFrame:
    """OHLCV per ticker and minute; only minutes with prints."""
    at = F.struct("ts_ns", "print_id")
    return t.groupBy("ticker", (F.col("ts_ns") - F.pmod("ts_ns", F.lit(MINUTE))).alias("minute_ns")).agg(
        F.min_by("px_e4", at).alias("open_e4"), F.max("px_e4").alias("high_e4"), F.min("px_e4").alias("low_e4"), F.max_by("px_e4", at).alias("close_e4"),
        F.sum(F.col("shares").cast("long")).alias("volume"), F.count(F.lit(1)).alias("n_prints"),
    )


def depth(ops: DataFrame, *, book: str, side: str, price: str, qty: str) -> DataFrame:
    """Standing quantity per level, from signed quantities; levels at or below 0 are gone."""
    return ops.groupBy(book, side, price).agg(F.sum(qty).alias("qty")).where("qty > 0")


def best_levels(levels: DataFrame, *, book: str, side: str, price: str) -> DataFrame:
    """Highest bid (side B) and lowest ask (side S) with their quantities."""
    bid, ask = F.col(side) == "B", F.col(side) == "S"
    return levels.groupBy(book).agg(
        F.max(F.when(bid, F.col(price))).alias("bid"), F.max_by("qty", F.when(bid, F.col(price))).alias("bid_qty"), F.min(F.when(ask, F.col(price))).alias("ask"), F.min_by("qty", F.when(ask, F.col(price))).alias("ask_qty")
    )


def closing_price(sessions: DataFrame) -> Column:
    """Price of the closing cross, else the last of regular hours, else the last; 0 counts as none."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in ("close_e4", "rth_last_e4") if c in sessions.columns), F.col("last_e4"))


def baseline(sessions: DataFrame, n: int = 20) -> DataFrame:
    """Per ticker over the last ``n`` distinct days of all: mean volume over the days present, last close, days.

    The distinct days are few (one row per day), so ranking them is one small window.
    """
    days = sessions.select("day").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("rank") <= n)
    close = closing_price(sessions)
    return sessions.join(days, "day").groupBy("ticker").agg(F.round(F.avg("volume"), 4).alias("adv"), F.max_by(close, F.col("day")).alias("prev_close_e4"), F.count(F.lit(1)).alias("days"))


def rolling_baseline(sessions: DataFrame, n: int = 20, digits: int = 4) -> DataFrame:
    """Per ticker and day: mean volume over its days among the ``n`` distinct days before; null without one."""
    order = sessions.select("day").distinct().withColumn("rank", F.row_number().over(Window.orderBy("day")))
    w = Window.partitionBy("ticker").orderBy("rank").rangeBetween(-n, -1)
    return sessions.join(order, "day").select("ticker", "day", F.round(F.avg("volume").over(w), digits).alias("adv"))


def most_active(sessions: DataFrame, n: int) -> DataFrame:
    """The n (ticker, day) with the largest notional; ties by ticker and day. A top-k report."""
    return sessions.orderBy(F.desc("notional_e4"), "ticker", "day").limit(n)


def priced_executions(adds: DataFrame, executions: DataFrame) -> DataFrame:
    """Executions with the price of the resting order; unknown references are dropped (left-semi count them)."""
    return executions.join(adds.select("session", "ref", F.col("px_e4").alias("resting_e4")), ["session", "ref"]).withColumn("px_e4", F.coalesce("px_e4", "resting_e4")).drop("resting_e4")


def sequence_gaps(packets: DataFrame, *, stream: str, seq: str, count: str) -> DataFrame:
    """Gaps ``(stream, from_seq, lost)`` of numbered packets; overlaps and duplicates close nothing and open nothing.

    A packet starts a gap if it begins beyond all sequence numbers before it. The
    running maximum goes by ranges of sequence numbers, so that one busy stream
    is spread over tasks.
    """
    span = 1_000_000
    x = packets.dropna(subset=[stream, seq]).select(F.col(stream).alias("s"), F.col(seq).cast("long").alias("q"), F.coalesce(F.col(count), F.lit(1)).cast("long").alias("c")).withColumn("b", F.floor(F.col("q") / span))
    per = x.groupBy("s", "b").agg(F.max(F.col("q") + F.col("c")).alias("top"))
    carry = per.select("s", "b", F.max("top").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    w = Window.partitionBy("s", "b").orderBy("q", "c").rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(carry, ["s", "b"]).withColumn("seen", F.greatest(F.max(F.col("q") + F.col("c")).over(w), F.col("carry")))
    return y.where("seen is not null and q > seen").select(F.col("s").alias(stream), F.col("seen").alias("from_seq"), (F.col("q") - F.col("seen")).alias("lost"))


def since_minute(bars: DataFrame, asked: DataFrame, *, from_ns: str) -> DataFrame:
    """``asked`` (ticker, ``from_ns``, ...) with ``volume_since``: volume of the bars from that minute on; 0 without any. ``bars`` are those of one session.

    Running totals per ticker and hour bucket, so no asked row is paired with the
    bars it sums over.
    """
    total = bars.groupBy("ticker").agg(F.sum("volume").alias("_all"))
    up_to = with_running_sum(bars.select("ticker", "minute_ns", "volume"), keys=["ticker"], time="minute_ns", tie=[], value=F.col("volume"), name="_sum")
    x = asof_join(asked, up_to, keys=["ticker"], left_time=from_ns, right_time="minute_ns", take={"_sum": "_before"})
    return x.join(total, "ticker", "left").withColumn("volume_since", F.when(F.col(from_ns).isNotNull(), F.coalesce(F.col("_all") - F.coalesce("_before", F.lit(0)), F.lit(0)))).select(*asked.columns, "volume_since")


def price_at_minute(bars: DataFrame, asked: DataFrame, *, at_ns: str) -> DataFrame:
    """``asked`` (ticker, ``at_ns``, ...) with ``price_e4``: close of the last bar at or before that minute; 0 without one. ``bars`` are those of one session."""
    x = asof_join(asked, bars, keys=["ticker"], left_time=at_ns, right_time="minute_ns", take={"close_e4": "price_e4"}, strict=False)
    return x.withColumn("price_e4", F.coalesce("price_e4", F.lit(0)))


def rvol(day_volume: Column, adv: Column, minute: Column) -> Column:
    """Volume so far over what is usual by this minute of the Eastern day, which is 0.002 of ``adv`` at least; 0 without ``adv``."""
    return F.when(adv > 0, day_volume / F.greatest(adv * volume_fraction(minute), adv * 0.002)).otherwise(0.0)
