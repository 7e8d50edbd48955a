"""Journals: JSON lines in day folders, read with explicit schemas and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.times import eastern_date

SCHEMAS = {
    "news": "t string, src string, kind string, id string, recv_ns bigint, sent_ns bigint, pub_ns bigint, engine_ns bigint, pub_to_recv_ms double, title string, link string, tickers array<string>, name_matched boolean, unresolved array<string>, form string, cik bigint, items string, halt_reason string, market string, score int, text_score int, catalyst string, flags string, amount_usd double, matched array<string>, sym string, price double, mcap double, in_universe boolean, dilution string, dup boolean, first_src string, behind_first_ms double, body string",
    "signals": "t string, tier string, ticker string, exchange string, score int, catalyst string, price double, ref_price double, move_pct double, rvol double, dollar_volume double, vwap double, bid double, ask double, spread_pct double, mcap double, amount_usd double, flags string, dilution string, halt_reason string, why string, title string, link string, src string, news_id string, news_recv_ns bigint, signal_ns bigint, news_to_signal_ms double",
    "outcomes": "t string, ticker string, news_id string, horizon_s bigint, score int, catalyst string, tier_reached string, ref_price double, price double, move_pct double, max_move_pct double, min_move_pct double, volume_since double, dollar_volume_since double",
    "trades": "t string, event string, ticker string, tier string, catalyst string, score int, news_id string, signal_ns bigint, entry_ns bigint, signal_px double, entry_px double, shares double, exit_ns bigint, exit_px double, exit_reason string, hold_s double, fees double, pnl_usd double, pnl_pct double, mfe_pct double, mae_pct double",
}


def read_journal(spark: SparkSession, folder: str, kind: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of ``folder/KIND/day=YYYY-MM-DD/`` with ``day`` from first to last inclusive; folders are pruned.

    Lines that do not parse have their text in ``_corrupt``, so that they can be counted.
    """
    raw = spark.read.schema(SCHEMAS[kind] + ", _corrupt string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(f"{folder}/{kind}")
    if first:
        raw = raw.where(F.col("day").cast("date") >= F.lit(first).cast("date"))
    if last:
        raw = raw.where(F.col("day").cast("date") <= F.lit(last).cast("date"))
    return raw


def closed_trades(trades: DataFrame) -> DataFrame:
    return trades.where("event = 'close'")


def write_journal(rows: DataFrame, folder: str, kind: str, *, time_ns: str) -> None:
    """Append to day folders by Eastern date as gzip JSON lines; null fields are left out."""
    x = rows.withColumn("day", F.date_format(eastern_date(F.col(time_ns)), "yyyy-MM-dd"))
    x.write.mode("append").partitionBy("day").option("ignoreNullFields", "true").option("compression", "gzip").json(f"{folder}/{kind}")


def store_sessions(sessions: DataFrame, folder: str) -> None:
    """Replace the days that ``sessions`` holds in a Parquet store and keep all others."""
    sessions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
