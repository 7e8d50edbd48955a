"""What changed between consecutive full snapshots.

Each snapshot row is tagged twice, as the new side of its own step and the old
side of the next, and one aggregation by (step, key) classifies the key from the
hashes of either side. All snapshots are compared in the same shuffle; repeated
rows fold into map-side partial results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display_symbol(c: Column) -> Column:
    """``brk/b``, `` BRK-B `` and ``BRK B`` become ``BRK.B``; blank becomes null."""
    bare = F.regexp_replace(F.upper(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.nullif(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "."), F.lit(""))


def squeezed(c: Column) -> Column:
    """Without case and spaces; null and blank are the same."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"[\s\p{Z}]+", "")), F.lit(""))


def final_deliveries(rows: DataFrame, *, date: str, delivered: str) -> DataFrame:
    """(date, delivered, step, next): the last delivery of each date, its own step (null for the first) and that of the date after it.

    One row per date, which does not grow with the rows of a snapshot.
    """
    d = rows.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("date")).agg(F.max(F.col(delivered)).alias("delivered"))
    w = Window.orderBy("date")
    return d.withColumn("step", F.when(F.lag("date").over(w).isNotNull(), F.col("date"))).withColumn("next", F.lead("date").over(w))


def snapshot_changes(
    rows: DataFrame,
    *,
    date: str,
    delivered: str,
    row_id: str,
    key: Column,
    is_record: Column,
    compared: Mapping[str, Column],
) -> DataFrame:
    """Rows ``(snap_date, key, change_kind)`` for each date after the first.

    ``change_kind`` is ``added``, ``removed`` (dated by the snapshot that lacks
    the key) or the name of a compared attribute. A snapshot is the delivery
    with the greatest ``delivered`` of its date; a date whose delivery holds no
    record is an empty snapshot. Rows with a null date, key or delivery, or
    without ``is_record``, are no records. Where a key repeats within a snapshot
    its smallest ``row_id`` speaks for it (a null one last). One date or none gives no rows.
    """
    dates = final_deliveries(rows, date=date, delivered=delivered)
    sides = [F.xxhash64(c).alias(f"h_{name}") for name, c in compared.items()]
    r = rows.select(F.col(date).alias("date"), F.col(delivered).alias("delivered"), F.coalesce(F.col(row_id).cast("long"), F.lit(2**63 - 1)).alias("id"), key.alias("key"), is_record.alias("ok"), *sides).where("ok and key is not null").drop("ok")
    r = r.join(_listed(dates), ["date", "delivered"])
    tagged = r.select("key", "id", *(f"h_{n}" for n in compared), F.explode(F.array(F.struct("step", F.lit(True).alias("new")), F.struct(F.col("next").alias("step"), F.lit(False).alias("new")))).alias("side"))
    tagged = tagged.where("side.step is not null").select("key", "id", F.col("side.step").alias("step"), F.col("side.new").alias("new"), *(f"h_{n}" for n in compared))
    # Plain longs throughout, so that both phases of the aggregation hash and nothing is sorted.
    of = {"b": F.when(F.col("new"), F.col("id")), "a": F.when(~F.col("new"), F.col("id"))}
    spoken = [F.min_by(f"h_{n}", rank).alias(f"{side}_{n}") for side, rank in of.items() for n in compared]
    both = tagged.groupBy("step", "key").agg(*(F.count(rank).alias(side) for side, rank in of.items()), *spoken)
    kinds = F.when(F.col("a") == 0, F.array(F.lit("added"))).when(F.col("b") == 0, F.array(F.lit("removed"))).otherwise(
        F.array_compact(F.array(*(F.when(F.col(f"a_{n}") != F.col(f"b_{n}"), F.lit(n)) for n in compared)))
    )
    return both.select(F.col("step").alias("snap_date"), "key", F.explode(kinds).alias("change_kind"))


def _listed(dates: DataFrame, most: int = 100_000) -> DataFrame:
    """The list of dates, broadcast if it has at most ``most`` rows (two centuries of daily snapshots do)."""
    rows = dates.limit(most + 1).collect()
    return F.broadcast(dates.sparkSession.createDataFrame(rows, dates.schema)) if len(rows) <= most else dates
