"""Per-period counts that late records correct, by stream slicing.

Event time is cut into panes that do not overlap, of the greatest width at which
all window bounds fall on pane bounds. A record touches one pane; a pane is kept
as partial counts by slot of arrival; windows are composed of the partial counts
of their panes, and a late record re-emits the windows that cover its pane, until
the cut-off. A story whose rows lie in several panes would be counted more than
once in a window that covers them: such stories, alone, are counted by window.

A partial count is a row ``(src, whole, start, slot, n)``: ``n`` stories of the pane
(or, where ``whole``, of the window) that begins at ``start`` arrived in the slot that
begins at ``slot``; those that are on time for every window carry the start itself.
Batch and stream (``streaming/late_panes.py``) compose windows by the same code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import cut, shuffle_partitions

#: A busy slot's corrections are written in runs of so many, spread over the tasks.
RUN = 10_000
#: Stories of several panes up to this number are broadcast (under 10 MB), more are joined by a shuffle.
LISTED = 50_000


class Slices:
    """Window, slide and lateness in nanoseconds with the pane and slot width they allow."""

    def __init__(self, *, window_ns: int, lateness_ns: int, slide_ns: int | None = None, slot_ns: int = 60_000_000_000):
        self.window, self.slide, self.lateness = window_ns, slide_ns or window_ns, lateness_ns
        self.pane = math.gcd(self.window, self.slide)
        self.slot = math.gcd(slot_ns, self.pane, lateness_ns)
        #: Windows that share no pane: a story of two panes is two stories.
        self.apart = self.window == self.slide

    def starts(self, pane: Column) -> Column:
        """The windows that cover a pane, window / slide of them; none where windows leave gaps."""
        last = pane - F.pmod(pane, F.lit(self.slide))
        every = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(self.window / self.slide))), lambda i: last - i.cast("long") * self.slide)
        return F.filter(every, lambda s: s + self.window > pane)


def floored(c: Column, width: int) -> Column:
    return c - F.pmod(c, F.lit(width))


def usable_rows(events: DataFrame, s: Slices, *, source: str, story: str, event_time: str, arrival: str) -> DataFrame:
    """(src, story, pane, t): rows that may count, of known source, story, time and arrival and not too late for the last window of their pane."""
    return (
        events.select(F.col(source).alias("src"), F.col(story).alias("story"), F.col(event_time).cast("long").alias("e"), F.col(arrival).cast("long").alias("t"))
        .where("src is not null and story is not null and e is not null and e != 0 and t is not null")
        .select("src", "story", floored(F.col("e"), s.pane).alias("pane"), "t")
        .where(F.col("t") - F.col("pane") < s.window + s.lateness)
    )


def _partial(rows: DataFrame, s: Slices, start: str, length: int, whole: bool) -> DataFrame:
    slot = F.when(F.col("t") - F.col(start) < length, F.col(start)).otherwise(floored(F.col("t"), s.slot))
    return rows.groupBy("src", F.lit(whole).alias("whole"), F.col(start).alias("start"), slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def partial_counts(rows: DataFrame, s: Slices) -> DataFrame:
    """Partial counts of ``usable_rows``, each story by its first arrival."""
    if s.apart:
        return _partial(rows.groupBy("src", "pane", "story").agg(F.min("t").alias("t")), s, "pane", s.pane, False)
    # Once per story, with the ends of its panes; read twice, so it is made once.
    k = cut(rows.groupBy("src", "story").agg(F.min("pane").alias("pane"), F.max("pane").alias("hi"), F.min("t").alias("t")))
    panes = _partial(k.where("pane = hi"), s, "pane", s.pane, False)
    several = k.where("pane < hi").select("src", "story")
    listed = several.limit(LISTED + 1).collect()
    if not listed:
        return panes
    if len(listed) <= LISTED:
        several = F.broadcast(k.sparkSession.createDataFrame(listed, several.schema))
    w = rows.join(several, ["src", "story"], "left_semi").select("src", "story", "t", F.explode(s.starts(F.col("pane"))).alias("period"))
    return panes.unionByName(_partial(w.groupBy("src", "period", "story").agg(F.min("t").alias("t")), s, "period", s.window, True))


def composed(partials: DataFrame, s: Slices) -> DataFrame:
    """(src, period, slot, n): windows put together from partial counts, on time (slot -1) and by slot of late arrival."""
    spread = F.when(F.col("whole"), F.array("start")).otherwise(s.starts(F.col("start")))
    w = partials.select("src", F.explode(spread).alias("period"), F.col("slot").alias("at"), "n")
    late = F.col("at") - F.col("period") - F.lit(s.window)
    slot = F.when(late < 0, F.lit(-1)).otherwise(late / s.slot).cast("long")
    return w.where(late < s.lateness).groupBy("src", "period", slot.alias("slot")).agg(F.sum("n").alias("n")).where("n <> 0")


def corrected_counts(
    events: DataFrame,
    *,
    source: str,
    story: str,
    event_time: str,
    arrival: str,
    window_ns: int,
    lateness_ns: int,
    slide_ns: int | None = None,
    slot_ns: int = 60_000_000_000,
    corrections_only: bool = True,
) -> DataFrame:
    """Rows ``(src, period_ns, n_stories)``, one per correction, or with the number at the close first.

    A period is a source and a window ``[start, start + window_ns)`` of event
    time. A story counts once per period and arrives with its earliest row
    there. Stories that arrive before the end make the number at the close;
    those before ``end + lateness_ns`` correct it one by one; later ones are
    dropped. Rows with null source, story or arrival, or with event time null or
    0, belong to no period. Without rows the result is empty. With
    ``corrections_only=False`` each period also gives its number at the close,
    which is 0 where all its stories were late.
    """
    s = Slices(window_ns=window_ns, slide_ns=slide_ns, lateness_ns=lateness_ns, slot_ns=slot_ns)
    slots = composed(partial_counts(usable_rows(events, s, source=source, story=story, event_time=event_time, arrival=arrival), s), s)
    # At most lateness_ns / slot_ns + 1 rows to a window.
    w = Window.partitionBy("src", "period").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    run = slots.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    late = run.where("slot >= 0")
    starts = late.select("src", "period", F.explode(F.expr(f"sequence(before + 1, before + n, {RUN}L)")).alias("lo"), (F.col("before") + F.col("n")).alias("hi"))
    spread = starts.repartition(shuffle_partitions(events.sparkSession), "src", "period", "lo")
    out = spread.select("src", F.col("period").alias("period_ns"), F.explode(F.sequence("lo", F.least("hi", F.col("lo") + (RUN - 1)))).alias("n_stories"))
    if not corrections_only:
        close = slots.groupBy("src", "period").agg(F.sum(F.when(F.col("slot") < 0, F.col("n")).otherwise(0)).alias("n_stories"))
        out = out.unionByName(close.withColumnRenamed("period", "period_ns"))
    return out
