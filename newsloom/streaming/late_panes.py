"""Corrected counts over a stream: additions to partial counts stored by batch, windows recomposed when a pane changes.

The stream remembers where each story was seen, in buckets of stories, so that a
busy source is spread over tasks and a bucket's state stays small. A micro-batch
yields what it adds to the partial counts of ``operators/late_counts.py``, or takes
back where a story turns out to have arrived earlier or to lie in a second pane.
The additions are stored by day of event time and batch; only the windows they
touch are composed again, from the days they lie in. A batch that is repeated
after a failure overwrites itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions.times import utc_micros
from newsloom.operators.late_counts import Slices, composed, usable_rows

#: The stories of a source (and pane, where windows do not overlap) are remembered in so many parts.
BUCKETS = 64
#: Event time that is stored in one folder.
DAY = 86_400_000_000_000


def contributions(panes: dict[int, int], s: Slices) -> Counter:
    """(whole, start, slot) of every partial count in which a story counts, given its panes with their first arrivals."""
    out: Counter = Counter()
    if s.apart or len(panes) == 1:
        for pane, t in panes.items():
            out[False, pane, pane if t - pane < s.pane else t - t % s.slot] += 1
        return out
    windows: dict[int, int] = {}
    for pane, t in panes.items():
        start = pane - pane % s.slide
        while start + s.window > pane:
            windows[start] = min(t, windows.get(start, t))
            start -= s.slide
    for start, t in windows.items():
        out[True, start, start if t - start < s.window else t - t % s.slot] += 1
    return out


def pane_counts(
    stream: DataFrame, *, source: str, story: str, event_time: str, arrival: str, window_ns: int, lateness_ns: int, slide_ns: int | None = None, slot_ns: int = 60_000_000_000, disorder_ns: int | None = None
) -> DataFrame:
    """(src, whole, start, slot, n): what a micro-batch adds to the partial counts.

    A story counts at the earliest arrival of its rows, in whatever order the stream
    delivers them. Time goes by arrivals, never by the sources' clocks: state of a
    pane goes once arrivals are ``lateness_ns`` past the end of its last window. Rows may be
    delivered up to ``disorder_ns`` of arrival behind the newest (``lateness_ns`` if not
    given); those further behind are lost.
    """
    s = Slices(window_ns=window_ns, slide_ns=slide_ns, lateness_ns=lateness_ns, slot_ns=slot_ns)
    disorder_ns = lateness_ns if disorder_ns is None else disorder_ns
    x = usable_rows(stream, s, source=source, story=story, event_time=event_time, arrival=arrival).withColumn("story", F.col("story").cast("string"))
    x = x.withColumn("arrived", utc_micros(F.col("t"))).withWatermark("arrived", f"{-(-disorder_ns // 1_000_000)} milliseconds")
    part = F.col("pane") if s.apart else F.lit(0).cast("long")
    x = x.withColumns({"part": part, "bucket": F.pmod(F.xxhash64("story"), F.lit(BUCKETS))})
    held_ns = s.window + s.lateness

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState):
        now = held.getCurrentWatermarkMs() * 1_000_000
        known: dict[str, dict[int, int]] = {}
        for name, pane, t in zip(*held.get, strict=True) if held.exists else ():
            known.setdefault(name, {})[pane] = t
        changed: Counter = Counter()
        if not held.hasTimedOut:
            rows = pd.concat(list(batches)).groupby(["story", "pane"])["t"].min()
            new: dict[str, dict[int, int]] = {}
            for (name, pane), t in rows.items():
                new.setdefault(name, {})[int(pane)] = int(t)
            for name, panes in new.items():
                old = known.get(name, {})
                both = {p: min(t for t in (old.get(p), panes.get(p)) if t is not None) for p in {*old, *panes}}
                if both != old:
                    after, before = contributions(both, s), contributions(old, s) if old else Counter()
                    for k in {*after, *before}:
                        changed[k] += after[k] - before[k]
                    known[name] = both
        # A pane stays with its story while another pane of it may still share a window.
        live = [(name, p, t) for name, panes in known.items() if max(panes) + held_ns + (0 if s.apart else s.window) > now for p, t in panes.items()]
        if live:
            held.update(tuple(list(c) for c in zip(*live, strict=True)))
            held.setTimeoutTimestamp(max(-(-(min(p for _, p, _ in live) + held_ns + (0 if s.apart else s.window)) // 1_000_000), held.getCurrentWatermarkMs() + 1))
        else:
            held.remove()
        got = [(key[0], *k, n) for k, n in changed.items() if n]
        yield pd.DataFrame(got, columns=["src", "whole", "start", "slot", "n"])

    out = f"src {dict(x.dtypes)['src']}, whole boolean, start bigint, slot bigint, n bigint"
    return x.groupBy("src", "part", "bucket").applyInPandasWithState(run, out, "stories array<string>, panes array<bigint>, ts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def compose(partials: DataFrame, s: Slices) -> DataFrame:
    """(src, period_ns, slot, n_stories): the number at the close and after each slot of corrections."""
    w = Window.partitionBy("src", "period").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return composed(partials, s).select("src", F.col("period").alias("period_ns"), "slot", F.sum("n").over(w).alias("n_stories"))


def latest_panes(store: DataFrame) -> DataFrame:
    """The partial counts as of the last batch: all that the batches added."""
    return store.groupBy("src", "whole", "start", "slot").agg(F.sum("n").alias("n"))


def start_corrections(partials: DataFrame, *, store: str, emitted: str, checkpoint: str, window_ns: int, lateness_ns: int, slide_ns: int | None = None, slot_ns: int = 60_000_000_000, **trigger) -> StreamingQuery:
    """Run the stream: additions to ``store``, by day of event time and batch; recomposed windows to ``emitted``, by batch; both in shared storage."""
    s = Slices(window_ns=window_ns, slide_ns=slide_ns, lateness_ns=lateness_ns, slot_ns=slot_ns)

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at = f"{store}/new={n}"
        latest_panes(batch).where("n <> 0").withColumn("day", F.floor(F.col("start") / F.lit(DAY)).cast("long")).write.mode("overwrite").parquet(at)
        new = spark.read.parquet(at)
        # Days that the batch touches: as few as arrivals and lateness span.
        days = sorted(r[0] for r in new.select("day").distinct().collect())
        if not days:
            return
        new.withColumn("batch", F.lit(n)).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{store}/days")
        around = -(-s.window // DAY)
        wanted = sorted({d + k for d in days for k in range(-around, around + 1)})
        # Batches of a later, failed attempt are not there yet: numbers only change by whole batches.
        # By pattern, so that only these days' folders are listed, however old the stream is.
        kept = spark.read.option("basePath", f"{store}/days").parquet(f"{store}/days/day={{{','.join(map(str, wanted))}}}").where(F.col("batch") <= n)
        touched = new.select("src", F.explode(F.when(F.col("whole"), F.array("start")).otherwise(s.starts(F.col("start")))).alias("period_ns")).distinct()
        compose(latest_panes(kept), s).join(touched, ["src", "period_ns"], "left_semi").write.mode("overwrite").parquet(f"{emitted}/batch={n}")

    return partials.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(one).trigger(**(trigger or {"availableNow": True})).start()
