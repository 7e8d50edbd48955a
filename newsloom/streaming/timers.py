"""Streams that wait: packets put in order until a gap is given up, outcomes when their horizon has passed.

Time is event time. What waits is held in state per key and let go by event-time
timers, so results do not depend on how rows fall into micro-batches. Rows that
come more than ``disorder`` behind the newest are lost.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions.times import utc_micros

MS = 1_000_000


def _timed(df: DataFrame, time_ns: str, disorder: str) -> DataFrame:
    return df.withColumn("_ts", utc_micros(F.col(time_ns))).withWatermark("_ts", disorder)


def _wake(held: GroupState, at_ns: int) -> None:
    held.setTimeoutTimestamp(max(-(-at_ns // MS), held.getCurrentWatermarkMs() + 1))


def packets_in_order(stream: DataFrame, *, key: str, seq: str, count: str, time_ns: str, payload: str, timeout_ns: int = 250 * MS, disorder: str = "1 second") -> DataFrame:
    """(key, seq, n, lost, payload): numbered packets in order, each number once.

    A packet beyond the next number is held until the gap before it is filled or
    is ``timeout_ns`` old; then the gap's numbers are counted in ``lost`` of the packet
    after it. ``seq`` and ``n`` are the numbers of a packet that are new: what
    overlaps earlier ones is trimmed, repeated packets drop out. The first packet
    of a key sets where its numbers start.
    """
    x = stream.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col(time_ns).isNotNull())
    x = _timed(x.select(F.col(key).alias("k"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(count), F.lit(1)).cast("long").alias("n"), F.col(time_ns).cast("long").alias("t"), F.col(payload).alias("payload")), "t", disorder)
    kinds = dict(x.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], held: GroupState):
        expected, since, wait = None, None, {}
        if held.exists:
            expected, since, seqs, ns, payloads = held.get
            wait = {s: (n, p) for s, n, p in zip(seqs, ns, payloads, strict=True)}
        out = []

        def drain(now: int) -> None:
            nonlocal expected, since
            moved = False
            for s in sorted(wait):
                if s > expected:
                    break
                n, p = wait.pop(s)
                if s + n > expected:
                    out.append((k[0], expected, s + n - expected, 0, p))
                    expected, moved = s + n, True
            if not wait:
                since = None
            elif moved or since is None:
                since = now

        def give_up(now: int) -> None:
            """Pass over gaps that are too old; the wait for the next one begins when the last ended."""
            nonlocal expected, since
            while wait and now - since > timeout_ns:
                since += timeout_ns
                lost, expected, at = min(wait) - expected, min(wait), len(out)
                drain(since)
                out[at] = (*out[at][:3], lost, out[at][4])

        if held.hasTimedOut:
            give_up(held.getCurrentWatermarkMs() * MS)
        else:
            rows = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")
            for s, n, t, p in zip(rows["seq"].tolist(), rows["n"].tolist(), rows["t"].tolist(), rows["payload"].tolist(), strict=True):
                give_up(t)
                if expected is None:
                    expected = s
                if n > 0 and s + n > expected and (s not in wait or n > wait[s][0]):
                    wait[s] = (n, p)
                    drain(t)
        seqs = sorted(wait)
        held.update((expected, since, seqs, [wait[s][0] for s in seqs], [wait[s][1] for s in seqs]))
        if wait:
            _wake(held, since + timeout_ns + 1)
        yield pd.DataFrame(out, columns=["k", "seq", "n", "lost", "payload"])

    state = f"expected bigint, since bigint, seqs array<bigint>, ns array<bigint>, payloads array<{kinds['payload']}>"
    got = x.groupBy("k").applyInPandasWithState(run, f"k {kinds['k']}, seq bigint, n bigint, lost bigint, payload {kinds['payload']}", state, "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(F.col("k").alias(key), "seq", "n", "lost", F.col("payload").alias(payload))


def horizon_outcomes(stories: DataFrame, prints: DataFrame, *, key: str, id_col: str, time_ns: str, print_ns: str, print_id: str, price: str, horizons_ns: Sequence[int], disorder: str = "1 second") -> DataFrame:
    """(id_col, horizon_ns, price): per story each horizon once, when time has passed it, with the last price before it.

    Null without a price till then. Of prints at one time the greatest ``print_id`` counts.
    """
    # No nulls: pandas would make them floats, which do not hold all ids.
    a = stories.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(time_ns).cast("long").alias("t"), F.lit(0).cast(dict(prints.dtypes)[print_id]).alias("tie"), F.lit(0).cast("long").alias("px"), F.lit(False).alias("print"))
    b = prints.where(F.col(price).isNotNull()).select(F.col(key).alias("k"), F.lit(0).cast(dict(a.dtypes)["id"]).alias("id"), F.col(print_ns).cast("long").alias("t"), F.col(print_id).alias("tie"), F.col(price).cast("long").alias("px"), F.lit(True).alias("print"))
    x = _timed(a.where("id is not null").unionByName(b.where("tie is not null")).where("k is not null and t is not null"), "t", disorder)
    id_type, tie_type = dict(x.dtypes)["id"], dict(x.dtypes)["tie"]

    def run(_, batches: Iterator[pd.DataFrame], held: GroupState):
        due, marks = [], []
        if held.exists:
            ids, dues, spans, ts, ties, pxs = held.get
            due, marks = list(zip(dues, spans, ids, strict=True)), list(zip(ts, ties, pxs, strict=True))
        if not held.hasTimedOut:
            for rows in batches:
                news = rows[~rows["print"]]
                due += [(t + h, h, i) for t, i in zip(news["t"].tolist(), news["id"].tolist(), strict=True) for h in horizons_ns]
                trades = rows[rows["print"]]
                marks += zip(trades["t"].tolist(), trades["tie"].tolist(), trades["px"].tolist(), strict=True)
        marks.sort()
        now = held.getCurrentWatermarkMs() * MS
        times = [m[0] for m in marks]
        out = []
        for at, h, i in (d for d in due if d[0] < now):
            j = bisect.bisect_left(times, at)
            out.append((i, h, marks[j - 1][2] if j else None))
        due = sorted((d for d in due if d[0] >= now), key=lambda d: d[0])
        # No later horizon looks behind the last price before now.
        marks = marks[max(0, bisect.bisect_left(times, min(now, due[0][0] if due else now)) - 1) :]
        held.update(([d[2] for d in due], [d[0] for d in due], [d[1] for d in due], *([m[c] for m in marks] for c in range(3))))
        if due:
            _wake(held, due[0][0] + 1)
        yield pd.DataFrame({"id": pd.Series([o[0] for o in out], dtype=object), "h": pd.Series([o[1] for o in out], dtype="int64"), "px": pd.Series([o[2] for o in out], dtype="Int64")})

    state = f"ids array<{id_type}>, dues array<bigint>, spans array<bigint>, ts array<bigint>, ties array<{tie_type}>, pxs array<bigint>"
    got = x.groupBy("k").applyInPandasWithState(run, f"id {id_type}, h bigint, px bigint", state, "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(F.col("id").alias(id_col), F.col("h").alias("horizon_ns"), F.col("px").alias(price))
