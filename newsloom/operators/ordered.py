"""Ordered analytics that hold when one key owns a large part of the rows.

A window over (key) alone would put all rows of a busy key into one task. Here
every operator works in partitions of (key, time bucket) and carries what it
needs from earlier buckets as one summary row per bucket, so that the only
window over a whole key runs over its buckets. Buckets are of fixed width, and cut
further where ``burst_rows`` says how many rows are too many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.slices import sliced

HOUR = 3_600_000_000_000


def bucket_of(time: Column, width: int) -> Column:
    return (time - F.pmod(time, F.lit(width))) / F.lit(width)


def with_last(df: DataFrame, *, keys: Sequence[str], time: str, tie: Sequence[str], value: Column, name: str, width: int = HOUR, inclusive: bool = False, burst_rows: int | None = None) -> DataFrame:
    """``df`` with the last non-null ``value`` of its key before each row (or at it, if ``inclusive``).

    Rows are ordered by ``time``, then ``tie``; of equal rows the order is open,
    so ``tie`` should make it total. Null keys form a key of their own. Rows with
    null time come first. With ``burst_rows`` buckets over so many rows are cut
    at quantiles of their times, for one pass of counting.
    """
    x = sliced(df.withColumn("_b", F.floor(bucket_of(F.col(time), width))), keys=keys, bucket="_b", time=time, most=burst_rows).withColumn("_v", value)
    order = F.struct(F.col(time).alias("t"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(tie)), F.col("_v").alias("v"))
    per = x.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_v").isNotNull(), order)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_b", F.max("_m").over(before)["v"].alias("_v"), F.lit(False).alias("_real")).where("_v is not null")
    # The carried value is one more row at the start of its bucket: no join, and one shuffle by (keys, bucket).
    y = x.withColumn("_real", F.lit(True)).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_real", time, *tie).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return y.withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_real").drop("_b", "_v", "_real")


def with_running_sum(df: DataFrame, *, keys: Sequence[str], time: str, tie: Sequence[str], value: Column, name: str, width: int = HOUR, burst_rows: int | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` (nulls count as nothing) up to and including each row.

    Null keys form a key of their own, rows with null time come first.
    """
    x = sliced(df.withColumn("_b", F.floor(bucket_of(F.col(time), width))), keys=keys, bucket="_b", time=time, most=burst_rows).withColumn("_v", F.coalesce(value, F.lit(0)))
    per = x.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_b", F.sum("_s").over(before).alias("_v"), F.lit(False).alias("_real")).where("_v is not null")
    y = x.withColumn("_real", F.lit(True)).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_real", time, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return y.withColumn(name, F.sum("_v").over(w)).where("_real").drop("_b", "_v", "_real")


def asof_join(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_time: str, right_time: str, take: dict[str, str], tie: Sequence[str] = (), strict: bool = True, width: int = HOUR, burst_rows: int | None = None
) -> DataFrame:
    """Each left row with the columns ``take`` (right name to new name) of the latest right row before it.

    ``strict`` sees only earlier times, else equal ones too. Of right rows at one
    time the greatest by ``tie`` counts. Left rows without partner, with null key
    or null time keep nulls. Right rows with null key or time take no part.
    Other right columns are ignored, clashing names included.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)]
    ties = [f"_t{i}" for i in range(len(tie))]
    payload = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)))
    r = right.dropna(subset=[*keys, right_time]).select(
        *named, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), *(F.col(c).alias(n) for c, n in zip(tie, ties, strict=True)), F.struct(*(F.col(a).alias(b) for a, b in take.items())).alias("_r")
    )
    l = left.select(*named, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), payload.alias("_l"))  # noqa: E741
    u = l.unionByName(r, allowMissingColumns=True)
    out = with_last(u, keys=ks, time="_t", tie=["_side", *ties], value=F.col("_r"), name="_m", width=width, burst_rows=burst_rows).where("_l is not null")
    return out.select(*(F.col(f"_l.c{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"_m.{b}").alias(b) for b in take.values()))


def interval_stats(points: DataFrame, values: DataFrame, *, keys: Sequence[str], point_id: str, point_time: str, value_time: str, value: str, weight: str, length: int, burst_rows: int | None = None) -> DataFrame:
    """Per point: n, sum of weight, notional, max and min of value over ``(time, time + length]``.

    Cut into buckets as long as the interval, an interval is the tail of one
    bucket and the head of the next. Both come from running aggregates, so no
    point is paired with the rows of its interval: the cost is linear however
    many intervals overlap. Points without rows get n = 0 and nulls; null keys
    and times of points likewise; such values take no part. With ``burst_rows``
    buckets over so many rows are cut at quantiles; each slice then begins with the
    aggregate of the slices before it and ends with that of those after it.
    """
    t = F.col(point_time)
    b = lambda c: F.floor(bucket_of(c, length))
    p = points.select(*keys, F.col(point_id).alias("_id"), t.alias("_s"))
    known = p.dropna(subset=[*keys, "_s"])
    heads = known.select(*keys, "_id", (F.col("_s") + length).alias("_t"), b(F.col("_s") + length).alias("_b"), F.lit(1).alias("_kind"))
    tails = known.select(*keys, "_id", F.col("_s").alias("_t"), b(F.col("_s")).alias("_b"), F.lit(2).alias("_kind"))
    v, w = F.col(value).cast("long"), F.col(weight).cast("long")
    rows = values.dropna(subset=[*keys, value_time]).select(*keys, F.col(value_time).alias("_t"), b(F.col(value_time)).alias("_b"), F.lit(0).alias("_kind"), v.isNotNull().cast("long").alias("n"), w.alias("w"), (v * w).alias("x"), v.alias("hi"), v.alias("lo"))
    u = sliced(heads.unionByName(tails).unionByName(rows, allowMissingColumns=True), keys=keys, bucket="_b", time="_t", most=burst_rows)
    how = {"n": F.sum, "w": F.sum, "x": F.sum, "hi": F.max, "lo": F.min}
    if isinstance(u.schema["_b"].dataType, T.StructType):
        per = u.where("_kind = 0").groupBy(*keys, "_b").agg(*(f(c).alias(c) for c, f in how.items()))
        every = u.select(*keys, "_b").distinct().join(per, [*keys, "_b"], "left")
        order = Window.partitionBy(*keys, F.col("_b.b")).orderBy("_b.s")
        for kind, side in ((-1, order.rowsBetween(Window.unboundedPreceding, -1)), (3, order.rowsBetween(1, Window.unboundedFollowing))):
            far = F.lit(-(2**63) if kind < 0 else 2**63 - 1).cast("long")
            u = u.unionByName(every.select(*keys, "_b", far.alias("_t"), F.lit(kind).alias("_kind"), *(f(c).over(side).alias(c) for c, f in how.items())).where("n is not null"), allowMissingColumns=True)
    up = Window.partitionBy(*keys, "_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Going down, values at a point's own time are still ahead of it: kind 2 comes before kind 0.
    down = Window.partitionBy(*keys, "_b").orderBy(F.col("_t").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aggs = lambda over: F.struct(*(f(c).over(over).alias(c) for c, f in how.items()))
    y = u.withColumn("_u", aggs(up)).withColumn("_d", aggs(down)).where("_kind in (1, 2)")
    y = y.select("_id", F.when(F.col("_kind") == 1, F.col("_u")).otherwise(F.col("_d")).alias("_a"))
    got = y.groupBy("_id").agg(F.sum("_a.n").alias("n"), F.sum("_a.w").alias("weight"), F.sum("_a.x").alias("notional"), F.max("_a.hi").alias("high"), F.min("_a.lo").alias("low"))
    out = p.select("_id").join(got, "_id", "left")
    return out.select(F.col("_id").alias(point_id), F.coalesce("n", F.lit(0)).alias("n"), "weight", "notional", "high", "low")


def _values(column) -> list:
    """``to_pylist`` of an Arrow column of numbers or texts, ten times as fast: Arrow makes a scalar of each value."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(column.type):
        out = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(object)
        out[column.is_null().to_numpy(zero_copy_only=False)] = None
        return out.tolist()
    if pa.types.is_string(column.type):
        d = column.dictionary_encode()
        texts = np.array([*d.dictionary.to_pylist(), None], object)
        return texts[pc.fill_null(d.indices, len(texts) - 1).to_numpy(zero_copy_only=False)].tolist()
    return column.to_pylist()


def _run_starts(columns: list) -> list[int]:
    """First rows of the runs of equal values of Arrow columns."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def fold_sorted(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], step: Callable, start: Callable, out: T.StructType | str, finish: Callable | None = None) -> DataFrame:
    """Sequential fold per key in constant memory.

    Rows are partitioned by ``keys`` and sorted; one pass carries the state
    across batches, so no key is ever held whole. ``step(state, row)`` gives
    ``(state, result tuple or None)``; ``start()`` the state of a new key;
    ``finish(key, state)`` the result tuples that come after a key's last row.
    """
    schema = T._parse_datatype_string(out) if isinstance(out, str) else out
    cols = df.columns
    at = [cols.index(k) for k in keys]

    def run(batches: Iterator) -> Iterator:
        # Plain Python values from Arrow: pandas would make floats of integers beside nulls.
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        key, state = None, None

        def batch(rows):
            columns = zip(*rows, strict=True) if rows else [()] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for b in batches:
            rows, starts, columns = [], _run_starts([b.column(i) for i in at]), [_values(c) for c in b.columns]
            for first, end in zip(starts, [*starts[1:], len(b)], strict=True):
                k = tuple(columns[i][first] for i in at)
                if k != key:
                    if finish and key is not None:
                        rows.extend(finish(key, state))
                    key, state = k, start()
                for row in zip(*(c[first:end] for c in columns), strict=True):
                    state, got = step(state, row)
                    if got is not None:
                        rows.append(got)
            yield batch(rows)
        if finish and key is not None:
            yield batch(finish(key, state))

    # Any order of the keys keeps a key's rows together; the last one tells most rows apart.
    return df.repartition(*keys).sortWithinPartitions(*reversed(keys), *order).mapInArrow(run, schema)


def runs_apart(df: DataFrame, *, keys: Sequence[str], time: str, tie: Sequence[str], gap: int, name: str = "run", width: int = HOUR) -> DataFrame:
    """``df`` with the start time of its run: runs of a key are parted by at least ``gap`` without rows.

    What a fold over pauses (cooldown, repeat suppression) remembers does not
    outlive such a gap, so each run can be folded alone.
    """
    x = with_last(df, keys=keys, time=time, tie=tie, value=F.col(time), name="_prev", width=width)
    first = F.when(F.col("_prev").isNull() | (F.col(time) - F.col("_prev") >= gap), F.col(time))
    return with_last(x, keys=keys, time=time, tie=tie, value=first, name=name, width=width, inclusive=True).drop("_prev")


def _kept_rows(rows: DataFrame, *, keys: Sequence[str], time: str, id_col: str, state: str | None, pause: int) -> DataFrame:
    """Rows ``(id_col)`` that are kept: ``pause`` after the last kept row of the key, or in another state than it (if ``state`` is given).

    What is kept after a row is found for all rows of a batch at once (a binary
    search by time, and the next change of state); then all keys follow these
    steps side by side. Only the last kept row of the last key goes on to the next batch.
    """
    runs = runs_apart(rows, keys=keys, time=time, tie=[id_col], gap=pause)
    by = [*keys, "run"]
    cols = [*by, time, id_col, *([state] if state else [])]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        last = None
        for b in batches:
            b = pa.Table.from_batches([b])
            if not len(b):
                continue
            carried = last is not None and all(last[c][0].as_py() == b[c][0].as_py() for c in by)
            if carried:
                b = pa.concat_tables([last.cast(b.schema), b])
            t = b[time].to_numpy()
            codes = [pd.factorize(pd.array(b[c].to_pandas(types_mapper=pd.ArrowDtype)), use_na_sentinel=False)[0] for c in (*by, *([state] if state else []))]
            new = np.zeros(len(t), bool)
            new[0] = True
            for c in codes[: len(by)]:
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new) - 1
            # A place orders rows by key, then time; the times of a key ascend already.
            distinct, rank = np.unique(t, return_inverse=True)
            wide = len(distinct) + 1
            step = np.searchsorted(group * wide + rank, group * wide + np.searchsorted(distinct, t + pause))
            ends = np.append(np.flatnonzero(new)[1:], len(t))[group]
            if state:
                change = np.append(np.flatnonzero((codes[-1][1:] != codes[-1][:-1]) | new[1:]) + 1, len(t))
                step = np.minimum(step, change[np.searchsorted(change, np.arange(len(t)), side="right")])
            step = np.maximum(step, np.arange(len(t)) + 1)
            kept = np.zeros(len(t), bool)
            at = np.flatnonzero(new)
            while len(at):
                kept[at] = True
                to = step[at]
                at = to[to < ends[at]]
            last = b.slice(int(np.flatnonzero(kept)[-1]), 1)
            if carried:
                kept[0] = False
            yield from b.select([id_col]).filter(pa.array(kept)).combine_chunks().to_batches()

    return runs.select(*cols).repartition(*by).sortWithinPartitions(*by, time, id_col).mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}")


def cooled_down(df: DataFrame, *, keys: Sequence[str], time: str, id_col: str, cooldown: int) -> DataFrame:
    """Rows ``(id_col)`` that pass: at least ``cooldown`` after the last row of the key that passed.

    Null times never pass. Of rows at one time the smallest id comes first.
    """
    rows = df.select(*keys, F.col(id_col), F.col(time).cast("long").alias(time)).where(F.col(time).isNotNull())
    return _kept_rows(rows, keys=keys, time=time, id_col=id_col, state=None, pause=cooldown)


def repeats_dropped(df: DataFrame, *, keys: Sequence[str], time: str, id_col: str, state: str, within: int) -> DataFrame:
    """Rows ``(id_col)`` that are kept: another state than the last kept row of the key, or ``within`` later than it."""
    rows = df.select(*keys, F.col(id_col), F.col(time).cast("long").alias(time), F.col(state)).where(F.col(time).isNotNull())
    return _kept_rows(rows, keys=keys, time=time, id_col=id_col, state=state, pause=within)


def state_changes(df: DataFrame, *, keys: Sequence[str], time: str, id_col: str, state: str, quiet_first: str | None = None) -> DataFrame:
    """Rows whose state differs from the one before; a first state equal to ``quiet_first`` is not a change."""
    x = with_last(df.where(F.col(time).isNotNull()), keys=keys, time=time, tie=[id_col], value=F.col(state), name="previous")
    changed = ~F.col(state).eqNullSafe(F.col("previous"))
    if quiet_first is not None:
        changed = changed & ~(F.col("previous").isNull() & (F.col(state) == quiet_first))
    return x.where(changed)


def merged_by_time(tables: dict[str, tuple[DataFrame, str, str]], *, keys: Sequence[str]) -> DataFrame:
    """(keys, time, kind, id) of several tables, each given with its time and id column, in order of time; of one time in the order given, then by id.

    The order is that of a range-partitioned sort; rows with null time are left out.
    """
    out = None
    for rank, (kind, (df, time, id_col)) in enumerate(tables.items()):
        x = df.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("time"), F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"), F.lit(rank).alias("_rank"))
        out = x if out is None else out.unionByName(x)
    return out.orderBy("time", "_rank", "id").drop("_rank")
