"""Attributes as known at event time: bitemporal as-of lookup.

A version of an attribute is usable for an event at time ``t`` when it is valid
(``valid <= t``) and recorded (``known <= t``), that is when
``available = max(valid, known) <= t``. Of the usable versions the one with the
greatest ``(valid, known, version)`` wins. Sorted by ``available`` the running
maximum of that triple is a staircase, so one binary search per event finds the
winner.

Events and changes are co-grouped by entity. Entities are packed into buckets
of a bounded row count, so that a group is one vectorised call over many small
entities. An entity with more rows than a bucket may hold is cut into time
slices at quantiles of its own times; each slice gets, as one row per field, the
winner among all changes of the slices before it. No group therefore grows with
an entity's share of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.slices import cuts_before, quantiles, slices_of, with_heads
from newsloom.runtime import shuffle_partitions

#: Rows of events and changes that one co-group may hold, about.
GROUP_ROWS = 100_000
BEFORE_ALL = -(2**63)


def is_known(df: DataFrame, field: str) -> Column:
    """Null, blank, zero, negative and NaN attributes are unknown."""
    kind = df.schema[field].dataType
    c = F.col(field)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce((c > 0) & ~F.isnan(c.cast("double")), F.lit(False))
    return c.isNotNull()


def attributes_asof(
    events: DataFrame,
    changes: DataFrame,
    *,
    entity: str,
    event_id: str,
    event_time: str,
    version: str,
    valid: str,
    known: str,
    fields: Sequence[str],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row ``(event_id, field, version)`` per event and field that has a usable version.

    Events without entity or time, changes without entity, valid or known time,
    and unknown field values take no part. Repeated change rows are ties on
    equal triples and give one answer; a repeated event row is answered once per
    row. Empty inputs give an empty result. Other columns of either input,
    clashing names included, are ignored.
    """
    spark = events.sparkSession
    e = events.select(
        F.col(entity).alias("entity"), F.col(event_id).cast("long").alias("id"), F.col(event_time).cast("long").alias("t")
    ).where("entity is not null and t is not null")
    flags = [is_known(changes, f).alias(f"f{i}") for i, f in enumerate(fields)]
    c = (
        changes.select(
            F.col(entity).alias("entity"),
            F.greatest(F.col(valid), F.col(known)).cast("long").alias("t"),
            F.col(valid).cast("long").alias("valid"),
            F.col(known).cast("long").alias("known"),
            F.col(version).cast("long").alias("id"),
            F.col(known).isNotNull().alias("recorded"),
            *flags,
        )
        .where("entity is not null and recorded and valid is not null")
        .where(" or ".join(f"f{i}" for i in range(len(fields))))
        .drop("recorded")
    )
    both = e.select("entity", "t").unionAll(c.select("entity", "t"))
    # One row for each entity over the limit, and one (null) for all others: at most total / group_rows + 1 rows.
    sizes = both.groupBy("entity").count().groupBy(F.when(F.col("count") > group_rows, F.col("entity")).alias("entity")).agg(F.sum("count").alias("n")).collect()
    total = sum(r["n"] for r in sizes)
    big = {r["entity"]: slices_of(r["n"], group_rows) for r in sizes if r["entity"] is not None}
    buckets = max(shuffle_partitions(spark), math.ceil(total / group_rows))
    cold = F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int")
    if not big:
        e, c = e.withColumn("grp", cold), c.withColumn("grp", cold)
    else:
        plan = _slices(spark, both, big, buckets)
        e = e.join(F.broadcast(plan), "entity", "left")
        same = cuts_before(F.col("t") + 1) - cuts_before(F.col("t"))
        spread = F.pmod(F.xxhash64("id"), F.greatest(same, F.lit(1))).cast("int")
        e = e.withColumn("grp", F.when(F.col("cuts").isNull(), cold).otherwise(F.col("base") + cuts_before(F.col("t")) + spread)).drop("cuts", "heads", "base")
        c = c.join(F.broadcast(plan), "entity", "left").withColumn("slice", F.when(F.col("cuts").isNotNull(), cuts_before(F.col("t"))))
        carry = _carried(c.where("slice is not null"), plan, len(fields))
        c = c.withColumn("grp", F.coalesce(F.col("base") + F.col("slice"), cold)).drop("cuts", "heads", "base", "slice").unionByName(carry)
    n = len(fields)
    names = list(fields)

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _lookup(left, right, names, n)

    out = T.StructType([T.StructField(event_id, T.LongType()), T.StructField("field", T.StringType()), T.StructField(version, T.LongType())])
    found = e.groupBy("grp").cogroup(c.groupBy("grp")).applyInPandas(find, T.StructType([T.StructField("id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("version", T.LongType())]))
    return found.select(*(F.col(a).alias(b.name) for a, b in zip(("id", "field", "version"), out.fields, strict=True)))


def _slices(spark, both: DataFrame, parts: dict[str, int], first: int) -> DataFrame:
    """(entity, base, cuts): quantiles of the times of each big entity; a few numbers a bucket."""
    most = max(parts.values())
    rows = (
        both.where(F.col("entity").isin(list(parts)))
        .groupBy("entity")
        .agg(quantiles("t", most).alias("cuts"))
        .collect()
    )
    plan, base = [], first
    for r in rows:
        own = parts[r["entity"]]
        cuts = [r["cuts"][round(i * most / own) - 1] for i in range(1, own)] if most > 1 else []
        plan.append((r["entity"], base, cuts))
        base += own
    return with_heads(spark.createDataFrame(plan, "entity string, base int, cuts array<bigint>"))


def _carried(c: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """For each slice and field the winner of all slices before it."""
    best = [F.max(F.when(F.col(f"f{i}"), F.struct("valid", "known", "id"))).alias(f"w{i}") for i in range(n)]
    per = c.groupBy("entity", "slice").agg(*best)
    every = plan.select("entity", "base", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("slice"))
    w = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    run = every.join(per, ["entity", "slice"], "left").select("entity", (F.col("base") + F.col("slice")).alias("grp"), *(F.max(f"w{i}").over(w).alias(f"w{i}") for i in range(n)))
    one = [
        F.struct(F.col(f"w{i}.valid").alias("valid"), F.col(f"w{i}.known").alias("known"), F.col(f"w{i}.id").alias("id"), *(F.lit(i == j).alias(f"f{j}") for j in range(n)))
        for i in range(n)
    ]
    x = run.select("entity", "grp", F.explode(F.array(*one)).alias("x")).where("x.valid is not null")
    return x.select("entity", F.lit(BEFORE_ALL).cast("long").alias("t"), "x.valid", "x.known", "x.id", *(f"x.f{j}" for j in range(n)), "grp")


def _lookup(events: pd.DataFrame, changes: pd.DataFrame, names: list[str], n: int) -> pd.DataFrame:
    """Vectorised binary search over all entities of a group at once."""
    out = {"id": [], "field": [], "version": []}
    if len(events) and len(changes):
        codes, _ = pd.factorize(pd.concat([changes["entity"], events["entity"]], ignore_index=True))
        times = np.concatenate([changes["t"].to_numpy(np.int64), events["t"].to_numpy(np.int64)])
        distinct, rank = np.unique(times, return_inverse=True)
        place = codes.astype(np.int64) * (len(distinct) + 1) + rank  # orders by entity, then time
        at_change, at_event = place[: len(changes)], place[len(changes) :]
        event_code = codes[len(changes) :]
        ids = events["id"].to_numpy(np.int64)
        valid, known, version = (changes[x].to_numpy(np.int64) for x in ("valid", "known", "id"))
        for i in range(n):
            use = np.flatnonzero(changes[f"f{i}"].to_numpy(bool))
            if not len(use):
                continue
            order = np.lexsort((version[use], known[use], valid[use]))
            merit = np.empty(len(use), np.int64)
            merit[order] = np.arange(len(use))
            by_place = np.argsort(at_change[use], kind="stable")
            use, merit = use[by_place], merit[by_place]
            code = codes[use].astype(np.int64)
            best = np.maximum.accumulate(merit + code * len(use))  # codes ascend: starts anew with each entity
            hit = np.searchsorted(at_change[use], at_event, side="right") - 1
            got = hit >= 0
            got[got] = code[hit[got]] == event_code[got]
            version_of = np.empty(len(use), np.int64)
            version_of[merit] = version[use]
            winner = version_of[best[hit[got]] - event_code[got].astype(np.int64) * len(use)]
            out["id"].append(ids[got])
            out["field"].append(np.full(int(got.sum()), names[i], dtype=object))
            out["version"].append(winner)
    return pd.DataFrame({"id": np.concatenate(out["id"]) if out["id"] else np.array([], np.int64), "field": np.concatenate(out["field"]) if out["field"] else np.array([], object), "version": np.concatenate(out["version"]) if out["version"] else np.array([], np.int64)})
