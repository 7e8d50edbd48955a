"""Cutting what is too large for one task at quantiles of its times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Slices of one group at most; beyond that they hold more rows, so that a plan and the sketches behind it stay small.
MOST_SLICES = 10_000


def slices_of(rows: int, most: int) -> int:
    """Into how many slices a group is cut: of ``most`` rows, or more where that would be too many slices."""
    return min(math.ceil(rows / most), MOST_SLICES)


def quantiles(time: str, grid: int) -> Column:
    """``grid`` - 1 cut points of equal shares, off by a tenth of a share at most."""
    return F.percentile_approx(time, [i / grid for i in range(1, grid)] or [0.5], max(10_000, 20 * grid))


def with_heads(plan: DataFrame) -> DataFrame:
    """``plan`` with ``heads``: every sqrt(n)-th of its sorted ``cuts``."""
    every = F.ceil(F.sqrt(F.size("cuts"))).cast("int")
    return plan.withColumn("heads", F.when(F.size("cuts") > 0, F.transform(F.sequence(F.lit(0), F.size("cuts") - 1, every), lambda i: F.get("cuts", i))).otherwise(F.col("cuts")))


def cuts_before(t: Column) -> Column:
    """How many of the sorted ``cuts`` lie before a time: first by ``heads``, then within the stretch that follows."""
    every = F.ceil(F.sqrt(F.size("cuts"))).cast("int")
    at = F.greatest(F.size(F.filter("heads", lambda b: b < t)) - 1, F.lit(0)) * every
    return F.when(F.size("cuts") == 0, 0).otherwise(at + F.size(F.filter(F.slice("cuts", at + 1, every), lambda b: b < t)))


def bursts(df: DataFrame, *, keys: Sequence[str], bucket: str, time: str, most: int) -> DataFrame | None:
    """(keys, bucket, cuts, heads) of each bucket of a key with more than ``most`` rows; None without one.

    Exact counts, first by key, as only a key over ``most`` rows has such a bucket. At
    most total / ``most`` buckets, each with its row count / ``most`` cuts, reach the driver.
    """
    spark = df.sparkSession
    big = df.groupBy(*keys).count().where(F.col("count") > most).select(*keys).collect()
    if not big:
        return None
    kinds = {f.name: f for f in df.schema.fields}
    schema = df.select(*keys, bucket).schema
    same = lambda a, b, cols: F.expr(" and ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in cols))
    hot = df.alias("l").join(F.broadcast(spark.createDataFrame([tuple(r) for r in big], df.select(*keys).schema)).alias("r"), same("l", "r", keys), "left_semi")
    sizes = hot.groupBy(*keys, bucket).count().where(F.col("count") > most).collect()
    if not sizes:
        return None
    parts = {tuple(r)[:-1]: slices_of(r["count"], most) for r in sizes}
    grid = max(parts.values())
    listed = F.broadcast(spark.createDataFrame(list(parts), schema)).alias("r")
    q = hot.alias("l").join(listed, same("l", "r", [*keys, bucket]), "left_semi").groupBy(*keys, bucket).agg(quantiles(time, grid).alias("q")).collect()
    rows = [(*tuple(r)[:-1], [r["q"][round(i * grid / parts[tuple(r)[:-1]]) - 1] for i in range(1, parts[tuple(r)[:-1]])]) for r in q]
    return with_heads(spark.createDataFrame(rows, T.StructType([*schema.fields, T.StructField("cuts", T.ArrayType(kinds[time].dataType))])))


def sliced(df: DataFrame, *, keys: Sequence[str], bucket: str, time: str, most: int | None) -> DataFrame:
    """``df`` whose ``bucket`` is cut where it bursts: (bucket, slice), still in order of time. Rows of one time stay together."""
    plan = None if most is None else bursts(df, keys=keys, bucket=bucket, time=time, most=most)
    if plan is None:
        return df
    names = [f"_c{i}" for i in range(len(keys) + 1)]
    p = plan.select(*(F.col(c).alias(n) for c, n in zip((*keys, bucket), names, strict=True)), "cuts", "heads")
    on = F.expr(" and ".join(f"`{c}` <=> `{n}`" for c, n in zip((*keys, bucket), names, strict=True)))
    at = F.when(F.col("cuts").isNull() | F.col(time).isNull(), 0).otherwise(cuts_before(F.col(time)))
    return df.join(F.broadcast(p), on, "left").withColumn(bucket, F.struct(F.col(bucket).alias("b"), at.cast("int").alias("s"))).drop(*names, "cuts", "heads")
