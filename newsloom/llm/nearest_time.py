"""Matching records by nearest time within a tolerance.

Time is cut into buckets as wide as the tolerance, so the partner of a record
lies in its own bucket or an adjacent one. Buckets are shuffled in spans of
``SPAN``: a left record goes to the spans of its bucket and of both neighbours,
which are one and the same unless its bucket is the first or last of its span;
each right record goes to its own span only. In a span the two sides are not
paired with each other: ordered by time, the right record last seen before a
left record and the one next after it are the only candidates (two window passes
over one shuffle), so a burst of n prints costs n log n and not n squared. The
difference is filtered, and over the spans of a left record the minimum by
(distance, time, identifier) is kept.

A span that holds a large part of the rows is cut into slices at quantiles of the
times of all that reaches it, left and right, neighbours' records included. Right
records of one time are first reduced to the smallest identifier, left records of
one time are spread over the slices that end at it, and each slice starts and
ends with the nearest right records of the slices before and after it: one
summary row per slice. No group therefore grows with a bucket's share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.slices import cuts_before, quantiles, slices_of, with_heads

#: Rows that one group may hold before it is cut into slices, about.
BUCKET_ROWS = 200_000
#: Buckets that are shuffled together.
SPAN = 32


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: str,
    left_id: str,
    left_time: str,
    right_entity: str | None = None,
    right_id: str,
    right_time: str,
    tolerance_ns: int,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rows ``(left_id, match_id)``, one per left record that has a partner.

    The partner has exactly the same entity and the smallest time difference, at
    most ``tolerance_ns``; at equal distance the earlier time wins, then the
    smaller identifier. Null entities, times and identifiers, and time 0 (which
    means unknown), match nothing. A right record may serve many left records.
    ``left_id`` must be unique; a repeated one gets its nearest partner over all
    its rows. Empty inputs give an empty result, other columns are ignored.
    """
    usable = "e is not null and t is not null and t <> 0 and id is not null"
    l = left.select(F.col(entity).alias("e"), F.col(left_id).cast("long").alias("id"), F.col(left_time).cast("long").alias("t")).where(usable)  # noqa: E741
    r = right.select(F.col(right_entity or entity).alias("e"), F.col(right_id).cast("long").alias("id"), F.col(right_time).cast("long").alias("t")).where(usable)
    bucket = F.floor((F.col("t") - F.expr(f"pmod(t, {tolerance_ns}L)")) / tolerance_ns).cast("long")
    span = lambda b: F.floor(b / F.lit(SPAN)).cast("long")
    l = l.withColumn("b", F.explode(F.array_distinct(F.array(*(span(bucket + k) for k in (-1, 0, 1))))))  # noqa: E741
    r = r.withColumn("b", span(bucket))
    hot = _hot_spans(l, r, bucket_rows)
    if not hot:
        u, key = l.withColumn("isl", F.lit(1)).unionByName(r.withColumn("isl", F.lit(0))), ["e", "b"]
    else:
        u, key = _sliced(l, r, hot), ["e", "b", "s"]
    # At one time right records come before left ones; of the right ones at one time the smallest id is seen last.
    back = Window.partitionBy(*key).orderBy("t", "isl", F.col("id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*key).orderBy(F.col("t").desc(), "isl", F.col("id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.when(F.col("isl") == 0, F.struct("t", "id"))
    x = u.select(*key, "t", "id", "isl", F.last(other, ignorenulls=True).over(back).alias("p"))
    x = x.select("t", "id", "isl", "p", F.last(other, ignorenulls=True).over(ahead).alias("n")).where("isl = 1")

    def rank(c: str):
        """Distance first, then the earlier of two times: unique to a time, so plain longs order candidates."""
        late = F.col(f"{c}.t") > F.col("t")
        return F.abs(F.col("t") - F.col(f"{c}.t")) * 2 + late.cast("long")

    near = lambda c: F.when(rank(c) <= 2 * tolerance_ns + 1, rank(c))
    best = x.select("id", near("p").alias("rp"), near("n").alias("rn"), F.col("p.id").alias("ip"), F.col("n.id").alias("in"))
    best = best.where("rp is not null or rn is not null").select("id", F.least("rp", "rn").alias("r"), F.when(F.col("rn").isNull() | (F.col("rp") <= F.col("rn")), F.col("ip")).otherwise(F.col("in")).alias("m"))
    return best.groupBy("id").agg(F.min_by("m", "r").alias("match_id")).select(F.col("id").alias(left_id), "match_id")


def _hot_spans(l: DataFrame, r: DataFrame, most: int) -> list[tuple]:  # noqa: E741
    """(entity, span, cuts) of each span that more than ``most`` rows reach.

    Exact counts of what arrives, neighbours' left records included; first by
    entity, as only an entity over ``most`` rows can have such a span. At most
    total / ``most`` spans qualify, each with its row count / ``most`` cuts: what
    reaches the driver is bounded by 2 * total / ``most`` numbers.
    """
    both = l.select("e", "b", "t").unionAll(r.select("e", "b", "t"))
    big = [x["e"] for x in both.groupBy("e").count().where(F.col("count") > most).select("e").collect()]
    if not big:
        return []
    spans = both.where(F.col("e").isin(big)).groupBy("e", "b").count().where(F.col("count") > most).collect()
    if not spans:
        return []
    parts = {(x["e"], x["b"]): slices_of(x["count"], most) for x in spans}
    grid = max(parts.values())
    keys = l.sparkSession.createDataFrame(list(parts), "e string, b bigint")
    q = both.join(F.broadcast(keys), ["e", "b"]).groupBy("e", "b").agg(quantiles("t", grid).alias("q")).collect()
    cuts = {(x["e"], x["b"]): x["q"] for x in q}
    return [(*k, [cuts[k][round(i * grid / m) - 1] for i in range(1, m)]) for k, m in parts.items()]


def _sliced(l: DataFrame, r: DataFrame, hot: list[tuple]) -> DataFrame:  # noqa: E741
    """Both sides by (e, b, s): s is the slice in a hot span and 0 elsewhere; with the summary rows of the hot slices' neighbours."""
    plan = with_heads(l.sparkSession.createDataFrame(hot, "e string, b bigint, cuts array<bigint>"))
    known = F.broadcast(plan)
    at = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(cuts_before(F.col("t")))
    # Left records of a time that is cut several times over may lie in any slice that ends or begins there.
    same = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(cuts_before(F.col("t") + 1) - cuts_before(F.col("t")))
    spread = F.pmod(F.xxhash64("id"), F.greatest(same, F.lit(1)).cast("long")).cast("int")
    ll = l.join(known, ["e", "b"], "left").select("e", "b", (at + spread).alias("s"), "t", "id", F.lit(1).alias("isl"))
    rr = r.join(known, ["e", "b"], "left").select("e", "b", at.alias("s"), "t", "id", F.col("cuts").isNotNull().alias("hot"))
    burst = rr.where("hot").groupBy("e", "b", "s", "t").agg(F.min("id").alias("id"))
    ends = burst.groupBy("e", "b", "s").agg(F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", F.col("id"))).alias("hi"))
    # Windows over a span's slices: one row each, rows / limit of them.
    every = plan.select("e", "b", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("s")).join(ends, ["e", "b", "s"], "left")
    w = Window.partitionBy("e", "b").orderBy("s")
    around = every.select("e", "b", "s", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), F.min("lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("n"))
    carry = around.select("e", "b", "s", F.explode(F.array("p", "n")).alias("c")).where("c is not null").select("e", "b", "s", "c.t", "c.id", F.lit(0).alias("isl"))
    parts = [ll, rr.where("not hot").select("e", "b", "s", "t", "id", F.lit(0).alias("isl")), burst.select("e", "b", "s", "t", "id", F.lit(0).alias("isl")), carry]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
