"""Statistics over journals of stories, signals, outcomes and closed trades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_medians(df: DataFrame, *, group: list[str], values: dict[str, Column], sub_bits: int = 6) -> DataFrame:
    """(group, names of ``values``): exact medians, the mean of the middle two; null without values.

    A median function holds all distinct values of a group in one task. Here counts
    by log-linear bucket, which merge before the shuffle, say in which buckets the
    middle ranks lie, and only the values of these are counted one by one; a bucket
    is a 64th of an octave, a fixed list for any number of rows. Null values and NaN take no part.
    """
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), c.cast("double").alias("v")) for name, c in values.items())))
    x = df.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), each.alias("x")).select(*(f"_g{i}" for i in range(len(group))), "x.name", "x.v").where("v is not null and not isnan(v)")
    by = [*(f"_g{i}" for i in range(len(group))), "name"]
    x = x.withColumn("b", _order_bucket(F.col("v"), sub_bits))
    w = Window.partitionBy(*by)
    h = x.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumns({"upto": F.sum("n").over(w.orderBy("b")), "total": F.sum("n").over(w)})
    lo, hi = F.floor((F.col("total") - 1) / 2) + 1, F.floor(F.col("total") / 2) + 1
    mid = h.where((F.col("upto") >= lo) & (F.col("upto") - F.col("n") < hi)).select(*(F.col(c).alias(f"m_{c}") for c in by), F.col("b").alias("m_b"), (F.col("upto") - F.col("n")).alias("before"), lo.alias("lo"), hi.alias("hi"))
    same = F.col("b") == F.col("m_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    # At most two buckets to a group and value: the list is as long as the groups.
    v = x.join(mid, same).groupBy(*by, "b", "before", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("n"))
    v = v.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "b").orderBy("v")))
    has = lambda rank: (F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("n") < F.col(rank))
    one = v.groupBy(*by).agg(((F.max(F.when(has("lo"), F.col("v"))) + F.max(F.when(has("hi"), F.col("v")))) / 2).alias("m"))
    out = one.groupBy(*by[:-1]).agg(*(F.max(F.when(F.col("name") == name, F.col("m"))).alias(name) for name in values))
    return out.select(*(F.col(f"_g{i}").alias(c) for i, c in enumerate(group)), *values)


def _order_bucket(v: Column, sub_bits: int) -> Column:
    """A whole number that grows with ``v``: its sign, octave and part of the octave."""
    a = F.abs(v)
    octave = F.greatest(F.floor(F.log2(a)), F.lit(-64))
    part = F.floor((a / F.pow(F.lit(2.0), octave) - 1) * (1 << sub_bits))
    # Rounding at the bounds of an octave must not put a greater value lower.
    size = (octave + 65) * (1 << sub_bits) + F.least(F.greatest(part, F.lit(0)), F.lit((1 << sub_bits) - 1))
    return F.when(a < 2.0**-64, 0).when(v < 0, -size).otherwise(size).cast("long")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys meet null keys."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    names = [c for c in right.columns if c not in keys]
    return left.join(right.select(*(F.col(c).alias(f"_m_{c}") for c in keys), *names), on, how).drop(*(f"_m_{c}" for c in keys))


def first_seen(stories: DataFrame, *, key: str, time: str, id_col: str, source: str) -> DataFrame:
    """Each story with the first source of its key, whether it repeats it, and how far behind it came.

    The first row per key is an aggregate joined back, so that a key with very
    many copies is never ordered in one task. Null keys are stories of their own.
    """
    first = stories.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(time).alias("t"), F.col(id_col).alias("i"), F.col(source).alias("s"))).alias("_f"))
    x = stories.join(first, F.col(key) == F.col("_k"), "left")
    dup = F.coalesce(F.col("_f.i") != F.col(id_col), F.lit(False))
    return x.withColumns({"dup": dup, "first_src": F.coalesce(F.col("_f.s"), F.col(source)), "behind_ns": F.coalesce(F.col(time) - F.col("_f.t"), F.lit(0))}).drop("_k", "_f")


def source_standing(seen: DataFrame, *, source: str, publish_lag: Column) -> DataFrame:
    """Per source: items, firsts, behind another source, median lag behind and median publish lag (0 and above)."""
    behind = F.col("dup") & (F.col("first_src") != F.col(source))
    counts = seen.groupBy(source).agg(F.count(F.lit(1)).alias("items"), F.count_if(~F.col("dup")).alias("firsts"), F.count_if(behind).alias("behind"))
    medians = exact_medians(seen, group=[source], values={"median_behind_ms": F.when(behind, F.col("behind_ns") / 1e6), "median_publish_ms": F.when(publish_lag >= 0, publish_lag)})
    return _joined(counts, medians, [source]).fillna(0.0, ["median_behind_ms", "median_publish_ms"])


def outcome_groups(outcomes: DataFrame, *sets: list[str], move: str = "move_pct", mfe: str = "max_move_pct", mae: str = "min_move_pct") -> DataFrame:
    """n, mean, median, share of moves above 0, mean best and worst move, for each grouping set in one pass."""
    cols = sorted({c for s in sets for c in s})
    out = None
    for keys in sets:
        g = outcomes.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg(move), 6).alias("mean_move"), F.round(100.0 * F.count_if(F.col(move) > 0) / F.count(F.lit(1)), 6).alias("up_pct"),
            F.round(F.avg(mfe), 6).alias("mean_mfe"), F.round(F.avg(mae), 6).alias("mean_mae"),
        )
        g = _joined(g, exact_medians(outcomes, group=list(keys), values={"median_move": F.col(move)}), list(keys)).withColumn("median_move", F.round("median_move", 6))
        g = g.select(*(F.col(c) if c in keys else F.lit(None).cast(dict(outcomes.dtypes)[c]).alias(c) for c in cols), "n", "mean_move", "median_move", "up_pct", "mean_mfe", "mean_mae")
        out = g if out is None else out.unionByName(g)
    return out


# Lower bounds of the score buckets and their names.
SCORE_BUCKETS = [(85, "85+"), (75, "75-84"), (65, "65-74"), (55, "55-64")]


def score_bucket(score: Column) -> Column:
    """Name of a score's bucket; null stays null."""
    out = F.when(score.isNull(), None)
    for least, name in SCORE_BUCKETS:
        out = out.when(score >= least, name)
    return out.otherwise("<55")


def funnel(stories: DataFrame, *, group: list[str], stages: dict[str, Column]) -> DataFrame:
    """Per group how many stories there are and how many pass each stage; one pass."""
    return stories.groupBy(*group).agg(F.count(F.lit(1)).alias("stories"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in stages.items()))


def source_counters(stories: DataFrame, *, source: str, id_col: str, stages: dict[str, Column]) -> DataFrame:
    """Per source items, and per stage the distinct stories that pass it (a story of several rows counts once)."""
    per = stories.groupBy(source, id_col).agg(F.count(F.lit(1)).alias("_n"), *(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in stages.items()))
    return per.groupBy(source).agg(F.sum("_n").alias("items"), *(F.sum(name).alias(name) for name in stages))


def day_results(trades: DataFrame, signals: DataFrame, *, day: str, pnl: str, tier: str, alerting: list[str]) -> DataFrame:
    """Per day of either table: signals, alerts, closed trades and their result."""
    none = F.lit(0).cast("bigint")
    s = signals.select(day, F.lit(1).alias("s"), F.when(F.col(tier).isin(alerting), 1).otherwise(0).alias("a"), F.lit(0).alias("c"), none.alias("p"))
    t = trades.select(day, F.lit(0).alias("s"), F.lit(0).alias("a"), F.lit(1).alias("c"), F.coalesce(F.col(pnl).cast("bigint"), none).alias("p"))
    return s.unionByName(t).groupBy(day).agg(F.sum("s").alias("signals"), F.sum("a").alias("alerts"), F.sum("c").alias("closed"), F.sum("p").alias("pnl"))


def parameter_sweep(trades: DataFrame, *, values: list[float], keeps: Callable[[Column], Column], pnl: str, name: str = "cut") -> DataFrame:
    """(name, n, total) per parameter value in one pass: each trade feeds the values that keep it."""
    kept = F.filter(F.array(*map(F.lit, values)), keeps)
    return trades.select(pnl, F.explode(kept).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("total"))


def report(seen: DataFrame, outcomes: DataFrame, curve: DataFrame, *, publish_lag: Column, stages: dict[str, Column]) -> dict[str, DataFrame]:
    """The sections of a journal report by name: sources, funnel, outcomes by horizon and by score, trades in all and by tier and reason.

    ``seen`` as of ``first_seen`` (with src, catalyst), ``curve`` as of ``equity`` (with tier, reason, day, pnl).
    """
    scored = outcomes.withColumn("score_bucket", score_bucket(F.col("score")))
    return {
        "sources": source_standing(seen, source="src", publish_lag=publish_lag),
        "funnel": funnel(seen, group=["catalyst"], stages=stages),
        "outcomes": outcome_groups(outcomes, ["horizon_s", "tier_reached"]),
        "outcomes_by_kind": outcome_groups(scored.where("horizon_s in (300, 1800)"), ["horizon_s", "catalyst"], ["horizon_s", "score_bucket"]),
        "trades": trade_stats(curve, group=[], day="day", pnl="pnl"),
        "trades_by_tier": trade_stats(curve, group=["tier"], day="day", pnl="pnl"),
        "trades_by_reason": trade_stats(curve, group=["reason"], day="day", pnl="pnl"),
    }


def equity(trades: DataFrame, *, group: list[str], day: str, order: list[str], pnl: str) -> DataFrame:
    """Running result, peak (from 0) and drawdown per group.

    Two levels: sums and running peaks within (group, day), and days carried by a
    window over one row per day. Null groups and days count as groups and days of their own.
    """
    in_day = Window.partitionBy(*group, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = trades.withColumn("_run", F.sum(pnl).over(in_day)).withColumn("_top", F.max("_run").over(in_day))
    days = x.groupBy(*group, day).agg(F.sum(pnl).alias("_sum"), F.max("_run").alias("_high"))
    before = Window.partitionBy(*group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    days = days.withColumn("_peak", F.greatest(F.lit(0), F.coalesce(F.max(F.col("_base") + F.col("_high")).over(before), F.lit(0)))).select(*group, day, "_base", "_peak")
    y = _joined(x, days, [*group, day], "inner").withColumn("cum", F.col("_base") + F.col("_run")).withColumn("peak", F.greatest("_peak", F.col("_base") + F.col("_top")))
    return y.withColumn("drawdown", F.col("peak") - F.col("cum")).drop("_run", "_top", "_base", "_peak")


def trade_stats(curve: DataFrame, *, group: list[str], day: str, pnl: str) -> DataFrame:
    """Counts, gross, expectancy, profit factor (infinite without losses, 0 without wins), drawdown, best three removed, span in days."""
    if not group:
        return trade_stats(curve.withColumn("_all", F.lit(1)), group=["_all"], day=day, pnl=pnl).drop("_all")
    p = F.col(pnl)
    out = curve.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("wins"), F.count_if(p <= 0).alias("losses"), F.sum(p).alias("total"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0)).alias("gross_win"), F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0)).alias("gross_loss"),
        F.max("drawdown").alias("max_drawdown"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span_days"),
    )
    top = _top3(curve.where(p > 0), group, pnl)
    out = _joined(out, top, group)
    return out.withColumns(
        {
            "without_top3": F.col("total") - F.coalesce("top3", F.lit(0)),
            "win_rate": F.round(F.col("wins") / F.col("n"), 6),
            "expectancy": F.round(F.col("total") / F.col("n"), 6),
            "profit_factor": F.when(F.col("gross_loss") > 0, F.round(F.col("gross_win") / F.col("gross_loss"), 6)).when(F.col("gross_win") > 0, F.lit(float("inf"))).otherwise(0.0),
        }
    ).drop("top3")


def _top3(wins: DataFrame, group: list[str], pnl: str, spread: int = 64) -> DataFrame:
    """Sum of the three greatest values per group, in two levels: best three per salt, then of those."""
    w1 = Window.partitionBy(*group, "_salt").orderBy(F.desc("_p"))
    w2 = Window.partitionBy(*group).orderBy(F.desc("_p"))
    x = wins.select(*group, F.col(pnl).alias("_p"), F.spark_partition_id().alias("_salt")).withColumn("_salt", F.pmod("_salt", F.lit(spread)))
    x = x.withColumn("_r", F.row_number().over(w1)).where("_r <= 3").withColumn("_r", F.row_number().over(w2)).where("_r <= 3")
    return x.groupBy(*group).agg(F.sum("_p").alias("top3"))


def log_bucket(value: Column, sub_bits: int = 4) -> Column:
    """Log-linear bucket of a non-negative integer: 2**sub_bits sub-buckets to each octave."""
    sub = 1 << sub_bits
    v = F.greatest(value.cast("long"), F.lit(0))
    octave = F.greatest(F.length(F.bin(v)) - 1 - sub_bits, F.lit(0))
    return F.when(v < sub, v).otherwise(octave.cast("long") * sub + F.call_function("shiftright", v, octave.cast("int")))


def bucket_top(bucket: Column, sub_bits: int = 4) -> Column:
    """Greatest value of a bucket."""
    sub = 1 << sub_bits
    octave = F.greatest(F.floor(bucket / sub) - 1, F.lit(0))
    return F.when(bucket < sub, bucket).otherwise(F.call_function("shiftleft", bucket - octave * sub + 1, octave.cast("int")) - 1)


def histogram_percentiles(df: DataFrame, *, group: list[str], value: str, at: list[float]) -> DataFrame:
    """Percentiles as upper bounds of log-linear buckets, capped at the maximum; counts merge across any partitions."""
    h = df.where(F.col(value).isNotNull()).groupBy(*group, log_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))
    w = Window.partitionBy(*group)
    run = h.withColumn("seen", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w)).withColumn("most", F.max("top").over(w))
    aggs = [F.min(F.when(F.col("seen") >= F.ceil(F.lit(q) * F.col("all")), F.least(bucket_top(F.col("bucket")), F.col("most")))).alias(f"p{str(round(q * 100, 1)).removesuffix('.0').replace('.', '_')}") for q in at]
    return run.groupBy(*group).agg(F.sum("n").alias("n"), *aggs)
