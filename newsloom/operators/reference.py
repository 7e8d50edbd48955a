"""The security master: merges, keys, primary securities, filings by window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.names import is_derivative, normalize_company


def upsert(base: DataFrame, changes: DataFrame, *, key: str, order: str, fields: Sequence[str], usable: dict[str, Column] | None = None) -> DataFrame:
    """Per key and field the last usable value by ``order``; keys of either side. Null values replace nothing.

    ``usable`` narrows what counts per field (for example values above 0). One
    aggregation shuffle over both inputs, with map-side partial results.
    """
    u = base.select(key, order, *fields).unionByName(changes.select(key, order, *fields)).where(F.col(key).isNotNull())
    ok = {f: F.col(f).isNotNull() & (usable or {}).get(f, F.lit(True)) for f in fields}
    return u.groupBy(key).agg(*(F.max(F.when(ok[f], F.struct(order, f)))[f].alias(f) for f in fields))


def latest_per_key(df: DataFrame, *, key: Sequence[str], order: Sequence[str | Column], take: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; partial maxima, no sort of a group."""
    return df.groupBy(*key).agg(F.max(F.struct(*(F.struct(*order).alias("_o"),), *take)).alias("_m")).select(*key, *(F.col(f"_m.{c}").alias(c) for c in take))


def primary_security(master: DataFrame, *, issuer: str, symbol: str, name: str, listed: Column, load_order: str) -> DataFrame:
    """(issuer, symbol): listed before unlisted, no derivative before derivatives, then the shortest symbol, then the first loaded."""
    rank = F.struct(F.when(listed, 0).otherwise(1).alias("a"), F.when(is_derivative(F.col(name)), 1).otherwise(0).alias("b"), F.length(symbol).alias("c"), F.col(load_order).alias("d"), F.col(symbol).alias("s"))
    return master.where(F.col(issuer).isNotNull()).groupBy(issuer).agg(F.min(rank)["s"].alias(symbol))


def unique_names(master: DataFrame, *, issuer: str, symbol: str, name: str) -> DataFrame:
    """(company, symbol) of names that exactly one known issuer bears and that have at least 4 characters.

    A name that repeats with unknown issuers is ambiguous and left out.
    """
    n = master.select(normalize_company(F.col(name)).alias("company"), F.col(issuer).alias("i"), F.col(symbol).alias("s")).where(F.length("company") >= 4)
    g = n.groupBy("company").agg(F.min("s").alias(symbol), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count(F.lit(1)).alias("n"), F.count("i").alias("known"))
    return g.where("n = 1 or (known = n and lo = hi)").select("company", symbol)


def flags_in_window(asked: DataFrame, filings: DataFrame, *, key: str, asked_day: str, day: str, kind: str, windows: dict[str, tuple[int, int]], asked_ns: str | None = None, received_ns: str | None = None) -> DataFrame:
    """``asked`` with ``flags``: OR of the bits of all kinds filed at most their window of days before, the day included.

    ``windows``: kind to (days, bit). With ``asked_ns`` and ``received_ns`` filings of
    the asked day itself count only if received by then; those without receipt
    time do not. Only the latest filing per kind at or
    before a day can matter, so the filings are first reduced to distinct
    (key, kind, day), and the range join runs on (key, month block): a filing
    reaches as many blocks as its window spans, a small constant.
    """
    block = 32
    spec = F.create_map(*(x for k, (days, bit) in windows.items() for x in (F.lit(k), F.struct(F.lit(days).alias("days"), F.lit(bit).cast("bigint").alias("bit")))))
    f = filings.where(F.col(key).isNotNull() & F.col(kind).isin(list(windows))).select(F.col(key).alias("_k"), F.unix_date(F.col(day)).alias("_d"), spec[F.col(kind)].alias("_w")).distinct()
    f = f.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("_d") / block), F.floor((F.col("_d") + F.col("_w.days")) / block))))
    a = asked.select(F.col(key).alias("_k"), F.unix_date(F.col(asked_day)).alias("_at")).dropna().distinct().withColumn("_blk", F.floor(F.col("_at") / block))
    hit = a.join(f, ["_k", "_blk"]).where((F.col("_at") >= F.col("_d")) & (F.col("_at") - F.col("_d") <= F.col("_w.days")))
    if asked_ns is not None:
        hit = hit.where("_at > _d")
    flags = hit.groupBy("_k", "_at").agg(F.bit_or("_w.bit").alias("flags"))
    out = asked.withColumns({"_k": F.col(key), "_at": F.unix_date(F.col(asked_day))}).join(flags, ["_k", "_at"], "left")
    if asked_ns is not None:
        # One entry per kind at most: when its first filing of the day came.
        day_of = filings.where(F.col(key).isNotNull() & F.col(kind).isin(list(windows)) & F.col(received_ns).isNotNull())
        first = day_of.groupBy(F.col(key).alias("_k"), F.unix_date(F.col(day)).alias("_at"), spec[F.col(kind)]["bit"].alias("bit")).agg(F.min(received_ns).alias("recv"))
        out = out.join(first.groupBy("_k", "_at").agg(F.collect_list(F.struct("recv", "bit")).alias("_today")), ["_k", "_at"], "left")
        known = F.filter("_today", lambda x: x["recv"] <= F.col(asked_ns))
        today = F.coalesce(F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x["bit"])), F.lit(0).cast("bigint"))
        out = out.withColumn("flags", F.coalesce("flags", F.lit(0).cast("bigint")).bitwiseOR(today)).drop("_today")
    return out.drop("_k", "_at").withColumn("flags", F.coalesce("flags", F.lit(0).cast("bigint")))


def merge_filings(*parts: DataFrame, key: str, day: str, kind: str, items: str) -> DataFrame:
    """One row per (key, day, kind) with the items of all parts OR-ed."""
    u = parts[0].select(key, day, kind, items)
    for p in parts[1:]:
        u = u.unionByName(p.select(key, day, kind, items))
    return u.groupBy(key, day, kind).agg(F.bit_or(F.coalesce(F.col(items), F.lit(0))).alias(items))


def outer_merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side with the columns of both."""
    return a.join(b, key, "full_outer")
