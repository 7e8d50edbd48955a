"""Signals as text, and which of them go where. Delivery itself is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.names import TIERS, ordinal
from newsloom.functions.text import money


def alert_line(*, tier: Column, ticker: Column, price: Column, move_pct: Column, mcap: Column, title: Column) -> Column:
    """``ALERT QLFK $2.4000 +12.50% mcap 31.5M | title``; parts that are null are left out."""
    part = lambda c, f: F.when(c.isNotNull(), f)
    head = F.concat_ws(" ", tier, ticker, part(price, F.concat(F.lit("$"), F.format_string("%.4f", price))), part(move_pct, F.format_string("%+.2f%%", move_pct)), part(mcap, F.concat(F.lit("mcap "), money(mcap))))
    return F.concat_ws(" | ", head, F.nullif(F.trim(title), F.lit("")))


def why_text(*, catalyst: Column, phrases: Column, amount_usd: Column, mcap: Column, hedges: Column, promos: Column, most: int = 3) -> Column:
    """Catalyst, the first ``most`` phrases, the amount and its share of the market value, and how often the text hedges or promotes."""
    amount = F.when(amount_usd > 0, F.concat(F.lit("$"), money(amount_usd), F.when(mcap > 0, F.format_string(" (%.2fx mcap)", amount_usd / mcap)).otherwise("")))
    count = lambda c, name: F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {name}")))
    return F.concat_ws("; ", catalyst, F.nullif(F.array_join(F.slice(F.coalesce(phrases, F.array().cast("array<string>")), 1, most), ", "), F.lit("")), amount, count(hedges, "hedges"), count(promos, "promos"))


def routed(signals: DataFrame, *, tier: str, least: str = "ALERT", halts: bool = True, movers: bool = True) -> DataFrame:
    """Signals of at least tier ``least`` (of WATCH, ALERT, HIGH), halts and movers if asked for, and INFO always; null tiers never."""
    n = ordinal(F.col(tier), TIERS)
    extra = ["INFO"] + ["HALT"] * halts + ["MOVER"] * movers
    return signals.where(F.col(tier).isin(extra) | n.between(TIERS.index(least), TIERS.index("HIGH")))
