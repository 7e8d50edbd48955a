"""Queries p1 to p3 and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.asof_attributes import attributes_asof
from newsloom.operators.late_counts import corrected_counts
from newsloom.operators.snapshot_diff import display_symbol, snapshot_changes, squeezed
from newsloom.runtime import table

HOUR = 3_600_000_000_000
FIELDS = ("shares_outstanding", "financial_status", "prev_close")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return attributes_asof(
        table(spark, d, "signals"), table(spark, d, "symbol_info"),
        entity="ticker", event_id="signal_id", event_time="t_signal_ns", version="version_id", valid="valid_from_ns", known="known_ns", fields=FIELDS,
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return corrected_counts(table(spark, d, "signals"), source="src", story="news_id", event_time="published_ns", arrival="t_news_recv_ns", window_ns=HOUR, lateness_ns=6 * HOUR)


def p2_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Three-hour windows every hour: each story sits in one pane and three windows."""
    return corrected_counts(table(spark, d, "signals"), source="src", story="news_id", event_time="published_ns", arrival="t_news_recv_ns", window_ns=3 * HOUR, slide_ns=HOUR, lateness_ns=6 * HOUR)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = snapshot_changes(
        table(spark, d, "symbol_snapshots"), date="snap_date", delivered="loaded_ns", row_id="row_id", key=display_symbol(F.col("ticker")),
        is_record=~F.coalesce(F.col("ticker").rlike(r"(?i)^\s*file\s+creation\s+time"), F.lit(False)),
        compared={"exchange": squeezed(F.col("exchange")), "financial_status": squeezed(F.col("financial_status"))},
    )
    return out.withColumnRenamed("key", "ticker")


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_sliding": p2_sliding, "p3_found": p3_found}


def oracle_sql() -> dict[str, str]:
    known = {"shares_outstanding": "shares_outstanding > 0", "financial_status": "trim(financial_status) <> ''", "prev_close": "prev_close > 0"}
    p1 = " union all ".join(
        f"""select s.signal_id, '{f}' as field, max_by(i.version_id, (i.valid_from_ns, i.known_ns, i.version_id)) as version_id
        from signals s join symbol_info i on s.ticker = i.ticker and i.valid_from_ns <= s.t_signal_ns and i.known_ns <= s.t_signal_ns and {k} group by s.signal_id"""
        for f, k in known.items()
    )

    def late(width: int, each: str) -> str:
        return f"""with story as (select src, period_ns, news_id, min(t_news_recv_ns) as t from ({each}) where src is not null and news_id is not null and t_news_recv_ns is not null group by all),
        ranked as (select src, period_ns, t, row_number() over (partition by src, period_ns order by t, news_id) as n from story)
        select src, period_ns, n as n_stories from ranked where t >= period_ns + {width} and t < period_ns + {width + 6 * HOUR}"""

    base = f"select src, news_id, t_news_recv_ns, published_ns - published_ns % {HOUR} as pane from signals where published_ns is not null and published_ns <> 0"
    p3 = r"""with final as (select snap_date, max(loaded_ns) as loaded_ns from symbol_snapshots where snap_date is not null group by 1),
    step as (select snap_date, lag(snap_date) over (order by snap_date) as prev from final),
    r as (select snap_date, upper(regexp_replace(regexp_replace(ticker, '^\s+|\s+$', '', 'g'), '[^A-Za-z0-9]+', '.', 'g')) as ticker,
      coalesce(lower(regexp_replace(exchange, '\s+', '', 'g')), '') as e, coalesce(lower(regexp_replace(financial_status, '\s+', '', 'g')), '') as f
      from symbol_snapshots join final using (snap_date, loaded_ns)
      where not regexp_matches(lower(ticker), '^\s*file\s+creation\s+time') and trim(ticker) <> ''),
    u as (select distinct * from r),
    j as (select coalesce(b.snap_date, a.step) as snap_date, coalesce(b.ticker, a.ticker) as ticker, a.ticker as old, b.ticker as new, a.e as ae, b.e as be, a.f as af, b.f as bf
      from (select u.*, prev from u join step using (snap_date) where prev is not null) b
      full join (select u.*, s.snap_date as step from u join step s on s.prev = u.snap_date) a on a.step = b.snap_date and a.ticker = b.ticker)
    select snap_date, ticker, 'added' as change_kind from j where old is null
    union all select snap_date, ticker, 'removed' from j where new is null
    union all select snap_date, ticker, 'exchange' from j where ae <> be
    union all select snap_date, ticker, 'financial_status' from j where af <> bf"""
    return {
        "p1_found": p1,
        "p2_found": late(HOUR, base.replace("as pane", "as period_ns")),
        "p2_sliding": late(3 * HOUR, f"select b.* exclude (pane), pane - k * {HOUR} as period_ns from ({base}) b, range(3) t(k)"),
        "p3_found": p3,
    }
