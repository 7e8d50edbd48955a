"""Queries for the engine's own operators on the driver's tables, each with the SQL that checks it.

Bindings: prints are ``tape``; stories are ``signals`` (journal order by
signal_id); outcomes are ``outcomes``; the security master is ``symbol_info`` and
``symbol_snapshots``; filings are ``orders`` (issuer = customer, kind = priority);
closed trades are ``lineitem`` with results in cents; texts are ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import names, text, times, urls
from newsloom.operators import journal, market, ordered, phrases, reference
from newsloom.operators import stories as stories_ops
from newsloom.runtime import table

S = 1_000_000_000
HOUR = 3600 * S
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query and its SQL; ``dates`` are given as text, which both engines write alike."""

    def add(f):
        @functools.wraps(f)
        def run(spark, d):
            df = f(spark, d)
            return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

        QUERIES[name] = run
        if sql:
            SQL[name] = f"select * replace ({', '.join(f'cast({c} as varchar) as {c}' for c in dates)}) from ({sql})" if dates else sql
        return f

    return add


PRINTS = "(select * from tape where ticker is not null and ts_ns is not null and printable and px_e4 > 0 and shares > 0)"
ET = "(make_timestamp({0} // 1000) at time zone 'UTC' at time zone 'America/New_York')"
ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tape(spark: SparkSession, d: str) -> DataFrame:
    return market.prints(table(spark, d, "tape"))


def stories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "signals").where("t_news_recv_ns is not null")


# ---- market data -------------------------------------------------------------------------------

DAY = f"cast({ET.format('ts_ns')} as date)"
MIN = f"(extract(hour from {ET.format('ts_ns')}) * 60 + extract(minute from {ET.format('ts_ns')}))"
SESSION = f"""(select ticker, day, arg_min(px_e4, (ts_ns, print_id)) filter (m between 570 and 959) as open_e4, max(px_e4) as high_e4, min(px_e4) as low_e4,
  arg_max(px_e4, (ts_ns, print_id)) as last_e4, arg_max(px_e4, (ts_ns, print_id)) filter (m between 570 and 959) as rth_last_e4, max(px_e4) filter (m < 570) as pm_high_e4,
  cast(sum(shares) as bigint) as volume, cast(sum(cast(px_e4 as bigint) * shares) as bigint) as notional_e4, count(*) as n_prints, max(ts_ns) as last_ns
  from (select *, {DAY} as day, {MIN} as m from {PRINTS}) group by ticker, day)"""


@query("q01_session_rollup", f"select * from {SESSION}",
    dates=("day",),
)
def session_rollup(spark, d):
    return market.session_rollup(tape(spark, d))


@query("q02_vwap", f"select ticker, day, round(notional_e4 / volume / 10000, 6) as vwap from {SESSION}",
    dates=("day",),
)
def vwap(spark, d):
    return market.session_rollup(tape(spark, d)).select("ticker", "day", market.vwap(F.col("notional_e4"), F.col("volume")).alias("vwap"))


@query(
    "q03_minute_bars",
    f"""select ticker, ts_ns - ts_ns % 60000000000 as minute_ns, arg_min(px_e4, (ts_ns, print_id)) as open_e4, max(px_e4) as high_e4, min(px_e4) as low_e4,
    arg_max(px_e4, (ts_ns, print_id)) as close_e4, cast(sum(shares) as bigint) as volume, count(*) as n_prints from {PRINTS} group by all""",
)
def minute_bars(spark, d):
    return market.minute_bars(tape(spark, d))


@query("q04_most_active", f"select ticker, day, notional_e4, volume from {SESSION} order by notional_e4 desc, ticker, day limit 20",
    dates=("day",),
)
def most_active(spark, d):
    return market.most_active(market.session_rollup(tape(spark, d)), 20).select("ticker", "day", "notional_e4", "volume")


@query(
    "q05_baseline",
    f"""with s as {SESSION}, d as (select day from (select distinct day from s) order by day desc limit 5)
    select ticker, round(avg(volume), 4) as adv, arg_max(coalesce(nullif(rth_last_e4, 0), last_e4), day) as prev_close_e4, count(*) as days from s join d using (day) group by ticker""",
)
def baseline(spark, d):
    return market.baseline(market.session_rollup(tape(spark, d)), 5)


@query(
    "q06_rolling_baseline",
    f"""with s as {SESSION}, o as (select day, row_number() over (order by day) as r from (select distinct day from s))
    select ticker, day, round(avg(volume) over (partition by ticker order by r range between 3 preceding and 1 preceding), 4) as adv from s join o using (day)""",
    dates=("day",),
)
def rolling_baseline(spark, d):
    return market.rolling_baseline(market.session_rollup(tape(spark, d)), 3)


@query(
    "q07_rvol",
    f"""with s as {SESSION}, o as (select day, row_number() over (order by day) as r from (select distinct day from s)),
    b as (select ticker, day, volume, avg(volume) over (partition by ticker order by r range between 3 preceding and 1 preceding) as adv from s join o using (day))
    select ticker, day, case when adv > 0 then round(volume / adv, 6) else 0.0 end as rvol from b""",
    dates=("day",),
)
def rvol(spark, d):
    """Of whole days: by midnight all of the usual volume is due."""
    s = market.session_rollup(tape(spark, d))
    b = s.join(market.rolling_baseline(s, 3, digits=12), ["ticker", "day"])
    return b.select("ticker", "day", F.round(market.rvol(F.col("volume"), F.col("adv"), F.lit(1439)), 6).alias("rvol"))


@query(
    "q08_asof_price",
    f"""select s.signal_id, s.ticker, p.print_id, p.px_e4, p.ts_ns from (select signal_id, ticker, t_news_recv_ns as t from signals where t_news_recv_ns is not null) s
    asof left join (select ticker, ts_ns, max(print_id) as print_id, max_by(px_e4, print_id) as px_e4 from {PRINTS} group by all) p on s.ticker = p.ticker and s.t > p.ts_ns""",
)
def asof_price(spark, d):
    s = stories(spark, d).select("signal_id", "ticker", "t_news_recv_ns")
    out = ordered.asof_join(s, tape(spark, d), keys=["ticker"], left_time="t_news_recv_ns", right_time="ts_ns", take={"print_id": "print_id", "px_e4": "px_e4", "ts_ns": "ts_ns"}, tie=["print_id"])
    return out.drop("t_news_recv_ns")


@query(
    "q09_horizon_prices",
    f"""select s.signal_id, s.h as horizon_s, p.px_e4 from (select signal_id, ticker, h, t_news_recv_ns + h::bigint * {S} as t from signals, (values (60), (300), (900), (1800), (3600)) v(h) where t_news_recv_ns is not null) s
    asof left join (select ticker, ts_ns, max_by(px_e4, print_id) as px_e4 from {PRINTS} group by all) p on s.ticker = p.ticker and s.t > p.ts_ns""",
)
def horizon_prices(spark, d):
    s = stories(spark, d).select("signal_id", "ticker", "t_news_recv_ns", F.explode(F.array(*map(F.lit, (60, 300, 900, 1800, 3600)))).alias("horizon_s"))
    s = s.withColumn("t", F.col("t_news_recv_ns") + F.col("horizon_s").cast("long") * S)
    return ordered.asof_join(s, tape(spark, d), keys=["ticker"], left_time="t", right_time="ts_ns", take={"px_e4": "px_e4"}, tie=["print_id"]).select("signal_id", "horizon_s", "px_e4")


@query(
    "q10_since_news",
    f"""select s.signal_id, count(p.print_id) as n, cast(sum(p.shares) as bigint) as weight, cast(sum(cast(p.px_e4 as bigint) * p.shares) as bigint) as notional, cast(max(p.px_e4) as bigint) as high, cast(min(p.px_e4) as bigint) as low
    from signals s left join {PRINTS} p on s.ticker = p.ticker and p.ts_ns > s.t_news_recv_ns and p.ts_ns <= s.t_news_recv_ns + {300 * S} where s.t_news_recv_ns is not null group by s.signal_id""",
)
def since_news(spark, d):
    """Volume, notional, best and worst price in the five minutes after each story."""
    return ordered.interval_stats(stories(spark, d), tape(spark, d), keys=["ticker"], point_id="signal_id", point_time="t_news_recv_ns", value_time="ts_ns", value="px_e4", weight="shares", length=300 * S)


@query(
    "q11_depth",
    """select l_suppkey, case when l_linenumber % 2 = 0 then 'B' else 'S' end as side, cast(l_discount * 100 as int) as level, cast(sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as bigint) as qty
    from lineitem group by all having sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) > 0""",
)
def depth(spark, d):
    return market.depth(_ladder(spark, d), book="l_suppkey", side="side", price="level", qty="q")


def _ladder(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, "B").otherwise("S").alias("side"), F.round(F.col("l_discount") * 100).cast("int").alias("level"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint").alias("q"))


@query(
    "q12_best_levels",
    """with l as (select l_suppkey, case when l_linenumber % 2 = 0 then 'B' else 'S' end as side, cast(l_discount * 100 as int) as level, cast(sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as bigint) as qty
    from lineitem group by all having sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) > 0)
    select l_suppkey, max(level) filter (side = 'B') as bid, arg_max(qty, level) filter (side = 'B') as bid_qty, min(level) filter (side = 'S') as ask, arg_min(qty, level) filter (side = 'S') as ask_qty from l group by 1""",
)
def best_levels(spark, d):
    return market.best_levels(market.depth(_ladder(spark, d), book="l_suppkey", side="side", price="level", qty="q"), book="l_suppkey", side="side", price="level")


@query(
    "q13_sequence_gaps",
    """with x as (select l_suppkey, l_orderkey * 2 as q, l_linenumber as c from lineitem),
    y as (select l_suppkey, q, max(q + c) over (partition by l_suppkey order by q, c rows between unbounded preceding and 1 preceding) as seen from x)
    select l_suppkey, seen as from_seq, q - seen as lost from y where q > seen""",
)
def sequence_gaps(spark, d):
    return market.sequence_gaps(table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 2).alias("q"), "l_linenumber"), stream="l_suppkey", seq="q", count="l_linenumber")


@query(
    "q14_state_changes",
    """with x as (select event_id, user_id, epoch_ns(ts) as t, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events)
    select event_id, user_id, event_type, previous from x where event_type is distinct from previous and not (previous is null and event_type = 'view')""",
)
def state_changes(spark, d):
    e = _events(spark, d)
    return ordered.state_changes(e, keys=["user_id"], time="t", id_col="event_id", state="event_type", quiet_first="view").select("event_id", "user_id", "event_type", "previous")


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"))


@query("q15_quote_spread", "select signal_id, case when bid > 0 and ask >= bid then round((ask - bid) / ((ask + bid) / 2) * 100, 6) else 0.0 end as spread from signals")
def quote_spread(spark, d):
    return table(spark, d, "signals").select("signal_id", F.round(F.coalesce(market.spread_pct(F.col("bid"), F.col("ask")), F.lit(0.0)), 6).alias("spread"))


@query(
    "q62_prints_during",
    f"""select t.print_id from (select print_id, ticker, ts_ns from tape where ticker is not null and ts_ns is not null) t
    asof join (select distinct ticker, t_news_recv_ns as o from signals where t_news_recv_ns is not null) s on t.ticker = s.ticker and t.ts_ns > s.o where t.ts_ns - s.o <= {90 * 60 * S}""",
)
def prints_during(spark, d):
    """Prints in the ninety minutes after the latest story of their ticker."""
    t = table(spark, d, "tape").where("ticker is not null and ts_ns is not null").select("print_id", "ticker", "ts_ns")
    return stories_ops.during(t, stories(spark, d).select("ticker", "t_news_recv_ns"), key="ticker", event_time="ts_ns", opened="t_news_recv_ns", length=90 * 60 * S).select("print_id")


# ---- sequential operators ----------------------------------------------------------------------


@query(
    "q16_cooldown",
    f"""with recursive e as (select event_id, user_id, event_type, epoch_ns(ts) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
    r as (select user_id, event_type, n, event_id, t, t as last, true as pass from e where n = 1
      union all select e.user_id, e.event_type, e.n, e.event_id, e.t, case when e.t - r.last >= {24 * HOUR} then e.t else r.last end, e.t - r.last >= {24 * HOUR} from r join e on e.user_id = r.user_id and e.event_type = r.event_type and e.n = r.n + 1)
    select event_id from r where pass""",
)
def cooldown(spark, d):
    return ordered.cooled_down(_events(spark, d), keys=["user_id", "event_type"], time="t", id_col="event_id", cooldown=24 * HOUR)


@query(
    "q17_repeats_dropped",
    f"""with recursive e as (select event_id, user_id, event_type, epoch_ns(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
    r as (select user_id, n, event_id, t as last, event_type as state, true as pass from e where n = 1
      union all select e.user_id, e.n, e.event_id, case when e.event_type <> r.state or e.t - r.last >= {6 * HOUR} then e.t else r.last end, case when e.event_type <> r.state or e.t - r.last >= {6 * HOUR} then e.event_type else r.state end,
      e.event_type <> r.state or e.t - r.last >= {6 * HOUR} from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select event_id from r where pass""",
)
def repeats_dropped(spark, d):
    return ordered.repeats_dropped(_events(spark, d), keys=["user_id"], time="t", id_col="event_id", state="event_type", within=6 * HOUR)


@query("q18_running_sum", "select event_id, cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id) as bigint) as total from events")
def running_sum(spark, d):
    e = _events(spark, d)
    return ordered.with_running_sum(e, keys=["user_id"], time="t", tie=["event_id"], value=F.round(F.col("value") * 100).cast("bigint"), name="total", width=24 * HOUR).select("event_id", "total")


@query("q19_once_per_day", "select ticker, min(signal_id) as signal_id, cast(t as date) as day from (select ticker, signal_id, make_timestamp(t_signal_ns // 1000) as t from signals where ticker is not null and t_signal_ns is not null) group by 1, 3",
    dates=("day",),
)
def once_per_day(spark, d):
    s = table(spark, d, "signals").where("ticker is not null and t_signal_ns is not null")
    return s.groupBy("ticker", F.to_date(times.utc(F.col("t_signal_ns"))).alias("day")).agg(F.min("signal_id").alias("signal_id"))


# ---- journal statistics ------------------------------------------------------------------------

KEYED = f"(select signal_id, src, t_news_recv_ns as t, published_ns, trim(regexp_replace({ASCII.format('title')}, '[^a-z0-9]+', ' ', 'g')) as k from signals where t_news_recv_ns is not null)"
SEEN = f"""(select signal_id, src, t, published_ns, k is not null and signal_id <> first_value(signal_id) over w as dup, case when k is null then src else first_value(src) over w end as first_src,
  case when k is null then 0 else t - first_value(t) over w end as behind_ns from {KEYED} window w as (partition by k order by t, signal_id))"""


def _seen(spark, d):
    s = stories(spark, d).select("signal_id", "src", F.col("t_news_recv_ns").alias("t"), "published_ns", text.headline_key(F.col("title")).alias("k"))
    return journal.first_seen(s, key="k", time="t", id_col="signal_id", source="src")


@query("q20_first_seen", f"select signal_id, dup, first_src, behind_ns from {SEEN}")
def first_seen(spark, d):
    return _seen(spark, d).select("signal_id", "dup", "first_src", "behind_ns")


@query(
    "q21_source_standing",
    f"""select src, count(*) as items, count(*) filter (not dup) as firsts, count(*) filter (dup and first_src <> src) as behind, coalesce(median(behind_ns / 1e6) filter (dup and first_src <> src), 0.0) as median_behind_ms,
    coalesce(median((t - published_ns) / 1e6) filter (published_ns > 0 and t >= published_ns), 0.0) as median_publish_ms from {SEEN} group by src""",
)
def source_standing(spark, d):
    lag = F.when(F.col("published_ns") > 0, (F.col("t") - F.col("published_ns")) / 1e6)
    return journal.source_standing(_seen(spark, d), source="src", publish_lag=lag)


@query("q22_funnel", "select catalyst, count(*) as stories, count(*) filter (ticker is not null) as with_ticker, count(*) filter (score >= 55) as scored, count(*) filter (tier in ('ALERT', 'HIGH')) as alerts from signals group by catalyst")
def funnel(spark, d):
    return journal.funnel(table(spark, d, "signals"), group=["catalyst"], stages={"with_ticker": F.col("ticker").isNotNull(), "scored": F.col("score") >= 55, "alerts": F.col("tier").isin("ALERT", "HIGH")})


@query(
    "q23_outcome_groups",
    """select horizon_s, tier_reached, catalyst, count(*) as n, round(avg(move_pct), 6) as mean_move, round(median(move_pct), 6) as median_move, round(100.0 * count(*) filter (move_pct > 0) / count(*), 6) as up_pct,
    round(avg(max_move_pct), 6) as mean_mfe, round(avg(min_move_pct), 6) as mean_mae from outcomes group by grouping sets ((horizon_s, tier_reached), (horizon_s, catalyst))""",
)
def outcome_groups(spark, d):
    return journal.outcome_groups(table(spark, d, "outcomes"), ["horizon_s", "tier_reached"], ["horizon_s", "catalyst"])


@query(
    "q24_story_outcomes",
    """select s.catalyst, count(*) as stories, round(avg(o.move_pct), 6) as avg_5m, round(avg(o.max_move_pct), 6) as avg_mfe from signals s join outcomes o on o.news_id = s.news_id and o.horizon_s = 300 group by 1""",
)
def story_outcomes(spark, d):
    o = table(spark, d, "outcomes").where("horizon_s = 300").select("news_id", "move_pct", "max_move_pct")
    return table(spark, d, "signals").select("news_id", "catalyst").join(o, "news_id").groupBy("catalyst").agg(F.count(F.lit(1)).alias("stories"), F.round(F.avg("move_pct"), 6).alias("avg_5m"), F.round(F.avg("max_move_pct"), 6).alias("avg_mfe"))


TRADES = "(select l_returnflag as tier, l_linestatus as reason, cast(l_shipdate as date) as day, l_orderkey, l_linenumber, cast(round(l_extendedprice * (l_discount - 0.05) * 100) as bigint) as pnl from lineitem)"


def _trades(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("reason"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (F.col("l_discount") - 0.05) * 100).cast("bigint").alias("pnl"))


def _equity(spark, d, group):
    return journal.equity(_trades(spark, d), group=group, day="day", order=["l_orderkey", "l_linenumber", "pnl"], pnl="pnl")


def _stats_sql(group: str, where: str = "") -> str:
    return f"""with c as (select *, sum(pnl) over (partition by {group} order by day, l_orderkey, l_linenumber, pnl) as cum, row_number() over (partition by {group} order by pnl desc) as r from {TRADES} {where}),
    e as (select *, greatest(0, max(cum) over (partition by {group} order by day, l_orderkey, l_linenumber, pnl)) - cum as drawdown from c)
    select {group}, count(*) as n, count(*) filter (pnl > 0) as wins, count(*) filter (pnl <= 0) as losses, cast(sum(pnl) as bigint) as total, cast(coalesce(sum(pnl) filter (pnl > 0), 0) as bigint) as gross_win,
    cast(coalesce(-sum(pnl) filter (pnl < 0), 0) as bigint) as gross_loss, cast(max(drawdown) as bigint) as max_drawdown, cast(date_diff('day', min(day), max(day)) + 1 as int) as span_days,
    cast(sum(pnl) - coalesce(sum(pnl) filter (r <= 3 and pnl > 0), 0) as bigint) as without_top3, round(count(*) filter (pnl > 0) / count(*), 6) as win_rate, round(sum(pnl) / count(*), 6) as expectancy,
    case when coalesce(-sum(pnl) filter (pnl < 0), 0) > 0 then round(coalesce(sum(pnl) filter (pnl > 0), 0) / -sum(pnl) filter (pnl < 0), 6) when sum(pnl) filter (pnl > 0) > 0 then 'inf'::double else 0.0 end as profit_factor from e group by {group}"""


@query("q25_equity_curve", f"""with c as (select *, cast(sum(pnl) over w as bigint) as cum from {TRADES} window w as (partition by tier order by day, l_orderkey, l_linenumber, pnl))
    select tier, l_orderkey, l_linenumber, cum, cast(greatest(0, max(cum) over (partition by tier order by day, l_orderkey, l_linenumber, pnl)) as bigint) as peak from c""")
def equity_curve(spark, d):
    return _equity(spark, d, ["tier"]).select("tier", "l_orderkey", "l_linenumber", "cum", "peak")


@query("q26_stats_by_tier", _stats_sql("tier"))
def stats_by_tier(spark, d):
    return journal.trade_stats(_equity(spark, d, ["tier"]), group=["tier"], day="day", pnl="pnl")


@query("q27_stats_by_reason", _stats_sql("reason"))
def stats_by_reason(spark, d):
    return journal.trade_stats(_equity(spark, d, ["reason"]), group=["reason"], day="day", pnl="pnl")


@query("q28_in_out_sample", f"select day < date '1998-01-01' as in_sample, count(*) as n, cast(sum(pnl) as bigint) as total, round(sum(pnl) / count(*), 6) as expectancy from {TRADES} group by 1")
def in_out_sample(spark, d):
    return _trades(spark, d).groupBy((F.col("day") < F.lit("1998-01-01").cast("date")).alias("in_sample")).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"), F.round(F.sum("pnl") / F.count(F.lit(1)), 6).alias("expectancy"))


@query("q29_day_results", f"select day, count(*) as closed, cast(sum(pnl) as bigint) as pnl from {TRADES} group by day",
    dates=("day",),
)
def day_results(spark, d):
    return _trades(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("closed"), F.sum("pnl").alias("pnl"))


@query(
    "q30_histogram",
    """with v as (select src, greatest(cast(round(news_to_signal_ms * 1000) as bigint), 0) as v from signals where news_to_signal_ms is not null and src is not null),
    b as (select src, v, case when v < 16 then v else (length(bin(v)) - 5) * 16 + (v >> cast(length(bin(v)) - 5 as int)) end as b from v),
    h as (select src, b, count(*) as n, max(v) as top from b group by 1, 2),
    r as (select *, sum(n) over (partition by src order by b) as seen, sum(n) over (partition by src) as al, max(top) over (partition by src) as most,
      case when b < 16 then b else (((b - (greatest(b // 16 - 1, 0)) * 16 + 1) << cast(greatest(b // 16 - 1, 0) as int)) - 1) end as up from h)
    select src, cast(sum(n) as bigint) as n, min(least(up, most)) filter (seen >= ceil(0.5 * al)) as p50, min(least(up, most)) filter (seen >= ceil(0.9 * al)) as p90, min(least(up, most)) filter (seen >= ceil(0.99 * al)) as p99 from r group by src""",
)
def histogram(spark, d):
    s = table(spark, d, "signals").where("src is not null and news_to_signal_ms is not null").select("src", F.greatest(F.expr("cast(round(news_to_signal_ms * 1000) as bigint)"), F.lit(0).cast("bigint")).alias("us"))
    return journal.histogram_percentiles(s, group=["src"], value="us", at=[0.5, 0.9, 0.99])


@query("q31_median", "select catalyst, median(score) as median_score, round(avg(score), 6) as mean_score from signals where catalyst is not null group by catalyst")
def median(spark, d):
    s = table(spark, d, "signals").where("catalyst is not null")
    return s.groupBy("catalyst").agg(F.round(F.avg("score"), 6).alias("mean_score")).join(journal.exact_medians(s, group=["catalyst"], values={"median_score": F.col("score")}), "catalyst")


@query("q32_score_bucket", "select case when score >= 85 then '85+' when score >= 75 then '75-84' when score >= 65 then '65-74' when score >= 55 then '55-64' else '<55' end as bucket, count(*) as n from signals where score is not null group by 1")
def score_bucket(spark, d):
    return table(spark, d, "signals").where("score is not null").groupBy(journal.score_bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("q33_param_sweep", f"select p as cut, count(*) as n, cast(sum(pnl) as bigint) as total from {TRADES}, (values (0), (1000), (10000), (50000)) v(p) where abs(pnl) >= p group by p")
def param_sweep(spark, d):
    return journal.parameter_sweep(_trades(spark, d), values=[0, 1000, 10000, 50000], keeps=lambda p: F.abs(F.col("pnl")) >= p, pnl="pnl")


# ---- security master and filings ---------------------------------------------------------------


@query("q34_upsert_master", """select ticker, arg_max(security_name, (version_id, security_name)) filter (security_name is not null) as security_name, arg_max(shares_outstanding, (version_id, shares_outstanding)) filter (shares_outstanding > 0) as shares_outstanding,
    arg_max(cik, (version_id, cik)) filter (cik is not null) as cik from symbol_info where ticker is not null group by ticker""")
def upsert_master(spark, d):
    i = table(spark, d, "symbol_info")
    return reference.upsert(i.where("feed = 'directory'"), i.where("feed <> 'directory' or feed is null"), key="ticker", order="version_id", fields=["security_name", "shares_outstanding", "cik"], usable={"shares_outstanding": F.col("shares_outstanding") > 0})


MASTER = "(select ticker, arg_max(security_name, version_id) filter (security_name is not null) as security_name, max(cik) as cik, arg_max(exchange, version_id) filter (exchange is not null) as exchange, min(version_id) as first_id from symbol_info where ticker is not null group by ticker)"


def _master(spark, d):
    return table(spark, d, "symbol_info").where("ticker is not null").groupBy("ticker").agg(
        F.max_by("security_name", F.when(F.col("security_name").isNotNull(), F.col("version_id"))).alias("security_name"), F.max("cik").alias("cik"),
        F.max_by("exchange", F.when(F.col("exchange").isNotNull(), F.col("version_id"))).alias("exchange"), F.min("version_id").alias("first_id"),
    )


@query(
    "q35_primary_security",
    f"""select cik, ticker from (select *, row_number() over (partition by cik order by coalesce(exchange <> 'OTC', false) desc, coalesce(regexp_matches(security_name, '(?i)(^|[^A-Za-z])(warrants?|units?|rights?)([^A-Za-z]|$)'), false), length(ticker), first_id, ticker) as r from {MASTER} where cik is not null) where r = 1""",
)
def primary_security(spark, d):
    return reference.primary_security(_master(spark, d), issuer="cik", symbol="ticker", name="security_name", listed=F.coalesce(F.col("exchange") != "OTC", F.lit(False)), load_order="first_id")


COMPANY = r"""regexp_replace(regexp_replace(trim(regexp_replace(upper(regexp_replace(replace(string_split({0}, ' - ')[1], '&', ' AND '), '[''.]', '', 'g')), '[^A-Z0-9]+', ' ', 'g')),
  '( (INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|PLC|LLC|LP|HOLDINGS|HOLDING|GROUP|SA|NV|AG|SE|ADR|ADS|THE|COMMON|STOCK|SHARES|ORDINARY|CLASS|A|B))+$', ''), '^THE (.)', '\1')"""


@query("q36_company_names", f"select distinct security_name, {COMPANY.format('security_name')} as company from symbol_info where security_name is not null")
def company_names(spark, d):
    return table(spark, d, "symbol_info").where("security_name is not null").select("security_name", names.normalize_company(F.col("security_name")).alias("company")).distinct()


@query(
    "q37_unique_names",
    f"""select company, min(ticker) as ticker from (select ticker, cik, {COMPANY.format('security_name')} as company from {MASTER}) where length(company) >= 4 group by company
    having count(*) = 1 or (count(cik) = count(*) and min(cik) = max(cik))""",
)
def unique_names(spark, d):
    return reference.unique_names(_master(spark, d), issuer="cik", symbol="ticker", name="security_name")


@query("q38_symbols", "select distinct ticker as raw, translate(upper(trim(ticker)), '-/ ', '...') as ticker, rpad(left(upper(trim(ticker)), 8), 8, ' ') as key8 from symbol_snapshots where ticker is not null")
def symbols(spark, d):
    t = table(spark, d, "symbol_snapshots").where("ticker is not null").select(F.col("ticker").alias("raw")).distinct()
    return t.select("raw", names.normalize_symbol(F.col("raw")).alias("ticker"), names.symbol_key8(text.trimmed(F.col("raw"))).alias("key8"))


FILINGS = "(select o_custkey as cik, cast(o_orderdate as date) as day, o_orderpriority as kind, cast(1 << cast(o_orderkey % 30 as int) as bigint) as items from orders)"


def _filings(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("kind"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("o_orderkey") % 30).cast("int")).alias("items"))


@query("q39_merge_filings", f"select cik, day, kind, bit_or(items) as items from {FILINGS} group by all",
    dates=("day",),
)
def merge_filings(spark, d):
    f = _filings(spark, d)
    return reference.merge_filings(f.where("items < 1000"), f.where("items >= 1000"), key="cik", day="day", kind="kind", items="items")


WINDOWS = {"1-URGENT": (10, 1), "2-HIGH": (30, 2), "3-MEDIUM": (120, 4), "5-LOW": (180, 8)}


@query(
    "q40_flags_in_window",
    f"""select a.cik, a.day, coalesce(bit_or(w.bit), 0) as flags from (select distinct cik, day from {FILINGS}) a left join ({FILINGS} f join (values {', '.join(f"('{k}', {n}, {b})" for k, (n, b) in WINDOWS.items())}) w(kind, n, bit) on f.kind = w.kind)
    on f.cik = a.cik and date_diff('day', f.day, a.day) between 0 and w.n group by all""",
    dates=("day",),
)
def flags_in_window(spark, d):
    f = _filings(spark, d)
    return reference.flags_in_window(f.select("cik", "day").distinct(), f, key="cik", asked_day="day", day="day", kind="kind", windows=WINDOWS)


@query("q41_flag_names", "select o_orderkey, concat_ws(',', case when o_orderkey & 1 = 1 then 'offering' end, case when o_orderkey & 8 = 8 then 'effect' end, case when o_orderkey & 2 = 2 then 's1' end, case when o_orderkey & 4 = 4 then 'shelf' end) as flags from orders")
def flag_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", names.mask_names(F.col("o_orderkey"), [(1, "offering"), (8, "effect"), (2, "s1"), (4, "shelf")]).alias("flags"))


@query("q42_before_day", f"select cik, count(*) as n, max(day) as last_day from {FILINGS} where day < date '1997-06-01' group by cik",
    dates=("last_day",),
)
def before_day(spark, d):
    return _filings(spark, d).where(F.col("day") < F.lit("1997-06-01").cast("date")).groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))


@query("q43_latest_per_issuer", "select o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as price, max(o_orderdate) as ordered_at from orders group by 1",
    dates=("ordered_at",),
)
def latest_per_issuer(spark, d):
    o = table(spark, d, "orders")
    return reference.latest_per_key(o, key=["o_custkey"], order=["o_orderdate", "o_orderkey"], take=["o_totalprice", "o_orderdate"]).select("o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ordered_at"))


@query("q44_missing_symbols", "select distinct ticker from tape where ticker is not null and ticker not in (select ticker from symbol_info where ticker is not null)")
def missing_symbols(spark, d):
    return table(spark, d, "tape").where("ticker is not null").select("ticker").distinct().join(table(spark, d, "symbol_info").select("ticker").distinct(), "ticker", "left_anti")


@query("q45_prints_with_news", "select ticker, count(*) as n, cast(sum(shares) as bigint) as shares from tape where ticker in (select ticker from signals where ticker is not null) group by ticker")
def prints_with_news(spark, d):
    return table(spark, d, "tape").join(table(spark, d, "signals").select("ticker").distinct(), "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


@query(
    "q46_outer_merge",
    """select coalesce(a.ticker, b.ticker) as ticker, a.shares, b.adv from (select ticker, max(shares_outstanding) as shares from symbol_info where feed = 'fundamentals' group by 1) a
    full join (select ticker, max(adv20) as adv from symbol_info where feed = 'baseline' group by 1) b on a.ticker = b.ticker""",
)
def outer_merge(spark, d):
    i = table(spark, d, "symbol_info")
    a = i.where("feed = 'fundamentals'").groupBy("ticker").agg(F.max("shares_outstanding").alias("shares"))
    return reference.outer_merge(a, i.where("feed = 'baseline'").groupBy("ticker").agg(F.max("adv20").alias("adv")), "ticker")


# ---- text --------------------------------------------------------------------------------------

RULES = ["purchase order", "today announced", "fast track designation", "approv*", "primary endpoint", "buy-back", "forward-looking", "gross margin", "who is holding", "halt*", "supply agreement", "million"]
PADDED = f"' ' || trim(regexp_replace({ASCII.format('text')}, '[^a-z0-9]+', ' ', 'g')) || ' '"


@query("q47_phrases", "select doc_id, r as rule from (select doc_id, " + PADDED + " as t from documents where text is not null), (values (0, ' purchase order '), (1, ' today announced '), (2, ' fast track designation '), (3, ' approv'), (4, ' primary endpoint '), (5, ' buy back '), (6, ' forward looking '), (7, ' gross margin '), (8, ' who is holding '), (9, ' halt'), (10, ' supply agreement '), (11, ' million ')) v(r, p) where contains(t, p)")
def phrase_hits(spark, d):
    return phrases.match_phrases(table(spark, d, "documents"), RULES, id_col="doc_id", text_col="text").select("doc_id", "rule")


@query("q48_headline_key", f"select signal_id, trim(regexp_replace({ASCII.format('title')}, '[^a-z0-9]+', ' ', 'g')) as key from signals")
def headline_key(spark, d):
    return table(spark, d, "signals").select("signal_id", text.headline_key(F.col("title")).alias("key"))


@query("q49_exact_dedupe", f"select min(signal_id) as signal_id, count(*) as n from (select signal_id, trim(regexp_replace({ASCII.format('title')}, '[^a-z0-9]+', ' ', 'g')) as k from signals where title is not null) group by k")
def exact_dedupe(spark, d):
    s = table(spark, d, "signals").where("title is not null")
    return s.groupBy(text.headline_key(F.col("title")).alias("k")).agg(F.min("signal_id").alias("signal_id"), F.count(F.lit(1)).alias("n")).drop("k")


# Without looking ahead: a symbol list ends before a venue and its colon, as text from there on is cut off first.
VENUES = """[{n: 'nasdaq global select market', c: 'US', v: 'NASDAQ'}, {n: 'nasdaq global market', c: 'US', v: 'NASDAQ'}, {n: 'nasdaq capital market', c: 'US', v: 'NASDAQ'}, {n: 'nyse american', c: 'US', v: 'NYSE'}, {n: 'nyse arca', c: 'US', v: 'NYSE'},
  {n: 'nasdaq', c: 'US', v: 'NASDAQ'}, {n: 'nyse', c: 'US', v: 'NYSE'}, {n: 'cboe bzx', c: 'US', v: 'CBOE'}, {n: 'cboe', c: 'US', v: 'CBOE'}, {n: 'otc', c: 'OTC', v: 'OTC'}, {n: 'tsx', c: 'Foreign', v: 'TSX'}, {n: 'amex', c: 'US', v: 'NYSE'}, {n: 'lse', c: 'Foreign', v: 'LSE'}, {n: 'cse', c: 'Foreign', v: 'CSE'}]"""
VENUE_RE = "nasdaq global select market|nasdaq global market|nasdaq capital market|nyse american|nyse arca|nasdaq|nyse|cboe bzx|cboe|otc|tsx|amex|lse|cse"


@query(
    "q50_ticker_tags",
    rf"""with p as (select doc_id, generate_subscripts(parts, 1) as i, unnest(parts) as part from (select doc_id, string_split(regexp_replace(text, '(^|[(\[ ,;/\n\t|>"])((?i:{VENUE_RE})) *: *', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) as parts from documents where text is not null)),
    t as (select doc_id, i, lower(split_part(part, chr(2), 1)) as n, regexp_extract(split_part(part, chr(2), 2), '^[A-Z](?:[A-Z0-9.-]{{0,8}}[A-Z0-9])?(?: *(?:,|and ) *[A-Z](?:[A-Z0-9.-]{{0,8}}[A-Z0-9])?)*') as l, split_part(part, chr(2), 2) as rest from p where i > 1),
    s as (select doc_id, i, n, unnest(regexp_split_to_array(l, ' *(?:,|and ) *')) as symbol from t where l <> '' and not regexp_matches(substr(rest, length(l) + 1, 1), '[a-z]'))
    select distinct doc_id, v.c as venue_class, v.v as venue, symbol from s join (select unnest({VENUES}) as v) on v.n = s.n""",
)
def ticker_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(phrases.ticker_tags(F.col("text"))).alias("x")).select("doc_id", "x.*")


AMOUNT = r"(?is)[$] *([0-9][0-9,]*(?:[.][0-9]+)?)(?: *(million|billion|thousand|trillion|mm|mln|bn|tn|m|b|k)\b)?([^$]{0,60})"


@query(
    "q51_dollar_amount",
    rf"""with m as (select doc_id, unnest(regexp_extract_all(text, '{AMOUNT}', 1)) as n, unnest(regexp_extract_all(text, '{AMOUNT}', 2)) as w, unnest(regexp_extract_all(text, '{AMOUNT}', 3)) as after from documents),
    v as (select doc_id, cast(replace(n, ',', '') as double) * case when lower(w) in ('million', 'mm', 'mln', 'm') then 1e6 when lower(w) in ('billion', 'bn', 'b') then 1e9 when lower(w) in ('thousand', 'k') then 1e3 when lower(w) in ('trillion', 'tn') then 1e12 else 1 end as v
      from m where not regexp_matches(after, '(?is)^(?:.{{0,8}}per |.{{0,3}}/sh)') and not regexp_matches(after, '(?is)^.{{0,36}}(?: market|industry|addressable| tam|opportunity| sector)'))
    select d.doc_id, coalesce(max(v.v), 0.0) as amount from documents d left join v using (doc_id) group by 1""",
)
def dollar_amount(spark, d):
    return table(spark, d, "documents").select("doc_id", phrases.dollar_amount(F.col("text")).alias("amount"))


NAMED = [("nbsp", " "), ("ensp", " "), ("emsp", " "), ("thinsp", " "), ("shy", ""), ("zwnj", ""), ("zwj", ""), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("hellip", "…"), ("trade", "™"), ("reg", "®"), ("copy", "©"), ("bull", "•"), ("eacute", "é"), ("euro", "€"), ("pound", "£"), ("amp", "&")]


def _decoded(c: str) -> str:
    for name, to in NAMED:
        c = f"replace({c}, '&{name};', '{to}')"
    return c


@query(
    "q52_html_text",
    r"""select doc_id, trim(regexp_replace(""" + _decoded(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)(?:[^A-Za-z0-9_:-][^>]*)?>.*?</(script|style)[^>]*>', ' ', 'g'),
    '(?i)</?(p|br|div|li|tr|td|th|h1|h2|h3|h4|h5|h6|ul|ol|table|section|article|blockquote|hr|pre|title|dd|dt)(/|[ \t\n\r\f\x0B][^>]*)?>', ' ', 'g'), '</?[A-Za-z0-9:-]+[^>]*>', '', 'g')""") + r""", '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') as plain from documents""",
)
def html_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.html_to_text("text").alias("plain"))


BLOCKS = "p|br|div|li|tr|td|th|h1|h2|h3|h4|h5|h6|ul|ol|table|section|article|blockquote|hr|pre|title|dd|dt"


@query(
    "q53_html_core",
    rf"""select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)[^>]*>', ' ', 'g'),
    '(?i)</?({BLOCKS})(/|\s[^>]*)?>', ' ', 'g'), '</?[A-Za-z0-9:-]+[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') as plain from documents""",
)
def html_core(spark, d):
    return table(spark, d, "documents").select("doc_id", text.html_core(F.col("text")).alias("plain"))


@query("q54_url_parts", r"""select signal_id, lower(regexp_extract(l, '(?i)^(https?)://([^/?#@:\s]+)', 1)) as scheme, lower(regexp_extract(l, '(?i)^(https?)://([^/?#@:\s]+)', 2)) as host, 443 as port,
    regexp_extract(l, '(?i)^https?://[^/?#]+([/?][^#]*)', 1) as target from (select signal_id, trim(link, chr(32) || chr(9) || chr(10)) as l from signals where link <> '')""")
def url_parts(spark, d):
    s = table(spark, d, "signals").where("link <> ''")
    return s.select("signal_id", urls.url_parts(text.trimmed(F.col("link"))).alias("u")).select("signal_id", "u.scheme", "u.host", "u.port", "u.target")


FORMS = ["S-1", " f-1/a", "S-1MEF", "S-3", "F-3ASR", "424B5", "EFFECT", "PRE 14A", "DEF 14C", "S-8", "s-8 pos", "8-K", "8-K/A ", "6-K", "10-Q/A", "10-K", "20-F", "NT 10-K", "NT 20-F", "SC 13G", "8-K12B", "S-11"]
CLASSES = "s1 s1 s1 s3 s3 424b effect pre14 def14 s8 s8 8k 8k 6k 10q 10k 10k nt nt other other other".split()


@query("q55_form_classes", f"select [{', '.join(map(repr, FORMS))}][p_partkey % {len(FORMS)} + 1] as form, [{', '.join(map(repr, CLASSES))}][p_partkey % {len(FORMS)} + 1] as p, count(*) as n from part group by 1, 2")
def form_classes(spark, d):
    form = F.get(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS)).cast("int"))
    return table(spark, d, "part").groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", names.classify_form(F.col("form")))


@query("q56_eastern_time", f"select print_id, {DAY} as day, cast({MIN} as int) as minute, strftime({ET.format('ts_ns')}, '%H:%M:%S') as hms from tape where ts_ns is not null",
    dates=("day",),
)
def eastern_time(spark, d):
    t = F.col("ts_ns")
    return table(spark, d, "tape").where("ts_ns is not null").select("print_id", times.eastern_date(t).alias("day"), times.eastern_minute(t).alias("minute"), times.eastern_hms(t).alias("hms"))


CURVE = "[0, 0.13, 0.22, 0.29, 0.35, 0.40, 0.45, 0.49, 0.53, 0.58, 0.63, 0.69, 0.78, 1]"


@query(
    "q57_volume_fraction",
    f"""select m as minute, round(case when m < 240 then 0.0::double when m < 570 then 0.04::double * (m - 240) / 330.0::double when m < 960 then 0.04::double + 0.92::double * (c[i + 1] + (c[least(i + 2, 14)] - c[i + 1]) * ((m - 570) / 30.0::double - i)) when m < 1200 then 0.96::double + 0.04::double * (m - 960) / 240.0::double else 1.0::double end, 9) as fraction
    from (select distinct cast({MIN} as int) as m, cast(floor((cast({MIN} as int) - 570) / 30.0) as int) as i, {CURVE}::double[] as c from tape where ts_ns is not null)""",
)
def volume_fraction(spark, d):
    m = table(spark, d, "tape").where("ts_ns is not null").select(times.eastern_minute(F.col("ts_ns")).alias("minute")).distinct()
    return m.select("minute", F.round(times.volume_fraction(F.col("minute")), 9).alias("fraction"))


@query("q58_iso_times", "select signal_id, t_signal_ns // 1000000 * 1000000 as ns from signals where t is not null and t_signal_ns is not null")
def iso_times(spark, d):
    """Printed and parsed again."""
    s = table(spark, d, "signals").where("t is not null and t_signal_ns is not null")
    return s.select("signal_id", times.parse_any_datetime(times.utc_iso(F.col("t_signal_ns"))).alias("ns"))


@query("q59_json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("q60_array_slices", "select vec_id, round(embedding[1]::double, 6) as first, cast(len(embedding[1:6]) as int) as n_head, cast(len(embedding) as int) as n from embeddings")
def array_slices(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size(F.slice("embedding", 1, 6)).alias("n_head"), F.size("embedding").alias("n"))


@query("q61_money", "select signal_id, case when mcap >= 1e9 then printf('%.1fB', floor(mcap / 1e8 + 0.5) / 10) when mcap >= 1e6 then printf('%.1fM', floor(mcap / 1e5 + 0.5) / 10) when mcap >= 1e3 then printf('%.1fK', floor(mcap / 1e2 + 0.5) / 10) else printf('%.0f', floor(mcap + 0.5)) end as mcap from signals where mcap is not null")
def money(spark, d):
    return table(spark, d, "signals").where("mcap is not null").select("signal_id", text.money(F.col("mcap")).alias("mcap"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
