"""Queries of functions, of stories and their securities, of journals' counters, and of streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import names, text, times, urls
from newsloom.operators import journal, market, ordered, phrases, reference
from newsloom.operators import stories as stories_ops
from newsloom.operators.late_counts import Slices
from newsloom.plans.catalog import ASCII, COMPANY, DAY, ET, FILINGS, HOUR, MASTER, MIN, PADDED, PRINTS, S, SEEN, SESSION, TRADES, WINDOWS, _equity, _filings, _master, _seen, _trades, query, stories, tape
from newsloom.runtime import scratch, table
from newsloom.sources import feeds
from newsloom.streaming import folds, late_panes, timers

# ---- functions ---------------------------------------------------------------------------------

NUMBERS = ["12", "-7", "1.5", "x", "", "3e2", ".5", "1x", " 4"]


@query(
    "q91_numbers",
    f"""select k, s, [12, -7, null, null, null, null, null, null, null][k + 1] as whole, [12.0, -7.0, 1.5, null, null, 300.0, 0.5, null, null][k + 1]::double as number, count(*) as n
    from (select l_orderkey % 9 as k, [{', '.join(map(repr, NUMBERS))}][l_orderkey % 9 + 1] as s from lineitem) group by all""",
)
def numbers(spark, d):
    k = F.col("l_orderkey") % len(NUMBERS)
    x = table(spark, d, "lineitem").select(k.alias("k"), F.get(F.array(*map(F.lit, NUMBERS)), k.cast("int")).alias("s"))
    return x.select("k", "s", text.parse_long(F.col("s")).alias("whole"), text.parse_double(F.col("s")).alias("number")).groupBy("k", "s", "whole", "number").agg(F.count(F.lit(1)).alias("n"))


@query("q92_feed_dates", "select signal_id, published_ns // 1000000000 * 1000000000 as rfc, published_ns as iso from signals where published_ns > 0")
def feed_dates(spark, d):
    """Printed in five ways of feeds, with offsets and zone names, and parsed again; ISO with nine digits."""
    s = table(spark, d, "signals").where("published_ns > 0")
    at = times.utc(F.col("published_ns"))
    shown = lambda hours, pattern, tail: F.concat(F.date_format(at + F.expr(f"interval '{hours}' hour"), pattern), F.lit(tail))
    k = F.col("signal_id") % 5
    rfc = (
        F.when(k == 0, shown(0, "EEE, dd MMM yyyy HH:mm:ss", " GMT")).when(k == 1, shown(-5, "d MMM yyyy HH:mm:ss", " -0500")).when(k == 2, shown(-4, "EEE, d MMM yy HH:mm:ss", " EDT"))
        .when(k == 3, shown(2, "dd-MMM-yyyy HH:mm:ss", " +02:00")).otherwise(shown(0, "dd MMM yyyy HH:mm:ss", " XYZ"))
    )
    iso = F.concat(shown(1, "yyyy-MM-dd'T'HH:mm:ss", "."), F.lpad(F.pmod("published_ns", F.lit(S)).cast("string"), 9, "0"), F.lit("+01:00"))
    return s.select("signal_id", times.parse_rfc822(rfc).alias("rfc"), times.parse_any_datetime(iso).alias("iso"))


@query("q93_eastern_dates", f"select print_id, epoch_us({DAY}::timestamp at time zone 'America/New_York') * 1000 + (epoch_us({ET.format('ts_ns')}) % 86400000000 // 1000) * 1000000 as ns, {DAY} as day, dayofweek({DAY}) as weekday, datediff('day', date '1970-01-01', {DAY}) as days from tape where ts_ns is not null", dates=("day",))
def eastern_dates(spark, d):
    t = table(spark, d, "tape").where("ts_ns is not null")
    et = times.eastern(F.col("ts_ns"))
    ms = F.lpad(F.floor(F.pmod("ts_ns", F.lit(S)) / 1_000_000).cast("string"), 3, "0")
    day = times.parse_ymd(F.when(F.col("print_id") % 2 == 0, F.date_format(et, "yyyy-MM-dd")).otherwise(F.date_format(et, "yyyyMMdd")))
    x = t.select("print_id", times.parse_eastern(F.date_format(et, "MM/dd/yyyy"), F.concat(F.date_format(et, "HH:mm:ss."), ms)).alias("ns"), day.alias("day"))
    return x.withColumns({"weekday": times.weekday(F.col("day")), "days": times.civil_days(F.col("day"))})


ITEM_LABELS = "1.01 1.02 1.03 1.04 1.05 2.01 2.02 2.03 2.04 2.05 2.06 3.01 3.02 3.03 4.01 4.02 5.01 5.02 5.03 5.04 5.05 5.06 5.07 5.08 6.01 6.02 6.03 6.04 6.05 7.01 8.01 9.01".split()
LABELS_SQL = f"[{', '.join(map(repr, ITEM_LABELS))}]"


@query(
    "q94_items",
    f"select o_orderkey, cast((1::bigint << (o_orderkey % 32)::int) | (1::bigint << (o_custkey % 32)::int) as bigint) as mask, array_to_string(list_sort(list_distinct([{LABELS_SQL}[o_orderkey % 32 + 1], {LABELS_SQL}[o_custkey % 32 + 1]])), ',') as labels from orders",
)
def items(spark, d):
    """Two items and one that does not exist, read from text, and written."""
    o = table(spark, d, "orders")
    label = lambda c: F.get(F.array(*map(F.lit, ITEM_LABELS)), (F.col(c) % 32).cast("int"))
    said = F.concat(F.lit("<p>ITEM "), label("o_orderkey"), F.lit(". item\t"), label("o_custkey"), F.lit("; Item 1.99</p>"))
    x = o.select("o_orderkey", names.items_mask(said).alias("mask"))
    return x.withColumn("labels", names.items_text(F.col("mask")))


@query("q95_quotes", "select signal_id, coalesce(bid > 0 and ask >= bid, false) as valid, signal_id % 4 in (1, 2, 3) as halted, signal_id % 4 = 2 as distressed from signals")
def quotes(spark, d):
    s = table(spark, d, "signals")
    state, status = (F.get(F.array(*map(F.lit, v)), (F.col("signal_id") % 4).cast("int")) for v in (["T", "H", "P", "Q"], ["N", " ", "D", ""]))
    return s.select("signal_id", market.quote_valid(F.col("bid"), F.col("ask")).alias("valid"), market.halted(state).alias("halted"), names.distressed(status).alias("distressed"))


@query(
    "q96_ordinals",
    "select tier, exchange, case tier when 'WATCH' then 1 when 'ALERT' then 2 when 'HIGH' then 3 when 'HALT' then 4 when 'MOVER' then 5 when 'INFO' then 6 end as tier_no, case exchange when 'Nasdaq GS' then 1 when 'Nasdaq GM' then 2 when 'Nasdaq CM' then 3 when 'NYSE' then 4 when 'NYSE American' then 5 when 'NYSE Arca' then 6 when 'Cboe BZX' then 7 when 'IEX' then 8 when 'OTC' then 9 when '?' then 0 end as exchange_no, tier as again, count(*) as n from signals where tier is not null group by all",
)
def ordinals(spark, d):
    s = table(spark, d, "signals").where("tier is not null").groupBy("tier", "exchange").agg(F.count(F.lit(1)).alias("n"))
    x = s.withColumns({"tier_no": names.ordinal(F.col("tier"), names.TIERS), "exchange_no": names.ordinal(F.col("exchange"), names.EXCHANGES)})
    return x.withColumn("again", names.name_of(F.col("tier_no"), names.TIERS))


@query("q97_share_counts", "select signal_id, case when mcap >= 1e6 then printf('%.1fM', floor(mcap / 1e5 + 0.5) / 10) when mcap >= 1e3 then printf('%.1fK', floor(mcap / 1e2 + 0.5) / 10) else printf('%.0f', floor(mcap + 0.5)) end as shares from signals where mcap is not null")
def share_counts(spark, d):
    return table(spark, d, "signals").where("mcap is not null").select("signal_id", text.share_count(F.col("mcap")).alias("shares"))


@query("q98_characters", "select l_orderkey, l_linenumber, chr(c::int) as c from (select l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 104729) % 1114111 + 1 as c from lineitem) where c not between 55296 and 57343")
def characters(spark, d):
    n = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1114111 + 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.utf8_char(n).alias("c")).where("c is not null")


@query("q99_json_text", "select signal_id, json_extract_string(to_json({v: title}), '$.v') as title, length(title) as chars from signals where title is not null")
def json_text(spark, d):
    """Escaped, put between quotes, and read again."""
    s = table(spark, d, "signals").where("title is not null")
    line = F.concat(F.lit('{"v":"'), text.json_escaped(F.col("title")), F.lit('"}'))
    return s.select("signal_id", F.from_json(line, "v string")["v"].alias("title"), F.length("title").alias("chars"))


@query("q100_entities", "select signal_id, title || ' & <' || ticker || '> – é & ' || chr(8364) || ' &nope; A' as said from signals where title is not null and ticker is not null")
def entities(spark, d):
    s = table(spark, d, "signals").where("title is not null and ticker is not null")
    made = F.concat("title", F.lit(" &amp; &lt;"), "ticker", F.lit("&gt; &ndash; &eacute; &#38; &#x20ac; &nope; &#65;"))
    return s.select("signal_id", text.decode_entities(made).alias("said"))


@query("q101_names_of_files", "select o_orderkey, '0001-' || o_orderkey as accession, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%m%d%Y') as stem from orders")
def names_of_files(spark, d):
    o = table(spark, d, "orders")
    k, stem = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "MMddyyyy")
    path = F.concat(F.lit("/data/"), stem, F.lit(".NASDAQ_ITCH50.gz"))
    return o.select("o_orderkey", urls.accession(F.concat(F.lit("edgar/data/7/0001-"), k, F.lit(".txt"))).alias("accession"), urls.session_name_date(path).alias("day"), urls.date_session_name(urls.session_name_date(path)).alias("stem"))


@query("q132_json_values", "select signal_id, signal_id * 1000000007 * 100003 + 1 as big, title as said, case when signal_id % 2 = 0 then score end as maybe, null::bigint as wrong from signals")
def json_values(spark, d):
    """Large integers, quoted text, missing and ill-typed values, at nested paths."""
    s = table(spark, d, "signals")
    # Written exactly beyond 64 bits too; such a number is no bigint when read.
    big = F.col("signal_id").cast("decimal(20,0)") * F.lit(1000000007 * 100003).cast("decimal(17,0)") + 1
    doc = F.to_json(F.struct(F.struct(big.alias("n"), F.array("title").alias("s")).alias("a"), F.when(F.col("signal_id") % 2 == 0, F.col("score")).alias("m"), F.lit("x1").alias("w")))
    get = lambda path, kind="string": text.json_value(doc, path, kind)
    return s.select("signal_id", get("$.a.n", "bigint").alias("big"), get("$.a.s[0]").alias("said"), get("$.m", "int").alias("maybe"), get("$.w", "bigint").alias("wrong"))


@query("q102_mixed_ids", "select count(*) as n, true as apart from signals")
def mixed_ids(spark, d):
    """Distinct longs have distinct mixes, equal ones equal mixes."""
    s = table(spark, d, "signals").select("signal_id", text.mixed(F.col("signal_id")).alias("m"))
    per = s.groupBy("m").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("n"), (F.max("k") == 1).alias("apart"))


# ---- market ------------------------------------------------------------------------------------

DAY_BARS = f"(select ticker, ts_ns - ts_ns % 60000000000 as minute_ns, arg_max(px_e4, (ts_ns, print_id)) as close_e4, cast(sum(shares) as bigint) as volume from {PRINTS} where {DAY} = date '2026-03-05' group by all)"
ASKED = "(select signal_id, ticker, t_news_recv_ns - t_news_recv_ns % 60000000000 as at from signals where ticker is not null and t_news_recv_ns is not null)"


def _day_bars(spark, d):
    return market.minute_bars(tape(spark, d).where(times.eastern_date(F.col("ts_ns")) == F.lit("2026-03-05").cast("date")))


def _asked(spark, d):
    return stories(spark, d).where("ticker is not null").select("signal_id", "ticker", F.expr("t_news_recv_ns - pmod(t_news_recv_ns, 60000000000L)").alias("at"))


@query("q103_since_minute", f"select a.signal_id, a.ticker, a.at, cast(coalesce(sum(b.volume), 0) as bigint) as volume_since from {ASKED} a left join {DAY_BARS} b on a.ticker = b.ticker and b.minute_ns >= a.at group by all")
def since_minute(spark, d):
    return market.since_minute(_day_bars(spark, d), _asked(spark, d), from_ns="at")


@query("q104_price_at_minute", f"select a.signal_id, a.ticker, a.at, coalesce(arg_max(b.close_e4, b.minute_ns), 0) as price_e4 from {ASKED} a left join {DAY_BARS} b on a.ticker = b.ticker and b.minute_ns <= a.at group by all")
def price_at_minute(spark, d):
    return market.price_at_minute(_day_bars(spark, d), _asked(spark, d), at_ns="at")


@query(
    "q105_rvol_so_far",
    f"""with s as {SESSION}, a as (select ticker, avg(volume) as adv from s group by 1), v as (select print_id, ticker, {MIN} as m, {DAY} as day, sum(shares) over (partition by ticker, {DAY} order by ts_ns, print_id) as sofar from {PRINTS}),
    f as (select v.*, adv, case when m < 240 then 0.0::double when m < 570 then 0.04::double * (m - 240) / 330.0::double when m >= 1200 then 1.0::double when m >= 960 then 0.96::double + 0.04::double * (m - 960) / 240.0::double
      else 0.04::double + 0.92::double * (c[i + 1] + (c[least(i + 2, 14)] - c[i + 1]) * ((m - 570) / 30.0::double - i)) end as frac from (select *, cast(floor((m - 570) / 30.0) as int) as i, [0, 0.13, 0.22, 0.29, 0.35, 0.40, 0.45, 0.49, 0.53, 0.58, 0.63, 0.69, 0.78, 1]::double[] as c from v) v join a using (ticker))
    select print_id, round(sofar / greatest(adv * frac, adv * 0.002), 6) as rvol from f""",
)
def rvol_so_far(spark, d):
    """Volume of the day up to each print over what is usual by then."""
    p = tape(spark, d).withColumn("day", times.eastern_date(F.col("ts_ns")))
    adv = market.session_rollup(tape(spark, d)).groupBy("ticker").agg(F.avg("volume").alias("adv"))
    x = ordered.with_running_sum(p, keys=["ticker", "day"], time="ts_ns", tie=["print_id"], value=F.col("shares").cast("bigint"), name="sofar").join(adv, "ticker")
    return x.select("print_id", F.round(market.rvol(F.col("sofar"), F.col("adv"), times.eastern_minute(F.col("ts_ns"))), 6).alias("rvol"))


@query(
    "q106_merged_by_time",
    f"""with m as (select ticker, t_news_recv_ns as time, 'story' as kind, signal_id as id, 0 as r from signals where ticker is not null and t_news_recv_ns is not null union all select ticker, ts_ns, 'print', print_id, 1 from {PRINTS})
    select ticker, time, kind, id, count(*) filter (r = 0) over (partition by ticker order by time, r, id) as stories from m""",
)
def merged_by_time(spark, d):
    """Stories and prints in one order, with how many stories of the ticker came by then."""
    m = ordered.merged_by_time({"story": (stories(spark, d).where("ticker is not null"), "t_news_recv_ns", "signal_id"), "print": (tape(spark, d), "ts_ns", "print_id")}, keys=["ticker"])
    x = m.withColumn("r", F.when(F.col("kind") == "story", 0).otherwise(1))
    return ordered.with_running_sum(x, keys=["ticker"], time="time", tie=["r", "id"], value=(1 - F.col("r")).cast("bigint"), name="stories").drop("r")


@query(
    "q131_crosses",
    f"""with t as (select *, {DAY} as day, {MIN} as m, case when print_id % 7 = 0 then 'O' when print_id % 11 = 0 then 'C' end as x from {PRINTS}),
    s as (select ticker, day, coalesce(arg_max(px_e4, (ts_ns, print_id)) filter (x = 'O'), arg_min(px_e4, (ts_ns, print_id)) filter (m between 570 and 959)) as open_e4, arg_max(px_e4, (ts_ns, print_id)) filter (x = 'C') as close_e4, arg_max(px_e4, (ts_ns, print_id)) filter (m between 570 and 959) as r, arg_max(px_e4, (ts_ns, print_id)) as l from t group by all)
    select ticker, day, open_e4, close_e4, coalesce(close_e4, r, l) as last_price_e4 from s""",
    dates=("day",),
)
def crosses(spark, d):
    """Some prints taken as opening and closing crosses."""
    t = tape(spark, d).withColumn("x", F.when(F.col("print_id") % 7 == 0, "O").when(F.col("print_id") % 11 == 0, "C"))
    s = market.session_rollup(t, cross="x")
    return s.select("ticker", "day", "open_e4", "close_e4", market.closing_price(s).alias("last_price_e4"))


# ---- stories and their securities --------------------------------------------------------------

TAGGED = "(select signal_id, ticker, case signal_id % 4 when 0 then ['NASDAQ: ' || ticker] when 1 then ['NYSE: ' || ticker, 'TSX: ' || ticker] when 2 then ['OTC: ZZZZQ', 'NYSE: ' || lower(ticker)] else [] end as tags from signals where ticker is not null)"


def _tagged(spark, d):
    s = table(spark, d, "signals").where("ticker is not null")
    t = lambda kind, venue, symbol: F.struct(F.lit(kind).alias("venue_class"), F.lit(venue).alias("venue"), symbol.alias("symbol"))
    tick, k = F.col("ticker"), F.col("signal_id") % 4
    none = F.array().cast("array<struct<venue_class:string,venue:string,symbol:string>>")
    return s.select("signal_id", "ticker", F.when(k == 0, F.array(t("US", "NASDAQ", tick))).when(k == 1, F.array(t("US", "NYSE", tick), t("Foreign", "TSX", tick))).when(k == 2, F.array(t("OTC", "OTC", F.lit("ZZZZQ")), t("US", "NYSE", F.lower(tick)))).otherwise(none).alias("tags"))


@query(
    "q107_resolved_tags",
    """select signal_id, case when k in (0, 1, 2) and known then ticker else '' end as tickers, case k when 0 then case when known then '' else ticker end when 1 then case when known then '' else ticker || ',' end || 'TSX:' || ticker when 2 then 'OTC:ZZZZQ' || case when known then '' else ',' || lower(ticker) end else '' end as unresolved
    from (select signal_id, ticker, signal_id % 4 as k, ticker in (select ticker from symbol_info where ticker is not null and version_id % 3 <> 0) as known from signals where ticker is not null)""",
)
def resolved_tags(spark, d):
    master = table(spark, d, "symbol_info").where("version_id % 3 <> 0")
    r = stories_ops.resolve_tags(_tagged(spark, d), master, id_col="signal_id")
    return r.select("signal_id", F.concat_ws(",", "tickers").alias("tickers"), F.concat_ws(",", "unresolved").alias("unresolved"))


UNIQUE = f"""(select company, min(ticker) as ticker from (select ticker, cik, {COMPANY.format('security_name')} as company from {MASTER}) where length(company) >= 4 group by company having count(*) = 1 or (count(cik) = count(*) and min(cik) = max(cik)))"""
NAMED = f"(select version_id, security_name, lag(security_name) over (order by version_id) as other from symbol_info where security_name is not null)"


@query(
    "q108_named_companies",
    f"""select version_id, coalesce(b.ticker, c.ticker) as ticker from (select version_id, {COMPANY.format('security_name')} as n1, {COMPANY.format("'No Such Firm' || version_id")} as n0, security_name from symbol_info where security_name is not null) a
    left join {UNIQUE} b on b.company = n0 left join {UNIQUE} c on c.company = n1 where coalesce(b.ticker, c.ticker) is not null""",
)
def named_companies(spark, d):
    """A contributor that nobody knows, then the subject of the lead sentence."""
    i = table(spark, d, "symbol_info").where("security_name is not null")
    lead = F.concat(F.lit("TOWN -- "), F.regexp_replace("security_name", "[(]", "["), F.lit(" today announced a thing"))
    c = i.select("version_id", stories_ops.name_candidates(F.array(F.concat(F.lit("No Such Firm"), F.col("version_id").cast("string"))), F.lit(None).cast("string"), lead).alias("candidates"))
    uniq = reference.unique_names(_master(spark, d), issuer="cik", symbol="ticker", name="security_name")
    return stories_ops.resolve_names(c, uniq, id_col="version_id")


@query("q109_not_yet_alerted", "select distinct ticker, cast(make_timestamp(t_signal_ns // 1000) as date) as day from signals s where ticker is not null and t_signal_ns is not null and tier = 'WATCH' and not exists (select 1 from signals a where a.tier in ('ALERT', 'HIGH') and a.ticker = s.ticker and a.t_signal_ns // 86400000000000 = s.t_signal_ns // 86400000000000)", dates=("day",))
def not_yet_alerted(spark, d):
    s = table(spark, d, "signals").where("ticker is not null and t_signal_ns is not null").select("ticker", "tier", F.to_date(times.utc(F.col("t_signal_ns"))).alias("day"))
    return s.where("tier = 'WATCH'").select("ticker", "day").distinct().join(s.where("tier in ('ALERT', 'HIGH')").select("ticker", "day").distinct(), ["ticker", "day"], "left_anti")


RULES = [("cat", "order", 50, "purchase order"), ("cat", "deal", 60, "supply agreement"), ("cat", "trial", 70, "primary endpoint"), ("hedge", None, -4, "forward looking"), ("hedge", None, -5, "who is holding"), ("spec", None, 6, "million"), ("spec", None, 12, "gross margin"), ("tier1", None, 9, "fast track designation"), ("nonbinding", None, -8, "today announced")]
RULES_SQL = ", ".join(f"({i}, '{k}', {repr(lab) if lab else 'null'}, {w}, ' {p} ', {len(p)})" for i, (k, lab, w, p) in enumerate(RULES))


@query(
    "q110_rule_totals",
    f"""with r(rule, kind, label, weight, p, len) as (values {RULES_SQL}), t as (select doc_id, {PADDED.replace('text', 'left(text, 120)')} as title, {PADDED.replace('text', 'substr(text, 121)')} as body from documents where text is not null),
    h as (select doc_id, r.*, true as in_title, strpos(title, p) + length(p) - 2 as e from t, r where contains(title, p) union all select doc_id, r.*, false, strpos(body, p) + length(p) - 2 from t, r where contains(body, p)),
    best as (select doc_id, arg_max(label, (weight + case when in_title then 5 else 0 end, in_title, -e, len, -rule)) as category, max(weight + case when in_title then 5 else 0 end) as category_weight from h where kind = 'cat' group by 1),
    per as (select doc_id, kind, rule, max(weight) as weight from h group by all)
    select p.doc_id, b.category, coalesce(any_value(b.category_weight), 0) as category_weight, count(*) as n_rules, cast(greatest(least(coalesce(sum(weight) filter (kind = 'hedge'), 0), 0), -8) as bigint) as hedge, cast(greatest(least(coalesce(sum(weight) filter (kind = 'spec'), 0), 15), 0) as bigint) as spec,
    coalesce(max(weight) filter (kind = 'tier1'), 0) as tier1, coalesce(min(weight) filter (kind = 'nonbinding'), 0) as nonbinding from per p left join best b using (doc_id) group by p.doc_id, b.category""",
)
def rule_totals(spark, d):
    """The first 120 characters count as title."""
    docs = table(spark, d, "documents").where("text is not null")
    hit = lambda c: phrases.match_phrases(docs.select("doc_id", c.alias("t")), [r[3] for r in RULES], id_col="doc_id", text_col="t")
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_id int, kind string, label string, weight int, phrase string")
    return stories_ops.rule_totals(hit(F.substring("text", 1, 120)), hit(F.expr("substring(text, 121)")), rules, id_col="doc_id", sums={"hedge": (-8, 0), "spec": (0, 15)}, extremes={"tier1": "max", "nonbinding": "min"})


@query("q111_rules_file", f"with r(rule, kind, label, weight, p, len) as (values {RULES_SQL}) select kind, label, weight, trim(p) as phrase from r")
def rules_file(spark, d):
    from newsloom.sources.landing import land_lines

    lines = ["# kind, weight, phrase", ""] + [f"{k}{':' + lab if lab else ''}\t{w}\t{p}" for k, lab, w, p in RULES]
    at = land_lines(spark.createDataFrame([(x,) for x in lines], "value string"), scratch(spark, "rules"))
    return phrases.read_rules(spark, at).drop("rule_id")


@query(
    "q112_replayed",
    """select signal_id as id, greatest(t_news_recv_ns + 5000000000, 0) as recv_ns, case when known then ticker else '' end as tickers, case when ticker is not null and not known then 1 else 0 end + 1 as n_dropped
    from (select *, coalesce(ticker in (select ticker from symbol_info where ticker is not null and version_id % 3 <> 0), false) as known from signals where t_news_recv_ns > 0)""",
)
def replayed(spark, d):
    """Recorded stories with one ticker that nobody knows and one that the master may know, five seconds later."""
    s = table(spark, d, "signals").where("t_news_recv_ns is not null").select(F.col("signal_id").alias("id"), F.col("t_news_recv_ns").alias("recv_ns"), F.array_compact(F.array(F.lit("??"), "ticker")).alias("tickers"))
    r = stories_ops.replayed(s, table(spark, d, "symbol_info").where("ticker is not null and version_id % 3 <> 0"), delay_ns=5 * S)
    return r.select("id", "recv_ns", F.concat_ws(",", "tickers").alias("tickers"), "n_dropped")


@query("q113_issuer_tickers", f"""with m as (select ticker, cik, first_id, coalesce(exchange <> 'OTC', false) as listed, coalesce(regexp_matches(security_name, '(?i)(^|[^A-Za-z])(warrants?|units?|rights?)([^A-Za-z]|$)'), false) as derived from {MASTER} where cik is not null),
    r as (select *, row_number() over (partition by cik order by listed desc, derived, length(ticker), first_id, ticker) as r from m), o as (select *, row_number() over (partition by cik order by r > 1, first_id, ticker) as k from r)
    select f.cik, coalesce(string_agg(ticker, ',' order by k), '') as tickers from (select distinct cik from m union select distinct -c_custkey from customer) f left join o using (cik) group by 1""")
def issuer_tickers(spark, d):
    """All securities of an issuer, its primary one first; unknown issuers have none."""
    m = _master(spark, d)
    filings = m.where("cik is not null").select("cik").distinct().unionByName(table(spark, d, "customer").select((-F.col("c_custkey")).cast("bigint").alias("cik")))
    master = m.select("cik", "ticker", "security_name", F.coalesce(F.col("exchange") != "OTC", F.lit(False)).alias("listed"), F.col("first_id").alias("load_order"))
    return feeds.with_issuer_tickers(filings, master).select("cik", F.concat_ws(",", "tickers").alias("tickers"))


@query(
    "q114_flags_as_received",
    f"""select a.cik, a.day, a.at, cast(coalesce(bit_or(w.bit) filter (f.day < a.day or f.recv <= a.at), 0) as bigint) as flags from (select distinct cik, day, 43200::bigint as at from {FILINGS}) a
    left join ((select *, (cik * 7919 + items) % 86400 as recv from {FILINGS}) f join (values {', '.join(f"('{k}', {n}, {b})" for k, (n, b) in WINDOWS.items())}) w(kind, n, bit) on f.kind = w.kind) on f.cik = a.cik and date_diff('day', f.day, a.day) between 0 and w.n group by all""",
    dates=("day",),
)
def flags_as_received(spark, d):
    """Filings of the day itself count from when they came."""
    f = _filings(spark, d).withColumn("recv", ((F.col("cik") * 7919 + F.col("items")) % 86400).cast("bigint"))
    asked = f.select("cik", "day").distinct().withColumn("at", F.lit(43200).cast("bigint"))
    return reference.flags_in_window(asked, f, key="cik", asked_day="day", day="day", kind="kind", windows=WINDOWS, asked_ns="at", received_ns="recv")


# ---- journals' counters and the report ---------------------------------------------------------


def _report(spark, d):
    seen = _seen(spark, d).join(table(spark, d, "signals").select("signal_id", "catalyst", "ticker", "score"), "signal_id")
    curve = _equity(spark, d, ["tier"])
    return journal.report(seen, table(spark, d, "outcomes"), curve, publish_lag=F.when(F.col("published_ns") > 0, (F.col("t") - F.col("published_ns")) / 1e6), stages={"with_ticker": F.col("ticker").isNotNull(), "scored": F.col("score") >= 55})


@query(
    "q115_outcomes_by_score",
    """with o as (select *, case when score >= 85 then '85+' when score >= 75 then '75-84' when score >= 65 then '65-74' when score >= 55 then '55-64' when score is not null then '<55' end as score_bucket from outcomes where horizon_s in (300, 1800))
    select catalyst, horizon_s, score_bucket, count(*) as n, round(avg(move_pct), 6) as mean_move, round(median(move_pct), 6) as median_move, round(100.0 * count(*) filter (move_pct > 0) / count(*), 6) as up_pct, round(avg(max_move_pct), 6) as mean_mfe, round(avg(min_move_pct), 6) as mean_mae
    from o group by grouping sets ((horizon_s, catalyst), (horizon_s, score_bucket))""",
)
def outcomes_by_score(spark, d):
    return _report(spark, d)["outcomes_by_kind"]


@query("q116_report_funnel", f"select catalyst, count(*) as stories, count(*) filter (ticker is not null) as with_ticker, count(*) filter (score >= 55) as scored from signals where t_news_recv_ns is not null group by catalyst")
def report_funnel(spark, d):
    return _report(spark, d)["funnel"]


@query("q117_source_counters", "select src, count(*) as items, count(distinct news_id) filter (score >= 55) as scored, count(distinct news_id) filter (ticker is not null) as with_ticker from signals where news_id is not null group by src")
def source_counters(spark, d):
    return journal.source_counters(table(spark, d, "signals").where("news_id is not null"), source="src", id_col="news_id", stages={"scored": F.col("score") >= 55, "with_ticker": F.col("ticker").isNotNull()})


@query(
    "q118_day_results",
    f"""select coalesce(a.day, b.day) as day, coalesce(signals, 0) as signals, coalesce(alerts, 0) as alerts, coalesce(closed, 0) as closed, cast(coalesce(pnl, 0) as bigint) as pnl from (select cast(o_orderdate as date) as day, count(*) as signals, count(*) filter (o_orderstatus in ('F', 'P')) as alerts from orders group by 1) a
    full join (select day, count(*) as closed, sum(pnl) as pnl from {TRADES} group by 1) b on a.day = b.day""",
    dates=("day",),
)
def day_results(spark, d):
    s = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("tier"))
    return journal.day_results(_trades(spark, d), s, day="day", pnl="pnl", tier="tier", alerting=["F", "P"])


# ---- streams, run over files of the tables until nothing is left -------------------------------


def _files(spark: SparkSession, df: DataFrame, order: str, parts: int = 3) -> DataFrame:
    """A stream over a table that was written in files of ascending ``order``; a file to a micro-batch, the first first."""
    at = scratch(spark, "landed")
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order)))
    for i in range(parts):  # a stream takes files by age
        df.where(part == i).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _drained(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    at = scratch(spark, name)
    df.writeStream.format("parquet").option("path", at).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(at)


def _received(spark, d):
    return table(spark, d, "signals").where("t_news_recv_ns is not null")


@query("q119_deduplicated_stream", "select distinct news_id from signals where news_id is not null and t_news_recv_ns is not null")
def deduplicated_stream(spark, d):
    s = _received(spark, d).where("news_id is not null").select("news_id", "t_news_recv_ns")
    return _drained(folds.deduplicated_stream(_files(spark, s, "t_news_recv_ns"), keys=["news_id"], time_ns="t_news_recv_ns", horizon="90 days"), "deduplicated").select("news_id")


@query("q120_first_seen_stream", f"select signal_id, dup, first_src, behind_ns from {SEEN} where signal_id in (select signal_id from signals where title is not null)")
def first_seen_stream(spark, d):
    s = _received(spark, d).where("title is not null").select("signal_id", "src", F.col("t_news_recv_ns").alias("t"), text.headline_key(F.col("title")).alias("k"))
    return _drained(folds.first_seen_stream(_files(spark, s, "t"), key="k", time="t", id_col="signal_id", source="src"), "seen")


@query(
    "q121_late_stream",
    f"""with s as (select src, published_ns - published_ns % {HOUR} as period_ns, news_id, min(t_news_recv_ns) as t from signals where src is not null and news_id is not null and t_news_recv_ns is not null and published_ns <> 0 group by all)
    select src, period_ns, count(*) as n_stories from s where t < period_ns + {7 * HOUR} group by all""",
)
def late_stream(spark, d):
    """Problem 2 as a stream: the last number of each period."""
    span = dict(window_ns=HOUR, lateness_ns=6 * HOUR)
    s = _received(spark, d).select("src", "news_id", "published_ns", "t_news_recv_ns")
    at = scratch(spark, "late")
    partials = late_panes.pane_counts(_files(spark, s, "t_news_recv_ns"), source="src", story="news_id", event_time="published_ns", arrival="t_news_recv_ns", **span)
    late_panes.start_corrections(partials, store=f"{at}/store", emitted=f"{at}/out", checkpoint=f"{at}/checkpoint", **span).awaitTermination()
    w = late_panes.compose(late_panes.latest_panes(spark.read.parquet(f"{at}/store/days")), Slices(**span))
    return w.groupBy("src", "period_ns").agg(F.max("n_stories").alias("n_stories"))


@query("q122_packets_in_order", "select l_suppkey as k, cast(sum(n) as bigint) as numbers, cast(sum(lost) as bigint) as lost from (select l_suppkey, least(c, q + c - coalesce(seen, q)) as n, greatest(q - coalesce(seen, q), 0) as lost from (select l_suppkey, q, c, max(q + c) over (partition by l_suppkey order by q, c rows between unbounded preceding and 1 preceding) as seen from (select distinct l_suppkey, l_orderkey * 2 as q, l_linenumber as c from lineitem)) where q + c > coalesce(seen, 0)) group by 1")
def packets_in_order(spark, d):
    """Packets come a little out of order; what is missing is given up. In the end each key's numbers are the batch's."""
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 2).cast("bigint").alias("q"), F.col("l_linenumber").cast("bigint").alias("c"))
    first = li.groupBy("l_suppkey").agg(F.min("q").alias("q0"))
    # A millisecond to a number; those after the first come up to a tenth of a second early or late.
    moved = F.when(F.col("q") == F.col("q0"), F.lit(-100)).otherwise(F.pmod(F.xxhash64("q", "c"), F.lit(200)) - 100)
    p = li.join(first, "l_suppkey").select("l_suppkey", "q", "c", ((F.col("q") + 1000 + moved) * 1_000_000).alias("t"), F.concat_ws("-", "q", "c").alias("payload"))
    end = li.groupBy("l_suppkey").agg(F.max("q").alias("q")).select("l_suppkey", F.col("q"), F.lit(0).cast("bigint").alias("c"), F.lit(10**9 * 86400 * 30).alias("t"), F.lit("end").alias("payload"))
    got = _drained(timers.packets_in_order(_files(spark, p.unionByName(end), "t"), key="l_suppkey", seq="q", count="c", time_ns="t", payload="payload", timeout_ns=250 * 1_000_000), "packets")
    return got.groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("n").alias("numbers"), F.sum("lost").alias("lost"))


@query(
    "q123_horizon_stream",
    f"""select s.signal_id, s.h as horizon_ns, cast(p.px_e4 as bigint) as px_e4 from (select signal_id, ticker, h, t_news_recv_ns + h as t from signals, (values ({60 * S}::bigint), ({300 * S}::bigint)) v(h) where t_news_recv_ns is not null and ticker is not null) s
    asof left join (select ticker, ts_ns, max_by(px_e4, print_id) as px_e4 from {PRINTS} group by all) p on s.ticker = p.ticker and s.t > p.ts_ns where s.t < (select max(t) from (select max(ts_ns) as t from {PRINTS} union all select max(t_news_recv_ns) from signals)) - {1 * S}""",
)
def horizon_stream(spark, d):
    """Outcomes as their horizons pass; those still open at the end are not given."""
    t = tape(spark, d).select("ticker", "ts_ns", "print_id", "px_e4")
    s = _received(spark, d).where("ticker is not null").select("signal_id", "ticker", "t_news_recv_ns")
    both = s.withColumn("at", F.col("t_news_recv_ns")).unionByName(t.withColumn("at", F.col("ts_ns")), allowMissingColumns=True)
    x = _files(spark, both, "at")
    return _drained(
        timers.horizon_outcomes(x.where("signal_id is not null").select("signal_id", "ticker", "t_news_recv_ns"), x.where("print_id is not null").select("ticker", "ts_ns", "print_id", "px_e4"), key="ticker", id_col="signal_id", time_ns="t_news_recv_ns", print_ns="ts_ns", print_id="print_id", price="px_e4", horizons_ns=[60 * S, 300 * S]), "outcomes"
    )
