"""Queries of readers, writers and decoders: files are made of the driver's tables, read back, and compared with the tables.

Every file has all rows that its table has for it. Files lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import names, text, times
from newsloom.operators import book, market
from newsloom.plans.catalog import DAY, ET, HOUR, MASTER, MIN, S, _master, query
from newsloom.runtime import scratch, shuffle_partitions, stored, table
from newsloom.sources import alerts, feeds, journal_files, landing, market_files, packets, polling, reference_files

WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SYMBOL = f"translate(upper(trim({{0}}, {WS})), '-/ ', '...')"


def _pick(values: list, by: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))


def _sql_pick(values: list, by: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{by} % {len(values)} + 1]"


# ---- directories and reference files -----------------------------------------------------------

LISTED = "(select * from symbol_snapshots where ticker is not null and trim(ticker) <> '' and not regexp_matches(lower(ticker), '^\\s*file creation time'))"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbol_snapshots").where("trim(ticker) <> '' and not ticker rlike '(?i)^\\\\s*file creation time'")


@query(
    "q63_nasdaq_directory",
    f"""select {SYMBOL.format('ticker')} as ticker, nullif(trim(security_name, {WS}), '') as security_name, {_sql_pick(['Nasdaq GS', 'Nasdaq GM', 'Nasdaq CM', '?'], 'row_id')} as exchange, nullif(trim(financial_status, {WS}), '') as financial_status,
    round_lot, coalesce(etf, false) as etf, coalesce(test_issue, false) as test_issue from {LISTED}""",
)
def nasdaq_directory(spark, d):
    yes = lambda c: F.when(F.col(c), "Y").otherwise("N")
    s = _snapshots(spark, d).select(
        F.col("ticker").alias("Symbol"), F.col("security_name").alias("Security Name"), _pick(["Q", "G", "S", "X"], "row_id").alias("Market Category"), yes("test_issue").alias("Test Issue"),
        F.col("financial_status").alias("Financial Status"), F.col("round_lot").alias("Round Lot Size"), yes("etf").alias("ETF"), F.lit("N").alias("NextShares"),
    )
    footer = spark.range(1).select(F.lit("File Creation Time: 0310202621:31").alias("Symbol"))
    at = landing.land_table(s.unionByName(footer, allowMissingColumns=True), scratch(spark, "directory"), "|")
    r = reference_files.nasdaq_listed(spark, at)
    return r.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("security_name", "financial_status")})


@query(
    "q64_other_directory",
    f"""select {SYMBOL.format('ticker')} as ticker, unnest(list_distinct([{SYMBOL.format('ticker')}, {SYMBOL.format("ticker || (case when row_id % 2 = 0 then '/W' else '' end)")}])) as alias,
    {_sql_pick(['NYSE', 'NYSE American', 'NYSE Arca', 'Cboe BZX', 'IEX', '?'], 'row_id')} as exchange, round_lot, coalesce(etf, false) as etf from {LISTED}""",
)
def other_directory(spark, d):
    yes = lambda c: F.when(F.col(c), "Y").otherwise("N")
    s = _snapshots(spark, d).select(
        F.col("ticker").alias("ACT Symbol"), F.col("security_name").alias("Security Name"), _pick(["N", "A", "P", "Z", "V", "?"], "row_id").alias("Exchange"), F.concat("ticker", F.when(F.col("row_id") % 2 == 0, "/W").otherwise("")).alias("CQS Symbol"),
        yes("etf").alias("ETF"), F.col("round_lot").alias("Round Lot Size"), yes("test_issue").alias("Test Issue"), F.concat(F.lit(" "), "ticker").alias("NASDAQ Symbol"),
    )
    return reference_files.other_listed(spark, landing.land_table(s, scratch(spark, "other"), "|")).select("ticker", "alias", "exchange", "round_lot", "etf")


@query("q65_issuer_map", f"select cik, ticker, security_name, exchange from {MASTER} where cik is not null")
def issuer_map(spark, d):
    """Documents with their columns in either order."""
    m = _master(spark, d).where("cik is not null").select(F.col("cik").cast("string").alias("cik"), "security_name", "ticker", "exchange")
    one = lambda cols, keys: F.to_json(F.struct(F.array(*map(F.lit, keys)).alias("fields"), F.array(F.array(*cols)).alias("data")))
    value = F.when(F.col("cik") % 2 == 0, one(["cik", "security_name", "ticker", "exchange"], ["cik", "name", "ticker", "exchange"])).otherwise(one(["exchange", "ticker", "cik", "security_name"], ["exchange", "ticker", "cik", "name"]))
    at = landing.land_lines(m.select(value.alias("value")), scratch(spark, "issuers"))
    return reference_files.issuer_rows(spark.read.text(at))


FACTS = "(select cik, shares_outstanding as s, adv20 as f from symbol_info where cik is not null and (shares_outstanding is not null or adv20 is not null))"


@query(
    "q66_fundamentals",
    f"select m.ticker, m.cik, f.shares_outstanding, f.public_float_usd from {MASTER} m left join (select cik, max(s) filter (s > 0) as shares_outstanding, max(f) filter (f > 0) as public_float_usd from {FACTS} group by 1) f using (cik)",
)
def fundamentals(spark, d):
    i = table(spark, d, "symbol_info").where("cik is not null and (shares_outstanding is not null or adv20 is not null)")
    at = landing.land_table(i.select("cik", "shares_outstanding", F.lit("2026-03-01").alias("a"), "adv20", F.lit("2026-03-01").alias("b")), scratch(spark, "facts"), "\t", header=False)
    return reference_files.with_fundamentals(_master(spark, d), reference_files.fundamentals(spark, at)).select("ticker", "cik", "shares_outstanding", "public_float_usd")


@query("q67_baseline_file", f"select {SYMBOL.format('ticker')} as ticker, prev_close, adv20 as adv, 20 as days from symbol_info where ticker is not null and (prev_close is not null or adv20 is not null)")
def baseline_file(spark, d):
    i = table(spark, d, "symbol_info").where("ticker is not null")
    at = landing.land_table(i.select("ticker", "prev_close", "adv20", F.lit(20).alias("n"), F.lit("2026-03-01").alias("a")), scratch(spark, "baseline"), "\t", header=False)
    return reference_files.baselines(spark, at).select("ticker", "prev_close", "adv", "days")


@query(
    "q68_short_volume",
    "select ticker, strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') as date, round(sum(shares) filter (print_id % 3 = 0) / sum(shares), 9) as short_ratio from tape where ticker is not null and ts_ns is not null group by 1, 2 having sum(shares) filter (print_id % 3 = 0) > 0",
)
def short_volume(spark, d):
    t = table(spark, d, "tape").where("ticker is not null and ts_ns is not null")
    day = F.date_format(times.utc(F.col("ts_ns")), "yyyyMMdd")
    v = t.groupBy(day.alias("Date"), F.col("ticker").alias("Symbol")).agg(F.sum(F.when(F.col("print_id") % 3 == 0, F.col("shares"))).alias("ShortVolume"), F.lit(0).alias("ShortExemptVolume"), F.sum("shares").alias("TotalVolume"), F.lit("Q").alias("Market"))
    r = reference_files.short_volume(spark, landing.land_table(v, scratch(spark, "short"), "|"))
    return r.where("short_ratio is not null").withColumn("short_ratio", F.round("short_ratio", 9))


FORMS = ["S-1", "F-3/A", "424B5", "EFFECT", "PRE 14A", "DEF 14A", "S-8", "8-K", "6-K/A", "10-Q", "10-K", "20-F", "SC 13G", "F-1MEF", "NT 20-F"]
KEPT = ["s1", "s3", "424b", "effect", "pre14", None, None, "8k", "6k", None, None, None, None, "s1", "nt"]
KEPT_SQL = "[" + ", ".join("null" if k is None else f"'{k}'" for k in KEPT) + f"][o_orderkey % {len(KEPT)} + 1]"
INDEX = f"(select o_custkey as cik, 'Firm ' || o_custkey as company, {_sql_pick(FORMS, 'o_orderkey')} as form, {KEPT_SQL} as cls, cast(o_orderdate as date) as day, 'edgar/data/' || o_custkey || '/' || o_orderkey || '.txt' as file from orders)"


def _index(spark, d):
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.concat_ws("|", F.col("o_custkey").cast("string"), F.concat(F.lit("Firm "), F.col("o_custkey").cast("string")), _pick(FORMS, "o_orderkey"), day, F.concat_ws("/", F.lit("edgar/data"), F.col("o_custkey").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt"))))
    head = spark.createDataFrame([("Description: Daily Index",), ("CIK|Company Name|Form Type|Date Filed|File Name",), ("-" * 80,), ("",)], "value string")
    at = landing.land_lines(head.unionByName(o.select(line.alias("value"))), scratch(spark, "index"), "gzip")
    return reference_files.master_index(spark, at)


@query("q69_master_index", f"select cik, company, form, cls, day, file from {INDEX} where cls is not null", dates=("day",))
def master_index(spark, d):
    return _index(spark, d)


@query("q70_candidates", f"select cls, count(*) as n from {INDEX} where cls in ('8k', '6k', 's3') and cik in (select c_custkey from customer where c_acctbal > 0) group by cls")
def candidates(spark, d):
    listed = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cik"))
    return reference_files.candidates(_index(spark, d), listed, ["8k", "6k", "s3"]).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("q71_filings_file", f"select cik, day, cls, cast(bit_or(1 << cast(day_n % 30 as int)) as bigint) as items from (select *, datediff('day', date '1970-01-01', day) as day_n from {INDEX}) where cls is not null group by all", dates=("day",))
def filings_file(spark, d):
    """Written, merged and read again."""
    from newsloom.operators.reference import merge_filings

    f = _index(spark, d).withColumn("items", F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.unix_date("day") % 30).cast("int")))
    at = scratch(spark, "filings")
    reference_files.write_filings(merge_filings(f, key="cik", day="day", kind="cls", items="items"), at)
    return reference_files.read_filings(spark, at)


FRAME = "(select o_custkey as cik, round(o_totalprice) as val, cast(o_orderdate as date) as dd, o_orderkey as k from orders)"


@query(
    "q72_frames",
    f"""select coalesce(a.cik, b.cik) as cik, a.v as shares_outstanding, a.d as shares_asof, b.v as public_float_usd, b.d as float_asof from (select cik, arg_max(val, (dd, -k)) as v, max(dd) as d from {FRAME} where k % 3 = 0 group by 1) a
    full join (select cik, arg_max(val, (dd, -k)) as v, max(dd) as d from {FRAME} where k % 3 = 1 group by 1) b on a.cik = b.cik""",
    dates=("shares_asof", "float_asof"),
)
def frames(spark, d):
    o = table(spark, d, "orders")
    doc = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").alias("cik"), F.lit("x").alias("entityName"), F.round("o_totalprice").alias("val"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"))).alias("data")))
    part = lambda k: reference_files.frame_values(o.where(F.col("o_orderkey") % 3 == k).select(doc.alias("value"), F.col("o_orderkey").alias("k")), order="k")
    return reference_files.merged_facts(part(0), part(1))


# ---- journals ----------------------------------------------------------------------------------


@query(
    "q73_journal",
    f"""select signal_id % 1000 as score, ticker, tier, news_id, signal_ns, day from (select *, t_signal_ns as signal_ns, cast({ET.format('t_signal_ns')} as date) as day from signals where t_signal_ns is not null) where day between date '2026-03-03' and date '2026-03-08'""",
    dates=("day",),
)
def journal(spark, d):
    """Signals to day folders and back, some of the days."""
    s = table(spark, d, "signals").where("t_signal_ns is not null").select((F.col("signal_id") % 1000).cast("int").alias("score"), "ticker", "tier", "news_id", F.col("t_signal_ns").alias("signal_ns"), times.utc_iso(F.col("t_signal_ns")).alias("t"))
    at = scratch(spark, "journal")
    journal_files.write_journal(s, at, "signals", time_ns="signal_ns")
    return journal_files.read_journal(spark, at, "signals", "2026-03-03", "2026-03-08").select("score", "ticker", "tier", "news_id", "signal_ns", F.col("day").cast("date").alias("day"))


@query("q74_journal_rows", "select signal_id, printf('%016x', signal_id * 1000003) as id, strftime(make_timestamp(t_signal_ns // 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as t, news_id is not null as has_id from signals where t_signal_ns is not null")
def journal_rows(spark, d):
    """The journal's own form of ids and times."""
    s = table(spark, d, "signals").where("t_signal_ns is not null")
    line = F.to_json(F.struct("signal_id", text.hex_id(F.col("signal_id") * 1000003).alias("id"), times.utc_iso(F.col("t_signal_ns")).alias("t"), F.nullif(F.col("news_id"), F.lit("")).alias("news_id")))
    # A null field is left out of the line.
    return s.select(line.alias("l")).select(F.get_json_object("l", "$.signal_id").cast("bigint").alias("signal_id"), F.get_json_object("l", "$.id").alias("id"), F.get_json_object("l", "$.t").alias("t"), F.col("l").contains("news_id").alias("has_id"))


@query(
    "q75_session_store",
    f"select ticker, day, cast(sum(shares) as bigint) as volume from (select *, {DAY} as day from tape where ticker is not null and ts_ns is not null and printable and px_e4 > 0 and shares > 0) group by ticker, day having day <> date '2026-03-04' or ticker > 'M'",
    dates=("day",),
)
def session_store(spark, d):
    """All days stored, then one of them replaced."""
    s = market.session_rollup(market.prints(table(spark, d, "tape"))).select("ticker", "day", "volume")
    at = scratch(spark, "sessions")
    journal_files.store_sessions(s, at)
    journal_files.store_sessions(s.where("day = date '2026-03-04' and ticker > 'M'"), at)
    return spark.read.parquet(at).select("ticker", F.col("day").cast("date").alias("day"), "volume")


# ---- feeds and pages ---------------------------------------------------------------------------


def _xml(c):
    """Escaped for a document."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, value):
    return F.concat(F.lit(f"<{name}>"), F.coalesce(value, F.lit("")), F.lit(f"</{name}>"))


TITLED = "(select * from signals where regexp_replace(title, '[ \\t\\n\\r\\f\\x0B]+', '', 'g') <> '')"
PLAIN = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def _stories(spark, d):
    return table(spark, d, "signals").where("regexp_replace(title, '[ \\t\\n\\r\\f\\x0B]+', '') <> ''")


@query(
    "q76_rss_items",
    f"""select {PLAIN.format('title')} as title, coalesce(trim(link, {WS}), '') as link, published_ns // 1000000000 * 1000000000 as published_ns, 'Score of ' || coalesce(ticker, 'none') || ' is < ' || score as body from {TITLED}""",
)
def rss_items(spark, d):
    """Titles entity-encoded once, bodies as encoded markup, dates in one of two tags."""
    s = _stories(spark, d)
    at = F.date_format(times.utc(F.col("published_ns")), "EEE, dd MMM yyyy HH:mm:ss")
    date = F.when(F.col("signal_id") % 2 == 0, _tag("pubDate", F.concat(at, F.lit(" GMT")))).otherwise(_tag("dc:date", times.utc_iso(F.col("published_ns"))))
    body = F.concat(F.lit("<p>Score of <b>"), F.coalesce("ticker", F.lit("none")), F.lit("</b> is &lt; "), F.col("score").cast("string"), F.lit("</p>"))
    title = F.regexp_replace(F.col("title"), "[\\n\\r]", " ")
    item = F.concat(F.lit("<item>"), _tag("guid", F.col("signal_id").cast("string")), _tag("title", _xml(title)), _tag("link", _xml(F.regexp_replace("link", "[\\n\\r]", " "))), F.when(F.col("published_ns").isNotNull(), date).otherwise(""), _tag("description", _xml(body)), F.lit("</item>"))
    r = feeds.rss_items(spark, landing.land_documents(s.select(item.alias("value")), scratch(spark, "rss"), "<rss><channel>", "</channel></rss>"))
    return r.select("title", F.coalesce("link", F.lit("")).alias("link"), F.expr("published_ns - pmod(published_ns, 1000000000L)").alias("published_ns"), "body")


@query(
    "q77_story_documents",
    f"select {PLAIN.format('title')} as title, 'https://x.example/' || signal_id as link, published_ns // 1000000 * 1000000 as published_ns, signal_id % 3 = 0 as named from {TITLED}",
)
def story_documents(spark, d):
    """Atom entries: the alternate link of several, dates published or updated, tags in the body."""
    s = _stories(spark, d)
    url = F.concat(F.lit("https://x.example/"), F.col("signal_id").cast("string"))
    links = F.concat(F.lit('<link rel="self" href="https://x.example/feed"/><link rel="alternate" href="'), url, F.lit('"/>'))
    date = F.when(F.col("published_ns").isNotNull(), F.when(F.col("signal_id") % 2 == 0, _tag("published", times.utc_iso(F.col("published_ns")))).otherwise(_tag("updated", times.utc_iso(F.col("published_ns"))))).otherwise("")
    body = F.when(F.col("signal_id") % 3 == 0, "Quill (NASDAQ: QLFK) said so").otherwise("No tag (here)")
    entry = F.concat(F.lit("<entry>"), _tag("id", F.concat(F.lit("urn:"), F.col("signal_id").cast("string"))), _tag("title", _xml(F.regexp_replace("title", "[\\n\\r]", " "))), links, date, _tag("summary", body), F.lit("</entry>"))
    r = feeds.story_items(spark, landing.land_documents(s.select(entry.alias("value")), scratch(spark, "atom"), "<feed>", "</feed>"))
    return r.select("title", "link", "published_ns", F.exists("tags", lambda t: t["symbol"] == "QLFK").alias("named"))


ENTRIES = "(select c_custkey, [' 8-K', 'S-1/A', '424B5'][c_custkey % 3 + 1] as form, case c_custkey % 3 when 0 then 'Item 2.02 and item 9.01' when 1 then '' else 'ITEM 1.01, item 9.99' end as items from customer)"


@query(
    "q78_filing_entries",
    f"""select trim(form) as form, 'Firm & Sons ' || c_custkey as company, c_custkey as cik, 'Filer' as role, case c_custkey % 3 when 0 then (1::bigint << 6) + (1::bigint << 31) when 1 then 0 else 1 end as items,
    trim(form) || ' Firm & Sons ' || c_custkey || case c_custkey % 3 when 0 then ': Results of Operations and Financial Condition' when 1 then '' else ': Entry into a Material Definitive Agreement' end as headline from {ENTRIES} where c_custkey % 5 <> 0""",
)
def filing_entries(spark, d):
    """Every fifth title does not read as a filing."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    title = F.when(F.col("c_custkey") % 5 == 0, "A note").otherwise(F.concat(_pick([" 8-K", "S-1/A", "424B5"], "c_custkey"), F.lit(" - Firm & Sons "), k, F.lit(" ("), F.lpad(k, 10, "0"), F.lit(") (Filer)")))
    items = _pick(["<b>Item 2.02</b> and item 9.01", "", "ITEM 1.01, item 9.99"], "c_custkey")
    entry = F.concat(F.lit("<entry>"), _tag("title", _xml(title)), F.lit('<link rel="alternate" href="https://x.example/i"/>'), _tag("id", k), _tag("updated", F.lit("2026-03-05T16:01:00-05:00")), _tag("summary", _xml(items)), F.lit("</entry>"))
    return feeds.filing_entries(spark, landing.land_documents(c.select(entry.alias("value")), scratch(spark, "filings-feed"), "<feed>", "</feed>")).select("form", "company", "cik", "role", "items", "headline")


WALL = f"(epoch_us(date_trunc('day', {ET.format('t_signal_ns')})::timestamp at time zone 'America/New_York') * 1000 + (epoch_us({ET.format('t_signal_ns')}) % 86400000000 // 1000000) * 1000000000)"


@query(
    "q79_halts",
    f"""select upper(ticker) as ticker, case when signal_id % 3 = 0 then 'RESUME' else 'HALT' end as kind, ['T1', 'LUDP', 'zz'][signal_id % 3 + 1] as reason, ['News pending', 'Volatility trading pause (LULD)', 'Other'][signal_id % 3 + 1] as means,
    {WALL} as halt_ns, case when signal_id % 3 = 0 then {WALL} end as resume_trade_ns from signals where ticker is not null and t_signal_ns is not null""",
)
def halts(spark, d):
    s = table(spark, d, "signals").where("t_signal_ns is not null")
    et = times.eastern(F.col("t_signal_ns"))
    day, hms = F.date_format(et, "MM/dd/yyyy"), F.date_format(et, "HH:mm:ss")
    resume = F.when(F.col("signal_id") % 3 == 0, F.concat(_tag("ndaq:ResumptionDate", day), _tag("ndaq:ResumptionTradeTime", hms))).otherwise("<ndaq:ResumptionDate></ndaq:ResumptionDate>")
    item = F.concat(F.lit("<item>"), _tag("title", F.col("ticker")), _tag("ndaq:HaltDate", day), _tag("ndaq:HaltTime", hms), _tag("ndaq:IssueSymbol", F.lower("ticker")), _tag("ndaq:ReasonCode", _pick(["T1", "LUDP", "zz"], "signal_id")), resume, F.lit("</item>"))
    r = feeds.halt_items(spark, landing.land_documents(s.select(item.alias("value")), scratch(spark, "halts"), '<rss xmlns:ndaq="http://ndaq.example/"><channel>', "</channel></rss>"))
    return r.select("ticker", "kind", "reason", feeds.halt_reason(F.col("reason")).alias("means"), "halt_ns", "resume_trade_ns")


@query("q80_feed_summary", "select src, count(*) as items, max(published_ns) as newest_ns from signals where title <> '' group by src")
def feed_summary(spark, d):
    return feeds.feed_summary(table(spark, d, "signals").where("title <> ''"), feed="src", published_ns="published_ns")


BASE = "https://www.example"
PAGED = f"(select *, o_orderkey from {INDEX.replace(' from orders)', ', o_orderkey from orders)')} where cls in ('8k', '6k'))".replace("select *, o_orderkey from", "select * from")


def _pages(spark, d):
    """(index rows, fetched pages): of every fourth filing the page has no acceptance time, of every seventh there is none; every third has an exhibit."""
    f = _index(spark, d).where("cls in ('8k', '6k')").withColumn("k", F.regexp_extract("file", r"/([0-9]+)\.txt$", 1).try_cast("bigint"))
    url = F.concat(F.lit(BASE + "/"), F.regexp_replace("file", r"\.txt$", "-index.htm"))
    accepted = F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit('<div class="h">Accepted</div> <div class="i">'), F.date_format("day", "yyyy-MM-dd"), F.lit(" 16:05:09</div>")))
    row = lambda kind, href: f'<tr><td>{kind}</td><td><a href="{href}">x</a></td></tr>'
    rows = F.when(F.col("k") % 3 == 0, row("8-K", "main.htm") + row("EX-99.2", "other.htm") + row("EX-99.1", "/ix?doc=/doc/press.htm")).otherwise(row("8-K", "main.htm"))
    index = f.where("k % 7 <> 0").select(url.alias("url"), F.concat(accepted, F.lit("<p>Item 2.02 Results</p><table>"), F.regexp_replace(rows, "press", F.concat(F.lit("press"), F.col("k").cast("string"))), F.lit("</table>")).alias("body"))
    docs = f.where("k % 7 <> 0 and k % 3 = 0").select(F.concat(F.lit(BASE + "/doc/press"), F.col("k").cast("string"), F.lit(".htm")).alias("url"), F.concat(F.lit("<p>Exhibit 99.1</p><p>Short</p><p>Firm reports result number "), F.col("k").cast("string"), F.lit("</p><p>Body</p>")).alias("body"))
    return f.drop("k"), index.unionByName(docs)


REBUILT = f"""(select f.*, cast(regexp_extract(file, '/([0-9]+)[.]txt$', 1) as bigint) as k from {INDEX} f where cls in ('8k', '6k'))"""
# Eastern times of day count from midnight, also where a clock was changed that day.
ACCEPTED = f"(epoch_us(day::timestamp at time zone 'America/New_York') * 1000 + {(16 * 3600 + 5 * 60 + 9) * S})"


@query(
    "q81_rebuilt_filings",
    f"""select cik, form, kind, title, url, items, {ACCEPTED} + wait as recv_ns from (
      select *, 'filing' as kind, null as title, '{BASE}/' || replace(file, '.txt', '-index.htm') as url, 64 as items, {30 * S} as wait from {REBUILT} where k % 7 <> 0 and k % 4 <> 0
      union all select *, 'exhibit', 'Firm reports result number ' || k, '{BASE}/doc/press' || k || '.htm', 64, {32 * S} from {REBUILT} where k % 7 <> 0 and k % 4 <> 0 and k % 3 = 0)""",
)
def rebuilt_filings(spark, d):
    index, pages = _pages(spark, d)
    return feeds.rebuild_filings(index, pages, BASE).select("cik", "form", "kind", "title", "url", "items", "recv_ns")


@query(
    "q82_rebuild_counters",
    f"""select count(*) as candidates, count(*) filter (k % 7 <> 0) as pages, count(*) filter (k % 7 <> 0 and k % 4 <> 0) as filings, count(*) filter (k % 7 <> 0 and k % 4 <> 0 and k % 3 = 0) as exhibits,
    count(*) - count(*) filter (k % 7 <> 0 and k % 4 <> 0) as errors from {REBUILT}""",
)
def rebuild_counters(spark, d):
    index, pages = _pages(spark, d)
    return feeds.rebuild_counters(index, pages, feeds.rebuild_filings(index, pages, BASE), BASE)


@query("q83_weekday_urls", "select day, 'https://h.example/edgar/daily-index/' || year(day) || '/QTR' || quarter(day) || '/master.' || strftime(day, '%Y%m%d') || '.idx' as url from (select unnest(generate_series(date '2026-01-01', date '2026-12-31', interval 1 day))::date as day) where dayofweek(day) between 1 and 5", dates=("day",))
def weekday_urls(spark, d):
    return feeds.weekdays(spark, "2026-01-01", "2026-12-31").withColumn("url", feeds.index_url("https://h.example", F.col("day")))


# ---- bridge lines and tapes --------------------------------------------------------------------

LINED = "(select *, ['T', 'Q', 'H', 'bad', 'T0'][print_id % 5 + 1] as k from tape where ticker is not null and ts_ns is not null)"


@query(
    "q84_bridge_lines",
    f"""select print_id as ts_ns, case k when 'bad' then null when 'T0' then null else k end as kind, case when k in ('T', 'Q', 'H') then ticker end as ticker, case k when 'T' then px_e4 end as px_e4, case k when 'T' then shares end as shares,
    case k when 'Q' then px_e4 end as bid_e4, case k when 'Q' then shares end as bid_size, case k when 'Q' then px_e4 + 100 end as ask_e4, case k when 'H' then 'H' end as state, case k when 'H' then 'T1' end as reason from {LINED} where px_e4 > 0 and shares > 0""",
)
def bridge_lines(spark, d):
    """Prints, quotes, halts, and lines that do not read; every line stamped (here with its id)."""
    t = table(spark, d, "tape").where("ticker is not null and ts_ns is not null and px_e4 > 0 and shares > 0")
    px = lambda e4: F.format_string("%d.%04d", F.floor(e4 / 10000), e4 % 10000)
    p, n, k = F.col("px_e4").cast("bigint"), F.col("shares").cast("string"), F.col("print_id") % 5
    line = (
        F.when(k == 0, F.concat_ws(" ", F.lit("T"), "ticker", px(p), n)).when(k == 1, F.concat_ws("  ", F.lit("Q"), "ticker", px(p), n, px(p + 100), n)).when(k == 2, F.concat_ws("\t", F.lit("H"), "ticker", F.lit("H"), F.lit("T1")))
        .when(k == 3, F.concat_ws(" ", F.lit("Z"), "ticker")).otherwise(F.concat_ws(" ", F.lit("T"), "ticker", F.lit("0.0"), n))
    )
    at = landing.land_lines(t.select(F.concat_ws(" ", F.col("print_id").cast("string"), line).alias("value")), scratch(spark, "tape"), "gzip")
    return market_files.read_tape(spark, at).select("ts_ns", "kind", "ticker", "px_e4", "shares", "bid_e4", "bid_size", "ask_e4", "state", "reason")


@query("q85_bad_lines", f"select case when k in ('T', 'Q', 'H') then k end as kind, count(*) as n from {LINED} where px_e4 > 0 and shares > 0 group by 1")
def bad_lines(spark, d):
    return bridge_lines(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- exchange sessions -------------------------------------------------------------------------
#
# A session of each ticker's initial (or more, each of at most LOCATES tickers) holds the prints of its tickers, in time. Each usable print n of a ticker comes as six
# messages: an add of 3 * shares (a bid, or an ask 5 cents above), an execution of one share count at its own or a given price,
# a cancel of half a share count, every third time a replacement 1 cent lower at the same size; five prints later the order is
# deleted. Every fifth print also comes as a trade that names its symbol. References lie beyond 2**53, beside nulls.

BIG = 2**53 + 1
LOCATES = 2**16 - 1
USABLE = "(select print_id, ticker, ts_ns, px_e4, shares, row_number() over (partition by ticker order by ts_ns, print_id) as n from tape where ticker is not null and ts_ns is not null and px_e4 > 10000 and shares > 1)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages without ``seq``, ordered by (session, n, place)."""
    t = table(spark, d, "tape").where("ticker is not null and ts_ns is not null and px_e4 > 10000 and shares > 1")
    # A ticker's prints in order: for fixtures only, so one window over a ticker will do. Each comes with the print whose order is deleted then.
    w = Window.partitionBy("ticker").orderBy("ts_ns", "print_id")
    t = t.withColumns({"n": F.row_number().over(w), "gone": F.lag("print_id", 5).over(w), "gone_ns": F.lag("ts_ns", 5).over(w), "late": F.lead("print_id", 5).over(w).isNull()})
    # Locates are numbers of one session and have two bytes: the tickers of an initial that are left over go to further sessions.
    k = F.row_number().over(Window.partitionBy(F.substring("ticker", 1, 1)).orderBy("ticker")) - 1
    locates = t.select("ticker").distinct().withColumn("k", k).select("ticker", F.concat_ws("_", F.substring("ticker", 1, 1), F.when(F.col("k") >= LOCATES, F.expr(f"string(k div {LOCATES})"))).alias("session"), (F.col("k") % LOCATES + 1).cast("int").alias("locate"))
    # Five more places follow the last print of a ticker, with deletes only.
    extra = F.col("extra")
    t = t.join(locates, "ticker").withColumn("extra", F.explode(F.when(F.col("late"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    t = t.select(
        "session", "locate", "ticker", "ts_ns", F.when(~extra, F.col("print_id")).alias("print_id"), F.col("px_e4").cast("bigint").alias("px"), F.col("shares").cast("bigint").alias("sh"), (F.col("n") + F.when(extra, 5).otherwise(0)).alias("n"),
        F.when(extra, F.col("print_id")).otherwise(F.col("gone")).alias("gone"), F.when(extra, F.col("ts_ns")).otherwise(F.col("gone_ns")).alias("gone_ns"),
    ).unionByName(locates.withColumn("n", F.lit(-1)), allowMissingColumns=True)
    # Moved before they multiply: one ticker may have a tenth of all prints.
    t = t.repartition(shuffle_partitions(spark), "ticker", "n")

    n, px, sh = F.col("n"), F.col("px"), F.col("sh")
    side = F.when(n % 2 == 0, "B").otherwise("S")
    price = px + F.when(side == "S", 500).otherwise(0)
    ref = lambda c: F.col(c) * 2 + BIG
    third, here = n % 3 == 0, F.col("print_id").isNotNull()
    # Kinds of messages: the k-th letter of DAECXUPER; D is of the order five prints before.
    kinds = F.array_compact(F.array(
        F.when(F.col("gone").isNotNull(), 0), F.when(here, 1), F.when(here, F.when(third, 3).otherwise(2)), F.when(here, 4), F.when(here & third, 5), F.when(F.col("print_id") % 5 == 0, 6), F.when(F.col("print_id") % 11 == 0, 7), F.when(n < 0, 8)
    ))
    k = F.col("k")
    return t.select("*", F.explode(kinds).alias("k")).select(
        "session", "locate", F.when(k == 0, F.col("gone_ns")).when(k == 8, F.lit(0)).otherwise(F.col("ts_ns")).alias("ts_ns"), F.substring(F.lit("DAECXUPER"), k + 1, F.lit(1)).alias("type"), "n", F.when(k < 8, k - F.when(k > 2, 1).otherwise(0)).otherwise(0).alias("place"),
        F.when(k == 7, F.lit(7).cast("bigint")).when(k == 0, ref("gone") + F.when((n - 5) % 3 == 0, 1).otherwise(0)).when(k < 6, ref("print_id")).alias("ref"), F.when(k == 5, ref("print_id") + 1).alias("new_ref"), F.when(k.isin(1, 6), side).alias("side"),
        F.when(k == 1, sh * 3).when(k == 4, F.floor(sh / 2)).when(k == 8, F.lit(100).cast("bigint")).when(k != 0, sh).alias("shares"), F.when(k == 1, price).when(k == 3, price + 7).when(k == 5, price - 100).when(k == 6, px).alias("px_e4"),
        F.when(k == 3, F.when(n % 2 == 0, "Y").otherwise("N")).alias("printable"), F.when(k.isin(1, 6, 8), F.col("ticker")).alias("stock"), F.when(k == 8, "Q").alias("category"), F.when(k == 8, "N").alias("status"),
    )


def _of_day(messages: DataFrame) -> DataFrame:
    """Times are since midnight, so ``ts_ns`` here is the time modulo a day."""
    return messages.withColumn("ts_ns", F.pmod("ts_ns", F.lit(24 * HOUR)))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose ``seq`` has their order only, (n, place, locate) in one number."""
    seq = ((F.col("n") + 1).cast("bigint") * 8 + F.col("place")) * (LOCATES + 1) + F.col("locate")
    return _of_day(_messages(spark, d)).withColumn("seq", seq)


def _places(spark: SparkSession, d: str) -> DataFrame:
    """What ``_made`` makes the messages of ``_messages`` of, parted by initial and in the sessions' order: a place for each print (what 0), five for the deletes after a ticker's last print (1) and one for its directory entry (2)."""
    t = table(spark, d, "tape").where("ticker is not null and ts_ns is not null and px_e4 > 10000 and shares > 1").select(F.substring("ticker", 1, 1).alias("initial"), "ticker", "ts_ns", "print_id", "px_e4", "shares")
    # Moved once: an initial's tickers are numbered, and its sessions ordered, where they are.
    w, of_day = Window.partitionBy("initial", "ticker").orderBy("ts_ns", "print_id"), lambda c: F.pmod(c, F.lit(24 * HOUR))
    t = t.repartition("initial").withColumns({"n": F.row_number().over(w).cast("bigint"), "gone": F.lag("print_id", 5).over(w), "gone_ns": F.lag("ts_ns", 5).over(w), "late": F.lead("print_id", 5).over(w).isNull()})
    t = t.withColumn("k", F.dense_rank().over(Window.partitionBy("initial").orderBy("ticker")) - 1)
    t = t.withColumn("what", F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("late"), 1), F.when(F.col("n") == 1, 2)))))
    tail = F.col("what") == 1
    return t.select(
        F.concat_ws("_", "initial", F.when(F.col("k") >= LOCATES, F.expr(f"string(k div {LOCATES})"))).alias("session"), (F.col("k") % LOCATES + 1).cast("int").alias("locate"), "ticker", "what", F.when(F.col("what") == 2, -1).otherwise(F.col("n") + F.when(tail, 5).otherwise(0)).alias("n"),
        of_day("ts_ns").alias("ts_ns"), "print_id", F.col("px_e4").cast("bigint").alias("px"), F.col("shares").cast("bigint").alias("sh"), F.when(tail, F.col("print_id")).otherwise(F.coalesce("gone", F.lit(0))).alias("gone"), F.when(tail, of_day("ts_ns")).otherwise(of_day(F.coalesce("gone_ns", F.lit(0)))).alias("gone_ns"),
    ).sortWithinPartitions("session", "n", "locate")


def _made(places):
    """The messages of a record batch of ``_places``, as ``_messages`` has them."""
    import numpy as np
    import pyarrow as pa

    names_of, texts = places.schema.names, lambda values: pa.array(values, pa.string())
    session, ticker = (places.column(names_of.index(c)) for c in ("session", "ticker"))
    v = {c: places.column(names_of.index(c)).to_numpy() for c in ("locate", "what", "n", "ts_ns", "print_id", "px", "sh", "gone", "gone_ns")}
    here, third, odd = v["what"] == 0, v["n"] % 3 == 0, v["n"] % 2 != 0
    # In the order of the letters DAECXUPER; D is of the order five prints before.
    kinds = [(here & (v["n"] > 5)) | (v["what"] == 1), here, here & ~third, here & third, here, here & third, here & (v["print_id"] % 5 == 0), here & (v["print_id"] % 11 == 0), v["what"] == 2]
    row, k = np.nonzero(np.stack(kinds, axis=1))
    ref, price = v["print_id"] * 2 + BIG, v["px"] + np.where(odd, 500, 0)
    of = lambda at, *values: np.choose(np.array(at)[k], [x[row] if isinstance(x, np.ndarray) else x for x in values])
    sessions, odd = session.dictionary_encode(), odd[row]
    return pa.RecordBatch.from_pydict({
        "session": pa.DictionaryArray.from_arrays(sessions.indices.take(pa.array(row)), sessions.dictionary),
        "type": texts([*"DAECXUPER"]).take(pa.array(k)),
        "locate": pa.array(v["locate"][row]),
        "ts_ns": pa.array(of([1, 0, 0, 0, 0, 0, 0, 0, 2], v["ts_ns"], v["gone_ns"], 0)),
        "ref": pa.array(of([1, 0, 0, 0, 0, 0, 0, 2, 2], ref, v["gone"] * 2 + BIG + ((v["n"] - 5) % 3 == 0), 7)),
        "new_ref": pa.array(ref[row] + 1),
        "side": texts(["B", "S"]).take(pa.array(odd.astype(np.int32))),
        "shares": pa.array(of([0, 1, 0, 0, 2, 0, 0, 0, 3], v["sh"], v["sh"] * 3, v["sh"] // 2, 100)),
        "px_e4": pa.array(of([0, 1, 0, 2, 0, 3, 0, 0, 0], v["px"], price, price + 7, price - 100)),
        "printable": texts(["Y", "N"]).take(pa.array(odd.astype(np.int32))),
        "stock": ticker.take(pa.array(row)),
        "category": pa.repeat("Q", len(row)),
        "status": pa.repeat("N", len(row)),
    })


def _recorded(spark: SparkSession, d: str) -> str:
    """Folder of the recorded sessions."""
    at = scratch(spark, "itch")
    landing.land_sessions(_places(spark, d), at, in_order=True, made=_made).collect()  # one row per file
    return at


def _session(spark: SparkSession, d: str, *columns: str, keep: bool = True, **options) -> DataFrame:
    """Recorded and read again, the given columns; kept for several reads unless ``keep`` is off."""
    spark.dataSource.register(market_files.SessionSource)
    m = spark.read.format("exchange_session").options(**options).load(_recorded(spark, d)).select(*(columns or "*"))
    return stored(m) if keep else m


@query(
    "q86_session_prints",
    f"""select ticker, px_e4, shares, kind, count(*) as n from (
      select ticker, px_e4 + case when n % 2 = 1 then 500 else 0 end as px_e4, shares, 'execution' as kind from {USABLE} where n % 3 <> 0
      union all select ticker, px_e4 + 7, shares, 'execution' from {USABLE} where n % 3 = 0 and n % 2 = 0
      union all select ticker, px_e4, shares, 'trade' from {USABLE} where print_id % 5 = 0) group by all""",
)
def session_prints(spark, d):
    """Written, read, decoded; executions take their order's price, locates become symbols."""
    m = _session(spark, d)
    return market_files.with_symbols(market_files.session_prints(m), m).groupBy("ticker", "px_e4", "shares", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q87_session_counters",
    f"""select left(ticker, 1) as session, count(*) as orders, count(*) filter (n % 3 = 0 and n % 2 = 1) as hidden, count(*) filter (print_id % 11 = 0) as unknown_refs,
    count(*) * 4 + count(*) filter (n % 3 = 0) + count(*) filter (print_id % 5 = 0) + count(*) filter (print_id % 11 = 0) + count(distinct ticker) as messages from {USABLE} group by 1""",
)
def session_counters(spark, d):
    c = market_files.session_counters(_session(spark, d, "session", "type", "ref", "new_ref", "printable", keep=False))
    return c.groupBy(F.substring("session", 1, 1).alias("session")).agg(*(F.sum(x).alias(x) for x in ("messages", "orders", "unknown_refs", "hidden")))


# Each order as the stretches of its life: (from, upto, size) in places of its book, a place being print * 8 + message.
LIVES = f"""(select ticker, print_id, case when n % 2 = 0 then 'B' else 'S' end as side, px_e4 + case when n % 2 = 1 then 500 else 0 end as px, shares as sh, n from {USABLE})"""
STRETCHES = f"""(select ticker, side, px, n * 8 + 1 as a, n * 8 + 2 as b, sh * 3 as q from {LIVES} union all select ticker, side, px, n * 8 + 2, n * 8 + 3, sh * 2 from {LIVES}
  union all select ticker, side, px, n * 8 + 3, case when n % 3 = 0 then n * 8 + 4 else (n + 5) * 8 end, sh * 2 - sh // 2 from {LIVES}
  union all select ticker, side, px - 100, n * 8 + 4, (n + 5) * 8, sh from {LIVES} where n % 3 = 0)"""
LAST = f"(select ticker, max(n) + 6 as upto from {USABLE} group by 1)"


@query(
    "q88_depth_after",
    f"""select ticker, side, px as px_e4, cast(sum(q) as bigint) as shares from {STRETCHES} s join {LAST} l using (ticker) where s.a <= least(cut_at, l.upto * 8) and s.b > least(cut_at, l.upto * 8) group by all""".replace("least(cut_at, l.upto * 8)", "(l.upto - 5) * 8 - 1"),
)
def depth_after(spark, d):
    """Standing shares before the deletes of the last five prints."""
    m = _session(spark, d, "session", "seq", "type", "locate", "stock", "ref", "new_ref", "side", "shares", "px_e4")
    # The deletes that come after a book's last print: those whose order is among its last five.
    last = m.where("type = 'A'").groupBy("session", "locate").agg(F.max("seq").alias("last_seq"))
    late = m.join(last.hint("shuffle_hash"), ["session", "locate"]).where("type <> 'D' or seq < last_seq").drop("last_seq")
    return market_files.with_symbols(book.depth_after(late), m).select("ticker", "side", "px_e4", "shares")


@query(
    "q89_tops_of_book",
    f"""with points as (select distinct ticker, a as p from {STRETCHES} union select distinct ticker, b from {STRETCHES}),
    t as (select points.ticker, p, max(px) filter (side = 'B') as bid_e4, min(px) filter (side = 'S') as ask_e4 from points left join {STRETCHES} s on s.ticker = points.ticker and s.a <= p and p < s.b group by all),
    z as (select t.*, cast(sum(q) filter (side = 'B' and px = bid_e4) as bigint) as bid_size, cast(sum(q) filter (side = 'S' and px = ask_e4) as bigint) as ask_size from t left join {STRETCHES} s on s.ticker = t.ticker and s.a <= p and p < s.b group by all),
    c as (select *, lag(p) over w as before, (bid_e4, bid_size, ask_e4, ask_size) as top, lag((bid_e4, bid_size, ask_e4, ask_size)) over w as previous from z window w as (partition by ticker order by p))
    select ticker, bid_e4, bid_size, ask_e4, ask_size, count(*) as n from c where before is null or top is distinct from previous group by all""",
)
def tops_of_book(spark, d):
    """The sessions' books are folded as they are read: no message is stored or moved."""
    spark.dataSource.register(book.TopsSource)
    tops = spark.read.format("exchange_tops").load(_recorded(spark, d)).withColumn("ticker", names.normalize_symbol(F.col("stock")))
    return tops.groupBy("ticker", "bid_e4", "bid_size", "ask_e4", "ask_size").agg(F.count(F.lit(1)).alias("n"))


@query("q90_directory_symbols", f"select distinct ticker, 'Q' as category, 'N' as status from {USABLE} where ticker not in (select ticker from symbol_info where ticker < 'N')")
def directory_symbols(spark, d):
    return market_files.missing_symbols(_session(spark, d, "type", "stock", "category", "status", keep=False, directoryOnly="true"), table(spark, d, "symbol_info").where("ticker < 'N'"))


# ---- polling, tapes and alerts -----------------------------------------------------------------


@query("q124_changed_documents", "select row_id from (select *, lag(md5(b)) over (partition by ticker order by loaded_ns, row_id) as was from (select row_id, ticker, loaded_ns, security_name as b from symbol_snapshots where loaded_ns is not null and security_name is not null)) where md5(b) is distinct from was")
def changed_documents(spark, d):
    return polling.changed_documents(table(spark, d, "symbol_snapshots").select("row_id", "ticker", "loaded_ns", "security_name"), url="ticker", fetched="loaded_ns", body="security_name", tie="row_id").select("row_id")


@query(
    "q125_unseen_items",
    f"""with x as (select src, news_id, t_news_recv_ns - t_news_recv_ns % {HOUR} as poll from signals where src is not null and news_id is not null and t_news_recv_ns is not null)
    select src, news_id, min(poll) as poll from x group by 1, 2 having min(poll) > (select min(poll) from x y where y.src = x.src)""",
)
def unseen_items(spark, d):
    s = table(spark, d, "signals").select("src", "news_id", F.expr(f"t_news_recv_ns - pmod(t_news_recv_ns, {HOUR}L)").alias("poll"))
    return polling.unseen_items(s, feed="src", poll="poll", id_col="news_id")


@query("q126_still_to_fetch", "select distinct link from signals where link is not null and link not in (select link from signals where link is not null and (signal_id % 3 = 0 or signal_id % 7 = 0))")
def still_to_fetch(spark, d):
    s = table(spark, d, "signals")
    return polling.still_to_fetch(s, s.where("signal_id % 3 = 0"), s.where("signal_id % 7 = 0"), url="link")


@query("q127_tape_lines", "select ts_ns, 'T' as kind, ticker, px_e4, shares from tape where ticker is not null and ts_ns is not null and px_e4 > 0 and shares > 0")
def tape_lines(spark, d):
    """Recorded and read again."""
    t = table(spark, d, "tape").where("ticker is not null and px_e4 > 0 and shares > 0").select("ts_ns", F.lit("T").alias("kind"), "ticker", "px_e4", "shares", *(F.lit(None).cast("bigint").alias(c) for c in ("bid_e4", "bid_size", "ask_e4", "ask_size")), *(F.lit(None).cast("string").alias(c) for c in ("state", "reason")))
    at = landing.land_lines(market_files.tape_lines(t).select("value"), scratch(spark, "recorded"), "gzip")
    return market_files.read_tape(spark, at).select("ts_ns", "kind", "ticker", "px_e4", "shares")


@query(
    "q128_alert_lines",
    """select signal_id, concat_ws(' | ', concat_ws(' ', tier, ticker, case when price is not null then printf('$%.4f', price) end, case when move_pct is not null then printf('%+.2f', move_pct) || '%' end, case when mcap is not null then 'mcap ' ||
      case when mcap >= 1e9 then printf('%.1fB', floor(mcap / 1e8 + 0.5) / 10) when mcap >= 1e6 then printf('%.1fM', floor(mcap / 1e5 + 0.5) / 10) when mcap >= 1e3 then printf('%.1fK', floor(mcap / 1e2 + 0.5) / 10) else printf('%.0f', floor(mcap + 0.5)) end end), nullif(trim(catalyst, ' '), '')) as line,
    concat_ws('; ', catalyst, 'a, b', case when amount_usd > 0 then '$' || case when amount_usd >= 1e9 then printf('%.1fB', floor(amount_usd / 1e8 + 0.5) / 10) when amount_usd >= 1e6 then printf('%.1fM', floor(amount_usd / 1e5 + 0.5) / 10) when amount_usd >= 1e3 then printf('%.1fK', floor(amount_usd / 1e2 + 0.5) / 10) else printf('%.0f', floor(amount_usd + 0.5)) end
      || case when mcap > 0 then printf(' (%.2fx mcap)', amount_usd / mcap) else '' end end, case when signal_id % 3 > 0 then (signal_id % 3) || ' hedges' end) as why from signals""",
)
def alert_lines(spark, d):
    s, c = table(spark, d, "signals"), F.col
    line = alerts.alert_line(tier=c("tier"), ticker=c("ticker"), price=c("price"), move_pct=c("move_pct"), mcap=c("mcap"), title=c("catalyst"))
    why = alerts.why_text(catalyst=c("catalyst"), phrases=F.array(F.lit("a"), F.lit("b")), amount_usd=c("amount_usd"), mcap=c("mcap"), hedges=c("signal_id") % 3, promos=F.lit(0))
    return s.select("signal_id", line.alias("line"), why.alias("why"))


@query("q129_routed", "select tier, count(*) as n from signals where tier in ('ALERT', 'HIGH', 'HALT', 'INFO') group by tier")
def routed(spark, d):
    return alerts.routed(table(spark, d, "signals"), tier="tier", movers=False).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q130_recovered_packets",
    f"""select ticker, px_e4, shares, kind, count(*) as n from (
      select ticker, px_e4 + case when n % 2 = 1 then 500 else 0 end as px_e4, shares, 'execution' as kind from {USABLE} where n % 3 <> 0
      union all select ticker, px_e4 + 7, shares, 'execution' from {USABLE} where n % 3 = 0 and n % 2 = 0
      union all select ticker, px_e4, shares, 'trade' from {USABLE} where print_id % 5 = 0) group by all""",
)
def recovered_packets(spark, d):
    """The sessions again, as packets of seven messages and, over them, packets of four: every number comes twice, out of order."""
    e = packets.encoded(_ordered(spark, d))
    e = stored(e.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("seq")).cast("bigint")))
    sent = [packets.packed(e.withColumn("p", F.floor(F.col("seq") / k)), packet_of="p") for k in (7, 4)]
    got = stored(packets.recovered(sent[0].unionByName(sent[1]), packet="packet"))
    return market_files.with_symbols(market_files.session_prints(got), got).groupBy("ticker", "px_e4", "shares", "kind").agg(F.count(F.lit(1)).alias("n"))
