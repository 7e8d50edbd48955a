"""Feeds and pages: documents that landed as files or rows, to event rows.

Transport (connections, polling, rate limits, back-off) is outside: the landing
folder and the file stream's checkpoint read each document once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.names import filing_headline, items_mask
from newsloom.functions.text import ascii_upper, collapse_whitespace, decode_entities, html_to_lines, html_to_text, trimmed
from newsloom.functions.times import parse_any_datetime, parse_eastern
from newsloom.functions.urls import resolve_url
from newsloom.operators.phrases import ticker_tags
from newsloom.operators.reference import primary_security
from newsloom.operators.stories import first_of

RSS = "guid string, id string, link array<struct<_text:string,_href:string,_rel:string>>, title string, description string, pubDate string, `content:encoded` string, summary string, content string, `dc:date` string, published string, updated string, `a10:updated` string, `dc:contributor` array<string>, category array<struct<_text:string,_term:string>>"
ATOM = "id string, title string, updated string, published string, summary string, content string, link array<struct<_href:string,_rel:string>>"
HALTS = ", ".join(f"`ndaq:{c}` string" for c in ("HaltDate", "HaltTime", "IssueSymbol", "IssueName", "Market", "ReasonCode", "PauseThresholdPrice", "ResumptionDate", "ResumptionQuoteTime", "ResumptionTradeTime")) + ", title string, pubDate string"


def _items(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, valueTag="_text", attributePrefix="_", mode="PERMISSIVE").schema(schema).load(path)


def _text(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def item_id(*candidates: Column) -> Column:
    """16 hex digits of the first candidate that is not blank."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.coalesce(*(_text(c) for c in candidates)))), 16, "0"))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items: id, title, link, published_ns, body, all tags of tickers in categories, title, then body. Items without title are dropped."""
    return _stories(spark, path, "item")


def atom_items(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries that are stories, with the columns of ``rss_items``."""
    return _stories(spark, path, "entry")


def story_items(spark: SparkSession, path: str) -> DataFrame:
    """Stories of RSS and Atom documents; a document that has items gives those only."""
    rss = rss_items(spark, path).withColumn("_file", F.input_file_name())
    atom = atom_items(spark, path).withColumn("_file", F.input_file_name())
    has_items = _items(spark, path, "item", "title string").select(F.input_file_name().alias("_file")).distinct()
    return rss.unionByName(atom.join(has_items, "_file", "left_anti")).drop("_file")


def _stories(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Date and body are the first that read of pubDate, dc:date, published, updated, a10:updated and of description, content:encoded, summary, content."""
    x = _items(spark, path, tag, RSS.replace("guid string", "guid struct<_text:string,_isPermaLink:string>"))
    cats = F.coalesce(F.transform("category", lambda c: F.concat(F.lit(" "), F.coalesce(_text(c["_text"]), c["_term"], F.lit("")))), F.array().cast("array<string>"))
    body = F.coalesce(*(_text(F.col(f"`{c}`")) for c in ("description", "content:encoded", "summary", "content")), F.lit(""))
    alternate = F.filter("link", lambda l: l["_rel"] == "alternate")  # noqa: E741
    link = F.coalesce(_text(F.get("link", F.lit(0))["_text"]), F.get(alternate, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    y = x.select(
        item_id(F.col("guid._text"), F.col("id"), link, F.col("title")).alias("id"), html_to_text("title").alias("title"), trimmed(link).alias("link"),
        F.coalesce(*(parse_any_datetime(F.col(f"`{c}`")) for c in ("pubDate", "dc:date", "published", "updated", "a10:updated"))).alias("published_ns"), html_to_text(body).alias("body"), cats.alias("categories"), F.col("`dc:contributor`").alias("contributors"),
    ).where("title <> ''")
    tags = F.array_distinct(F.concat(F.flatten(F.transform("categories", ticker_tags)), ticker_tags(F.col("title")), ticker_tags(F.col("body"))))
    return y.withColumn("tags", tags).drop("categories")


TITLE = r"^(.*?) - (.*?)\s*\((\d{1,10})\)(?:.*?\(([^)]*)\))?"


def filing_title(c: Column) -> Column:
    """struct(form, company, cik, role) of ``8-K - NAME (CIK) (Role)``; null if it does not read so."""
    g = lambda i: F.regexp_extract(c, TITLE, i)
    return F.when(c.rlike(TITLE), F.struct(trimmed(g(1)).alias("form"), trimmed(g(2)).alias("company"), g(3).try_cast("bigint").alias("cik"), g(4).alias("role")))


def filing_entries(spark: SparkSession, path: str) -> DataFrame:
    """Atom filing entries: form, company, cik, items, headline of their titles, link (rel=alternate first), published_ns. Bad titles are dropped."""
    x = _items(spark, path, "entry", ATOM)
    alternate = F.filter("link", lambda l: l["_rel"] == "alternate")  # noqa: E741
    link = F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    summary = html_to_text(F.coalesce("summary", "content", F.lit("")))
    return x.withColumn("t", filing_title(trimmed(F.col("title")))).where("t is not null").select(
        item_id(F.col("id"), link, F.col("title")).alias("id"), "t.form", "t.company", "t.cik", "t.role", items_mask(summary).alias("items"), filing_headline(F.col("t.form"), F.col("t.company"), items_mask(summary)).alias("headline"), link.alias("link"),
        F.coalesce(parse_any_datetime(F.col("updated")), parse_any_datetime(F.col("published"))).alias("published_ns"),
    )


def with_issuer_tickers(filings: DataFrame, master: DataFrame, *, most: int | None = None) -> DataFrame:
    """``filings`` with ``tickers``: the issuer's securities, the primary one first, then in load order, ``most`` at most if given; [] for unknown issuers.

    ``master`` has (cik, ticker, security_name, listed, load_order).
    """
    primary = primary_security(master, issuer="cik", symbol="ticker", name="security_name", listed=F.col("listed"), load_order="load_order").withColumnRenamed("ticker", "_p")
    m = master.where("cik is not null and ticker is not null").join(primary, "cik")
    per = m.groupBy("cik").agg(F.array_sort(F.collect_set(F.struct((F.col("ticker") != F.col("_p")).alias("a"), F.col("load_order").alias("b"), F.col("ticker").alias("ticker"))))["ticker"].alias("tickers"))
    out = filings.join(per, "cik", "left")
    return out.withColumn("tickers", F.coalesce(first_of(F.array_distinct("tickers"), most), F.array().cast("array<string>")))


def halt_items(spark: SparkSession, path: str) -> DataFrame:
    """Halts and resumptions. The id covers the fields that change, so a resume time makes a new event; rows without symbol are dropped."""
    x = _items(spark, path, "item", HALTS)
    n = {c: F.col(f"`ndaq:{c}`") for c in ("HaltDate", "HaltTime", "IssueSymbol", "IssueName", "Market", "ReasonCode", "PauseThresholdPrice", "ResumptionDate", "ResumptionQuoteTime", "ResumptionTradeTime")}
    resumes = _text(n["ResumptionTradeTime"]).isNotNull()
    key = F.concat_ws("|", *(F.coalesce(trimmed(n[c]), F.lit("")) for c in ("IssueSymbol", "HaltDate", "HaltTime", "ReasonCode", "ResumptionDate", "ResumptionQuoteTime", "ResumptionTradeTime")))
    day = F.coalesce(_text(n["ResumptionDate"]), n["HaltDate"])
    return x.select(
        item_id(key).alias("id"), ascii_upper(trimmed(n["IssueSymbol"])).alias("ticker"), F.when(resumes, "RESUME").otherwise("HALT").alias("kind"), trimmed(n["ReasonCode"]).alias("reason"), trimmed(n["Market"]).alias("market"),
        parse_eastern(n["HaltDate"], n["HaltTime"]).alias("halt_ns"), F.when(_text(n["ResumptionQuoteTime"]).isNotNull(), parse_eastern(day, n["ResumptionQuoteTime"])).alias("resume_quote_ns"),
        F.when(resumes, parse_eastern(day, n["ResumptionTradeTime"])).alias("resume_trade_ns"), trimmed(n["PauseThresholdPrice"]).try_cast("double").alias("pause_threshold"), F.col("title"),
    ).where("ticker <> ''")


def index_page(html: Column) -> Column:
    """struct(accepted_ns, items) of a filing's index page; the acceptance time is Eastern."""
    at = F.regexp_extract(html, r"(?s)Accepted</div>\s*<div[^>]*>\s*([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9:]{8})", 0)
    g = lambda i: F.regexp_extract(at, r"([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9:]{8})", i)
    return F.struct(parse_eastern(F.concat_ws("/", g(2), g(3), g(1)), g(4)).alias("accepted_ns"), items_mask(F.regexp_replace(html, "<[^>]*>", " ")).alias("items"))


def exhibit_href(html: Column) -> Column:
    """Link of the press release: first table row typed EX-99.1, else the first of another EX-99; null without one."""
    rows = F.split(F.coalesce(html, F.lit("")), "(?i)<tr")
    ranked = F.transform(
        rows,
        lambda r, i: F.struct(
            F.when(r.rlike(r">\s*EX-99\.1\s*<"), 0).when(r.rlike(r">\s*EX-99[^<]*<"), 5).alias("rank"), i.alias("at"), F.nullif(F.regexp_replace(F.regexp_extract(r, r"""(?i)href=["']([^"']+)""", 1), r"^/ix\?doc=", ""), F.lit("")).alias("href")
        ),
    )
    return F.array_min(F.filter(ranked, lambda x: x["rank"].isNotNull() & x["href"].isNotNull()))["href"]


# First lines of exhibits that are no headline.
BOILERPLATE = r"(?i)^(exhibit\s*99|ex-99|for immediate release|press release|news release|document)"


def exhibit_headline(html: Column) -> Column:
    """First line of at least 15 characters that is no boilerplate, 250 at most; else the first 200 characters of the text."""
    lines = html_to_lines(html)
    good = F.get(F.filter(F.split(lines, "\n"), lambda l: (F.length(l) >= 15) & ~l.rlike(BOILERPLATE)), F.lit(0))  # noqa: E741
    return F.coalesce(F.substring(good, 1, 250), F.substring(collapse_whitespace(lines), 1, 200))


def rebuild_filings(index: DataFrame, pages: DataFrame, base_url: str, delay_ns: int = 30_000_000_000, exhibit_delay_ns: int = 2_000_000_000) -> DataFrame:
    """Filing and exhibit events of past days from an index and a table of fetched pages ``(url, body)``.

    A filing is received at its acceptance plus ``delay_ns``, its exhibit
    ``exhibit_delay_ns`` later; a filing whose page gives no acceptance time
    is left out. Pages are joined by URL, never broadcast.
    """
    page = F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace("file", r"\.txt$", "-index.htm"))
    f = index.withColumn("url", page).join(pages.select(F.col("url"), F.col("body")), "url").withColumn("p", index_page(F.col("body"))).where("p.accepted_ns is not null")
    f = f.select("cik", "company", "form", "url", F.col("p.items").alias("items"), (F.col("p.accepted_ns") + delay_ns).alias("recv_ns"), resolve_url(F.col("url"), exhibit_href(F.col("body"))).alias("exhibit"))
    filings = f.select("cik", "company", "form", "url", "items", "recv_ns", F.lit("filing").alias("kind"), F.lit(None).cast("string").alias("title"))
    docs = f.where("exhibit is not null").join(pages.select(F.col("url").alias("exhibit"), F.col("body").alias("doc")), "exhibit")
    return filings.unionByName(docs.select("cik", "company", "form", F.col("exhibit").alias("url"), "items", (F.col("recv_ns") + exhibit_delay_ns).alias("recv_ns"), F.lit("exhibit").alias("kind"), exhibit_headline(F.col("doc")).alias("title")))


def rebuild_counters(index: DataFrame, pages: DataFrame, events: DataFrame, base_url: str) -> DataFrame:
    """One row (candidates, pages, filings, exhibits, errors): how many index rows there were, had a page, and gave events; errors are those that gave none."""
    page = F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace("file", r"\.txt$", "-index.htm"))
    asked = index.select(page.alias("url")).join(pages.select("url", F.lit("page").alias("got")), "url", "left").select(F.coalesce("got", F.lit("none")).alias("what"))
    is_ = lambda *names: F.count_if(F.col("what").isin(*names))
    c = asked.unionByName(events.select(F.col("kind").alias("what"))).agg(is_("page", "none").alias("candidates"), is_("page").alias("pages"), is_("filing").alias("filings"), is_("exhibit").alias("exhibits"))
    return c.withColumn("errors", F.col("candidates") - F.col("filings"))


__all__ = ["rss_items", "atom_items", "story_items", "filing_entries", "with_issuer_tickers", "halt_items", "filing_title", "index_page", "exhibit_href", "exhibit_headline", "rebuild_filings", "rebuild_counters", "item_id", "decode_entities"]


# Halt codes and what they mean; all others are "Other".
HALT_REASONS = {
    "T1": "News pending", "T2": "News released", "T3": "News and resumption times", "T5": "Single-stock trading pause", "T6": "Extraordinary market activity", "T7": "Quotation-only period", "T8": "ETF halt",
    "T12": "Additional information requested", "H4": "Non-compliance", "H9": "Not current", "H10": "SEC trading suspension", "H11": "Regulatory concern", "O1": "Operations halt", "IPO1": "IPO not yet trading",
    "IPOQ": "IPO released for quotation", "IPOE": "IPO positioning window extension", "M1": "Corporate action", "M2": "Quotation not available", "LUDP": "Volatility trading pause (LULD)", "LUDS": "Volatility trading pause, straddle",
    "MWC1": "Market-wide circuit breaker L1", "MWC2": "Market-wide circuit breaker L2", "MWC3": "Market-wide circuit breaker L3", "MWC0": "Market-wide circuit breaker carryover", "R4": "Qualification issues resolved",
    "R9": "Filing requirements satisfied", "C3": "Issuer news not forthcoming", "C4": "Qualifications halt ended", "C9": "Qualifications halt concluded", "C11": "Halt concluded by other authority", "R1": "New issue available", "D": "Security deletion",
}


def halt_reason(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in HALT_REASONS.items() for x in kv))[ascii_upper(trimmed(code))], F.lit("Other"))


def feed_summary(items: DataFrame, *, feed: str, published_ns: str) -> DataFrame:
    """(feed, items, newest_ns) per feed, for a look at what a set of documents holds."""
    return items.groupBy(feed).agg(F.count(F.lit(1)).alias("items"), F.max(published_ns).alias("newest_ns"))


def index_url(base: str, day: Column) -> Column:
    """Address of a day's filing index."""
    return F.concat(F.lit(base.rstrip("/") + "/edgar/daily-index/"), F.date_format(day, "yyyy"), F.lit("/QTR"), F.quarter(day).cast("string"), F.lit("/master."), F.date_format(day, "yyyyMMdd"), F.lit(".idx"))


def weekdays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day) from first to last inclusive, without Saturdays and Sundays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.where(~F.dayofweek("day").isin(1, 7))
