"""Story feeds in Atom, filing headlines and tickers, minute lookups, names of files, intraday RVOL."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.operators import market
from newsloom.sources import feeds

BASE = 1_746_532_800 * 10**9
M = market.MINUTE
ATOM = """<feed xmlns:a10="http://a/"><title>Feed</title><entry><id>u1</id><title>Quill (NASDAQ: QLFK) Signs</title><link rel="self" href="https://w/self"/><link rel="alternate" href="https://w/1"/><category term="NYSE:TARN"/>
<published>2025-05-06T08:00:00-04:00</published><updated>2025-05-07T08:00:00-04:00</updated><summary> </summary><content type="html">&lt;p&gt;Body (TSX: LODN)&lt;/p&gt;</content></entry>
<entry><id>u2</id><title>b</title><link href="https://w/2"/><published>?</published><updated>2025-05-06T12:00:00Z</updated><summary>sum</summary><content>no</content></entry></feed>"""
RSS = """<rss xmlns:a10="http://a/"><channel><item><guid>1</guid><link>https://w/3</link><title>c</title><a10:updated>2025-05-06T12:00:00Z</a10:updated><content>text</content></item></channel></rss>"""
FILINGS = """<feed><entry><title>8-K - QUILL (0000000007) (Filer)</title><link href="s"/><summary>Item 1.01: x Item 8.01: y Item 9.01: z</summary><updated>2025-05-06T08:00:00-04:00</updated><id>u1</id></entry>
<entry><title>S-3 - TARNWATER (0000000008) (Filer)</title><link href="t"/><updated>2025-05-06T08:00:00-04:00</updated><id>u2</id></entry></feed>"""


def test_atom_stories(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(ATOM)
    (tmp_path / "in" / "r.xml").write_text(RSS)
    got = {r.title: r for r in feeds.story_items(spark, str(tmp_path / "in")).collect()}
    first, second, third = got["Quill (NASDAQ: QLFK) Signs"], got["b"], got["c"]
    assert len(got) == 3 and [r.published_ns for r in (first, second, third)] == [BASE] * 3
    assert [(r.link, r.body) for r in (first, second, third)] == [("https://w/1", "Body (TSX: LODN)"), ("https://w/2", "sum"), ("https://w/3", "text")]
    assert [t.symbol for t in first.tags] == ["TARN", "QLFK", "LODN"]
    assert len({r.id for r in got.values()}) == 3


def test_filing_headline_and_tickers(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FILINGS)
    master = spark.createDataFrame([(7, "QLFW", "Quill Warrants", True, 1), (7, "QLFKA", "Quill", True, 2), (7, "QLFK", "Quill", True, 3)], "cik long, ticker string, security_name string, listed boolean, load_order int")
    got = sorted(tuple(r) for r in feeds.with_issuer_tickers(feeds.filing_entries(spark, str(tmp_path / "f.xml")), master).select("cik", "headline", "tickers").collect())
    assert got == [(7, "8-K QUILL: Entry into a Material Definitive Agreement; Other Events", ["QLFK", "QLFW", "QLFKA"]), (8, "S-3 TARNWATER", [])]


def test_minute_lookups(spark):
    bars = spark.createDataFrame([("A", 0, 5, 100), ("A", M, 7, 110), ("A", 90 * M, 11, 120), ("B", M, 1, 10)], "ticker string, minute_ns long, volume long, close_e4 int")
    asked = spark.createDataFrame([("A", 0), ("A", M), ("A", 2 * M), ("A", 91 * M), ("B", 0), ("C", 0)], "ticker string, at long")
    assert sorted(tuple(r) for r in market.since_minute(bars, asked, from_ns="at").collect()) == [("A", 0, 23), ("A", M, 18), ("A", 2 * M, 11), ("A", 91 * M, 0), ("B", 0, 1), ("C", 0, 0)]
    assert sorted(tuple(r) for r in market.price_at_minute(bars, asked, at_ns="at").collect()) == [("A", 0, 100), ("A", M, 110), ("A", 2 * M, 110), ("A", 91 * M, 120), ("B", 0, 0), ("C", 0, 0)]


def test_rvol_and_names(spark):
    df = spark.createDataFrame([(100, 1000.0, 960), (100, 1000.0, 0), (100, 0.0, 960), (100, None, 960)], "v long, adv double, m int")
    assert [r[0] for r in df.select(market.rvol(F.col("v"), F.col("adv"), F.col("m"))).collect()] == pytest.approx([100 / 960, 50, 0, 0])
    f = spark.createDataFrame([("edgar/data/7/0001-26-000002.txt", "/x/05062025.NASDAQ_ITCH50.gz"), ("a", "x/0506"), (None, None)], "a string, b string")
    assert [tuple(r) for r in f.select(urls.accession(F.col("a")), urls.session_name_date(F.col("b"))).collect()] == [("0001-26-000002", "2025-05-06"), ("a", None), (None, None)]
    assert spark.range(1).select(urls.date_session_name(F.lit("2025-05-06")), urls.date_session_name(F.lit("x"))).first() == ("05062025", None)
