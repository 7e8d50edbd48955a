"""Readers and writers on small made-up files."""

import gzip

from pyspark.sql import functions as F

from newsloom.operators import market, stories
from newsloom.sources import feeds, journal_files, market_files, reference_files

BASE = 1_746_532_800 * 10**9


def put(path, content):
    path.write_text(content)
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_directories(spark, tmp_path):
    n = put(tmp_path / "n.txt", "Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares\nQLFK|Quillfeather Kilns, Inc. - Common Stock|S|N|N|100|N|N\nWWWX|A Fund|G|N||100|Y|N\nWEIR|Test|Q|Y|D|x|N|N\nFile Creation Time: 0506202521:31||||||\n")
    assert rows(reference_files.nasdaq_listed(spark, n), "ticker", "exchange", "financial_status", "etf", "test_issue", "round_lot") == [("QLFK", "Nasdaq CM", "N", False, False, 100), ("WEIR", "Nasdaq GS", "D", False, True, None), ("WWWX", "Nasdaq GM", None, True, False, 100)]
    o = put(tmp_path / "o.txt", "ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol\nBRK.B|Big|N|BRK.B|N|1|N|BRK-B\nFOX$A|Fox|A|FOXpA|N|100|N|FOX-A\nFile Creation Time: x|||||||\n")
    assert rows(reference_files.other_listed(spark, o), "ticker", "alias", "exchange") == [("BRK.B", "BRK.B", "NYSE"), ("FOX$A", "FOX$A", "NYSE American"), ("FOX$A", "FOX.A", "NYSE American"), ("FOX$A", "FOXPA", "NYSE American")]


def test_issuers_and_numbers(spark, tmp_path):
    j = put(tmp_path / "i.json", '{"fields":["cik","name","ticker","exchange"],\n"data":[[8800417,"Quill \\"K\\" é","qlfk","Nasdaq"],[1,"x","brk-b",null]]}')
    issuers = reference_files.issuer_map(spark, j)
    assert rows(issuers, "cik", "security_name", "ticker", "exchange") == [(1, "x", "BRK.B", None), (8800417, 'Quill "K" é', "QLFK", "Nasdaq")]
    f = put(tmp_path / "f.tsv", "8800417\t12000000\t2026-06-30\t0\t\nx\t1\t\t\t\n")
    got = reference_files.with_fundamentals(issuers, reference_files.fundamentals(spark, f))
    assert rows(got.where("cik > 1"), "ticker", "shares_outstanding", "public_float_usd") == [("QLFK", 12e6, None)]
    s = put(tmp_path / "s.txt", "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20250505|QLFK|40000|0|100000|B,Q,N\n20250505|NOPE|1|0|0|Q\n")
    assert rows(reference_files.short_volume(spark, s), "ticker", "short_ratio") == [("NOPE", None), ("QLFK", 0.4)]
    frames = spark.createDataFrame([(1, 5.0, "2026-03-31", 1), (1, 6.0, "2026-06-30", 2), (1, 7.0, "2026-06-30", 3)], "cik long, val double, end string, load_order int")
    assert rows(reference_files.newest_frames(frames), "cik", "val") == [(1, 6.0)]


def test_filing_index(spark, tmp_path):
    m = put(tmp_path / "m.idx", "Description: index\n\nCIK|Company Name|Form Type|Date Filed|File Name\n------\n8800523|TARNWATER|424B5|20250505|edgar/a.txt\n8800523|TARNWATER|S-3|2025-05-05|edgar/b.txt\n3333333|C|PRE 14A|2025-05-05|edgar/c.txt\n2222222|D|4|2025-05-05|edgar/d.txt\n2222222|D|10-Q|2025-05-05|e.txt\n5|E|S-1|2026-02-31|f.txt\n")
    assert rows(reference_files.master_index(spark, m), "cik", "cls") == [(3333333, "pre14"), (8800523, "424b"), (8800523, "s3")]


RSS = """<rss><channel><title>t</title><item><guid isPermaLink="false">1</guid><link> https://w/1 </link><category>Nasdaq:QLFK</category><title><![CDATA[Quill Lends &amp; Waits]]></title>
<description>&lt;p&gt;Quill (NASDAQ: QLFK), (TSXV: LODN) says &amp;quot;warm&amp;quot;&lt;/p&gt;</description><pubDate>Tue, 06 May 2025 12:00 GMT</pubDate></item>
<item><guid>2</guid><title> </title></item></channel></rss>"""
ATOM = """<feed><entry><title>8-K - QUILLFEATHER KILNS, INC. (0008800417) (Filer)</title><link rel="self" href="s"/><link rel="alternate" href="https://s/x-index.htm"/>
<summary type="html"> &lt;b&gt;Filed&lt;/b&gt; Item 1.01: Entry&lt;br&gt;Item 9.01: Exhibits</summary><updated>2025-05-06T08:00:00-04:00</updated><id>u1</id></entry><entry><title>bad</title><id>u2</id></entry></feed>"""
HALT = """<rss xmlns:ndaq="http://n/"><channel><item><title>QLFK</title><ndaq:HaltDate>05/06/2025</ndaq:HaltDate><ndaq:HaltTime>08:00:00</ndaq:HaltTime><ndaq:IssueSymbol>qlfk</ndaq:IssueSymbol><ndaq:Market>NASDAQ</ndaq:Market><ndaq:ReasonCode>LUDP</ndaq:ReasonCode><ndaq:PauseThresholdPrice>3.15</ndaq:PauseThresholdPrice>{}</item><item><title>x</title></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    got = feeds.rss_items(spark, put(tmp_path / "r.xml", RSS)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.title, r.link, r.published_ns, r.body) == ("Quill Lends & Waits", "https://w/1", BASE, 'Quill (NASDAQ: QLFK), (TSXV: LODN) says "warm"')
    assert [t.symbol for t in r.tags] == ["QLFK", "LODN"]
    assert rows(feeds.filing_entries(spark, put(tmp_path / "a.xml", ATOM)), "form", "company", "cik", "role", "items", "link", "published_ns") == [("8-K", "QUILLFEATHER KILNS, INC.", 8800417, "Filer", 1 | 1 << 31, "https://s/x-index.htm", BASE)]
    a = feeds.halt_items(spark, put(tmp_path / "h.xml", HALT.format(""))).collect()
    b = feeds.halt_items(spark, put(tmp_path / "h2.xml", HALT.format("<ndaq:ResumptionTradeTime>08:05:00</ndaq:ResumptionTradeTime>"))).collect()
    assert [(x.ticker, x.kind, x.halt_ns, x.resume_trade_ns, x.pause_threshold) for x in a + b] == [("QLFK", "HALT", BASE, None, 3.15), ("QLFK", "RESUME", BASE, BASE + 300 * 10**9, 3.15)]
    assert a[0].id != b[0].id


def test_tags_are_resolved_before_they_are_capped(spark, tmp_path):
    many = "".join(f"<category>TSX:F{i:02}</category>" for i in range(20))
    x = feeds.rss_items(spark, put(tmp_path / "m.xml", f"<rss><channel><item><guid>1</guid><title>Quill (NASDAQ: QLFK)</title>{many}</item></channel></rss>"))
    assert rows(x, F.size("tags")) == [(21,)]
    got = stories.resolve_tags(x, spark.createDataFrame([("QLFK",)], "ticker string"), id_col="id", most=6, most_unresolved=3).first()
    assert (got.tickers, got.unresolved) == (["QLFK"], ["TSX:F00", "TSX:F01", "TSX:F02"])
    every = stories.resolve_tags(x, spark.createDataFrame([("QLFK",)], "ticker string"), id_col="id").first()
    assert len(every.unresolved) == 20


def test_pages_and_rebuild(spark):
    index_page = '<div class="infoHead">Accepted</div>\n<div class="info">2025-05-06 08:00:00</div><div>Item 1.01: x<br />Item 9.01: y</div><table><tr><td><a href="/ix?doc=/d/main.htm">m</a></td><td>8-K</td></tr><tr><td><a href="/d/ex10.htm">e</a></td><td>EX-10.1</td></tr><tr><td><a href="/d/ex99-2.htm">f</a></td><td>EX-99.2</td></tr><tr><td><a href="/d/ex99-1.htm">g</a></td><td>EX-99.1</td></tr></table>'
    exhibit = "<p><b>Exhibit 99.1</b></p><p>Short</p><p>Quillfeather Kilns Lends 31 Kilns Upriver</p><p>UPPER WEIR</p>"
    pages = spark.createDataFrame([("https://s/d/x-index.htm", index_page), ("https://s/d/ex99-1.htm", exhibit), ("https://s/d/y-index.htm", "no time")], "url string, body string")
    index = spark.createDataFrame([(1, "QUILL", "8-K", "d/x.txt"), (2, "B", "8-K", "d/y.txt"), (3, "C", "8-K", "d/z.txt")], "cik long, company string, form string, file string")
    got = rows(feeds.rebuild_filings(index, pages, "https://s"), "cik", "kind", "recv_ns", "items", "title")
    assert got == [(1, "exhibit", BASE + 32 * 10**9, 1 | 1 << 31, "Quillfeather Kilns Lends 31 Kilns Upriver"), (1, "filing", BASE + 30 * 10**9, 1 | 1 << 31, None)]


def test_bridge_and_tape(spark, tmp_path):
    lines = spark.createDataFrame([("T QLFK 2.40 100 5",), ("Q QLFK 2.39 10 2.41 20",), ("H QLFK H LUDP",), ("T QLFK x 1",), ("",), ("Z 1",)], "value string")
    got = market_files.bridge_lines(lines)
    assert rows(got.where("kind is not null"), "kind", "ticker", "ts_ns", "px_e4", "shares", "bid_e4", "ask_e4", "state") == [("H", "QLFK", None, None, None, None, None, "H"), ("Q", "QLFK", None, None, None, 23900, 24100, None), ("T", "QLFK", 5, 24000, 100, None, None, None)]
    assert got.where("kind is null").count() == 3
    with gzip.open(tmp_path / "t.gz", "wt") as f:
        f.write("100 T QLFK 2.00 5\n200 Q QLFK 1 1 2 2\n")
    assert rows(market_files.read_tape(spark, str(tmp_path / "t.gz")), "kind", "ts_ns") == [("Q", 200), ("T", 100)]


def at(h, m):
    return (h * 60 + m) * 60 * 10**9


def test_exchange_session(spark, tmp_path):
    e = market_files.encode_message
    msgs = [
        e("S", 0, at(3, 0), code="O"), e("R", 1, at(3, 0), stock="QLFK", category="S", status="N", shares=100), e("R", 2, at(3, 0), stock="MOSS"), e("A", 1, at(8, 0), ref=1, side="B", shares=1000, px_e4=20000),
        e("A", 1, at(8, 0), ref=2, side="S", shares=500, px_e4=21000), e("E", 1, at(8, 1), ref=1, shares=300), e("C", 1, at(8, 2), ref=2, shares=200, printable="Y", px_e4=20500), e("C", 1, at(8, 2), ref=2, shares=100, printable="N", px_e4=20500),
        e("X", 1, at(8, 3), ref=1, shares=200), e("U", 1, at(8, 4), ref=1, new_ref=3, shares=400, px_e4=22000), e("Q", 1, at(9, 30), shares=5000, stock="QLFK", px_e4=22500, code="O"), e("E", 1, at(9, 31), ref=3, shares=400),
        e("D", 1, at(9, 32), ref=2), e("P", 1, at(9, 33), side="B", shares=1000, stock="QLFK", px_e4=23000), e("E", 1, at(9, 34), ref=99, shares=7), e("H", 1, at(9, 34), stock="QLFK", state="H", reason="LUDP"),
    ]
    with gzip.open(tmp_path / "s1.gz", "wb") as f:
        f.write(b"".join(msgs) + b"\x00\x24A")  # a truncated end
    (tmp_path / "s2.bin").write_bytes(b"".join(msgs[:1]) + b"\x00\x02zz")  # an unknown type
    spark.dataSource.register(market_files.SessionSource)
    m = spark.read.format("exchange_session").option("path", f"{tmp_path}/s1.gz,{tmp_path}/s2.bin").load()
    assert m.count() == len(msgs) + 1
    p = market_files.session_prints(m)
    assert rows(p.groupBy("locate").agg(F.sum("shares"), F.max("px_e4"), F.min("px_e4")), "*") == [(1, 6900, 23000, 20000)]
    h = m.where("type = 'H'").first()
    assert (h.stock, h.state, h.reason, h.seq) == ("QLFK", "H", "LUDP", 15)
    assert rows(market_files.missing_symbols(m, spark.createDataFrame([("QLFK",)], "ticker string")), "ticker") == [("MOSS",)]


def test_sequence_gaps(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 1), ("a", 3, 1), ("a", 6, 2), ("a", 5, 1), ("b", 10, 1), (None, 1, 1), ("b", None, 1), ("b", 2_000_011, 5)], "s string, q long, c int")
    assert rows(market.sequence_gaps(df, stream="s", seq="q", count="c"), "s", "from_seq", "lost") == [("a", 4, 1), ("b", 11, 2_000_000)]


def test_journal_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("close", "QLFK", BASE, 1.5, None), ("open", "QLFK", BASE + 86_400 * 10**9, None, "x")], "event string, ticker string, exit_ns bigint, pnl_usd double, tier string")
    journal_files.write_journal(t, str(tmp_path), "trades", time_ns="exit_ns")
    with gzip.open(next((tmp_path / "trades" / "day=2025-05-06").glob("*.gz")), "rt") as f:
        assert "tier" not in f.read()
    (tmp_path / "trades" / "day=2025-05-07" / "z.json").write_text("{broken\n")
    back = journal_files.read_journal(spark, str(tmp_path), "trades").cache()
    assert back.where("_corrupt is not null").count() == 1
    assert rows(journal_files.closed_trades(back), "ticker", "exit_ns", "pnl_usd", "tier") == [("QLFK", BASE, 1.5, None)]
    assert rows(journal_files.read_journal(spark, str(tmp_path), "trades", "2025-05-07", "2025-05-11").where("event is not null"), "event") == [("open",)]


def test_session_store_replaces_days(spark, tmp_path):
    a = spark.createDataFrame([("A", "2026-01-01", 1), ("A", "2026-01-02", 2)], "ticker string, day string, volume int")
    journal_files.store_sessions(a, f"{tmp_path}/b")
    journal_files.store_sessions(spark.createDataFrame([("A", "2026-01-02", 3)], a.schema), f"{tmp_path}/b")
    assert rows(spark.read.parquet(f"{tmp_path}/b"), "volume") == [(1,), (3,)]
