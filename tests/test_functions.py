"""Scalar functions against expected values, nulls and blanks included."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import names, text, times, urls
from newsloom.operators import journal, market, phrases

BASE = 1_746_532_800 * 10**9  # 2025-05-06T12:00:00Z


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").coalesce(1)
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_dates(spark):
    rfc = ["Tue, 06 May 2025 12:00:00 GMT", "Tue, 06 May 2025 12:00 GMT", "06 May 2025 08:00:00 -0400", "Tue, 06 May 2025 08:00:00 EDT", "06-May-25 12:00:00 +0000", "Tue, 06 May 2025 12:00:00 XYZ", "garbage", None, ""]
    assert values(spark, times.parse_rfc822, rfc) == [BASE] * 6 + [None] * 3
    iso = ["2025-05-06T08:00:00-04:00", "2025-05-06T12:00:00Z", "2025-05-06T12:00:00", "2025-05-06 12:00:00.250Z", "2025-05-06T12:00:00.123456789123Z", "2025-05-06", "2025-13-06", "2025-05-06T12:00:00QQ", None]
    day = BASE - 12 * 3600 * 10**9
    assert values(spark, times.parse_iso8601, iso) == [BASE] * 3 + [BASE + 250_000_000, BASE + 123_456_789, day, None, None, None]
    assert values(spark, times.parse_any_datetime, [iso[0], rfc[0], "x"]) == [BASE, BASE, None]


def test_eastern(spark):
    s = 10**9
    open_ = BASE + 5400 * s
    rows = spark.createDataFrame([("05/06/2025", "09:30:00"), ("05/06/2025", "09:30:00.500"), ("5/6/2025", ""), ("x", "09:30:00"), ("05/06/2025", "x")], "d string, t string")
    midnight = BASE - 8 * 3600 * s
    assert [r[0] for r in rows.select(times.parse_eastern(F.col("d"), F.col("t"))).collect()] == [open_, open_ + 500_000_000, midnight, None, None]
    dst = [1772953140 * s, 1772953200 * s]  # 2026-03-08 06:59 and 07:00 UTC
    assert values(spark, times.eastern_hms, [open_, *dst], "bigint") == ["09:30:00", "01:59:00", "03:00:00"]
    assert values(spark, times.eastern_minute, [open_], "bigint") == [570]
    assert values(spark, times.utc_iso, [open_ + 1_999_999, None], "bigint") == ["2025-05-06T13:30:00.001Z", None]
    assert values(spark, times.volume_fraction, [0, 239, 570, 600, 960, 1200], "int") == pytest.approx([0, 0, 0.04, 0.04 + 0.92 * 0.13, 0.96, 1])


def test_entities_and_html(spark):
    assert values(spark, text.decode_entities, ["Salt&amp;Co &lt;i&gt; &#8217;n &#x2014; &mystery; &", "&amp;lt;", "", None, "&#0; &#99999999;", "&#xD800;"]) == ["Salt&Co <i> ’n — &mystery; &", "&lt;", "", None, "&#0; &#99999999;", "&#xD800;"]
    html = ["<p>Warm&nbsp;<b>bricks</b></p><script>let k=3;</script><p>Ash &amp; soot</p><!-- k -->", "a < b", "<![CDATA[<p>in</p>]]> out", "x<br/>y", "fire&shy;clay", "<style>p{}", "open <b", None, "", " <p> </p> "]
    assert values(spark, text.html_to_text, html) == ["Warm bricks Ash & soot", "a < b", "in out", "x y", "fireclay", "", "open", None, "", ""]
    assert values(spark, text.html_to_lines, ["<p>Kiln opens</p><p>It is warm</p>"]) == ["Kiln opens\nIt is warm"]
    assert values(spark, text.html_core, html[:1]) == ["Warm bricks Ash & soot"]
    assert values(spark, text.html_to_text, ["<p>" + "word " * 100_000 + "</p>"])[0] == ("word " * 100_000).strip()


def test_headlines_and_numbers(spark):
    k = values(spark, text.headline_key, ["Quill Lends 31 Kilns, Again!", "QUILL lends 31 kilns again", "Quill’s Loan", "Quill's  Loan", "", None, "x" * 2000])
    assert k[0] == k[1] and k[2] == k[3] and k[4] == "" and k[5] is None and len(k[6]) == 2000
    assert values(spark, lambda c: text.headline_key(c, 511), ["x" * 2000, "a" * 510 + " b"]) == ["x" * 511, "a" * 510]
    assert values(spark, text.parse_long, ["12", "-3", "1.5", "1x", "", None]) == [12, -3, None, None, None, None]
    assert values(spark, text.parse_double, ["1.5", "-.5", "2e3", "x", "", None]) == [1.5, -0.5, 2000.0, None, None, None]
    assert values(spark, lambda c: text.truncate_utf8(c, 5), ["abcdefg", "ééééé", "日本", "", None]) == ["abcde", "éé", "日", "", None]
    assert values(spark, text.money, [1.25e9, 12.34e6, 999.0, None], "double") == ["1.3B", "12.3M", "999", None]
    assert values(spark, text.ascii_lower, ["AÉ"]) == ["aÉ"]


def test_names(spark):
    company = ["Quillfeather Kilns, Inc. - Common Stock", "QUILLFEATHER KILNS, INC.", "The Weir's Edge Holdings Ltd.", "Salt & Tallow", "Low Tide Corp - Class B Common Stock", "Inc", None]
    assert values(spark, names.normalize_company, company) == ["QUILLFEATHER KILNS", "QUILLFEATHER KILNS", "WEIRS EDGE", "SALT AND TALLOW", "LOW TIDE", "INC", None]
    assert values(spark, names.normalize_symbol, [" brk-b ", "BRK/B", "BRK B", None]) == ["BRK.B"] * 3 + [None]
    assert values(spark, names.is_derivative, ["Quill Warrants", "Unity Corp", "Quill Unit", "Brightside Co"]) == [True, False, True, False]
    forms = ["424B5", "S-1/A", "f-3", "EFFECT", "8-K", "6-K", "NT 10-Q", "SC 13G", " S-8 POS", "DEF 14A"]
    assert values(spark, names.classify_form, forms) == ["424b", "s1", "s3", "effect", "8k", "6k", "nt", "other", "s8", "def14"]
    assert values(spark, names.items_mask, ["Item 1.01: x; ITEM 9.01", "item 6.06", None]) == [1 | 1 << 31, 0, 0]
    assert values(spark, names.items_text, [1 | 1 << 31, 0], "bigint") == ["1.01,9.01", ""]


def test_urls(spark):
    parts = values(spark, urls.url_parts, ["https://X.example/a?b#c", "http://h:81", "ftp://h/", "https://u@h/", None])
    assert [tuple(p) if p else None for p in parts] == [("https", "x.example", 443, "/a?b"), ("http", "h", 81, "/"), None, None, None]
    df = spark.createDataFrame([("https://h/a/b?q", x) for x in ("http://o/z", "//o/z", "/z", "z", "z#f")] + [("https://h", "z"), ("x", "z")], "b string, h string")
    assert [r[0] for r in df.select(urls.resolve_url(F.col("b"), F.col("h"))).collect()] == ["http://o/z", "https://o/z", "https://h/z", "https://h/a/z", "https://h/a/z", "https://h/z", None]


def test_amounts_and_tags(spark):
    amounts = ["a $31.5M kiln", "priced near US$7,100,000 in", "$2.4 billion quarry", "near $4.75 per share", "bricks for up to $12 million", "in a $9 billion addressable market", "$5 and $7 thousand", "", None, "none"]
    assert values(spark, phrases.dollar_amount, amounts) == [31.5e6, 7.1e6, 2.4e9, 0, 12e6, 0, 7000, 0, 0, 0]
    tags = values(spark, phrases.ticker_tags, ["Quill (NASDAQ: QLFK, QLFKW) and (TSXV:LODN)", "(NYSE: A and B)", "Nasdaq: The deal", "xnasdaq: AB", None, "(NYSE American: PEBL.)"])
    assert [[tuple(t) for t in x] for x in tags] == [[("US", "NASDAQ", "QLFK"), ("US", "NASDAQ", "QLFKW"), ("Foreign", "TSXV", "LODN")], [("US", "NYSE", "A"), ("US", "NYSE", "B")], [], [], [], [("US", "NYSE", "PEBL")]]


def test_tags_of_cross_listings(spark):
    texts = ["(NYSE: ABC, NASDAQ: XYZ)", "(TSX: ABC and NASDAQ: XYZ)", "(NYSE:ABC,D,TSX Venture:XYZ)", "(TSX : ABC, DEF and NYSE American : XYZ, W)", "(NASDAQ: NYSE, LSE)", "(NYSE: NASDAQ: XYZ)"]
    got = [[(t.venue, t.symbol) for t in x] for x in values(spark, phrases.ticker_tags, texts)]
    assert got == [
        [("NYSE", "ABC"), ("NASDAQ", "XYZ")], [("TSX", "ABC"), ("NASDAQ", "XYZ")], [("NYSE", "ABC"), ("NYSE", "D"), ("TSXV", "XYZ")],
        [("TSX", "ABC"), ("TSX", "DEF"), ("NYSE", "XYZ"), ("NYSE", "W")], [("NASDAQ", "NYSE"), ("NASDAQ", "LSE")], [("NASDAQ", "XYZ")],
    ]


def test_phrases(spark):
    df = spark.createDataFrame([(1, "FDA approves a kiln lining in a large amount"), (2, "stands at-the-market all day; AT THE MARKET"), (3, None), (4, ""), (5, "...")], "id long, t string")
    got = sorted(tuple(r) for r in phrases.match_phrases(df, ["fda approv*", "mou", "at the market", "approves"], id_col="id", text_col="t").select("id", "rule", "n").collect())
    assert got == [(1, 0, 1), (1, 3, 1), (2, 2, 2)]
    with pytest.raises(ValueError):
        phrases.match_phrases(df, ["x"] * (phrases.MOST_RULES + 1), id_col="id", text_col="t")


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("# comment\ncat:fda\t72\tfda approval\n\nhedge\t-4\tcould\n")
    rows = phrases.read_rules(spark, str(tmp_path / "r.tsv")).orderBy("rule_id").collect()
    assert [(r.kind, r.label, r.weight, r.phrase) for r in rows] == [("cat", "fda", 72, "fda approval"), ("hedge", None, -4, "could")]
    (tmp_path / "bad.tsv").write_text("what\t1\tx\n")
    with pytest.raises(ValueError):
        phrases.read_rules(spark, str(tmp_path / "bad.tsv"))


def test_histogram_buckets(spark):
    xs = [0, 1, 15, 16, 17, 31, 32, 33, 1000, 123_456_789]
    b = values(spark, journal.log_bucket, xs, "bigint")
    top = values(spark, lambda c: journal.bucket_top(journal.log_bucket(c)), xs, "bigint")
    assert b == sorted(b) and all(x <= t <= x * 17 / 16 + 1 for x, t in zip(xs, top, strict=True))


def test_quotes(spark):
    df = spark.createDataFrame([(1.0, 1.1), (0.0, 1.0), (2.0, 1.0)], "b double, a double")
    assert [round(r[0], 4) for r in df.select(market.spread_pct(F.col("b"), F.col("a"))).collect()] == [9.5238, 0, 0]


def test_json_values(spark):
    docs = ['{"a":{"n":9007199254740993,"s":["x\\"y",null]}}', '﻿{"a":{"n":"7"}}', '{"a":{"n":1.5}}', "{broken", "", None, '{"a":null}', '{"a":{"s":["null"]}}']
    assert values(spark, lambda c: text.json_value(c, "$.a.n", "bigint"), docs)[:2] == [2**53 + 1, 7]
    assert values(spark, lambda c: text.json_value(c, "$.a.s[0]"), docs) == ['x"y', None, None, None, None, None, None, "null"]
    assert values(spark, lambda c: text.json_value(c, "$.a.s[1]"), docs) == [None] * 8


def test_ids_and_characters(spark):
    assert values(spark, text.hex_id, [255, -1, None], "bigint") == ["00000000000000ff", "f" * 16, None]
    assert values(spark, text.utf8_char, [65, 0xE9, 0x20AC, 0x1F680, 0xD800, 0x110000, -1, None], "int") == ["A", "é", "€", "🚀", None, None, None, None]
    assert values(spark, text.json_escaped, ['a"b\\\n', "", None]) == ['a\\"b\\\\\\n', "", None]
    assert values(spark, times.parse_ymd, ["2025-02-28", "20250228", "2025-02-30", "x", None])[2:] == [None, None, None]
    assert values(spark, lambda c: names.ordinal(c, names.TIERS), ["HIGH", "NONE", "x", None]) == [3, 0, None, None]
    assert values(spark, names.distressed, ["N", " ", "", None, "D"]) == [False, False, False, False, True]


def test_json_values_beyond_64_bits(spark, tmp_path):
    """The first id whose number is beyond 64 bits: every row comes, that one's number is no bigint."""
    from newsloom.plans import catalog, more_catalog  # noqa: F401

    spark.createDataFrame([(92230, "a", 1), (92231, "b", 2)], "signal_id long, title string, score int").write.parquet(f"{tmp_path}/signals.parquet")
    got = sorted((r.signal_id, r.big, r.said) for r in catalog.queries()["q132_json_values"](spark, str(tmp_path)).collect())
    assert got == [(92230, 92230 * 1000000007 * 100003 + 1, "a"), (92231, None, "b")]
