"""Books, tags, names, replay, rule totals and settings."""

import pytest
from pyspark.sql import functions as F

from newsloom.config import Config
from newsloom.operators import book, phrases, stories
from newsloom.sources import feeds


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


MESSAGES = "session string, locate int, seq bigint, ts_ns bigint, type string, ref bigint, new_ref bigint, side string, shares bigint, px_e4 bigint"


def test_books(spark):
    m = [
        (0, "A", 1, None, "B", 100, 20000), (1, "A", 2, None, "S", 50, 21000), (2, "A", 3, None, "B", 10, 19000), (3, "E", 1, None, None, 40, None), (4, "X", 9, None, None, 5, None),
        (5, "U", 1, 4, None, 30, 20500), (6, "D", 2, None, None, None, None), (7, "E", 4, None, None, 99, None), (8, "P", None, None, "B", 1, 1),
    ]
    df = spark.createDataFrame([("s", 1, q, q * 10, k, r, n, s, sh, px) for q, k, r, n, s, sh, px in m] + [("s", 2, 9, 90, "A", 7, None, "S", 5, 100), ("s", 2, 10, 91, "A", 8, None, None, 5, 100)], MESSAGES)
    tops = rows(book.tops_of_book(df), "locate", "seq", "bid_e4", "bid_size", "ask_e4", "ask_size")
    want = [(1, 0, 20000, 100, None, None), (1, 1, 20000, 100, 21000, 50), (1, 3, 20000, 60, 21000, 50), (1, 5, 20500, 30, 21000, 50), (1, 6, 20500, 30, None, None), (1, 7, 19000, 10, None, None), (2, 9, None, None, 100, 5)]
    assert tops == sorted(want, key=str)
    assert rows(book.depth_after(df.where("side is not null or type <> 'A'")), "locate", "side", "px_e4", "shares") == [(1, "B", 19000, 10), (2, "S", 100, 5)]
    assert book.tops_of_book(df.limit(0)).count() == 0


def test_book_equals_plain_replay_at_random(spark):
    import random

    rnd, out, orders, levels, want, top = random.Random(4), [], {}, {"B": {}, "S": {}}, [], None
    for q in range(600):
        kind = rnd.choice("AAAEXDU")
        ref = rnd.choice(list(orders)) if orders and rnd.random() < 0.9 else 10**6
        if kind == "A":
            row = (q, q, "A", q, None, rnd.choice("BS"), rnd.randint(1, 9), rnd.randint(1, 20))
            orders[q] = [row[5], row[7], row[6]]
        elif kind == "U":
            row = (q, q, "U", ref, q, None, rnd.randint(1, 9), rnd.randint(1, 20))
            if ref in orders:
                orders[q] = [orders.pop(ref)[0], row[7], row[6]]
        else:
            row = (q, q, kind, ref, None, None, rnd.randint(1, 5), None)
            if ref in orders:
                orders[ref][2] -= row[6]
                if kind == "D" or orders[ref][2] <= 0:
                    del orders[ref]
        out.append(("s", 1, *row))
        for s in "BS":
            levels[s] = {}
        for s, p, n in orders.values():
            levels[s][p] = levels[s].get(p, 0) + n
        b, a = max(levels["B"], default=None), min(levels["S"], default=None)
        now = (b, levels["B"].get(b), a, levels["S"].get(a))
        if now != (top or (None,) * 4):
            want.append((q, *now))
        top = now
    df = spark.createDataFrame(out, MESSAGES)
    got = sorted(tuple(r) for r in book.tops_of_book(df).select("seq", "bid_e4", "bid_size", "ask_e4", "ask_size").collect())
    assert got == want


def test_depth_equals_plain_replay_with_chains_of_replacements(spark):
    import random

    rnd, out, orders = random.Random(5), [], {}
    for q in range(800):
        kind = rnd.choice("AAUUUUEXD")
        ref = rnd.choice(list(orders)) if orders and rnd.random() < 0.9 else rnd.randrange(q + 1)
        new = kind in "AU"
        row = (q, q, kind, q if kind == "A" else ref, q if kind == "U" else None, rnd.choice("BS") if kind == "A" else None, rnd.randint(1, 9) if kind != "D" else None, rnd.randint(1, 20) if new else None)
        out.append(("s", q % 2, *row))
        book_of = lambda r: r[0] == q % 2  # noqa: B023, E731
        if kind == "A":
            orders[q] = (q % 2, row[5], row[7], row[6])
        elif ref in orders and book_of(orders[ref]):
            locate, side, price, have = orders.pop(ref)
            if kind == "U":
                orders[q] = (locate, side, row[7], row[6])
            elif kind != "D" and have > row[6]:
                orders[ref] = (locate, side, price, have - row[6])
    want = {}
    for locate, side, price, n in orders.values():
        want[locate, side, price] = want.get((locate, side, price), 0) + n
    got = rows(book.depth_after(spark.createDataFrame(out, MESSAGES)), "locate", "side", "px_e4", "shares")
    assert got == sorted(((*k, n) for k, n in want.items()), key=str) and got
    chain = [("s", 1, 0, 0, "A", 1, None, "B", 100, 20000), ("s", 1, 1, 1, "U", 1, 2, None, 90, 20000), ("s", 1, 2, 2, "U", 2, 3, None, 80, 20100), ("s", 1, 3, 3, "E", 3, None, None, 10, None)]
    assert rows(book.depth_after(spark.createDataFrame(chain, MESSAGES)), "side", "px_e4", "shares") == [("B", 20100, 70)]


def test_tags_and_names(spark):
    s = spark.createDataFrame([(1, "x (NASDAQ: QLFK, NOPE) (TSXV: LODN)"), (2, "none"), (3, None)], "id long, t string").withColumn("tags", phrases.ticker_tags(F.col("t")))
    master = spark.createDataFrame([("QLFK",), ("LODN",), (None,)], "ticker string")
    assert rows(stories.resolve_tags(s, master, id_col="id"), "id", "tickers", "unresolved") == [(1, ["QLFK"], ["NOPE", "TSXV:LODN"]), (2, [], []), (3, [], [])]
    n = spark.createDataFrame([(1, ["Quillfeather Kilns, Inc."], "x", "y"), (2, None, "Tarn Water Opens Lock", None), (3, None, None, "UPPER WEIR -- Quillfeather Kilns, Inc. (the) today"), (4, None, "zzz", "")], "id long, c array<string>, t string, b string")
    n = n.withColumn("candidates", stories.name_candidates(F.col("c"), F.col("t"), F.col("b")))
    unique = spark.createDataFrame([("QUILLFEATHER KILNS", "QLFK"), ("TARN WATER", "TARN")], "company string, ticker string")
    assert rows(stories.resolve_names(n, unique, id_col="id"), "id", "ticker") == [(1, "QLFK"), (2, "TARN"), (3, "QLFK")]


def test_replay_and_intervals(spark):
    news = spark.createDataFrame([("b", 5, ["X", "A"]), ("a", 5, ["B", "A"]), ("z", 0, ["A"]), ("c", 1, None)], "id string, recv_ns long, tickers array<string>")
    master = spark.createDataFrame([("A",), ("B",)], "ticker string")
    got = [tuple(r) for r in stories.replayed(news, master, delay_ns=-3).select("id", "recv_ns", "tickers", "n_dropped").collect()]
    assert got == [("c", 0, [], 0), ("a", 2, ["B", "A"], 0), ("b", 2, ["A"], 1)]
    e = spark.createDataFrame([("A", 5), ("A", 10), ("A", 16), ("B", 5), (None, 5)], "k string, t long")
    o = spark.createDataFrame([("A", 5), (None, 1)], "k string, o long")
    assert rows(stories.during(e, o, key="k", event_time="t", opened="o", length=10), "k", "t") == [("A", 10)]


def test_rule_totals(spark):
    rules = spark.createDataFrame([(0, "cat", "kiln", 60, "firing"), (1, "cat", "loan", 63, "lease"), (2, "spec", None, 9, "glazed"), (3, "spec", None, 9, "hallmark"), (4, "tier1", None, 7, "guild")], "rule_id long, kind string, label string, weight int, phrase string")
    df = spark.createDataFrame([(1, "Firing", "lease glazed, hallmark, glazed by guild"), (2, "", "nothing")], "id long, t string, b string")
    words = [r.phrase for r in rules.orderBy("rule_id").collect()]
    hits = lambda c: phrases.match_phrases(df, words, id_col="id", text_col=c)
    got = stories.rule_totals(hits("t"), hits("b"), rules, id_col="id", sums={"spec": (0, 15)}, extremes={"tier1": "max"})
    assert rows(got, "id", "category", "category_weight", "n_rules", "spec", "tier1") == [(1, "kiln", 65, 5, 15, 7)]


def test_small_pieces(spark):
    df = spark.createDataFrame([("ludp ",), ("T1",), ("??",), (None,)], "c string")
    assert [r[0] for r in df.select(feeds.halt_reason(F.col("c"))).collect()] == ["Volatility trading pause (LULD)", "News pending", "Other", "Other"]
    assert [str(r[0]) for r in feeds.weekdays(spark, "2025-05-09", "2025-05-12").collect()] == ["2025-05-09", "2025-05-12"]
    assert spark.range(1).select(feeds.index_url("https://s/", F.lit("2025-05-05").cast("date"))).first()[0] == "https://s/edgar/daily-index/2025/QTR2/master.20250505.idx"


def test_settings():
    c = Config.parse('# c\n[kiln]\nheat = 40 ; note\nname = "a # b"\n[loan desk]\nurl=https://x#y\non = yes\n')
    c.override("kiln.heat=65")
    assert (c.get("kiln", "heat", 0), c.get("kiln", "name"), c.get("loan desk", "url"), c.get("loan desk", "on", False), c.get("x", "y", 1.5)) == (65, "a # b", "https://x#y", True, 1.5)
    assert c.sections == [("kiln", ""), ("loan", "desk")]
    with pytest.raises(ValueError):
        Config.parse("what")
