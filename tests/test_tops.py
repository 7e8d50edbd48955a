"""Tops of book folded as session files are read, and the recording of these files."""

import glob
import gzip
import random

from compare import DATA
from pyspark.sql import functions as F

from newsloom.operators import book
from newsloom.plans import catalog, files_catalog
from newsloom.sources import landing, market_files

TOPS = ["session", "locate", "seq", "ts_ns", "bid_e4", "bid_size", "ask_e4", "ask_size"]


def _random_session(seed: int, n: int) -> list[bytes]:
    """Messages of three books: references beyond 2**53 and unknown ones, replacements of replacements, orders of no side or size, and stocks that change."""
    rnd, m = random.Random(seed), market_files.encode_message
    out = [m("R", 1, 0, stock="EARLY"), m("R", 2, 0, stock="TWO")]
    for i in range(n):
        ref = lambda: 2**53 + rnd.randrange(200)
        kind, locate, ts = rnd.choice("AAFECXDDDUUUPQ"), rnd.randint(1, 3), 1000 + i
        out.append(m(kind, locate, ts, ref=ref(), new_ref=ref(), side=rnd.choice("BBSS "), shares=rnd.choice([0, 1, 5, 9]), px_e4=20_000 + rnd.randrange(12) + (i if i % 2 else -i), stock="X") if kind not in "PQ" else m(kind, locate, ts, stock="OTHER"))
    return [*out, m("H", 1, 9, stock="LATE", state="H"), m("H", 2, 9), m("D", 3, 9, ref=1)[:-1]]  # the last message is cut off


def test_books_of_files_are_those_of_messages(spark, tmp_path):
    for seed, name in enumerate(("a.gz", "b.gz", "c")):
        data = b"".join(_random_session(seed, 4000))
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    (tmp_path / "empty.gz").write_bytes(gzip.compress(b""))
    for source in (market_files.SessionSource, book.TopsSource):
        spark.dataSource.register(source)
    m, got = (spark.read.format(f"exchange_{x}").load(str(tmp_path)) for x in ("session", "tops"))
    want = market_files.with_symbols(book.tops_of_book(m), m).select(*TOPS, "ticker")
    rows = sorted(map(str, want.collect()))
    assert len(rows) > 1000 and rows == sorted(map(str, got.select(*TOPS, F.col("stock").alias("ticker")).collect()))
    assert {(r.locate, r.stock) for r in got.select("locate", "stock").distinct().collect()} == {(1, "LATE"), (2, "TWO"), (3, None)}


def test_books_go_on_from_block_to_block(tmp_path, monkeypatch):
    (tmp_path / "s.gz").write_bytes(gzip.compress(b"".join(_random_session(7, 2000))))
    reader = book._TopsReader({"path": f"{tmp_path}/s.gz"})
    read = lambda: [list(r.values()) for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    whole = read()
    monkeypatch.setattr(market_files, "BLOCK", 500)
    assert len(whole) > 100 and read() == whole


def test_prices_that_come_and_go_leave_nothing():
    side = book._Side("B")
    side.add(10**6, 1)
    for i in range(10_000):
        side.add(i % 50, 1)
        side.drop(i % 50, 1)
    assert len(side.heap) < 100 and (side.px, side.size) == (10**6, 1)
    side.drop(10**6, 1)
    assert (side.px, side.size) == (None, None)


def test_no_message_is_stored_or_moved_for_tops(spark):
    """The one shuffle is that of the counting."""
    plan = catalog.queries()["q89_tops_of_book"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "exchange_tops" in plan and plan.count("Exchange ") == 1 and "Join" not in plan


def test_places_record_the_same_sessions_as_messages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files_catalog, "LOCATES", 2)  # several sessions to an initial
    d = f"{DATA}/sf0.001"
    seq = ((F.col("n") + 1).cast("bigint") * 3 + F.col("locate")) * 8 + F.col("place")
    landing.land_sessions(files_catalog._of_day(files_catalog._messages(spark, d)).withColumn("seq", seq), f"{tmp_path}/messages").collect()
    places = files_catalog._places(spark, d)
    # The tape is moved once.
    assert places._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    landing.land_sessions(places, f"{tmp_path}/places", in_order=True, made=files_catalog._made).collect()
    files = lambda at: {p.rsplit("/", 1)[-1]: gzip.open(p).read() for p in glob.glob(f"{tmp_path}/{at}/*.gz")}
    assert any("_" in name for name in files("places")) and files("places") == files("messages")
