"""Exchange sessions whose gzip stream breaks off."""

import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from newsloom.operators import book, ordered
from newsloom.sources import landing, market_files, packets


def test_truncated_gzip_gives_all_whole_messages(spark, tmp_path):
    rnd = random.Random(6)
    msgs = [market_files.encode_message("A", 1, i, ref=rnd.getrandbits(60), side="B", shares=rnd.getrandbits(30), px_e4=rnd.getrandbits(30)) for i in range(30_000)]
    whole = gzip.compress(b"".join(msgs))
    for name, cut in (("tail", len(whole) - 4), ("near", len(whole) - 20), ("half", len(whole) // 2)):
        (tmp_path / f"{name}.gz").write_bytes(whole[:cut])
    spark.dataSource.register(market_files.SessionSource)
    m = spark.read.format("exchange_session").option("path", ",".join(f"{tmp_path}/{n}.gz" for n in ("tail", "near", "half"))).load()
    got = {r.session: r["count"] for r in m.groupBy("session").count().collect()}
    inflated = lambda data: len(zlib.decompressobj(31).decompress(data))
    assert got == {"tail": 30_000, "near": inflated(whole[:-20]) // len(msgs[0]), "half": inflated(whole[: len(whole) // 2]) // len(msgs[0])}


def test_more_than_a_block(tmp_path):
    msg = market_files.encode_message("D", 1, 5, ref=7)
    n = market_files.BLOCK // len(msg) * 2 + 11
    whole = gzip.compress(msg * n)
    for name, data in (("whole", whole), ("cut", whole[:-1])):
        (tmp_path / name).write_bytes(data)
        with gzip.open(tmp_path / name, "rb") as f:
            seqs = [b.column("seq") for b in market_files.read_messages(f, "s")]
        assert sum(map(len, seqs)) == n and seqs[-1][-1].as_py() == n - 1


class Failing(io.RawIOBase):
    """A stream whose second read fails."""

    def __init__(self, data):
        self.data, self.reads = data, 0

    def readable(self):
        return True

    def readinto(self, into):
        self.reads += 1
        if self.reads > 1:
            raise OSError("disk gone")
        n = min(len(into), len(self.data))
        into[:n] = self.data[:n]
        return n


def test_a_failing_read_is_an_error():
    msg = market_files.encode_message("D", 1, 5, ref=7)
    with pytest.raises(OSError, match="disk gone"):
        list(market_files.read_messages(io.BufferedReader(Failing(msg * 500), 1 << 12), "s"))


def test_folders_and_patterns(spark, tmp_path):
    msg = market_files.encode_message("D", 1, 5, ref=7)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a1.gz", "a2.gz", "sub/b.gz", "_ignored.gz"):
        (tmp_path / "in" / name).write_bytes(gzip.compress(msg))
    files = lambda p: [f.rsplit("/", 1)[-1] for f in market_files.session_files(p)]
    assert files(f"{tmp_path}/in") == ["a1.gz", "a2.gz", "b.gz"] and files(f"{tmp_path}/in/a*.gz") == ["a1.gz", "a2.gz"] and files(f"file://{tmp_path}/in/a1.gz") == ["a1.gz"]
    spark.dataSource.register(market_files.SessionSource)
    assert spark.read.format("exchange_session").load(f"file://{tmp_path}/in").count() == 3


def test_references_beyond_doubles_survive_beside_nulls(spark):
    """A replacement's new reference shares its column with nulls; the delete of it must hit."""
    big = 2**53 + 1
    rows = [("s", 1, 1, 0, "A", big - 2, None, "B", 10, 500), ("s", 1, 2, 0, "U", big - 2, big, None, 8, 600), ("s", 1, 3, 0, "A", big - 1, None, "B", 5, 400), ("s", 1, 4, 0, "D", big, None, None, None, None)]
    m = spark.createDataFrame(rows, "session string, locate int, seq long, ts_ns long, type string, ref long, new_ref long, side string, shares long, px_e4 long")
    tops = [(r.seq, r.bid_e4, r.bid_size) for r in book.tops_of_book(m).orderBy("seq").collect()]
    assert tops == [(1, 500, 10), (2, 600, 8), (4, 400, 5)]
    assert [(r.px_e4, r.shares) for r in book.depth_after(m).collect()] == [(400, 5)]


def test_recorded_sessions_read_back(spark, tmp_path):
    rows = [("s1", 1, 1, 9, "A", 2**60 + 1, "B", 10, 500, None), ("s1", 2, 1, 10, "D", 2**60 + 1, None, None, None, None), ("s2", 1, 7, 1, "R", None, None, 100, None, "QLFK")]
    m = spark.createDataFrame(rows, "session string, seq long, locate int, ts_ns long, type string, ref long, side string, shares long, px_e4 long, stock string")
    assert sorted(map(tuple, landing.land_sessions(m, f"{tmp_path}/out").collect())) == [("s1", 2), ("s2", 1)]
    spark.dataSource.register(market_files.SessionSource)
    back = spark.read.format("exchange_session").load(f"{tmp_path}/out")
    assert sorted((r.session, r.seq, r.type, r.locate, r.ref or 0) for r in back.collect()) == [("s1", 0, "A", 1, 2**60 + 1), ("s1", 1, "D", 1, 2**60 + 1), ("s2", 0, "R", 7, 0)]
    named = market_files.with_symbols(back, back)
    assert sorted(str(r.ticker) for r in named.collect()) == ["None", "None", "QLFK"]
    assert sorted(map(tuple, market_files.session_counters(back).select("session", "messages", "orders", "unknown_refs").collect())) == [("s1", 2, 1, 0), ("s2", 1, 0, 0)]


def test_a_folder_of_others_is_not_taken(tmp_path):
    assert landing.claim_folder(f"{tmp_path}/new") == landing.claim_folder(f"{tmp_path}/new")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "mine.txt").write_text("x")
    with pytest.raises(FileExistsError):
        landing.claim_folder(f"{tmp_path}/old")


def test_counters_come_with_the_rows(spark):
    df, seen = landing.counted(spark.range(10), "numbers", odd=F.col("id") % 2 == 1)
    assert df.count() == 10 and seen.get == {"rows": 10, "odd": 5}


def test_packets_in_any_order_give_each_message_once(spark):
    m = [market_files.encode_message("D", 1, i, ref=2**60 + i) for i in range(9)]
    p = packets.encode_packet
    sent = [p("S1", 5, m[4:7]), p("S1", 1, m[0:3]), p("S1", 3, m[2:6]), p("S1", 1, m[0:3]), p("S1", 8, []), p("S2", 1, m[7:9])[:-1], p("S1", 9, [])[:18] + b"\xff\xff", b"short", None]
    df = spark.createDataFrame([(x,) for x in sent], "b binary")
    got = sorted((r.session, r.seq, r.ref) for r in packets.recovered(df, packet="b").collect())
    assert got == [("S1", i + 1, 2**60 + i) for i in range(7)] + [("S2", 1, 2**60 + 7)]  # the last message of S2 is cut off
    assert packets.recovered(df.limit(0), packet="b").count() == 0


def test_a_depth_moves_messages_once_and_no_changes(spark):
    """The fold gives the levels that stand at its end: one shuffle, and no aggregation of what each message changed."""
    rows = [("s", x % 3, x, 0, "A", x, None, "BS"[x % 2], 10, 500 + x % 5) for x in range(60)] + [("s", 0, 99, 0, "U", 0, 100, None, 4, 77), ("s", 1, 98, 0, "E", 1, None, None, 10, None), ("t", 0, 1, 0, "A", 5, None, "B", 3, 9)]
    m = spark.createDataFrame(rows, "session string, locate int, seq long, ts_ns long, type string, ref long, new_ref long, side string, shares long, px_e4 long")
    got = book.depth_after(m)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    want = {}
    for s, loc, _, _, kind, ref, _, side, shares, px in rows[:60] + rows[-1:]:
        want[s, loc, side, px] = want.get((s, loc, side, px), 0) + shares * (ref not in (0, 1) or s == "t")
    want["s", 0, "B", 77] = 4
    assert {(r.session, r.locate, r.side, r.px_e4): r.shares for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_sessions_in_order_are_written_as_they_stand(spark, tmp_path):
    rows = [(f"s{i % 2}", i, 1, i, "A", 2**60 + i, "B", 10, 500, None) for i in range(50)]
    m = spark.createDataFrame(rows, "session string, seq long, locate int, ts_ns long, type string, ref long, side string, shares long, px_e4 long, stock string")
    assert sorted(map(tuple, landing.land_sessions(m, f"{tmp_path}/a").collect())) == [("s0", 25), ("s1", 25)]
    parted = m.repartition("session").sortWithinPartitions("session", "seq").drop("seq")
    written = landing.land_sessions(parted, f"{tmp_path}/b", in_order=True)
    assert written._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the caller's own
    written.collect()
    assert all(gzip.decompress((tmp_path / "a" / n).read_bytes()) == gzip.decompress((tmp_path / "b" / n).read_bytes()) for n in ("s0.gz", "s1.gz"))


def test_counters_take_one_pass_without_joins(spark):
    rows = [("s", "A", 1, None, None), ("s", "E", 1, None, None), ("s", "U", 1, 2, None), ("s", "C", 2, None, "N"), ("s", "C", 3, None, "Y"), ("s", "C", 3, None, None), ("s", "D", None, None, None), ("s", "A", None, None, None), ("s", "P", None, None, None), ("s", "U", 8, None, None), ("t", "X", 1, None, None), ("u", "R", None, None, None)]
    c = market_files.session_counters(spark.createDataFrame(rows, "session string, type string, ref long, new_ref long, printable string"))
    assert "Join" not in c._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, c.select("session", "messages", "orders", "unknown_refs", "hidden").collect())) == [("s", 10, 2, 4, 1), ("t", 1, 0, 1, 0), ("u", 1, 0, 0, 0)]


def test_columns_are_read_as_plain_values():
    """Beyond 2**53, beside nulls, of slices and empty columns; runs of equal keys begin where they do."""
    import pyarrow as pa

    big = 2**53 + 1
    for values, kind in (([big, None, 3], pa.int64()), ([1, 2, 2], pa.int32()), (["a", None, ""], pa.string()), ([None] * 3, pa.string()), ([None] * 3, pa.int64()), ([1.5, None, 2.0], pa.float64()), ([True, None, False], pa.bool_())):
        for c in (pa.array(values, kind), pa.array([*values, *values], kind).slice(1, 4), pa.array([], kind)):
            assert ordered._values(c) == c.to_pylist()
    assert ordered._run_starts([pa.array(["a", "a", None, None, "b"]), pa.array([1, 1, 1, 2, 2])]) == [0, 2, 3, 4] and ordered._run_starts([pa.array([], pa.string())]) == []
