"""Every query of the catalogue equals its SQL; those without SQL run and have rows. Edge cases of the operators behind them."""

import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from newsloom.operators import journal, ordered, reference
from newsloom.plans import catalog, files_catalog, more_catalog  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    d = f"{DATA}/sf0.001"
    df = catalog.queries()[name](spark, d)
    if name in catalog.oracle_sql():
        assert_same(df, catalog.oracle_sql()[name], d)
    else:
        assert df.count() > 0


def test_asof_ties_nulls_and_clashes(spark):
    left = spark.createDataFrame([("A", 5, "l"), ("A", 6, "l"), ("B", 9, "l"), (None, 9, "l"), ("A", None, "l")], "k string, t long, v string")
    right = spark.createDataFrame([("A", 5, "r1"), ("A", 5, "r2"), ("A", 1, "r0"), (None, 1, "n"), ("A", None, "n")], "k string, t long, v string")
    run = lambda strict: sorted((tuple(r) for r in ordered.asof_join(left, right, keys=["k"], left_time="t", right_time="t", take={"v": "found"}, tie=["v"], strict=strict, width=2).collect()), key=str)
    assert run(True) == sorted([("A", 5, "l", "r0"), ("A", 6, "l", "r2"), ("B", 9, "l", None), (None, 9, "l", None), ("A", None, "l", None)], key=str)
    assert run(False) == sorted([("A", 5, "l", "r2"), ("A", 6, "l", "r2"), ("B", 9, "l", None), (None, 9, "l", None), ("A", None, "l", None)], key=str)
    assert ordered.asof_join(left.limit(0), right, keys=["k"], left_time="t", right_time="t", take={"v": "found"}).count() == 0


def test_trade_statistics(spark):
    pnl = [100, -50, 200, -50, -100, 30]
    t = spark.createDataFrame([(i, f"2026-01-{1 + 2 * i:02d}", p) for i, p in enumerate(pnl)], "i int, day string, pnl long").withColumn("day", F.to_date("day"))
    r = journal.trade_stats(journal.equity(t.withColumn("g", F.lit(1)), group=["g"], day="day", order=["i"], pnl="pnl"), group=[], day="day", pnl="pnl").first()
    assert (r.total, r.profit_factor, r.max_drawdown, r.without_top3, r.span_days, r.wins, r.losses) == (130, 1.65, 150, -200, 11, 3, 3)


def test_filing_flags(spark):
    f = spark.createDataFrame([(1, "2026-09-23", "424b"), (1, "2026-09-24", "s3"), (2, "2026-09-24", "x")], "cik long, day string, kind string").withColumn("day", F.to_date("day"))
    a = spark.createDataFrame([(1, "2026-09-25"), (1, "2026-10-25"), (1, "2026-09-22"), (2, "2026-09-25"), (None, "2026-09-25")], "cik long, day string").withColumn("day", F.to_date("day"))
    got = reference.flags_in_window(a, f, key="cik", asked_day="day", day="day", kind="kind", windows={"424b": (10, 1), "s3": (1095, 8)})
    assert sorted(r.flags for r in got.collect()) == [0, 0, 0, 8, 9]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k string, t long, i long, s string")
    assert ordered.cooled_down(e, keys=["k"], time="t", id_col="i", cooldown=5).count() == 0
    assert ordered.state_changes(e, keys=["k"], time="t", id_col="i", state="s").count() == 0
    assert journal.first_seen(e, key="k", time="t", id_col="i", source="s").count() == 0


def test_exact_medians(spark):
    """Against the library's median: skewed groups, ties, zeros, negatives, nulls, NaN and a null group."""
    import random
    import statistics

    rnd = random.Random(4)
    rows = [(rnd.choice(["a"] * 8 + ["b", None]), rnd.choice([None, float("nan"), 0.0, -0.0, 1.0, 1.0, rnd.uniform(-5, 5), rnd.lognormvariate(0, 9), -rnd.lognormvariate(0, 9), 2.0 ** rnd.randint(-70, 60)])) for _ in range(4000)]
    rows += [("one", 3.5), ("none", None)]
    got = {r.g: r.m for r in journal.exact_medians(spark.createDataFrame(rows, "g string, v double"), group=["g"], values={"m": F.col("v")}).collect()}
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    assert got == {g: statistics.median(v) for g, v in want.items()}


def test_seconds_are_exact(spark):
    """The quotient of these nanoseconds by doubles is the next second."""
    from newsloom.functions import times

    ns = [1772433625999999999, 1772433625999999990, 0, -1, None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, n long").orderBy("i").select(F.unix_seconds(times.utc(F.col("n")))).collect()]
    assert got == [1772433625, 1772433625, 0, -1, None]


def test_merge_by_time_and_counters(spark):
    a = spark.createDataFrame([("k", 5, 1), ("k", None, 2), ("k", 9, 3)], "k string, t long, i long")
    b = spark.createDataFrame([("k", 5, 7), ("k", 5, 6)], "k string, u long, j long")
    assert [(r.time, r.kind, r.id) for r in ordered.merged_by_time({"b": (b, "u", "j"), "a": (a, "t", "i")}, keys=["k"]).collect()] == [(5, "b", 6), (5, "b", 7), (5, "a", 1), (9, "a", 3)]
    s = spark.createDataFrame([("x", 1, 60), ("x", 1, 10), ("x", 2, None), (None, 3, 90)], "src string, id long, score int")
    got = {r.src: (r["items"], r.hot) for r in journal.source_counters(s, source="src", id_col="id", stages={"hot": F.col("score") >= 55}).collect()}
    assert got == {"x": (3, 1), None: (1, 1)}
    assert [r[0] for r in s.select(journal.score_bucket(F.col("score"))).collect()] == ["55-64", "<55", None, "85+"]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_kept_rows_by_brute_force(spark, batch):
    """Cooldown and repeats over keys with nulls, ties, negative times and null states, in small and large batches."""
    import random

    rnd = random.Random(batch)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, None]), i, rnd.choice([None, rnd.randint(-40, 400), 7]), rnd.choice(["x", "x", "y", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, j int, i long, t long, s string")
    groups = {}
    for k, j, i, t, s in rows:
        if t is not None:
            groups.setdefault((k, j), []).append((t, i, s))
    cooled, kept = [], []
    for g in groups.values():
        last = held = None
        for t, i, s in sorted(g, key=lambda r: r[:2]):
            if last is None or t - last >= 9:
                last = t
                cooled.append(i)
            if held is None or s != held[1] or t - held[0] >= 9:
                held = t, s
                kept.append(i)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(r.i for r in ordered.cooled_down(df, keys=["k", "j"], time="t", id_col="i", cooldown=9).collect()) == sorted(cooled)
        assert sorted(r.i for r in ordered.repeats_dropped(df, keys=["k", "j"], time="t", id_col="i", state="s", within=9).collect()) == sorted(kept)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_bursts_are_cut(spark, monkeypatch):
    """Half of all rows in one bucket of one key (or of a null key): equal results, and no group over twice the limit."""
    import random

    from newsloom.operators import slices

    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", None]), i, rnd.choice([rnd.randint(0, 99), rnd.randint(100, 2000)]), rnd.choice([None, i])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, i long, t long, v long")
    sizes, cut_up = [], slices.sliced

    def watched(x, **kw):
        out = cut_up(x, **kw)
        if kw["most"] is not None:
            sizes.append(out.groupBy(*kw["keys"], kw["bucket"]).agg(F.count("*").alias("n"), F.count_distinct(kw["time"]).alias("d")).where("d > 1").agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(ordered, "sliced", watched)
    plain = lambda x: sorted(map(str, x.collect()))
    args = dict(keys=["k"], time="t", tie=["i"], value=F.col("v"), width=100)
    for f in (ordered.with_last, ordered.with_running_sum):
        assert plain(f(df, name="x", **args, burst_rows=20)) == plain(f(df, name="x", **args))
    joined = lambda most: plain(ordered.asof_join(df, df, keys=["k"], left_time="t", right_time="t", take={"i": "j"}, tie=["i"], width=100, burst_rows=most))
    assert joined(30) == joined(None)
    per = lambda most: plain(ordered.interval_stats(df.where("i % 3 = 0"), df, keys=["k"], point_id="i", point_time="t", value_time="t", value="v", weight="i", length=100, burst_rows=most))
    assert per(25) == per(None)
    assert len(sizes) == 4 and max(sizes) <= 60


def test_statistics_of_null_groups(spark):
    """A null group, and null days, are kept and get their own figures."""
    t = spark.createDataFrame([(None, 1, "2026-01-01", 10), (None, 2, "2026-01-02", -4), (None, 3, None, 7), ("g", 1, None, 5)], "g string, i int, day string, pnl long").withColumn("day", F.to_date("day"))
    curve = journal.equity(t, group=["g"], day="day", order=["i"], pnl="pnl")
    assert curve.count() == 4
    got = {r.g: (r.n, r.total, r.without_top3) for r in journal.trade_stats(curve, group=["g"], day="day", pnl="pnl").collect()}
    assert got == {None: (3, 13, -4), "g": (1, 5, 0)}
    days = journal.day_results(t, spark.createDataFrame([(None, "A"), ("2026-01-01", "B")], "day string, tier string").withColumn("day", F.to_date("day")), day="day", pnl="pnl", tier="tier", alerting=["A"])
    assert sorted((str(r.day), r.signals, r.alerts, r.closed, r.pnl) for r in days.collect()) == [("2026-01-01", 1, 0, 1, 10), ("2026-01-02", 0, 0, 1, -4), ("None", 1, 1, 2, 12)]
    e = t.limit(0)
    assert journal.trade_stats(journal.equity(e, group=["g"], day="day", order=["i"], pnl="pnl"), group=["g"], day="day", pnl="pnl").count() == 0
    assert journal.exact_medians(e, group=["g"], values={"m": F.col("pnl")}).count() == 0
