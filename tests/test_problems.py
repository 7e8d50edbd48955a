"""Problems 1 to 3: against SQL on the tables, against brute force on small skewed and dirty inputs."""

import random

import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from newsloom.operators.asof_attributes import attributes_asof
from newsloom.operators.late_counts import corrected_counts
from newsloom.operators.snapshot_diff import snapshot_changes, squeezed
from newsloom.plans import core_problems


@pytest.mark.parametrize("name", sorted(core_problems.queries()))
def test_query_equals_sql(spark, name):
    d = f"{DATA}/sf0.001"
    assert assert_same(core_problems.queries()[name](spark, d), core_problems.oracle_sql()[name], d) > 0


EVENTS = "ent string, eid long, t long, v long"  # v clashes with the version column of the changes
CHANGES = "ent string, v long, vf long, kn long, x double, y string, t string"


def asof(spark, events, changes, rows):
    e, c = spark.createDataFrame(events, EVENTS), spark.createDataFrame(changes, CHANGES)
    out = attributes_asof(e, c, entity="ent", event_id="eid", event_time="t", version="v", valid="vf", known="kn", fields=["x", "y"], group_rows=rows)
    assert out.columns == ["eid", "field", "v"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("rows", [15, 10**6])
def test_asof_attributes_by_brute_force(spark, rows):
    rnd = random.Random(rows)
    ent = lambda: rnd.choice(["A"] * 6 + ["B", "C", None])
    some = lambda hi: rnd.choice([None] + [rnd.randint(0, hi)] * 9)
    events = [(ent(), i, rnd.choice([some(100), 50]), 7) for i in range(300)]
    changes = [(ent(), i % 250, some(100), some(100), rnd.choice([None, 0.0, -1.0, float("nan"), 5.0]), rnd.choice([None, "", " ", "N"]), "z") for i in range(300)]
    want = set()
    for e, i, t, _ in events:
        for f, at, ok in (("x", 4, lambda v: v == 5.0), ("y", 5, lambda v: v == "N")):
            got = [(c[2], c[3], c[1]) for c in changes if e is not None and t is not None and c[0] == e and ok(c[at]) and c[2] is not None and c[3] is not None and max(c[2], c[3]) <= t]
            if got:
                want.add((i, f, max(got)[2]))
    assert asof(spark, events, changes, rows) == sorted(want)


def test_asof_attributes_of_empty_and_repeated_rows(spark):
    change = ("A", 1, 5, 5, 1.0, None, None)
    assert asof(spark, [], [change], 10) == []
    assert asof(spark, [("A", 1, 9, 0)], [], 10) == []
    assert asof(spark, [("A", 1, 9, 0)] * 2, [change, change, ("A", 2, 5, 5, 2.0, None, None)], 10) == [(1, "x", 2)] * 2


def late(spark, rows, **kw):
    df = spark.createDataFrame(rows, "src string, story string, e long, t long, n_stories string")
    return sorted(tuple(r) for r in corrected_counts(df, source="src", story="story", event_time="e", arrival="t", window_ns=10, lateness_ns=20, slot_ns=4, **kw).collect())


def test_late_counts(spark):
    rows = [("s", "a", 3, 9, "x"), ("s", "b", 4, 10, None), ("s", "b", 4, 12, None), ("s", "c", 9, 29, None), ("s", "d", 9, 30, None)]  # d is too late
    assert late(spark, rows) == [("s", 0, 2), ("s", 0, 3)]
    assert late(spark, rows, corrections_only=False) == [("s", 0, 1), ("s", 0, 2), ("s", 0, 3)]
    unknown = [(None, "a", 3, 11, ""), ("s", None, 3, 11, ""), ("s", "a", 0, 11, ""), ("s", "a", None, 11, ""), ("s", "a", 3, None, "")]
    assert late(spark, unknown) == [] == late(spark, [])
    assert late(spark, [("s", str(i), 1, 11, "") for i in range(50)]) == [("s", 0, i + 1) for i in range(50)]  # ties


def test_late_counts_slide_over_panes(spark):
    # Windows of 10 every 5: story a lies in windows 0 and 5, and is late only for window 0.
    rows = [("s", "a", 7, 12, "")]
    assert late(spark, rows, slide_ns=5) == [("s", 0, 1)]


SNAP = "row_id long, d string, l long, k string, x string, f string, snap_date string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SNAP)
    out = snapshot_changes(df, date="d", delivered="l", row_id="row_id", key=F.upper("k"), is_record=~F.coalesce(F.col("k").startswith("footer"), F.lit(False)), compared={"x": squeezed(F.col("x")), "f": squeezed(F.col("f"))})
    return sorted(tuple(r) for r in out.collect())


def test_snapshot_changes(spark):
    rows = [
        (1, "01", 1, "a", "N Y", None, ""), (2, "01", 1, "b", "q", "N", ""), (3, "01", 1, "c", "q", "", ""),
        (4, "02", 1, "zzz", "q", "N", ""),  # an earlier delivery of 02
        (5, "02", 2, "A", "ny", " ", ""), (6, "02", 2, "b", "r", "D", ""), (7, "02", 2, "d", "q", "", ""), (8, "02", 2, "d", "other", "", ""), (9, "02", 2, "footer", "q", "", ""), (10, "02", 2, None, "q", "", ""),
        (11, "03", 1, "footer", "", "", ""),  # delivered, but empty
    ]
    assert changes(spark, rows) == [("02", "B", "f"), ("02", "B", "x"), ("02", "C", "removed"), ("02", "D", "added"), ("03", "A", "removed"), ("03", "B", "removed"), ("03", "D", "removed")]
    assert changes(spark, []) == [] == changes(spark, rows[:3])


def test_display_symbols(spark):
    from newsloom.operators.snapshot_diff import display_symbol

    df = spark.createDataFrame([(" brk/b ",), ("BRK-B",), ("brk b",), ("BRK.B\t",), ("",), (" ",), (None,)], "k string")
    assert [r[0] for r in df.select(display_symbol(F.col("k"))).collect()] == ["BRK.B"] * 4 + [None] * 3


def test_one_entity_in_many_slices(spark):
    """A hot entity cut into hundreds of slices, with many events at one time, against a plain join."""
    e = spark.range(6000).selectExpr("'H' e", "id", "if(id % 3 = 0, 500, (id * 7919) % 10007) t")
    c = spark.range(3000).selectExpr("'H' e", "id v", "(id * 104729) % 10007 vf", "(id * 104729) % 10007 + id % 50 kn", "double(id % 5) x")
    got = attributes_asof(e, c, entity="e", event_id="id", event_time="t", version="v", valid="vf", known="kn", fields=["x"], group_rows=20)
    best = e.join(c.where("x > 0").drop("e"), (F.col("vf") <= F.col("t")) & (F.col("kn") <= F.col("t"))).groupBy("id").agg(F.max(F.struct("vf", "kn", "v"))["v"].alias("v"))
    assert sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, best.collect()))


def test_late_counts_of_stories_in_several_panes(spark):
    """Windows of 10 every 5. Story a is told in panes 0, 5 and 20: once in window 0, whichever pane it arrived in first."""
    rows = [("s", "a", 1, 12, ""), ("s", "a", 6, 11, ""), ("s", "a", 21, 33, ""), ("s", "b", 7, 16, ""), ("s", "b", 8, 50, "")]
    got = late(spark, rows, slide_ns=5, corrections_only=False)
    # window -5: a (12, late); 0: a (11, late) and b (16, late); 5: a (11, in time) and b (16, late); 15 and 20: a (33).
    assert got == sorted([("s", -5, 0), ("s", -5, 1), ("s", 0, 0), ("s", 0, 1), ("s", 0, 2), ("s", 5, 1), ("s", 5, 2), ("s", 15, 0), ("s", 15, 1), ("s", 20, 0), ("s", 20, 1)])


def test_small_limits_change_nothing(spark, monkeypatch):
    """Problems 1 and 2 on the tables with limits so small that every large entity is sliced and nothing is broadcast."""
    from compare import DATA

    from newsloom.operators import asof_attributes as aa
    from newsloom.operators import late_counts
    from newsloom.plans import core_problems as c

    d = f"{DATA}/sf0.01"
    plain = lambda df: sorted(map(tuple, df.collect()))
    p1, p2 = plain(c.p1_found(spark, d)), plain(c.p2_sliding(spark, d))
    monkeypatch.setattr(aa.attributes_asof, "__kwdefaults__", {**aa.attributes_asof.__kwdefaults__, "group_rows": 60})
    monkeypatch.setattr(late_counts, "LISTED", 1)
    assert plain(c.p1_found(spark, d)) == p1 and len(p1) > 1000
    assert plain(c.p2_sliding(spark, d)) == p2 and len(p2) > 100
