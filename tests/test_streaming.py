"""Streams over several micro-batches give what the batch operators give."""

import pytest
from compare import DATA
from pyspark.sql import functions as F

from newsloom.operators import journal, market, ordered
from newsloom.operators.late_counts import Slices, corrected_counts
from newsloom.streaming import folds
from newsloom.streaming.late_panes import compose, latest_panes, pane_counts, start_corrections

HOUR = 3_600_000_000_000


@pytest.fixture
def landed(spark, tmp_path):
    """A table cut into files by arrival, and a stream that reads one file a micro-batch."""

    def land(df, order, parts=4):
        rows = df.orderBy(order).collect()
        size = -(-len(rows) // parts)
        for i in range(parts):
            part = rows[i * size : (i + 1) * size]
            if part:
                spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        import os
        import time

        files = []
        for i in range(parts):
            d = f"{tmp_path}/in/{i}"
            for f in os.listdir(d) if os.path.isdir(d) else []:
                if f.endswith(".parquet"):
                    files.append(f"{d}/{f}")
                    os.utime(f"{d}/{f}", (time.time() - 100 + i, time.time() - 100 + i))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    return land


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def events(spark):
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    return e.select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"))


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_cooldown(spark, landed, tmp_path):
    e = events(spark)
    got = drained(folds.cooled_down_stream(landed(e, "t"), keys=["user_id"], time="t", id_col="event_id", cooldown=24 * HOUR), tmp_path, "cooled")
    assert ids(got) == ids(ordered.cooled_down(e, keys=["user_id"], time="t", id_col="event_id", cooldown=24 * HOUR))


def test_repeats(spark, landed, tmp_path):
    e = events(spark)
    got = drained(folds.repeats_dropped_stream(landed(e, "t"), keys=["user_id"], time="t", id_col="event_id", state="event_type", within=HOUR), tmp_path, "repeats")
    assert ids(got) == ids(ordered.repeats_dropped(e, keys=["user_id"], time="t", id_col="event_id", state="event_type", within=HOUR))


def stories(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/signals.parquet").where("t_news_recv_ns is not null")


def test_first_seen(spark, landed, tmp_path):
    s = stories(spark).where("title is not null").select("signal_id", "src", "title", F.col("t_news_recv_ns").alias("t"))
    got = drained(folds.first_seen_stream(landed(s, "t"), key="title", time="t", id_col="signal_id", source="src"), tmp_path, "seen")
    want = journal.first_seen(s, key="title", time="t", id_col="signal_id", source="src").select("signal_id", "dup", "first_src", "behind_ns")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_deduplicated(spark, landed, tmp_path):
    s = stories(spark).where("news_id is not null").select("news_id", "t_news_recv_ns")
    got = drained(folds.deduplicated_stream(landed(s, "t_news_recv_ns"), keys=["news_id"], time_ns="t_news_recv_ns", horizon="30 days"), tmp_path, "dedup")
    assert ids(got.select("news_id")) == ids(s.select("news_id").distinct())


def test_minute_bars(spark, landed, tmp_path):
    t = spark.read.parquet(f"{DATA}/sf0.001/tape.parquet").where("ts_ns is not null")
    got = drained(folds.minute_bars_stream(landed(t, "ts_ns")), tmp_path, "bars")
    want = {tuple(r) for r in market.minute_bars(market.prints(t)).collect()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want and len(rows) >= 0.9 * len(want)  # the last minutes are still open


SPAN = dict(window_ns=HOUR, lateness_ns=6 * HOUR, slot_ns=60_000_000_000)
NAMES = dict(source="src", story="news_id", event_time="published_ns", arrival="t_news_recv_ns")


def corrected(stream, tmp_path, span=SPAN):
    """Run to the end; (stored partial counts, final number of each emitted period, the query)."""
    q = start_corrections(pane_counts(stream, **NAMES, **span), store=f"{tmp_path}/store", emitted=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp", **span)
    q.awaitTermination(600)
    assert q.exception() is None
    spark = stream.sparkSession
    out = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out/batch=*")
    last = out.groupBy("src", "period_ns").agg(F.max("batch").alias("batch"))
    # Of the last emission of a period the number after all its slots.
    final = out.join(last, ["src", "period_ns", "batch"]).groupBy("src", "period_ns").agg(F.max_by("n_stories", "slot").alias("n"))
    return spark.read.parquet(f"{tmp_path}/store/days"), {(r.src, r.period_ns): r.n for r in final.collect() if r.n}, q


def numbers(s, span=SPAN):
    want = corrected_counts(s, **NAMES, **span, corrections_only=False).groupBy("src", "period_ns").agg(F.max("n_stories").alias("n"))
    return {(r.src, r.period_ns): r.n for r in want.collect() if r.n}


def test_corrections(spark, landed, tmp_path):
    s = stories(spark).select("src", "news_id", "published_ns", "t_news_recv_ns")
    store, got, _ = corrected(landed(s, "t_news_recv_ns"), tmp_path)
    want = numbers(s)
    assert got == want
    last = compose(latest_panes(store), Slices(**SPAN)).groupBy("src", "period_ns").agg(F.max("n_stories").alias("n"))
    assert {(r.src, r.period_ns): r.n for r in last.collect()} == want


def test_corrections_hours_late_in_small_batches(spark, landed, tmp_path):
    ns = lambda h: int(h * HOUR) + 400_000 * HOUR
    news = [("w", f"h{h}-{i}", ns(h + i / 10), ns(h + i / 10) + 1) for h in range(12) for i in range(3)]
    news += [("w", "ahead", ns(500), ns(0.5))]  # a source whose clock is wrong silences nobody
    news += [("w", "late1", ns(0.2), ns(3.1)), ("w", "late2", ns(0.3), ns(3.2)), ("w", "late1", ns(0.2), ns(4.1)), ("w", "h0-0", ns(0), ns(5.5)), ("w", "late3", ns(2.2), ns(8.4)), ("w", "toolate", ns(0.1), ns(7.5))]
    news += [("w", "last", ns(20), ns(20) + 1)]
    s = spark.createDataFrame(news, "src string, news_id string, published_ns long, t_news_recv_ns long")
    _, got, q = corrected(landed(s, "t_news_recv_ns", parts=21), tmp_path)
    assert {(p - ns(0)) // HOUR: n for (_, p), n in got.items()} == {h: 3 + {0: 2, 2: 1}.get(h, 0) for h in range(12)} | {20: 1, 500: 1}
    # State of the periods whose lateness is over is gone.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 38


@pytest.mark.parametrize("slide", [1, 2])
def test_stream_and_batch_agree_on_every_kind_of_late_story(spark, landed, tmp_path, slide):
    """Fifty micro-batches; each hour has stories on time, late, too late, delivered twice, delivered out of order and lying in two hours."""
    import random

    rnd = random.Random(slide)
    ns = lambda h: int(h * HOUR) + 400_000 * HOUR
    news = []
    for h in range(16):
        for k, delay in enumerate((0.1, 0.4, 2.5, 5.9, 6.6, 7.9, 9.5)):
            e = h + rnd.random()
            news.append((rnd.choice("ab"), f"{h}-{k}", ns(e), ns(e + delay)))
            if k % 2:
                news.append((*news[-1][:3], news[-1][3] + rnd.randrange(HOUR)))  # repeated
            if k % 3 == 0:
                news.append((*news[-1][:2], ns(e + rnd.choice((0.8, 1.5, 5))), news[-1][3] + rnd.randrange(2 * HOUR)))  # told again under another hour
    s = spark.createDataFrame(news, "src string, news_id string, published_ns long, t_news_recv_ns long")
    # Delivered up to half an hour of arrival out of order.
    shuffled = s.withColumn("delivered", F.col("t_news_recv_ns") + F.pmod(F.xxhash64("news_id", "t_news_recv_ns"), F.lit(HOUR // 2)))
    span = SPAN | dict(window_ns=slide * HOUR, slide_ns=HOUR)
    _, got, _ = corrected(landed(shuffled, "delivered", parts=50), tmp_path, span)
    assert got == numbers(s, span) and len(got) > 20
