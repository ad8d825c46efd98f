import datetime as dt
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.streaming import bars as stream_bars


def test_klines_with_and_without_header(spark, tmp_path):
    row = "1704067200000,1,2,0.5,1.5,10,1704067259999,15,4,7,10,0"
    (tmp_path / "a.csv").write_text("open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n" + row + "\n")
    (tmp_path / "b.csv").write_text(row + "\n")
    got = readers.klines(spark, str(tmp_path)).collect()
    assert len(got) == 2 and {r.ts for r in got} == {dt.datetime(2024, 1, 1)} and got[0].trade_imbalance == 0.4 and got[0].avg_trade_size == 2.5


def test_trades_drop_zero_prices(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp_ms,price,quantity,is_buyer_maker\n1704067200000,0,1,True\n1704067200001,5,1,True\n1704067200002,6,2,false\n")
    assert sorted((r.price, r.is_buyer_maker) for r in readers.live_trades(spark, str(tmp_path)).collect()) == [(5.0, True), (6.0, False)]


def test_order_book_skips_blank_levels(spark, tmp_path):
    names = ["timestamp_ms"] + [f"{s}_{x}{k}" for s in ("bid", "ask") for k in (1, 2) for x in "pq"]
    (tmp_path / "l.csv").write_text(",".join(names) + "\n1704067200000,9,1,,,10,2,11,3\n")
    r = readers.order_book(spark, str(tmp_path), 2).first()
    assert len(r.bids) == 1 and len(r.asks) == 2


def test_dots_are_missing(spark, tmp_path):
    (tmp_path / "v.csv").write_text("DATE,V\n2024-01-02,13.2\n2024-01-03,.\n")
    assert [(str(r.d), r.vix) for r in readers.dated_values(spark, str(tmp_path), "vix").collect()] == [("2024-01-02", 13.2)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "1,a\n2,b\n")
    (tmp_path / "broken.zip").write_bytes(b"no")
    assert sorted(tuple(r) for r in readers.zipped_csv(spark, str(tmp_path), "n int, s string").collect()) == [(1, "a"), (2, "b")]


def test_ingest_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    new = spark.createDataFrame([("202401", 1), ("202402", 2)], "month string, x int")
    readers.ingest(new.filter("month = '202401'"), path)
    readers.ingest(new, path)
    readers.ingest(new, path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2]
    assert readers.months(spark, path, "202402", "202402").count() == 1


def test_missing_days(spark):
    wanted = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 2, 1),)], "month date")
    have = spark.createDataFrame([(dt.date(2024, 1, 1),)], "month date")
    days = spark.createDataFrame([(dt.date(2024, 2, 2),)], "d date")
    assert [r.d.day for r in readers.missing_days(wanted, have, days, "2024-02-04").orderBy("d").collect()] == [1, 3, 4]


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], "sum_open_interest int, fundingRate int")
    assert readers.resolve_column(df, "rate", "open") == "fundingRate"


def test_json_arrays(spark):
    df = spark.createDataFrame([("[[1704067200000, 1, 2, 0.5, 1.5]]",)], "j string")
    r = readers.json_arrays(df, "j", ["open", "high", "low", "close"]).first()
    assert (r.ts, r.high) == (dt.datetime(2024, 1, 1), 2.0)


def test_csv_sink(spark, tmp_path):
    readers.write_csv(spark.createDataFrame([(1, [1, 2], None)], "a int, b array<int>, c string"), str(tmp_path / "csv"))
    r = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert (r.a, r.b, r.c) == ("1", "[1,2]", None)


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=25 * i), i % 3, "view", float(i % 5 + 1), "{}") for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], stream_bars.TICKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    src = str(tmp_path / "in" / "*")
    q = stream_bars.write_bars(stream_bars.bars(stream_bars.tick_stream(spark, src), 1, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    seen = stream_bars.progress(q)
    assert sum(p["rows"] for p in seen) == 60 and all(p["late"] == 0 for p in seen)
    got = {r.ts: (r.open, r.close, r.trade_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(rows, stream_bars.TICKS)
    want = df.groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts")).agg(F.min_by("value", "ts").alias("o"), F.max_by("value", "ts").alias("c"), F.count(F.lit(1)).alias("n"))
    assert {r.ts: (r.o, r.c, r.n) for r in want.collect() if r.ts in got} == got and len(got) >= 23


def test_runs_at_once_leave_one_copy_of_a_partition(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "out")

    def run(k):
        rows = [(m, k) for m in ("202401", "202402", None) for _ in range(5)]
        return readers.ingest(spark.createDataFrame(rows, "month string, run int"), path)

    with ThreadPoolExecutor(4) as pool:
        done = [name for names in pool.map(run, range(4)) for name in names]
    assert sorted(done) == ["month=202401", "month=202402", "month=__HIVE_DEFAULT_PARTITION__"]
    got = spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs")).collect()
    assert len(got) == 3 and all((r.n, r.runs) == (5, 1) for r in got)
    assert readers.ingest(spark.createDataFrame([("202401", 9), ("202403", 9)], "month string, run int"), path) == ["month=202403"]
    assert not [x for x in (tmp_path / "out").iterdir() if x.name.startswith("_staging")]


def test_thinning_out_of_order_equals_the_batch(spark, tmp_path):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    events = sorted((start + dt.timedelta(seconds=int(s)), int(u)) for s, u in zip(rng.integers(0, 40_000, 300), rng.integers(0, 4, 300), strict=True))
    # arrival up to 8 minutes out of order; files by arrival
    arrival = sorted(events, key=lambda e: (e[0] + dt.timedelta(seconds=int(rng.integers(0, 480)))))
    arrival.append((start + dt.timedelta(seconds=50_000), 9))  # moves the watermark on
    source = tmp_path / "in"
    source.mkdir()
    for k in range(0, len(arrival), 43):
        part = pd.DataFrame(arrival[k : k + 43], columns=["ts", "user_id"])
        part["ts"] = part["ts"].astype("datetime64[us]")
        part.to_parquet(source / f"{k:04d}.parquet")
    import os
    import time

    for k, f in enumerate(sorted(source.iterdir())):
        os.utime(f, (time.time() - 1000 + k, time.time() - 1000 + k))
    raw = spark.readStream.schema("ts timestamp_ntz, user_id long").option("maxFilesPerTrigger", 1).parquet(str(source)).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    made = stream_bars.thin_late(raw, "user_id", 600)
    query = made.writeStream.format("memory").queryName("thinned").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r.ts.replace(tzinfo=None), r.user_id) for r in spark.sql("SELECT user_id, ts FROM thinned").collect())
    want, last = [], {}
    for ts, u in events:
        if u not in last or (ts - last[u]).total_seconds() > 600:
            last[u] = ts
            want.append((ts, u))
    assert got == want and len(want) > 100
