"""Growing files as a stream: new lines, half lines, the next day's file, a restart."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import live


def drained(df, tmp_path, name):
    """What a run from the checkpoint adds to the table of all runs."""
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_files_grow_and_days_roll_over(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day = folder / "trades_2024-01-01.csv"
    head = "timestamp_ms,price,quantity,is_buyer_maker\n"
    day.write_text(head + "1704067200000,5,1,True\n1704067200001,0,1,True\n1704067200002,6,2,fal")
    (folder / "other.txt").write_text("1,1,1,True\n")
    got = lambda: sorted((r.price, r.qty, r.is_buyer_maker) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    drained(live.trades(spark, str(folder)), tmp_path, "out")
    assert got() == [(5.0, 1.0, True)]  # the half line waits
    with day.open("a") as f:
        f.write("se\n1704067200003,7,3,True\n")
    (folder / "trades_2024-01-02.csv").write_text(head + "1704153600000,8,4,false\r\n")
    drained(live.trades(spark, str(folder)), tmp_path, "out")  # a new run goes on from the checkpoint
    assert got() == [(5.0, 1.0, True), (6.0, 2.0, False), (7.0, 3.0, True), (8.0, 4.0, False)]
    drained(live.trades(spark, str(folder)), tmp_path, "out")
    assert len(got()) == 4


@pytest.mark.parametrize("chunk", [20, 64])
def test_a_late_start_reads_in_chunks(spark, tmp_path, chunk):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("".join(f"line {k}\n" for k in range(40)))
    (folder / "b").write_text("é\n")
    for _ in range(60):
        drained(live.lines(spark, f"file://{folder}", "*", chunk).select("file", "line"), tmp_path, "out")
        rows = [(r.file, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        if len(rows) == 41 or chunk == 20 and len(rows) > 6:
            break
    assert len(rows) == len(set(rows)) and set(rows) <= {("a", f"line {k}") for k in range(40)} | {("b", "é")}
    assert len(rows) == 41 or chunk == 20


def test_snapshots(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.csv").write_text("timestamp_ms,bid_p1,bid_q1,bid_p2,bid_q2,ask_p1,ask_q1,ask_p2,ask_q2\n1704067200000,9,1,,,10,2,11,3\n")
    drained(live.order_book(spark, str(folder), levels=2).select("ts", F.size("bids").alias("b"), F.size("asks").alias("a")), tmp_path, "out")
    assert [(r.b, r.a) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2)]
