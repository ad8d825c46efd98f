"""The bar builder as a watermarked stream, and event thinning with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICKS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Tick files as a stream; rows without a price are dropped."""
    raw = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.filter("value > 0").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.lit(1) + F.col("event_id") % 7).alias("qty"), F.col("event_type").isin("error", "signup").alias("is_buyer_maker"), "event_type")


def bars(ticks: DataFrame, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Bars of closed windows; rows later than the watermark are dropped (and counted in the query's progress)."""
    order = F.struct("ts", "id")
    buys, sells = F.count_if(~F.col("is_buyer_maker")), F.count_if("is_buyer_maker")
    made = ticks.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("trade_count"), ((buys - sells) / F.count(F.lit(1))).alias("trade_imbalance"),
    )
    return made.select(F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count", "trade_imbalance")


def write_bars(made: DataFrame, path: str, checkpoint: str):
    """Append closed bars to Parquet, exactly once through the file sink's log; ends when the input is read."""
    return made.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def thin(events: DataFrame, key: str, gap_s: float) -> DataFrame:
    """Keep an event if it comes more than gap_s after its key's last kept one; the state is that one time."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = state.get[0] if state.exists else None, []
        for ts in sorted(t for b in batches for t in b["ts"]):
            if last is None or ts.timestamp() - last > gap_s:
                last = ts.timestamp()
                kept.append(ts)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(kept), "ts": kept})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def thin_late(events: DataFrame, key: str, gap_s: float, late: str = "10 minutes") -> DataFrame:
    """thin in the order of event time, whatever the order of arrival: an event waits until the watermark, `late` behind the latest,
    has passed it, and is then placed. What comes later than that is dropped. A key's state goes once no event to come can be
    within gap_s of its last kept one. Times are whole milliseconds here; null times are left out.
    """
    gap = int(round(gap_s * 1000))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        mark = state.getCurrentWatermarkMs()
        waiting = sorted([*waiting, *(int(t) for b in batches for t in b["ms"] if t >= mark)] if not state.hasTimedOut else waiting)
        kept = []
        while waiting and waiting[0] < mark:
            t = waiting.pop(0)
            if last is None or t - last > gap:
                last = t
                kept.append(t)
        if not waiting and (last is None or mark > last + gap):
            if state.exists:
                state.remove()
        else:
            state.update((last, waiting))
            state.setTimeoutTimestamp(max(mark + 1, waiting[0] + 1 if waiting else last + gap + 1))
        yield pd.DataFrame({key: pd.Series([name[0]] * len(kept), dtype=object if not kept else None), "ms": pd.Series(kept, dtype="int64")})

    kind = events.schema[key].dataType.simpleString()
    held = events.filter("ts IS NOT NULL").withWatermark("ts", late).select(key, "ts", F.unix_millis("ts").alias("ms"))
    made = held.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ms long", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(key, F.timestamp_millis("ms").alias("ts"))


def progress(query) -> list[dict]:
    """What a stream has done, batch by batch: batch, rows, rows a second, rows dropped as late."""
    made = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    late = lambda p: sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", []))
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond"), "late": late(p)} for p in made]
