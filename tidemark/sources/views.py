"""Market-shaped views of the star schema, and the same views as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as bar_ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, price, qty, quote_qty, is_buyer_maker, event_type."""
    qty = F.lit(1) + F.col("event_id") % 7
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), qty.alias("qty"), (F.col("value") * qty).alias("quote_qty"), F.col("event_type").isin("error", "signup").alias("is_buyer_maker"), "event_type")


def bars(spark: SparkSession, sf_dir: str, minutes: int = 1) -> DataFrame:
    return bar_ops.from_ticks(ticks(spark, sf_dir), minutes)


def aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse second instrument: the last price of each minute among one kind of tick."""
    return bar_ops.from_ticks(ticks(spark, sf_dir).filter("event_type = 'view'"), 1).select("ts", F.col("close").alias("aux_close"))


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily signal: d, vix, vix3m, slope."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.round(F.avg("o_totalprice"), 4).alias("vix"), F.max("o_totalprice").alias("vix3m"))
    return daily.withColumn("slope", F.round(F.col("vix3m") - F.col("vix"), 4))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price: d, close."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.round(F.avg("l_extendedprice"), 4).alias("close"))


def fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily funding rate and 0-100 sentiment: d, rate, fg."""
    fg = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor((F.round(F.avg("l_tax"), 8) * 1250 - 50) * 2.5 + 50)))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.round(F.avg("l_discount") - 0.05, 8).alias("rate"), fg.cast("double").alias("fg"))


def probes(spark: SparkSession, sf_dir: str, every: int = 30) -> DataFrame:
    """Probe times on a grid over the ticks' span: ts."""
    step = F.expr(f"INTERVAL {every} MINUTES")
    span = ticks(spark, sf_dir).agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", step)).alias("ts"))


def bars_sql(minutes: int = 1, where: str = "TRUE") -> str:
    return f"""SELECT time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, (ts, id)) AS close, sum(qty)::BIGINT AS volume, sum(quote_qty) AS quote_volume, count(*) AS trade_count,
      avg(qty) AS avg_trade_size, (count(*) FILTER (WHERE NOT is_buyer_maker) - count(*) FILTER (WHERE is_buyer_maker)) / count(*)::DOUBLE AS trade_imbalance
      FROM ticks WHERE {where} GROUP BY 1"""


#: Named pieces of a WITH clause; SQL of a query names those it needs.
CTE: dict[str, str] = {
    "ticks": "SELECT event_id AS id, ts, value AS price, 1 + event_id % 7 AS qty, value * (1 + event_id % 7) AS quote_qty, event_type IN ('error', 'signup') AS is_buyer_maker, event_type FROM events",
    "b1": bars_sql(1),
    "b15": bars_sql(15),
    "aux": "SELECT ts, close AS aux_close FROM (" + bars_sql(1, "event_type = 'view'") + ")",
    "sig": "SELECT d, vix, vix3m, round(vix3m - vix, 4) AS slope FROM (SELECT CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice), 4) AS vix, max(o_totalprice) AS vix3m FROM orders GROUP BY 1)",
    "px": "SELECT CAST(l_shipdate AS DATE) AS d, round(avg(l_extendedprice), 4) AS close FROM lineitem GROUP BY 1",
    "ret": "SELECT d, close, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM px",
    "fund": "SELECT CAST(l_shipdate AS DATE) AS d, round(avg(l_discount) - 0.05, 8) + 0.0 AS rate, greatest(0.0, least(100.0, floor((round(avg(l_tax), 8) * 1250 - 50) * 2.5 + 50)))::DOUBLE AS fg FROM lineitem GROUP BY 1",
    "probes": "SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT date_trunc('day', max(ts)) FROM events), INTERVAL 30 MINUTE))::TIMESTAMP AS ts",
}
_NEEDS = {"b1": ("ticks",), "b15": ("ticks",), "aux": ("ticks",), "ret": ("px",)}


def with_views(sql: str, *names: str, **extra: str) -> str:
    """sql under a WITH of the named views, those they need, and further ones in order."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({text})" for n, text in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql
