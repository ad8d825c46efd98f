"""Features, scaling, thresholds, model scoring, and the merged signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, boosting, features, frames, hmm, models
from ..sources import views
from ..sources.views import with_views as sql
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()

_D = "SELECT ts, ts::DATE AS day, close, trade_imbalance, trade_count, avg_trade_size, row_number() OVER w AS i, count(*) OVER (PARTITION BY ts::DATE) AS n FROM b15 WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts)"


def day_bars(spark, sf):
    return views.bars(spark, sf, 15).withColumn("day", F.to_date("ts"))


@query(sql("SELECT day, ts, i AS row, round(close, 6) AS last_close, round(sum(close) OVER (PARTITION BY day ORDER BY ts ROWS 59 PRECEDING), 4) AS total FROM k QUALIFY i >= 60", "b15", k=_D))
def window_tensor_main(spark, sf):
    made = frames.windows(day_bars(spark, sf), ["close", "trade_imbalance"], 60, "ts", ["day"])
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x["close"])
    return made.select("day", "ts", "row", r6(F.element_at("window", -1)["close"], "last_close"), r6(total, "total", 4))


@query(sql("SELECT w.w, day, ts, i AS row FROM k, (VALUES (15), (30)) w(w) WHERE n >= 60 AND i BETWEEN w.w AND 59", "b15", k=_D))
def window_tensor_early(spark, sf):
    made = [frames.windows(day_bars(spark, sf), ["close"], w, "ts", ["day"], w, 59, 60).select(F.lit(w).alias("w"), "day", "ts", "row") for w in (15, 30)]
    return made[0].unionByName(made[1])


def feature_rows(spark, sf):
    b = asof.carried(day_bars(spark, sf), views.aux(spark, sf), "aux_close", F.to_date("ts"))
    return features.minute_features(b)


_F = {
    "c": "SELECT b15.ts, b15.ts::DATE AS day, close, trade_imbalance, trade_count, avg_trade_size, coalesce(last_value(aux_close IGNORE NULLS) OVER (ORDER BY b15.ts ROWS UNBOUNDED PRECEDING), first_value(aux_close IGNORE NULLS) OVER (PARTITION BY b15.ts::DATE ORDER BY b15.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS aux_close FROM b15 LEFT JOIN aux ON aux.ts = b15.ts",
    "e": "SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS ret, coalesce(aux_close / lag(aux_close) OVER w - 1, 0) AS aux_ret FROM c WINDOW w AS (ORDER BY ts)",
    "f": "SELECT day, ts, ret, trade_imbalance, trade_count, avg_trade_size, aux_ret, coalesce(stddev_samp(ret) OVER w, 0) AS vol20, coalesce(CASE WHEN count(*) OVER w >= 5 AND stddev_pop(ret) OVER w > 1e-12 AND stddev_pop(aux_ret) OVER w > 1e-12 THEN corr(ret, aux_ret) OVER w END, 0) AS corr20 FROM e WINDOW w AS (PARTITION BY day ORDER BY ts ROWS 19 PRECEDING)",
}


@query(sql("SELECT day, ts, round(ret, 6) + 0.0 AS ret, round(trade_imbalance, 6) + 0.0 AS trade_imbalance, trade_count, round(avg_trade_size, 6) AS avg_trade_size, round(aux_ret, 6) + 0.0 AS aux_ret, round(vol20, 5) + 0.0 AS vol20 FROM f", "b15", "aux", **_F))
def feature_builder(spark, sf):
    return feature_rows(spark, sf).select("day", "ts", r6("ret"), r6("trade_imbalance"), "trade_count", r6("avg_trade_size"), r6("aux_ret"), r6("vol20", None, 5))


@query(sql("SELECT ts, round((ret - m) / s, 5) + 0.0 AS ret, round((trade_count - mc) / sc, 5) + 0.0 AS trade_count FROM f, (SELECT avg(ret) AS m, stddev_pop(ret) AS s, avg(trade_count) AS mc, stddev_pop(trade_count) AS sc FROM f WHERE ts < TIMESTAMP '2024-01-15') WHERE ts >= TIMESTAMP '2024-01-15'", "b15", "aux", **_F))
def scaler_frozen(spark, sf):
    rows, columns = feature_rows(spark, sf), ["ret", "trade_count"]
    scaler = features.fit_scaler(rows.filter("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), columns)
    return features.scale(rows.filter("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'"), columns, scaler).select("ts", r6("ret", None, 5), r6("trade_count", None, 5))


@query(sql("SELECT is_train, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM (SELECT d, row_number() OVER (ORDER BY d) <= floor((SELECT count(*) FROM px) * 0.8) AS is_train FROM px) GROUP BY 1", "px"))
def chrono_split(spark, sf):
    return features.chronological_split(views.px(spark, sf), "d").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query(sql("SELECT event_type, round(t, 6) AS threshold, count(*) FILTER (WHERE price > t) AS flagged, count(*) AS n FROM ticks JOIN (SELECT event_type AS e, quantile_cont(price, 0.925) AS t FROM ticks GROUP BY 1) ON e = event_type GROUP BY 1, 2", "ticks"))
def score_threshold_flag(spark, sf):
    held = features.flag_above(views.ticks(spark, sf), "price", 0.925, ["event_type"])
    return held.groupBy("event_type", r6("threshold")).agg(F.count_if("is_anomaly").alias("flagged"), F.count(F.lit(1)).alias("n"))


@query(sql("SELECT ts, model, score FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY k) AS n FROM (SELECT ts, 'early' AS model, trade_imbalance AS score, 0 AS k FROM b15 WHERE hour(ts) < 12 UNION ALL SELECT ts, 'main', close, 1 FROM b15)) WHERE n = 1", "b15").replace("SELECT ts, model, score FROM", "SELECT ts, model, round(score, 6) + 0.0 AS score FROM"))
def ensemble_merge(spark, sf):
    b = views.bars(spark, sf, 15)
    early, main = b.filter(F.hour("ts") < 12).select("ts", F.col("trade_imbalance").alias("score")), b.select("ts", F.col("close").alias("score"))
    return features.merge_models([("early", early), ("main", main)]).select("ts", "model", r6("score"))


@query(sql("SELECT day, min(ts) AS start, count(*) AS rows FROM (SELECT *, sum(1 - f) OVER (PARTITION BY day ORDER BY ts) AS g FROM (SELECT ts::DATE AS day, ts, (trade_imbalance > 0.3)::INT AS f FROM b15)) WHERE f = 1 GROUP BY day, g", "b15"))
def anomaly_episodes(spark, sf):
    held = day_bars(spark, sf).withColumn("flag", F.col("trade_imbalance") > 0.3)
    return features.episodes(held, "flag", "ts", ["day"]).select("day", "start", "rows")


@query(sql("SELECT count(*) AS episodes, round(avg(rows), 6) AS mean_rows, max(rows) AS longest, round(100.0 * avg((rows <= 14)::INT), 6) AS short_pct FROM (SELECT count(*) AS rows FROM (SELECT *, sum(1 - f) OVER (PARTITION BY day ORDER BY ts) AS g FROM (SELECT ts::DATE AS day, ts, (trade_imbalance > 0.3)::INT AS f FROM b15)) WHERE f = 1 GROUP BY day, g)", "b15"))
def episode_summary(spark, sf):
    """How long episodes last, and the share of those of at most 14 rows."""
    made = QUERIES["anomaly_episodes"](spark, sf)
    short = 100.0 * F.avg(F.when(F.col("rows") <= 14, 1.0).otherwise(0.0))
    return made.agg(F.count(F.lit(1)).alias("episodes"), r6(F.avg("rows"), "mean_rows"), F.max("rows").alias("longest"), r6(short, "short_pct"))


def signals(spark, sf):
    """(ts, anomaly_score, is_anomaly): the size of the trade imbalance stands for a model's score."""
    return views.bars(spark, sf, 15).select("ts", F.abs("trade_imbalance").alias("anomaly_score"), (F.abs("trade_imbalance") > 0.3).alias("is_anomaly"))


def direction_rows(spark, sf):
    return features.direction_features(asof.carried(day_bars(spark, sf), views.aux(spark, sf), "aux_close", F.to_date("ts")), signals(spark, sf))


_SHOWN = ("anomaly_score", "ret_1", "ret_5", "ret_15", "vol_15", "momentum_15", "aux_ret", "aux_vol20")


@query(sql("SELECT day, ts, " + ", ".join(f"round(coalesce({c}, 0), 5) + 0.0 AS {c}" for c in _SHOWN) + ", hour(ts)::INT * 60 + minute(ts)::INT - 570 AS from_open, (later / close - 1 > 0)::INT AS label FROM g2 WHERE abs(trade_imbalance) > 0.3 AND later IS NOT NULL",
  "b15", "aux", c=_F["c"],
  g1="SELECT *, abs(trade_imbalance) AS anomaly_score, " + ", ".join(f"close / lag(close, {k}) OVER o - 1 AS ret_{k}" for k in (1, 5, 15)) + ", coalesce(aux_close / lag(aux_close) OVER o - 1, 0) AS aux_ret, lead(close, 15) OVER o AS later FROM c WINDOW o AS (ORDER BY ts)",
  g2="SELECT *, CASE WHEN count(ret_1) OVER r = 15 THEN stddev_samp(ret_1) OVER r END AS vol_15, CASE WHEN count(ret_1) OVER r = 15 THEN avg(ret_1) OVER r END AS momentum_15, stddev_samp(aux_ret) OVER a AS aux_vol20 FROM g1 WINDOW r AS (ORDER BY ts ROWS 14 PRECEDING), a AS (PARTITION BY day ORDER BY ts ROWS 19 PRECEDING)"))
def direction_features(spark, sf):
    return direction_rows(spark, sf).select("day", "ts", *[F.round(c, 5).alias(c) for c in _SHOWN], "from_open", "label")


def direction_model(spark, sf, trees):
    """The model of the first four fifths of the anomalous rows in time, and all rows with is_train."""
    rows = features.chronological_split(direction_rows(spark, sf), "ts").persist()
    return boosting.fit(rows.filter("is_train"), list(features.DIRECTION), "label", trees), rows


@query()
def direction_gbt(spark, sf):
    """Accuracy by confidence on the rows that the model of 300 trees was not trained on."""
    model, rows = direction_model(spark, sf, 300)
    return models.confidence(boosting.predicted(model, rows.filter("NOT is_train")), "label").select("level", "n", r6("accuracy"))


@query()
def direction_importances(spark, sf):
    """Mean gain of the splits on each feature, in the first 60 trees."""
    model, rows = direction_model(spark, sf, 60)
    return boosting.importances(rows, model).select("feature", r6("importance"))


@query()
def direction_signals(spark, sf):
    """All signals, with the direction that 60 trees predict on anomalous rows: nothing on the others."""
    model, rows = direction_model(spark, sf, 60)
    return models.write_back(signals(spark, sf), boosting.predicted(model, rows), "ts").select("ts", "anomaly_score", "is_anomaly", r6("direction_prob"), "predicted_direction", r6("direction_confidence"))


@query()
def autoencoder_scores(spark, sf):
    """Scores under untrained weights of the architecture: the form of the pipeline, not a trained model."""
    made = frames.windows(feature_rows(spark, sf), list(features.FEATURES), 60, "ts", ["day"])
    return models.score_windows(made, list(features.FEATURES), models.random_weights(len(features.FEATURES), (16, 8)), ["day", "ts"]).select("day", "ts", r6("score"))


@query()
def substitute_anomalies(spark, sf):
    scored = models.substitute_scores(feature_rows(spark, sf), list(features.FEATURES), ["day", "ts"])
    return features.flag_above(scored, "score", 0.925, []).select("day", "ts", r6("score"), "is_anomaly")


@query()
def pca_2(spark, sf):
    return models.pca(views.table(spark, sf, "embeddings"), "embedding", 2, ["vec_id"])


@query()
def hmm_3state(spark, sf):
    """Three states of the daily return: state, its posterior, and the likelihood of the whole series."""
    w = frames.over("d")
    held = views.px(spark, sf).withColumn("ret", frames.change(F.col("close"), 1, w))
    made = hmm.states(held, ["ret"], "d")
    return made.select("d", "state", *[r6(F.get("posterior", F.lit(k)), f"posterior_{k}") for k in range(3)], r6("log_likelihood", None, 4))


@query()
def hmm_keyed(spark, sf):
    """Two states of the daily mean price of each kind of part, by its brand, all series at once."""
    sold = views.table(spark, sf, "lineitem").join(views.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    series = sold.groupBy("p_brand", F.col("l_shipdate").cast("date").alias("d")).agg(F.avg("l_extendedprice").alias("price"))
    return hmm.states(series, ["price"], "d", ["p_brand"], 2, 20).select("p_brand", "d", "state", r6(F.array_max("posterior"), "posterior"))
