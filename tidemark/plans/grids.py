"""Whole strategy grids: volatility ratio, ratio and funding, and additive signal sets, in full and walked forward."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import grids, orderstats, scans, strategy
from ..sources.views import with_views as sql
from . import backtests, research
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()

#: The published search spaces.
RATIO = ([2, 3, 4, 5, 7], [21, 45, 60, 70, 75, 80, 85, 90], [0.70, 0.75, 0.80, 0.85])
FIXED = ([2, 3, 4, 5, 7, 10], [14, 21, 30, 45, 60, 65, 70, 75, 80, 85, 90], [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85])
BOTH = ([2, 3, 4, 5, 7], [14, 21, 30, 45, 60, 70, 80], [0.55, 0.60, 0.65, 0.70, 0.75, 0.80], [1, 3, 5, 7], [0.60, 0.65, 0.70, 0.75, 0.80])
FUNDING, INTEREST, FEAR, GREED, AVERAGE, SHORT = [5, 7, 14, 21], [5, 7, 14], [20, 25, 30], [70, 75, 80], [10, 20, 30], [2, 3, 4]
SETS = ["all5", "fr_oi_fg", "fr_oi_ma", "fr_fg_ma"]
REGIME = ([3, 5], [21, 60], [0.75, 0.85])

ROUNDS = grids.quarters("1996-01-01", 22)
SPLIT = ["1999-01-01"]


def regime_flags(panel, short, long, levels, keep=()):
    """component, n, v: -1 where a ratio is above its quantile of the days before, else 0."""
    held = orderstats.expanding_quantiles(grids.ratios(panel, "rv", short, long), "ratio", levels, "n", ["s", "l"], prior_only=True)
    held = grids.at_levels(held, "quantiles", levels).withColumn("v", F.when(F.col("ratio") > F.col("limit"), -1).otherwise(0))
    return held.select(grids.named("rv", "s", "l", "q").alias("component"), "n", "v", *keep)


def regime_moments(spark, sf, space, starts):
    """Moments of each (short, long, quantile), with funding."""
    panel = grids.numbered(backtests.daily(spark, sf))
    line = grids.Line(panel, "d", "ret", "rate", starts)
    combos = grids.combinations(spark, [([f"rv:{s}:{lo}:{q}"], 1) for s, lo, q in product(*space) if s < lo])
    return grids.evaluate(combos, grids.packed(regime_flags(panel, *space), len(line.ret)), line)


def _values(rows, *names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{x}::DOUBLE" if isinstance(x, float) else f"'{x}'" if isinstance(x, str) else str(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") v({', '.join(names)}))"


def _means(x: str, lengths, fn: str = "avg") -> str:
    return f"""SELECT k, d, CASE WHEN count({x}) OVER w = k THEN {fn}({x}) OVER w END AS m FROM wide, {_values(sorted(lengths), "k")}
      WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN (k - 1) PRECEDING AND CURRENT ROW)"""


def _regime_sql(short, long, levels) -> dict[str, str]:
    listed = lambda xs: ", ".join(map(str, xs))
    return {
        "rm": _means("rv", {*short, *long}),
        "rr": f"SELECT a.k AS s, b.k AS l, d, a.m / nullif(b.m, 0) AS ratio FROM rm a JOIN rm b USING (d) WHERE a.k IN ({listed(short)}) AND b.k IN ({listed(long)}) AND a.k < b.k AND a.m / nullif(b.m, 0) IS NOT NULL",
        "rq": f"SELECT *, quantile_cont(ratio, [{listed(levels)}]) OVER (PARTITION BY s, l ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS limits FROM rr",
        "rf": f"SELECT s, l, q, d, CASE WHEN ratio > coalesce(limits[i], 'inf'::DOUBLE) THEN -1 ELSE 0 END AS v FROM rq, {_values([(i, float(q)) for i, q in enumerate(levels, 1)], 'i', 'q')}",
    }


def _segments(starts) -> str:
    return "(" + " + ".join(f"(d >= DATE '{x}')::INT" for x in starts) + ")"


def _moments(rows: str, starts, first: float, funding: bool = True) -> dict[str, str]:
    """rows: param, d, short (whether the components' sum is low enough) -> moments by segment, as in grids.evaluate."""
    rate = "rate" if funding else "0.0"
    return {
        "ps": f"SELECT param, d, coalesce(lag(CASE WHEN short THEN -1.0 ELSE 1.0 END) OVER (PARTITION BY param ORDER BY d), {first})::DOUBLE AS pos FROM ({rows})",
        "pn": f"""SELECT param, d, pos, {_segments(starts)} AS segment, pos * ret - turn * 0.0004 - pos * {rate} AS strat, ret - {rate} AS hold, turn, pos * {rate} AS funding
          FROM (SELECT *, coalesce(abs(pos - lag(pos) OVER (PARTITION BY param ORDER BY d)), 0) AS turn FROM ps) JOIN wide USING (d)""",
        "mo": """SELECT param, segment, count(*) AS n, count(*) FILTER (WHERE pos < 0) AS short, sum(strat) AS total, sum(strat * strat) AS square, sum(strat - hold) AS excess, sum((strat - hold) ** 2) AS excess_square,
          sum(hold) AS hold, product(1 + strat) AS growth FROM pn GROUP BY 1, 2""",
    }


def _score(n: str, total: str, square: str, ddof: int = 1) -> str:
    squares = f"({square} - {total} * {total} / {n})"
    return f"CASE WHEN {n} > {ddof} AND {squares} > 1e-18 THEN {total} / {n} / sqrt({squares} / ({n} - {ddof})) * sqrt(365) ELSE 0 END"


def _walk(relative: bool, least: int, short: float) -> dict[str, str]:
    x = ("excess", "excess_square", 0) if relative else ("total", "square", 1)
    return {
        "gr": f"SELECT param, segment FROM (SELECT DISTINCT param FROM mo), (SELECT unnest(range({len(ROUNDS)})) AS segment)",
        "tr": f"""SELECT param, segment AS round, coalesce(sum(n) OVER w, 0) AS n_train, coalesce(sum(short) OVER w, 0) AS short, coalesce(sum({x[0]}) OVER w, 0) AS x, coalesce(sum({x[1]}) OVER w, 0) AS xx
          FROM gr LEFT JOIN mo USING (param, segment) WINDOW w AS (PARTITION BY param ORDER BY segment)""",
        "be": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY score DESC, param) AS place FROM (SELECT param, round, n_train, round({_score('n_train', 'x', 'xx', x[2])}, 9) + 0.0 AS score FROM tr
          WHERE round < {len(ROUNDS) - 1} AND n_train >= {least} AND short >= {short} * n_train)) WHERE place = 1""",
    }


_RESULT = f"""SELECT be.round::INT AS round, be.param::INT AS param, round(score, 6) + 0.0 AS score, n_train::BIGINT AS n_train, coalesce(n, 0)::BIGINT AS n_test, round(coalesce(total, 0), 6) + 0.0 AS total, round(coalesce(hold, 0), 6) + 0.0 AS hold,
  round({_score('n', 'total', 'square')}, 6) + 0.0 AS test_score, round(coalesce(growth, 1), 6) AS growth FROM be LEFT JOIN mo ON mo.param = be.param AND mo.segment = be.round + 1"""


def _walked(moments, **rule):
    return _shown(grids.walk_forward(moments, rounds=len(ROUNDS) - 1, **rule))


def _shown(best):
    return best.select("round", "param", r6("score"), "n_train", "n_test", r6("total"), r6("hold"), r6("test_score"), r6("growth"))


_P = {"wide": backtests._P["panel"]}
_V = backtests._V


def _params(space) -> str:
    return _values([(k, s, lo, q) for k, (s, lo, q) in enumerate(x for x in product(*space) if x[0] < x[1])], "param", "s", "l", "q")


def _regime_rows(space) -> str:
    return f"SELECT param, d, v < 0 AS short FROM rf JOIN {_params(space)} USING (s, l, q)"


@query(sql(_RESULT, *_V, **_P, **_regime_sql(*RATIO), **_moments(_regime_rows(RATIO), ROUNDS, 0), **_walk(False, 30, 0)))
def walk_forward_rv(spark, sf):
    """All 160 combinations of the volatility ratio over 22 quarters, chosen by the Sharpe ratio of the days before each."""
    return _walked(regime_moments(spark, sf, RATIO, ROUNDS), least=30)


@query(sql(f"SELECT count(*) AS rounds, median(s) AS short, median(l) AS long, round(median(q), 6) AS level FROM be JOIN {_params(RATIO)} p ON p.param = be.param", *_V, **_P, **_regime_sql(*RATIO), **_moments(_regime_rows(RATIO), ROUNDS, 0), **_walk(False, 30, 0)))
def walk_forward_median(spark, sf):
    """The median of each parameter that the 22 rounds chose."""
    best = grids.walk_forward(regime_moments(spark, sf, RATIO, ROUNDS), least=30, rounds=len(ROUNDS) - 1)
    named = spark.createDataFrame([(k, s, lo, q) for k, (s, lo, q) in enumerate(x for x in product(*RATIO) if x[0] < x[1])], "p int, s int, l int, q double")
    middle = lambda c: F.percentile(c, F.lit(0.5))  # noqa: E731  22 rows
    return best.join(named, F.col("param") == F.col("p")).agg(F.count(F.lit(1)).alias("rounds"), middle("s").alias("short"), middle("l").alias("long"), r6(middle("q"), "level"))


@query(sql(_RESULT, *_V, **_P, **_regime_sql(*RATIO), **_moments(_regime_rows(RATIO), ROUNDS, 0), **_walk(True, 60, 0.05)))
def walk_forward_ratio(spark, sf):
    """The same grid, chosen by information ratio among combinations short on at least a twentieth of the training days."""
    return _walked(regime_moments(spark, sf, RATIO, ROUNDS), relative=True, least=60, short=0.05)


def _sides(m, a: int, b: int):
    """n and score of two segments of each combination, side by side."""
    one = lambda c, s: F.max(F.when(F.col("segment") == s, F.col(c)))
    return m.groupBy("param").agg(*[one(c, s).alias(f"{c}_{s}") for s in (a, b) for c in ("n", "total", "square", "growth", "short")])


_SIDES = f"""SELECT param::INT AS param, a.n AS n_train, round({_score('a.n', 'a.total', 'a.square')}, 6) + 0.0 AS train, round({_score('b.n', 'b.total', 'b.square')}, 6) + 0.0 AS test, round(b.growth - 1, 6) + 0.0 AS test_return,
  round(100.0 * (a.short + b.short) / (a.n + b.n), 6) AS short_pct FROM mo a JOIN mo b USING (param) WHERE a.segment = 0 AND b.segment = 1"""


def _both_sides(m):
    s = _sides(m, 0, 1)
    score = lambda k: grids.ratio_score(F.col(f"n_{k}"), F.col(f"total_{k}"), F.col(f"square_{k}"))
    short = 100.0 * (F.col("short_0") + F.col("short_1")) / (F.col("n_0") + F.col("n_1"))
    return s.select("param", F.col("n_0").alias("n_train"), r6(score(0), "train"), r6(score(1), "test"), r6(F.col("growth_1") - 1, "test_return"), r6(short, "short_pct"))


@query(sql(_SIDES, *_V, **_P, **_regime_sql(*FIXED), **_moments(_regime_rows(FIXED), SPLIT, 0)))
def fixed_oos_grid(spark, sf):
    """All 528 combinations of the volatility ratio, on the days before a fixed date and on those from it on."""
    return _both_sides(regime_moments(spark, sf, FIXED, SPLIT))


def and_moments(spark, sf, starts):
    """Moments of short positions only where the volatility ratio and the mean funding are both above their quantiles of the days
    before; the funding's quantiles begin where the ratio's long mean does.
    """
    short, long, levels, lengths, rates = BOTH
    panel = grids.numbered(backtests.daily(spark, sf))
    line = grids.Line(panel, "d", "ret", "rate", starts)
    flags = regime_flags(panel, short, long, levels)
    ready = grids.ratios(panel, "rv", short[:1], long).select("l", F.col("n").alias("__n"))
    means = grids.rolling_means(panel, "rate", lengths, digits=12).join(ready, F.col("n") == F.col("__n")).select("l", "length", "n", "m")
    held = orderstats.expanding_quantiles(means, "m", rates, "n", ["l", "length"], prior_only=True)
    held = grids.at_levels(held, "quantiles", rates).withColumn("v", F.when(F.col("m") > F.col("limit"), -1).otherwise(0))
    both = flags.union(held.select(grids.named("fr", "l", "length", "q"), "n", "v"))
    combos = [([f"rv:{s}:{lo}:{q}", f"fr:{lo}:{n}:{fq}"], 2) for s, lo, q, n, fq in product(*BOTH) if s < lo]
    return grids.evaluate(grids.combinations(spark, combos), grids.packed(both, len(line.ret)), line)


_AND = {
    **_regime_sql(*BOTH[:3]),
    "fm": f"SELECT DISTINCT rr.l, m.k, m.d, round(m.m, 12) AS m FROM ({_means('rate', BOTH[3])}) m JOIN rr ON rr.d = m.d AND rr.s = {BOTH[0][0]} WHERE m.m IS NOT NULL",
    "fq": f"SELECT *, quantile_cont(m, {BOTH[4]}) OVER (PARTITION BY l, k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS limits FROM fm",
    "ff": f"SELECT l, k, q, d, m > coalesce(limits[i], 'inf'::DOUBLE) AS high FROM fq, {_values([(i, float(q)) for i, q in enumerate(BOTH[4], 1)], 'i', 'q')}",
    "cb": "SELECT * FROM " + _values([(k, *x) for k, x in enumerate(x for x in product(*BOTH) if x[0] < x[1])], "param", "s", "l", "q", "k", "fq"),
}
_AND_ROWS = "SELECT param, rf.d, rf.v < 0 AND ff.high AS short FROM cb JOIN rf ON rf.s = cb.s AND rf.l = cb.l AND rf.q = cb.q JOIN ff ON ff.l = cb.l AND ff.k = cb.k AND ff.q = cb.fq AND ff.d = rf.d"


@query(sql(_SIDES, *_V, **_P, **_AND, **_moments(_AND_ROWS, SPLIT, 0)))
def regime_and_funding_grid(spark, sf):
    """All 4,200 combinations, on the days before a fixed date and on those from it on."""
    return _both_sides(and_moments(spark, sf, SPLIT))


@query(sql(_RESULT, *_V, **_P, **_AND, **_moments(_AND_ROWS, ROUNDS, 0), **_walk(False, 60, 0)))
def walk_forward_and(spark, sf):
    """The 4,200 combinations over 22 quarters."""
    return _walked(and_moments(spark, sf, ROUNDS), least=60)


@query(sql("""SELECT param::INT AS param, round(CASE WHEN count(*) > 1 THEN avg(strat) / stddev_samp(strat) * sqrt(252) END - 0.5 * abs(min(path - peak)) - 0.3 * 0.0004 * count(*) FILTER (WHERE turn > 0) - 0.4 * sum(funding) - 2.0 * avg((abs(pos) > 1)::INT), 6) AS objective
  FROM (SELECT *, max(path) OVER (PARTITION BY param ORDER BY d) AS peak FROM (SELECT *, sum(strat) OVER (PARTITION BY param ORDER BY d) AS path FROM pn)) GROUP BY 1""", *_V, **_P, **_regime_sql(*RATIO), **{k: v for k, v in _moments(_regime_rows(RATIO), [], 0).items() if k != "mo"}).replace("() AS segment", "0 AS segment"))  # fmt: skip
def composite_objective(spark, sf):
    """Sharpe ratio less drawdown, trades, funding and excess leverage, of all 160 combinations over all days."""
    m = regime_moments(spark, sf, RATIO, [])
    score = grids.ratio_score(F.col("n"), F.col("total"), F.col("square"), 252)
    return m.select("param", r6(strategy.objective(score, F.col("drawdown"), F.col("changes"), F.col("funding"), F.col("over") / F.col("n")), "objective"))


def signal_components(panel):
    """component, n, v of funding, open interest, sentiment bands, moving averages and volatility regimes."""
    funding = grids.rolling_means(panel, "rate", FUNDING, total=True, digits=9)
    funding = orderstats.quantile_columns(funding, {"hi": ("m", 0.75, False, 1), "lo": ("m", 0.25, False, 1)}, "n", ["length"])
    side = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
    made = funding.select(grids.named("fr", "length"), "n", side(F.col("m") > F.col("hi"), F.col("m") < F.col("lo")))
    interest = grids.rolling_means(panel, "oic", INTEREST, digits=12)
    made = made.union(interest.select(grids.named("oi", "length"), "n", side(F.col("m") > 0, F.col("m") < 0)))
    bands = F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in product(FEAR, GREED)]))
    mood = panel.select("n", "fg", bands.alias("b")).select("n", "fg", "b.*")
    made = made.union(mood.select(grids.named("fg", "low", "high"), "n", side(F.col("fg") < F.col("low"), F.col("fg") > F.col("high"))))
    price = scans.running_sum(panel, F.log1p("ret"), "n", scans.span_of(panel, "n"), "logs").withColumn("price", F.exp("logs"))
    means = grids.rolling_means(price, "price", AVERAGE).withColumnRenamed("n", "__n")
    lengths = F.explode(F.array(*map(F.lit, AVERAGE)))
    held = price.select("n", "price", lengths.alias("k")).join(means, (F.col("n") == F.col("__n")) & (F.col("k") == F.col("length")), "left")
    made = made.union(held.select(grids.named("ma", "k"), "n", side(F.col("price") > F.col("m"), F.col("price") < F.col("m"))))
    return regime_flags(panel, *REGIME).union(made).toDF("component", "n", "v")


def signal_grid() -> list[tuple[list[str], int]]:
    """All combinations in their published order: the parameters that a set does not use vary as well."""
    rows = []
    for fw, ow, low, high, ma, kind, least in product(FUNDING, INTEREST, FEAR, GREED, AVERAGE, SETS, SHORT):
        parts = [f"fr:{fw}"] + [f"oi:{ow}"] * ("oi" in kind or kind == "all5") + [f"fg:{low}:{high}"] * ("fg" in kind or kind == "all5") + [f"ma:{ma}"] * ("ma" in kind or kind == "all5")
        for regime in [[f"rv:{s}:{lo}:{q}"] for s, lo, q in product(*REGIME)] if kind == "all5" else [[]]:
            rows.append((parts + regime, least))
    return rows


def signal_moments(spark, sf, starts):
    panel = grids.numbered(research.wide(spark, sf))
    line = grids.Line(panel, "d", "ret", None, starts)
    return grids.evaluate(grids.combinations(spark, signal_grid()), grids.packed(signal_components(panel), len(line.ret)), line, first=1.0)


def _signal_sql(starts) -> dict[str, str]:
    use = lambda kind, part: kind == "all5" or part in kind
    rows = []
    for fw, ow, low, high, ma, kind, least in product(FUNDING, INTEREST, FEAR, GREED, AVERAGE, SETS, SHORT):
        for s, lo, q in product(*REGIME) if kind == "all5" else [(0, 0, 0.0)]:
            rows.append((len(rows), kind, fw, ow if use(kind, "oi") else 0, low if use(kind, "fg") else 0, high if use(kind, "fg") else 0, ma if use(kind, "ma") else 0, s, lo, float(q), least))
    full = _moments("", starts, 1.0, False)
    return {
        "cb": "SELECT * FROM " + _values(rows, "param", "kind", "fw", "ow", "low", "high", "ma", "s", "l", "q", "least"),
        "fs": f"SELECT k AS fw, d, round(m, 9) AS f FROM ({_means('rate', FUNDING, 'sum')}) WHERE m IS NOT NULL",
        "fr": "SELECT fw, d, CASE WHEN f > quantile_cont(f, 0.75) OVER w THEN 1 WHEN f < quantile_cont(f, 0.25) OVER w THEN -1 ELSE 0 END AS v1 FROM fs WINDOW w AS (PARTITION BY fw ORDER BY d ROWS UNBOUNDED PRECEDING)",
        "om": f"SELECT k AS ow, d, sign(round(m, 12))::INT AS v2 FROM ({_means('oic', INTEREST)}) WHERE m IS NOT NULL UNION ALL SELECT 0, d, 0 FROM wide",
        "fg": f"SELECT low, high, d, CASE WHEN fg < low THEN 1 WHEN fg > high THEN -1 ELSE 0 END AS v3 FROM (SELECT d, fg FROM wide), {_values(FEAR, 'low')}, {_values(GREED, 'high')} UNION ALL SELECT 0, 0, d, 0 FROM wide",
        "pr": "SELECT d, exp(sum(ln(1 + ret)) OVER (ORDER BY d)) AS price FROM wide",
        "pm": _means("price", AVERAGE).replace("FROM wide", "FROM pr"),
        "mv": "SELECT k AS ma, d, CASE WHEN price > m THEN 1 WHEN price < m THEN -1 ELSE 0 END AS v4 FROM pm JOIN pr USING (d) UNION ALL SELECT 0, d, 0 FROM wide",
        **_regime_sql(*REGIME),
        "rg": "SELECT s, l, q, d, v AS v5 FROM rf UNION ALL SELECT 0, 0, 0.0, d, 0 FROM wide",
        # parameters that count, whatever the threshold: their scores, then positions by threshold, then all combinations
        "ky": "SELECT *, row_number() OVER (ORDER BY kind, fw, ow, low, high, ma, s, l, q) AS key FROM (SELECT DISTINCT kind, fw, ow, low, high, ma, s, l, q FROM cb)",
        "sc": "SELECT key, d, v1 + v2 + v3 + v4 + v5 AS score FROM ky JOIN fr USING (fw) JOIN om USING (ow, d) JOIN fg USING (low, high, d) JOIN mv USING (ma, d) JOIN rg USING (s, l, q, d)",
        "sl": "SELECT key, d, lag(score) OVER w AS one, lag(score, 2) OVER w AS two, row_number() OVER w AS i FROM sc WINDOW w AS (PARTITION BY key ORDER BY d)",
        "pp": "SELECT key, least, d, CASE WHEN i = 1 OR one > -least THEN 1.0 ELSE -1.0 END::DOUBLE AS pos, CASE WHEN i <= 2 OR two > -least THEN 1.0 ELSE -1.0 END::DOUBLE AS was FROM sl, " + _values(SHORT, "least"),
        "pn": f"SELECT key, least, pos, {_segments(starts)} AS segment, pos * ret - abs(pos - was) * 0.0004 AS strat, ret AS hold FROM pp JOIN wide USING (d)",
        "mk": full["mo"].replace("param, segment", "key, least, segment").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3"),
        "mo": "SELECT cb.param, mk.* FROM cb JOIN ky USING (kind, fw, ow, low, high, ma, s, l, q) JOIN mk ON mk.key = ky.key AND mk.least = cb.least",
    }


_WIDE = {"panel": backtests._P["panel"], **{k: v for k, v in research._PANEL.items()}}


@query(sql(_RESULT, *_V, **_WIDE, **_signal_sql(ROUNDS), **_walk(True, 60, 0.05)))
def walk_forward_signals(spark, sf):
    """Four sets of signals in 10,692 combinations over 22 quarters, by information ratio."""
    return _walked(signal_moments(spark, sf, ROUNDS), relative=True, least=60, short=0.05)


@query(sql(_SIDES, *_V, **_WIDE, **_signal_sql(SPLIT)))
def signal_sets_grid(spark, sf):
    """The 10,692 combinations on the days before a fixed date and on those from it on."""
    return _both_sides(signal_moments(spark, sf, SPLIT))
