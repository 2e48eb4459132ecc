"""Queries of candle geometry and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded, settled
from tidemark.operators import candles, knowledge
from tidemark.plans import sql
from tidemark.sources.bars import item_bars

GEOMETRY = f"""
v AS (SELECT *, coalesce(high >= greatest(open, close) AND low <= least(open, close) AND low > 0 AND volume >= 0, false) AS valid FROM bars),
g0 AS (SELECT symbol, ts, open, high, low, close, volume, valid, CASE WHEN valid THEN high - low END AS range, CASE WHEN valid THEN close - open END AS body,
              CASE WHEN valid THEN high - greatest(open, close) END AS upper_wick, CASE WHEN valid THEN least(open, close) - low END AS lower_wick,
              CASE WHEN valid THEN close END AS cv, CASE WHEN valid THEN open END AS ov, CASE WHEN valid THEN volume END AS vv FROM v),
g1 AS (SELECT *, valid AND coalesce(range, 1) = 0 AS zero_range, abs(body) AS abs_body, valid AND coalesce(range, 1) <> 0 AS usable FROM g0),
g2 AS (SELECT *, {sql.full("avg(vv)", "vv", 20, "prior")} AS v20, {sql.full("avg(abs_body)", "abs_body", 20, "prior")} AS avg_body_prior,
              {sql.full("avg(range)", "range", 10, "prior")} AS r10, CASE WHEN usable THEN range END AS den FROM g1),
g3 AS (SELECT *, {sql.pos("abs_body", "den")} AS body_ratio, {sql.pos("upper_wick", "den")} AS upper_wick_ratio, {sql.pos("lower_wick", "den")} AS lower_wick_ratio,
              {sql.pos("cv - low", "den")} AS close_position, CASE WHEN body > 0 THEN 'bullish' WHEN body < 0 THEN 'bearish' WHEN valid THEN 'neutral' ELSE 'invalid' END AS direction,
              round(ov / nullif(lag(cv) OVER ({sql.W}), 0) - 1, 10) AS gap, {sql.pos("vv", "v20")} AS relative_volume,
              {sql.pos(f"lag(cv) OVER ({sql.W}) - lag(cv, 11) OVER ({sql.W})", "r10")} AS trend_score FROM g2),
g AS (SELECT symbol, ts, open, high, low, close, volume, valid, range, body, upper_wick, lower_wick, zero_range, abs_body, usable, body_ratio, upper_wick_ratio, lower_wick_ratio,
             close_position, direction, gap, relative_volume, avg_body_prior, trend_score,
             CASE WHEN trend_score >= 1 THEN 'up' WHEN trend_score <= -1 THEN 'down' WHEN trend_score IS NOT NULL THEN 'none' ELSE 'unknown' END AS prior_trend FROM g3)"""

DOUBLES = "open high low close volume range body upper_wick lower_wick abs_body body_ratio upper_wick_ratio lower_wick_ratio close_position gap relative_volume avg_body_prior trend_score".split()
GEOMETRY_SQL = f"WITH {sql.BARS}, {GEOMETRY} SELECT symbol, ts, valid, zero_range, usable, direction, prior_trend, {sql.all_settled(' '.join(DOUBLES))} FROM g"

LAGS = ", ".join(f"lag({c}, {k}) OVER ({sql.W}) AS {a}{k}" for c, a, most in (("open", "o", 2), ("high", "h", 4), ("low", "l", 4), ("close", "c", 4), ("range", "r", 1), ("abs_body", "ab", 4), ("body_ratio", "br", 4), ("upper_wick_ratio", "uw", 2), ("lower_wick_ratio", "lw", 2), ("direction", "d", 4), ("usable", "u", 4), ("prior_trend", "t", 4), ("ts", "ts", 4)) for k in range(1, most + 1))
U = ["usable", "usable AND u1", "usable AND u1 AND u2", "", "usable AND u1 AND u2 AND u3 AND u4"]


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0.0, least(1.0, {x})) END"


def _up(x: str, a: float, b: float) -> str:
    return _clip(f"(({x}) - {a}) / ({b} - {a})")


def _down(x: str, a: float, b: float) -> str:
    return _clip(f"({a} - ({x})) / ({a} - {b})")


def _mean(*x: str) -> str:
    return f"list_avg([{', '.join(x)}])"


def _masks() -> dict[str, tuple[str, str]]:
    out = {}
    hammer = lambda a, b, w: (f"{U[0]} AND body_ratio <= 0.3 AND {a} >= 0.6 AND {b} <= 0.1 AND {w} >= 2 * abs_body", _mean(_up(a, 0.6, 1), _down(b, 0.1, 0), _down("body_ratio", 0.3, 0)))
    out["hammer"] = out["hanging_man"] = hammer("lower_wick_ratio", "upper_wick_ratio", "lower_wick")
    out["inverted_hammer"] = out["shooting_star"] = hammer("upper_wick_ratio", "lower_wick_ratio", "upper_wick")
    log = _clip(f"ln(nullif({sql.pos('abs_body', 'ab1')}, 0)) / ln(10.0)")
    out["bullish_engulfing"] = f"{U[1]} AND d1 = 'bearish' AND direction = 'bullish' AND br1 > 0.1 AND open <= c1 AND close >= o1 AND abs_body > ab1", log
    out["bearish_engulfing"] = f"{U[1]} AND d1 = 'bullish' AND direction = 'bearish' AND br1 > 0.1 AND open >= c1 AND close <= o1 AND abs_body > ab1", log
    tb, tt = sql.pos("abs(low - l1)", "(range + r1) / 2"), sql.pos("abs(high - h1)", "(range + r1) / 2")
    out["tweezer_bottom"] = f"{U[1]} AND d1 = 'bearish' AND direction = 'bullish' AND {tb} <= 0.05", _down(tb, 0.05, 0)
    out["tweezer_top"] = f"{U[1]} AND d1 = 'bullish' AND direction = 'bearish' AND {tt} <= 0.05", _down(tt, 0.05, 0)
    ms, es = sql.pos("close - c2", "o2 - c2"), sql.pos("c2 - close", "c2 - o2")
    shape = "br2 >= 0.5 AND br1 <= 0.3 AND body_ratio >= 0.5"
    star = lambda p: _mean(_up("br2", 0.5, 1), _down("br1", 0.3, 0), _up("body_ratio", 0.5, 1), _up(p, 0.5, 1))
    out["morning_star"] = f"{U[2]} AND d2 = 'bearish' AND direction = 'bullish' AND {shape} AND greatest(o1, c1) <= c2 AND {ms} >= 0.5", star(ms)
    out["evening_star"] = f"{U[2]} AND d2 = 'bullish' AND direction = 'bearish' AND {shape} AND least(o1, c1) >= c2 AND {es} >= 0.5", star(es)
    three = _mean(_up("br2", 0.5, 1), _up("br1", 0.5, 1), _up("body_ratio", 0.5, 1))
    body = "body_ratio >= 0.5 AND br1 >= 0.5 AND br2 >= 0.5 AND o1 BETWEEN least(o2, c2) AND greatest(o2, c2) AND open BETWEEN least(o1, c1) AND greatest(o1, c1)"
    out["three_white_soldiers"] = f"{U[2]} AND {body} AND direction = 'bullish' AND d1 = 'bullish' AND d2 = 'bullish' AND upper_wick_ratio <= 0.25 AND uw1 <= 0.25 AND uw2 <= 0.25 AND close > c1 AND c1 > c2", three
    out["three_black_crows"] = f"{U[2]} AND {body} AND direction = 'bearish' AND d1 = 'bearish' AND d2 = 'bearish' AND lower_wick_ratio <= 0.25 AND lw1 <= 0.25 AND lw2 <= 0.25 AND close < c1 AND c1 < c2", three
    inner = " AND ".join(f"h{k} <= h4 AND l{k} >= l4 AND ab{k} < ab4" for k in (1, 2, 3))
    five = _mean(_up("br4", 0.5, 1), _up("body_ratio", 0.5, 1))
    out["rising_three_methods"] = f"{U[4]} AND d4 = 'bullish' AND direction = 'bullish' AND br4 >= 0.5 AND body_ratio >= 0.5 AND {inner} AND close > c4", five
    out["falling_three_methods"] = f"{U[4]} AND d4 = 'bearish' AND direction = 'bearish' AND br4 >= 0.5 AND body_ratio >= 0.5 AND {inner} AND close < c4", five
    wide = sql.pos("range", "r1")
    out["inside_bar"] = f"{U[1]} AND high < h1 AND low > l1", _down(wide, 1, 0)
    out["outside_bar"] = f"{U[1]} AND high > h1 AND low < l1", _up(wide, 1, 3)
    out["doji"] = f"{U[0]} AND body_ratio <= 0.1", _down("body_ratio", 0.1, 0)
    out["spinning_top"] = f"{U[0]} AND body_ratio > 0.1 AND body_ratio <= 0.3 AND upper_wick_ratio >= 0.25 AND lower_wick_ratio >= 0.25", _mean(_up("upper_wick_ratio", 0.25, 0.5), _up("lower_wick_ratio", 0.25, 0.5))
    out["marubozu"] = f"{U[0]} AND body_ratio >= 0.9 AND upper_wick_ratio <= 0.05 AND lower_wick_ratio <= 0.05", _up("body_ratio", 0.9, 1)
    multiple = sql.pos("abs_body", "avg_body_prior")
    out["long_body"] = f"{U[0]} AND body_ratio >= 0.6 AND {multiple} >= 1.5", _mean(_up(multiple, 1.5, 3), _up("body_ratio", 0.6, 1))
    return out


OBSERVATION_COLUMNS = "symbol, ts, pattern, family, bars, orientation, context_required, trend_before, context_met, strength, first_bar_ts"


#: pattern, family, bars, orientation, trend asked for, whether the name hangs on it.
LISTED = """
doji indecision 1 neutral - -
spinning_top indecision 1 neutral - -
marubozu momentum 1 own - -
long_body momentum 1 own - -
hammer reversal 1 bullish down named
hanging_man reversal 1 bearish up named
inverted_hammer reversal 1 bullish down named
shooting_star reversal 1 bearish up named
bullish_engulfing reversal 2 bullish down -
bearish_engulfing reversal 2 bearish up -
tweezer_bottom reversal 2 bullish down -
tweezer_top reversal 2 bearish up -
inside_bar structure 2 neutral - -
outside_bar structure 2 neutral - -
morning_star reversal 3 bullish down -
evening_star reversal 3 bearish up -
three_white_soldiers continuation 3 bullish - -
three_black_crows continuation 3 bearish - -
rising_three_methods continuation 5 bullish - -
falling_three_methods continuation 5 bearish - -
"""


def _observation(listed: str) -> str:
    name, family, bars, way, trend, named = listed.split()
    mask, strength = _masks()[name]
    before, first = ("prior_trend", "ts") if bars == "1" else (f"t{int(bars) - 1}", f"ts{int(bars) - 1}")
    context = "CAST(NULL AS VARCHAR)" if trend == "-" else f"'{trend}'"
    met = "CAST(NULL AS BOOLEAN)" if trend == "-" else f"coalesce({before} = '{trend}', false)"
    hit = f"({mask})" + (f" AND {before} = '{trend}'" if named == "named" else "")
    side = "direction" if way == "own" else f"'{way}'"
    return f"SELECT symbol, ts, '{name}' AS pattern, '{family}' AS family, {bars} AS bars, {side} AS orientation, {context} AS context_required, {before} AS trend_before, {met} AS context_met, {sql.settled(strength)} AS strength, {first} AS first_bar_ts FROM x WHERE {hit}"


OBSERVATIONS_CTE = f"{sql.BARS}, {GEOMETRY}, x AS (SELECT *, {LAGS} FROM g), obs AS ({' UNION ALL '.join(_observation(p) for p in LISTED.split(chr(10)) if p)})"
OBSERVATIONS_SQL = f"WITH {OBSERVATIONS_CTE} SELECT {OBSERVATION_COLUMNS} FROM obs"


def flt_18_geometry(spark, sf_dir):
    return rounded(candles.geometry(item_bars(spark, sf_dir)))


def observations(spark, sf_dir):
    return candles.observations(candles.geometry(item_bars(spark, sf_dir))).withColumn("strength", settled(F.col("strength")))


def cdl_17_observations(spark, sf_dir):
    return observations(spark, sf_dir)


def _one(names):
    return lambda spark, sf_dir: observations(spark, sf_dir).where(F.col("pattern").isin(*names)).groupBy("symbol", "pattern", "orientation", "context_met").agg(F.count("*").alias("n"), settled(F.avg("strength")).alias("mean_strength"), F.min("ts").alias("first_ts"), F.max("first_bar_ts").alias("last_first_bar"))


def _one_sql(names):
    listed = ", ".join(f"'{n}'" for n in names)
    return f"WITH {OBSERVATIONS_CTE} SELECT symbol, pattern, orientation, context_met, count(*) AS n, round(avg(strength) + 1e-9, 6) AS mean_strength, min(ts) AS first_ts, max(first_bar_ts) AS last_first_bar FROM obs WHERE pattern IN ({listed}) GROUP BY ALL"


#: Row of the inventory, patterns.
FAMILIES = {
    "cdl_02_doji": ["doji"], "cdl_03_spinning_top": ["spinning_top"], "cdl_04_marubozu": ["marubozu"], "cdl_05_long_body": ["long_body"],
    "cdl_06_hammer": ["hammer", "hanging_man"], "cdl_07_inverted_hammer": ["inverted_hammer", "shooting_star"], "cdl_08_engulfing": ["bullish_engulfing", "bearish_engulfing"],
    "cdl_09_tweezer": ["tweezer_bottom", "tweezer_top"], "cdl_10_inside_bar": ["inside_bar"], "cdl_11_outside_bar": ["outside_bar"], "cdl_12_star": ["morning_star", "evening_star"],
    "cdl_13_three": ["three_white_soldiers", "three_black_crows"], "cdl_14_three_methods": ["rising_three_methods", "falling_three_methods"],
}


def cdl_16_context(spark, sf_dir):
    """How often each pattern that asks for a trend has it before its first bar."""
    obs = observations(spark, sf_dir).where("context_required is not null")
    return obs.groupBy("pattern", "context_required", "trend_before").agg(F.count("*").alias("n"), F.count_if("context_met").alias("met"))


CDL_16_SQL = f"WITH {OBSERVATIONS_CTE} SELECT pattern, context_required, trend_before, count(*) AS n, count(*) FILTER (context_met) AS met FROM obs WHERE context_required IS NOT NULL GROUP BY ALL"


def agg_39_strongest(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("side", F.concat_ws("_", "family", "orientation"))
    sides = ["reversal_bullish", "reversal_bearish", "continuation_bullish", "continuation_bearish", "momentum_bullish", "momentum_bearish"]
    return obs.groupBy("symbol", "ts").pivot("side", sides).agg(F.max("strength"))


AGG_39_SQL = f"WITH {OBSERVATIONS_CTE} SELECT symbol, ts, " + ", ".join(f"max(strength) FILTER (family || '_' || orientation = '{s}') AS {s}" for s in "reversal_bullish reversal_bearish continuation_bullish continuation_bearish momentum_bullish momentum_bearish".split()) + " FROM obs GROUP BY symbol, ts"


def topk_01_ordering(spark, sf_dir):
    """Place of each observation in the stable order (ts, pattern) of its instrument."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts", "pattern")
    return observations(spark, sf_dir).select("symbol", "ts", "pattern", F.row_number().over(w).cast("long").alias("place"))


TOPK_01_SQL = f"WITH {OBSERVATIONS_CTE} SELECT symbol, ts, pattern, row_number() OVER (PARTITION BY symbol ORDER BY ts, pattern) AS place FROM obs"


def cdl_18_knowledge(spark, sf_dir):
    return knowledge.recognised(candles.geometry(item_bars(spark, sf_dir)))


_TWO = "usable AND u1 AND br1 >= 0.5"
_INSIDE = "greatest(open, close) < greatest(o1, c1) AND least(open, close) > least(o1, c1)"
_SHAPE = "br2 >= 0.5 AND br1 <= 0.3 AND body_ratio >= 0.5 AND br1 <= 0.1 AND usable AND u1 AND u2"
#: Masks over lags named o1, c1 and so on.
KNOWLEDGE = {
    "bullish_harami": f"{_TWO} AND {_INSIDE} AND d1 = 'bearish' AND body_ratio <= 0.3 AND body_ratio > 0.1 AND direction = 'bullish'",
    "bearish_harami": f"{_TWO} AND {_INSIDE} AND d1 = 'bullish' AND body_ratio <= 0.3 AND body_ratio > 0.1 AND direction = 'bearish'",
    "bullish_harami_cross": f"{_TWO} AND {_INSIDE} AND d1 = 'bearish' AND body_ratio <= 0.1",
    "bearish_harami_cross": f"{_TWO} AND {_INSIDE} AND d1 = 'bullish' AND body_ratio <= 0.1",
    "piercing_line": f"{_TWO} AND body_ratio >= 0.5 AND d1 = 'bearish' AND direction = 'bullish' AND open < l1 AND close > (o1 + c1) / 2 AND close < o1",
    "dark_cloud_cover": f"{_TWO} AND body_ratio >= 0.5 AND d1 = 'bullish' AND direction = 'bearish' AND open > h1 AND close < (o1 + c1) / 2 AND close > o1",
    "dragonfly_doji": "usable AND body_ratio <= 0.1 AND lower_wick_ratio >= 0.6 AND upper_wick_ratio <= 0.1",
    "gravestone_doji": "usable AND body_ratio <= 0.1 AND upper_wick_ratio >= 0.6 AND lower_wick_ratio <= 0.1",
    "morning_doji_star": f"{_SHAPE} AND d2 = 'bearish' AND direction = 'bullish' AND greatest(o1, c1) <= c2 AND round((close - c2) / (o2 - c2), 10) >= 0.5",
    "evening_doji_star": f"{_SHAPE} AND d2 = 'bullish' AND direction = 'bearish' AND least(o1, c1) >= c2 AND round((c2 - close) / (c2 - o2), 10) >= 0.5",
}

CDL_18_SQL = f"WITH {sql.BARS}, {GEOMETRY}, x AS (SELECT *, {LAGS} FROM g) " + " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS pattern FROM x WHERE {m}" for n, m in KNOWLEDGE.items())

QUERIES = {"flt_18_geometry": flt_18_geometry, "cdl_17_observations": cdl_17_observations, "cdl_16_context": cdl_16_context, "agg_39_strongest": agg_39_strongest, "topk_01_ordering": topk_01_ordering, "cdl_18_knowledge": cdl_18_knowledge} | {k: _one(v) for k, v in FAMILIES.items()}
SQL = {"flt_18_geometry": GEOMETRY_SQL, "cdl_17_observations": OBSERVATIONS_SQL, "cdl_16_context": CDL_16_SQL, "agg_39_strongest": AGG_39_SQL, "topk_01_ordering": TOPK_01_SQL, "cdl_18_knowledge": CDL_18_SQL} | {k: _one_sql(v) for k, v in FAMILIES.items()}
