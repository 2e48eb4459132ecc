"""Queries of technical indicators, swings, regimes and strategy states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import lagged, rounded, smoothed, with_runs
from tidemark.operators import indicators, regimes, strategies, structure
from tidemark.plans import sql
from tidemark.sources.bars import item_bars, sessions

WINDOWED = "sma_20 sma_50 sma_200 stoch_raw_k stoch_k stoch_d roc_12 true_range bb_middle bb_upper bb_lower bb_width_pct bb_percent_b realized_vol_20 relative_volume_20 obv".split()
RECURSIVE = "ema_20 ema_50 ema_200 macd macd_signal macd_hist rsi_14 atr_14".split()


def pick(*columns, recursive=False):
    def query(spark, sf_dir):
        df = indicators.windowed(item_bars(spark, sf_dir))
        return rounded((indicators.recursive(df) if recursive else df).select("symbol", "ts", *columns))

    return query


prev = f"lag(close) OVER ({sql.W})"
WINDOWED_CTE = f"""
w0 AS (SELECT *, {", ".join(sql.full("avg(close)", "close", n) + f" AS sma_{n}" for n in (20, 50, 200))}, {sql.full("max(high)", "high", 14)} AS hh, {sql.full("min(low)", "low", 14)} AS ll,
  round(100.0 * (close / nullif(lag(close, 12) OVER ({sql.W}), 0) - 1), 10) AS roc_12, CASE WHEN {prev} IS NOT NULL THEN greatest(high - low, abs(high - {prev}), abs(low - {prev})) END AS true_range,
  2.0 * {sql.full("stddev_pop(close)", "close", 20)} AS spread, ln(close / nullif({prev}, 0)) AS lr, {sql.full("avg(volume)", "volume", 20, "prior")} AS v20, close - {prev} AS change,
  sum(coalesce(sign(d), 0) * volume) OVER ({sql.W} ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT *, close - {prev} AS d FROM bars)),
w1 AS (SELECT *, {sql.ratio("100.0 * (close - ll)", "hh - ll")} AS stoch_raw_k, sma_20 AS bb_middle, sma_20 + spread AS bb_upper, sma_20 - spread AS bb_lower, {sql.ratio("volume", "v20")} AS relative_volume_20,
  {sql.full("stddev_samp(lr)", "lr", 20)} * sqrt(252.0) AS realized_vol_20 FROM w0),
w2 AS (SELECT *, {sql.full("avg(stoch_raw_k)", "stoch_raw_k", 3)} AS stoch_k, {sql.ratio("bb_upper - bb_lower", "bb_middle")} AS bb_width_pct, {sql.ratio("close - bb_lower", "bb_upper - bb_lower")} AS bb_percent_b FROM w1),
w AS (SELECT *, {sql.full("avg(stoch_k)", "stoch_k", 3)} AS stoch_d, greatest(change, 0.0) + 0 * change AS gain, greatest(-change, 0.0) + 0 * change AS loss FROM w2)"""


def pick_sql(*columns):
    return f"WITH {sql.BARS}, {WINDOWED_CTE} SELECT symbol, ts, {sql.all_settled(' '.join(columns))} FROM w"


def recursive_cte(*parts):
    """w joined with the smoothers that the query asks for."""
    spans = {"ema_20": ("close", 20, 2 / 21), "ema_50": ("close", 50, 2 / 51), "ema_200": ("close", 200, 2 / 201), "fast": ("close", 12, 2 / 13), "slow": ("close", 26, 2 / 27), "up": ("gain", 14, 1 / 14), "down": ("loss", 14, 1 / 14), "atr": ("true_range", 14, 1 / 14)}
    names = [n for n in spans if n in parts]
    ctes = [sql.smooth(f"s_{n}", "w", *spans[n]) for n in names]
    base = f"r0 AS MATERIALIZED (SELECT w.*, {', '.join(f's_{n}.y AS {n}' for n in names)} {sql.joined([f's_{n}' for n in names], 'w')})"
    out = f"WITH RECURSIVE {sql.BARS}, {WINDOWED_CTE}, {', '.join(ctes)}, {base}"
    if "fast" in parts:
        out += f", m AS (SELECT *, fast - slow AS macd FROM r0), {sql.smooth('s_signal', 'm', 'macd', 9, 0.2)}, r AS (SELECT m.*, s_signal.y AS macd_signal, m.macd - s_signal.y AS macd_hist {sql.joined(['s_signal'], 'm')})"
    else:
        out += ", r AS (SELECT * FROM r0)"
    return out


RSI = "round(100.0 * up / nullif(up + down, 0), 10)"
ALL_RECURSIVE = recursive_cte("ema_20", "ema_50", "ema_200", "fast", "slow", "up", "down", "atr")


def indicators_all(spark, sf_dir):
    return rounded(indicators.analyse(item_bars(spark, sf_dir)).select("symbol", "ts", *WINDOWED, *RECURSIVE))


ALL_SQL = f"{ALL_RECURSIVE}, z AS (SELECT *, {RSI} AS rsi_14, atr AS atr_14 FROM r) SELECT symbol, ts, {sql.all_settled(' '.join(WINDOWED + RECURSIVE))} FROM z"


def win_03_many_symbols(spark, sf_dir):
    """All recursive indicators of a symbol for each supplier."""
    bars = item_bars(spark, sf_dir, "l_suppkey").withColumn("true_range", indicators.true_range()).select("symbol", "ts", "close", "true_range")
    return rounded(indicators.recursive(bars).select("symbol", "ts", *RECURSIVE))


MANY_SQL = f"{ALL_RECURSIVE}, z AS (SELECT *, {RSI} AS rsi_14, atr AS atr_14 FROM r) SELECT symbol, ts, {sql.all_settled(' '.join(RECURSIVE))} FROM z".replace("SELECT l_returnflag AS symbol", "SELECT CAST(l_suppkey AS VARCHAR) AS symbol")

# swings and structure

SWING_CTE = f"""
p0 AS (SELECT symbol, ts, high, low, row_number() OVER ({sql.W}) - 1 AS idx, lead(ts, 5) OVER ({sql.W}) AS confirmed_at,
  {sql.full("max(high)", "high", 5, "prior")} AS hl, {sql.full("min(low)", "low", 5, "prior")} AS ll,
  CASE WHEN count(high) OVER nxt = 5 THEN max(high) OVER nxt END AS hr, CASE WHEN count(low) OVER nxt = 5 THEN min(low) OVER nxt END AS lr
  FROM bars WINDOW nxt AS ({sql.W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
p1 AS (SELECT symbol, ts, idx, 'high' AS kind, high AS price, confirmed_at, idx + 5 AS confirmed_idx FROM p0 WHERE high > hl AND high >= hr
  UNION ALL SELECT symbol, ts, idx, 'low', low, confirmed_at, idx + 5 FROM p0 WHERE low < ll AND low <= lr),
p2 AS (SELECT *, round(price / lag(price) OVER (PARTITION BY symbol, kind ORDER BY idx) - 1, 10) AS change_pct, row_number() OVER (PARTITION BY symbol ORDER BY confirmed_idx, idx, kind) - 1 AS swing_id FROM p1),
swings AS (SELECT *, CASE WHEN change_pct IS NULL THEN NULL WHEN kind = 'high' THEN CASE WHEN change_pct > 0.001 THEN 'HH' WHEN change_pct < -0.001 THEN 'LH' ELSE 'EH' END
  ELSE CASE WHEN change_pct > 0.001 THEN 'HL' WHEN change_pct < -0.001 THEN 'LL' ELSE 'EL' END END AS label FROM p2)"""


def win_28_swings(spark, sf_dir):
    return rounded(structure.swings(item_bars(spark, sf_dir)))


WIN_28_SQL = f"WITH {sql.BARS}, {SWING_CTE} SELECT symbol, ts, idx, kind, confirmed_at, confirmed_idx, swing_id, label, {sql.all_settled('price change_pct')} FROM swings"


def win_27_pivots(spark, sf_dir):
    return structure.pivots(item_bars(spark, sf_dir)).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.max("confirmed_at").alias("last_confirmed"), F.sum("idx").alias("idx_sum"))


WIN_27_SQL = f"WITH {sql.BARS}, {SWING_CTE} SELECT symbol, kind, count(*) AS n, max(confirmed_at) AS last_confirmed, CAST(sum(idx) AS BIGINT) AS idx_sum FROM p1 GROUP BY symbol, kind"

STRUCTURE_CTE = f"""
labelled AS (SELECT symbol, kind, label, confirmed_at, swing_id FROM swings WHERE label IS NOT NULL),
st0 AS (SELECT b.symbol, b.ts,
  (SELECT list(label ORDER BY swing_id DESC)[1:2] FROM labelled s WHERE s.symbol = b.symbol AND s.confirmed_at <= b.ts AND kind = 'high') AS highs,
  (SELECT list(label ORDER BY swing_id DESC)[1:2] FROM labelled s WHERE s.symbol = b.symbol AND s.confirmed_at <= b.ts AND kind = 'low') AS lows,
  (SELECT list(label ORDER BY swing_id DESC)[1:6] FROM labelled s WHERE s.symbol = b.symbol AND s.confirmed_at <= b.ts) AS ev,
  (SELECT arg_max(price, swing_id) FROM swings s WHERE s.symbol = b.symbol AND s.confirmed_at <= b.ts AND kind = 'high') AS last_swing_high,
  (SELECT arg_max(price, swing_id) FROM swings s WHERE s.symbol = b.symbol AND s.confirmed_at <= b.ts AND kind = 'low') AS last_swing_low FROM bars b),
st1 AS (SELECT *, CASE WHEN coalesce(len(highs), 0) < 2 OR coalesce(len(lows), 0) < 2 THEN 'insufficient_data' WHEN list_distinct(highs) = ['HH'] AND list_distinct(lows) = ['HL'] THEN 'uptrend'
  WHEN list_distinct(highs) = ['LH'] AND list_distinct(lows) = ['LL'] THEN 'downtrend' WHEN list_has_all(['LH', 'EH'], highs) AND list_has_all(['HL', 'EL'], lows) THEN 'range' ELSE 'transition' END AS structure FROM st0),
st AS (SELECT *, CASE structure WHEN 'uptrend' THEN 'up' WHEN 'downtrend' THEN 'down' WHEN 'range' THEN 'sideways' WHEN 'transition' THEN 'unclear' ELSE structure END AS trend,
  round(CASE structure WHEN 'uptrend' THEN len(list_filter(ev, lambda x: x IN ('HH', 'HL'))) WHEN 'downtrend' THEN len(list_filter(ev, lambda x: x IN ('LH', 'LL')))
        WHEN 'range' THEN len(list_filter(ev, lambda x: x IN ('LH', 'EH', 'HL', 'EL'))) END / len(ev), 6) AS trend_quality,
  coalesce(array_to_string(list_reverse(ev), ','), '') AS trend_evidence FROM st1)"""


def win_31_structure(spark, sf_dir):
    return rounded(structure.structure(item_bars(spark, sf_dir)))


WIN_31_SQL = f"WITH {sql.BARS}, {SWING_CTE}, {STRUCTURE_CTE} SELECT symbol, ts, structure, trend, {sql.settled('trend_quality', 'trend_quality')}, trend_evidence, {sql.all_settled('last_swing_high last_swing_low')} FROM st"


def _state(x):
    return f"CASE WHEN {x} >= 1.5 THEN 'expansion' WHEN {x} <= 0.5 THEN 'contraction' WHEN {x} IS NOT NULL THEN 'normal' ELSE 'unknown' END"


def win_29_ranges(spark, sf_dir):
    wide = structure.StructureConfig(max_width=1.85)  # unit prices vary widely
    return rounded(structure.ranges(item_bars(spark, sf_dir), wide))


WIN_29_SQL = f"""WITH {sql.BARS},
q0 AS (SELECT symbol, ts, close, high - low AS candle, {sql.full("max(high)", "high", 20)} AS window_high, {sql.full("min(low)", "low", 20)} AS window_low, row_number() OVER ({sql.W}) AS i FROM bars),
q1 AS (SELECT *, round((window_high - window_low) / ((window_high + window_low) / 2), 10) AS window_width_pct, {sql.full("avg(candle)", "candle", 20, "prior")} AS c20, close - lag(close, 20) OVER ({sql.W}) AS move FROM q0),
q2 AS (SELECT *, coalesce(window_width_pct <= 1.85, false) AS in_consolidation, {sql.pos("candle", "c20")} AS candle_range_ratio, {sql.pos("window_width_pct", f"lag(window_width_pct, 20) OVER ({sql.W})")} AS window_width_ratio FROM q1),
q3 AS (SELECT *, CASE WHEN in_consolidation THEN i - row_number() OVER (PARTITION BY symbol, in_consolidation ORDER BY ts) END AS episode FROM q2),
q4 AS (SELECT *, CASE WHEN in_consolidation THEN max(window_high) OVER e END AS range_high, CASE WHEN in_consolidation THEN min(window_low) OVER e END AS range_low, CASE WHEN in_consolidation THEN count(*) OVER e + 19 END AS range_bar_count
  FROM q3 WINDOW e AS (PARTITION BY symbol, in_consolidation, episode ORDER BY ts ROWS UNBOUNDED PRECEDING)),
q5 AS (SELECT *, round((range_high - range_low) / ((range_high + range_low) / 2), 10) AS range_width_pct FROM q4)
SELECT symbol, ts, in_consolidation, range_bar_count, {sql.all_settled("window_high window_low window_width_pct range_high range_low range_width_pct candle_range_ratio window_width_ratio")},
  {_state("candle_range_ratio")} AS candle_range_state, {_state("window_width_ratio")} AS window_width_state, CASE WHEN move > 0 THEN 'up' WHEN move < 0 THEN 'down' WHEN move IS NOT NULL THEN 'flat' ELSE 'unknown' END AS window_direction FROM q5"""

# regimes


def reg_05_engine(spark, sf_dir):
    return rounded(regimes.analyse(item_bars(spark, sf_dir)))


def _ages():
    out = []
    for d in regimes.DIMENSIONS:
        out.append(f"{d}_n AS (SELECT symbol, ts, {d}_regime AS s, row_number() OVER ({sql.W}) AS i, row_number() OVER (PARTITION BY symbol, {d}_regime ORDER BY ts) AS j FROM reg), {d}_a AS (SELECT symbol, ts, i, row_number() OVER (PARTITION BY symbol, s, i - j ORDER BY ts) AS age FROM {d}_n)")
    return ", ".join(out)


REG_CTE = f"""{recursive_cte("fast", "slow", "up", "down", "atr")}, {SWING_CTE}, {STRUCTURE_CTE},
k0 AS MATERIALIZED (SELECT r.*, {RSI} AS rsi_14, round(realized_vol_20, 10) AS v FROM r),
k1 AS MATERIALIZED (SELECT k0.*, list(v) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 756 PRECEDING AND 1 PRECEDING) AS ref0 FROM k0),
k2 AS (SELECT *, list_filter(coalesce(ref0, []), lambda x: x IS NOT NULL) AS ref FROM k1),
k3 AS (SELECT k2.*, len(ref) AS volatility_reference_count, CASE WHEN v IS NOT NULL AND len(ref) >= 252 THEN round((len(list_filter(ref, lambda x: x < v)) + 0.5 * len(list_filter(ref, lambda x: x = v))) / len(ref), 10) END AS volatility_percentile FROM k2),
k4 AS (SELECT k3.symbol, k3.ts, st.structure AS trend_regime, st.trend_quality, realized_vol_20 AS volatility_measure, volatility_percentile, volatility_reference_count, round(atr / close, 10) AS atr_pct, rsi_14, roc_12, macd, relative_volume_20,
  CASE WHEN volatility_percentile IS NULL THEN 'insufficient_data' WHEN volatility_percentile >= 0.95 THEN 'extreme' WHEN volatility_percentile >= 0.8 THEN 'high' WHEN volatility_percentile < 0.2 THEN 'low' ELSE 'normal' END AS volatility_regime,
  CASE WHEN rsi_14 IS NULL OR roc_12 IS NULL OR macd IS NULL THEN 'insufficient_data' WHEN rsi_14 > 50 AND roc_12 > 0 AND macd > 0 THEN CASE WHEN rsi_14 >= 70 THEN 'extreme_positive' ELSE 'positive' END
       WHEN rsi_14 < 50 AND roc_12 < 0 AND macd < 0 THEN CASE WHEN rsi_14 <= 30 THEN 'extreme_negative' ELSE 'negative' END ELSE 'neutral' END AS momentum_regime,
  CASE WHEN relative_volume_20 IS NULL THEN 'insufficient_data' WHEN relative_volume_20 >= 1.5 THEN 'high' WHEN relative_volume_20 < 0.5 THEN 'low' ELSE 'normal' END AS participation_regime
  FROM k3 JOIN st ON st.symbol = k3.symbol AND st.ts = k3.ts),
reg AS MATERIALIZED (SELECT *, CASE WHEN trend_regime = 'insufficient_data' OR volatility_regime = 'insufficient_data' THEN 'insufficient_data' WHEN trend_regime = 'uptrend' THEN 'trending_up' WHEN trend_regime = 'downtrend' THEN 'trending_down'
  WHEN trend_regime = 'range' THEN 'ranging' WHEN volatility_regime = 'low' THEN 'low_volatility_transition' WHEN volatility_regime = 'normal' THEN 'transition' ELSE 'high_volatility_transition' END AS composite_regime FROM k4)"""
REG_05_SQL = f"""{REG_CTE}, {_ages()}
SELECT reg.symbol, reg.ts, trend_regime, volatility_regime, momentum_regime, participation_regime, composite_regime, volatility_reference_count, {sql.all_settled("trend_quality volatility_measure volatility_percentile atr_pct rsi_14 roc_12 macd relative_volume_20")},
  {", ".join(f"{d}_a.age AS {d}_age, {d}_a.age = 1 AND {d}_a.i > 1 AS {d}_changed" for d in regimes.DIMENSIONS)}
FROM reg {" ".join(f"JOIN {d}_a ON {d}_a.symbol = reg.symbol AND {d}_a.ts = reg.ts" for d in regimes.DIMENSIONS)}"""


def reg_transitions(spark, sf_dir):
    """Regime alerts: each change of a dimension's label with the label before."""
    state = regimes.analyse(item_bars(spark, sf_dir))
    long = state.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_regime").alias("label")) for d in regimes.DIMENSIONS])).alias("d")).select("symbol", "ts", "d.*")
    before = lagged("label", 1, "symbol", "dimension")
    return long.withColumn("previous", before).where("previous is not null and previous <> label")


STM_08_SQL = f"""{REG_CTE}, long AS (UNPIVOT (SELECT symbol, ts, {", ".join(f"{d}_regime AS {d}" for d in regimes.DIMENSIONS)} FROM reg) ON {", ".join(regimes.DIMENSIONS)} INTO NAME dimension VALUE label)
SELECT symbol, ts, dimension, label, previous FROM (SELECT *, lag(label) OVER (PARTITION BY symbol, dimension ORDER BY ts) AS previous FROM long) WHERE previous <> label"""

# strategies


def features(spark, sf_dir):
    bars = item_bars(spark, sf_dir)
    state = regimes.analyse(bars).select("symbol", "ts", F.col("trend_regime").alias("structure"), "composite_regime", "rsi_14")
    return indicators.windowed(bars).select("symbol", "ts", "close", "sma_20", "sma_50", "sma_200").join(state, ["symbol", "ts"])


def str_06_states(spark, sf_dir):
    signals = strategies.states(features(spark, sf_dir), strategies.BASELINES)
    return strategies.effective(signals, sessions(item_bars(spark, sf_dir)))


STATES_CTE = f"""{REG_CTE},
f AS (SELECT w.symbol, w.ts, w.close, sma_20, sma_50, sma_200, reg.rsi_14, reg.trend_regime, reg.composite_regime FROM w JOIN reg ON reg.symbol = w.symbol AND reg.ts = w.ts),
sig0 AS (SELECT symbol, ts, 'buy_and_hold' AS strategy, CASE WHEN close IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'LONG' END AS state FROM f
  UNION ALL SELECT symbol, ts, 'sma_trend', CASE WHEN sma_200 IS NULL THEN 'INSUFFICIENT_DATA' WHEN close > sma_200 THEN 'LONG' ELSE 'FLAT' END FROM f
  UNION ALL SELECT symbol, ts, 'sma_crossover', CASE WHEN sma_20 IS NULL OR sma_50 IS NULL THEN 'INSUFFICIENT_DATA' WHEN sma_20 > sma_50 THEN 'LONG' ELSE 'FLAT' END FROM f
  UNION ALL SELECT symbol, ts, 'rsi_momentum', CASE WHEN rsi_14 IS NULL THEN 'INSUFFICIENT_DATA' WHEN rsi_14 > 50 THEN 'LONG' ELSE 'FLAT' END FROM f
  UNION ALL SELECT symbol, ts, 'price_action_trend', CASE trend_regime WHEN 'insufficient_data' THEN 'INSUFFICIENT_DATA' WHEN 'uptrend' THEN 'LONG' ELSE 'FLAT' END FROM f
  UNION ALL SELECT symbol, ts, 'regime_trend', CASE composite_regime WHEN 'insufficient_data' THEN 'INSUFFICIENT_DATA' WHEN 'trending_up' THEN 'LONG' ELSE 'FLAT' END FROM f),
sig AS (SELECT *, lag(state) OVER (PARTITION BY symbol, strategy ORDER BY ts) AS state_in_effect FROM sig0),
cal AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS effective_at FROM (SELECT DISTINCT ts FROM bars))"""
STR_06_SQL = f"{STATES_CTE} SELECT symbol, sig.ts, strategy, state, state_in_effect, coalesce(state <> state_in_effect, false) AS changed, effective_at FROM sig JOIN cal ON cal.ts = sig.ts"


def agg_14_summary(spark, sf_dir):
    return strategies.summary(strategies.states(features(spark, sf_dir), strategies.BASELINES))


AGG_14_SQL = f"{STATES_CTE} SELECT symbol, strategy, count(*) AS bars, count(*) FILTER (state = 'LONG') AS long, count(*) FILTER (state = 'FLAT') AS flat, count(*) FILTER (state = 'INSUFFICIENT_DATA') AS insufficient, count(*) FILTER (state <> state_in_effect) AS changes, min(ts) FILTER (state <> 'INSUFFICIENT_DATA') AS first_decided FROM sig GROUP BY ALL"


def sim_01_targets(spark, sf_dir):
    signals = strategies.states(features(spark, sf_dir), strategies.BASELINES)
    return strategies.targets(signals).select("symbol", "ts", "strategy", "state", "target")


SIM_01_SQL = f"{STATES_CTE} SELECT symbol, ts, strategy, state, coalesce(last_value(CASE state WHEN 'LONG' THEN 1.0::DOUBLE WHEN 'FLAT' THEN 0.0::DOUBLE END IGNORE NULLS) OVER (PARTITION BY symbol, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS target FROM sig"

CATALOG_COLUMNS = WINDOWED + RECURSIVE


def view_02_warmup(spark, sf_dir):
    """First defined row of each indicator against its catalog."""
    from tidemark.functions.semantics import by

    df = indicators.analyse(item_bars(spark, sf_dir)).withColumn("i", F.row_number().over(by()) - 1)
    names = [n for n, _, _ in indicators.catalog()]
    long = df.select("symbol", "i", F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).alias("v")) for n in names])).alias("x")).where("x.v is not null")
    first = long.groupBy("symbol", "x.indicator").agg(F.min("i").cast("long").alias("first_row"))
    known = spark.createDataFrame(indicators.catalog(), "indicator string, family string, warm_up long")
    return first.join(F.broadcast(known), "indicator").withColumn("as_said", F.col("first_row") == F.col("warm_up"))


_CATALOG = ", ".join(f"('{n}', '{f}', {w})" for n, f, w in indicators.catalog())
_FIRST = " UNION ALL ".join(f"SELECT symbol, '{n}' AS indicator, min(i) FILTER ({n} IS NOT NULL) AS first_row FROM z GROUP BY symbol" for n, _, _ in indicators.catalog())
VIEW_02_SQL = f"{ALL_RECURSIVE}, z AS (SELECT *, {RSI} AS rsi_14, atr AS atr_14, row_number() OVER ({sql.W}) - 1 AS i FROM r), k(indicator, family, warm_up) AS (VALUES {_CATALOG}), u AS ({_FIRST}) SELECT symbol, indicator, first_row, family, warm_up, first_row = warm_up AS as_said FROM u JOIN k USING (indicator) WHERE first_row IS NOT NULL"


QUERIES = {
    "win_01_sma": pick("sma_20", "sma_50", "sma_200"), "win_08_stochastic": pick("stoch_raw_k", "stoch_k", "stoch_d"), "win_09_roc": pick("roc_12"), "win_10_true_range": pick("true_range"),
    "win_12_bollinger": pick("bb_middle", "bb_upper", "bb_lower", "bb_width_pct", "bb_percent_b"), "win_13_realized_vol": pick("realized_vol_20"), "win_14_relative_volume": pick("relative_volume_20"), "win_15_obv": pick("obv"),
    "win_04_ema": pick("ema_20", "ema_50", "ema_200", recursive=True), "win_06_macd": pick("macd", "macd_signal", "macd_hist", recursive=True), "win_07_rsi": pick("rsi_14", recursive=True), "win_11_atr": pick("atr_14", recursive=True),
    "win_03_many_symbols": win_03_many_symbols, "win_03_all_indicators": indicators_all, "win_27_pivots": win_27_pivots, "win_28_swings": win_28_swings, "win_31_structure": win_31_structure, "win_29_ranges": win_29_ranges,
    "reg_05_engine": reg_05_engine, "stm_08_regime_transitions": reg_transitions, "str_06_states": str_06_states, "agg_14_summary": agg_14_summary, "sim_01_targets": sim_01_targets, "view_02_warmup": view_02_warmup,
}
SQL = {
    "win_01_sma": pick_sql("sma_20", "sma_50", "sma_200"), "win_08_stochastic": pick_sql("stoch_raw_k", "stoch_k", "stoch_d"), "win_09_roc": pick_sql("roc_12"), "win_10_true_range": pick_sql("true_range"),
    "win_12_bollinger": pick_sql("bb_middle", "bb_upper", "bb_lower", "bb_width_pct", "bb_percent_b"), "win_13_realized_vol": pick_sql("realized_vol_20"), "win_14_relative_volume": pick_sql("relative_volume_20"), "win_15_obv": pick_sql("obv"),
    "win_04_ema": f"{recursive_cte('ema_20', 'ema_50', 'ema_200')} SELECT symbol, ts, {sql.all_settled('ema_20 ema_50 ema_200')} FROM r", "win_06_macd": f"{recursive_cte('fast', 'slow')} SELECT symbol, ts, {sql.all_settled('macd macd_signal macd_hist')} FROM r",
    "win_07_rsi": f"{recursive_cte('up', 'down')} SELECT symbol, ts, {sql.settled(RSI, 'rsi_14')} FROM r", "win_11_atr": f"{recursive_cte('atr')} SELECT symbol, ts, {sql.settled('atr', 'atr_14')} FROM r",
    "view_02_warmup": VIEW_02_SQL, "win_03_many_symbols": MANY_SQL, "win_03_all_indicators": ALL_SQL, "win_27_pivots": WIN_27_SQL, "win_28_swings": WIN_28_SQL, "win_31_structure": WIN_31_SQL, "win_29_ranges": WIN_29_SQL,
    "reg_05_engine": REG_05_SQL, "stm_08_regime_transitions": STM_08_SQL, "str_06_states": STR_06_SQL, "agg_14_summary": AGG_14_SQL, "sim_01_targets": SIM_01_SQL,
}
