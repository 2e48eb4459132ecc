"""Queries of price-action zones and events, of risk sizing, and of the models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.operators import features, fx, price_action, risk, structure
from tidemark.plans import sql, zone_sql
from tidemark.plans.portfolio_queries import signals
from tidemark.sources.bars import item_bars, resample, table


def _zones(spark, sf_dir):
    bars = item_bars(spark, sf_dir)
    return bars, price_action.zone_versions(structure.swings(bars))


def pa_08_zone_versions(spark, sf_dir):
    return rounded(_zones(spark, sf_dir)[1])


def pa_01_events(spark, sf_dir):
    bars, versions = _zones(spark, sf_dir)
    return rounded(price_action.events(bars, versions))


def pa_07_outcomes(spark, sf_dir):
    bars, versions = _zones(spark, sf_dir)
    return rounded(price_action.outcomes(price_action.events(bars, versions), bars))


def pa_10_zones(spark, sf_dir):
    return rounded(price_action.zones(*_zones(spark, sf_dir)))


def win_33_nearest(spark, sf_dir):
    return rounded(price_action.nearest(*_zones(spark, sf_dir)))


# sizing and stops over bars


def sim_10_sizing(spark, sf_dir):
    return rounded(risk.sizes(item_bars(spark, sf_dir)))


SIM_10_SQL = f"""WITH RECURSIVE {sql.BARS}, v0 AS (SELECT *, ln(close / nullif(lag(close) OVER ({sql.W}), 0)) AS lr, lag(close) OVER ({sql.W}) AS c1 FROM bars),
v1 AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr, {sql.full('stddev_samp(lr)', 'lr', 20)} * sqrt(252.0) AS vol FROM v0), {sql.smooth('s_atr', 'v1', 'tr', 14, 1 / 14)},
v AS (SELECT v1.*, s_atr.y AS atr {sql.joined(['s_atr'], 'v1')}),
x AS (SELECT symbol, ts, 'full' AS method, 1.0 AS exposure, true AS known FROM v UNION ALL SELECT symbol, ts, 'fixed_fraction', 0.5, true FROM v
  UNION ALL SELECT symbol, ts, 'volatility_target', least(1.0, 0.10 / vol), coalesce(vol > 0, false) FROM v UNION ALL SELECT symbol, ts, 'atr_risk', least(1.0, 0.01 * close / (2.0 * atr)), coalesce(atr > 0 AND close > 0, false) FROM v)
SELECT symbol, ts, method, {sql.settled('CASE WHEN known THEN exposure ELSE 0.0 END', 'exposure')}, CASE WHEN known THEN method ELSE 'risk_input_undefined' END AS reason FROM x"""


def sim_13_drawdown_states(spark, sf_dir):
    """Lock states of simulated equity."""
    from tidemark.operators import portfolio

    bars, targets = signals(spark, sf_dir)
    return risk.drawdown_states(portfolio.simulate(targets, bars, "symbol", "strategy"), "symbol", "strategy")


def _fx(spark, sf_dir):
    """Hourly bars of a market that each event moves by a hundredth of its value less 50, from 1000 on, with their closing
    spread. Moves are added in hundredths, so that no order of additions shows."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", (F.round(F.col("value") * 100).cast("long") - 5000).alias("move"))
    moved = F.sum("move").over(Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return resample(e.select("symbol", "ts", "event_id", (1000 + moved / 10_000).alias("price")), 3600).withColumn("spread", F.col("close") * 0.0002)


MEASURES = "atr atr_sma atr_pct er rsi ema_20 ema_50 ema_200 bb_middle bb_lower bb_upper".split()


def win_21_fx_features(spark, sf_dir):
    return rounded(fx.features(_fx(spark, sf_dir)).select("symbol", "ts", *MEASURES, "liquid", "near_rollover", "tradable"))


def _minute(zone):
    at = f"timezone('{zone}', timezone('UTC', ts))"
    return f"(hour({at}) * 60 + minute({at}))"


_SPANS = {"e20": ("close", 20, 2 / 21), "e50": ("close", 50, 2 / 51), "e200": ("close", 200, 2 / 201), "a14": ("tr", 14, 1 / 14), "g14": ("gain", 14, 1 / 14), "l14": ("loss", 14, 1 / 14)}
FX = f"""tk AS (SELECT event_type AS symbol, ts, 1000 + (sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE / 10000 AS price FROM events),
hb AS (SELECT symbol, epoch_ms(CAST(floor(epoch(tk.ts) / 3600) * 3600000 AS BIGINT)) AS ts, arg_min(price, tk.ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, tk.ts) AS close FROM tk GROUP BY symbol, floor(epoch(tk.ts) / 3600)), x0 AS (SELECT *, close * 0.0002 AS spread, lag(close) OVER ({sql.W}) AS c1, close - lag(close) OVER ({sql.W}) AS mv FROM hb),
x1 AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr, greatest(mv, 0 * mv) AS gain, greatest(-mv, 0 * mv) AS loss, abs(mv) AS way FROM x0),
{", ".join(sql.smooth(n, "x1", *v) for n, v in _SPANS.items())},
x2 AS (SELECT x1.*, e20.y AS ema_20, e50.y AS ema_50, e200.y AS ema_200, round(a14.y, 10) AS atr, round(100 * g14.y / nullif(g14.y + l14.y, 0), 10) AS rsi {sql.joined(list(_SPANS), "x1")}),
x3 AS (SELECT *, {sql.full("avg(atr)", "atr", 50)} AS atr_sma, list(atr) OVER ({sql.W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS seen, count(atr) OVER ({sql.W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS n,
  round(abs(close - lag(close, 20) OVER ({sql.W})) / nullif({sql.full("sum(way)", "way", 20)}, 0), 10) AS er, {sql.full("avg(close)", "close", 20)} AS bb_middle, 2 * {sql.full("stddev_pop(close)", "close", 20)} AS band,
  ({_minute("Europe/London")} BETWEEN 480 AND 1019 OR {_minute("America/New_York")} BETWEEN 480 AND 1019) AS liquid, {_minute("America/New_York")} BETWEEN 990 AND 1034 AS near_rollover FROM x2),
f AS (SELECT *, CASE WHEN atr IS NOT NULL AND n >= 100 THEN (len(list_filter(seen, lambda z: z < atr)) + (len(list_filter(seen, lambda z: z = atr)) + 1) / 2) / n END AS atr_pct, bb_middle - band AS bb_lower, bb_middle + band AS bb_upper, liquid AND NOT near_rollover AS tradable FROM x3)"""
WIN_21_SQL = f"WITH RECURSIVE {FX} SELECT symbol, ts, {sql.all_settled(' '.join(MEASURES))}, liquid, near_rollover, tradable FROM f"


def reg_06_fx_regime(spark, sf_dir):
    return fx.regime(fx.features(_fx(spark, sf_dir)))


REG_06_SQL = f"""WITH RECURSIVE {FX}, v AS (SELECT *, coalesce(atr_pct >= 0.97, false) AS volatile, coalesce(atr_pct <= 0.03, false) AS quiet FROM f)
SELECT symbol, ts, CASE WHEN volatile THEN 'volatile' WHEN quiet THEN 'quiet' WHEN er >= 0.3 THEN 'trending' WHEN er <= 0.18 THEN 'ranging' ELSE 'mixed' END AS regime, volatile OR quiet OR coalesce(spread / nullif(atr, 0) > 0.3, false) OR NOT tradable AS veto FROM v"""


def str_08_pullback(spark, sf_dir):
    return rounded(fx.pullback_signals(fx.features(_fx(spark, sf_dir))))


def str_09_momentum(spark, sf_dir):
    return rounded(fx.breakout_signals(fx.features(_fx(spark, sf_dir))))


def str_10_reversion(spark, sf_dir):
    return rounded(fx.reversion_signals(fx.features(_fx(spark, sf_dir))))


_THREE = f"OVER ({sql.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
#: Signals as CTE s(symbol, ts, dir, stop_dist, target_dist, score, max_hold).
PULLBACK = f"""q AS (SELECT *, (ema_50 - lag(ema_50, 20) OVER ({sql.W})) / atr AS slope, coalesce(bool_or(low <= ema_20) {_THREE}, false) AS dipped, coalesce(bool_or(high >= ema_20) {_THREE}, false) AS rose FROM f),
q1 AS (SELECT *, CASE WHEN close > ema_200 AND ema_20 > ema_50 AND slope >= 0.5 AND dipped AND close > ema_20 THEN 1 WHEN close < ema_200 AND ema_20 < ema_50 AND slope <= -0.5 AND rose AND close < ema_20 THEN -1 END AS dir FROM q),
s AS (SELECT symbol, ts, dir, 2.0 * atr AS stop_dist, 3.0 * atr AS target_dist, 0.55 + 0.25 * least(abs(ema_20 - ema_50) / atr, 2.0) / 2 + 0.2 * least(abs(slope) / 3, 1.0) AS score, 48 AS max_hold FROM q1 WHERE dir IS NOT NULL)"""
BREAKOUT = f"""q AS (SELECT *, {sql.full("max(high)", "high", 20, "prior")} AS top, {sql.full("min(low)", "low", 20, "prior")} AS bottom FROM f),
q1 AS (SELECT *, CASE WHEN close > top AND close > ema_200 AND atr > atr_sma AND rsi BETWEEN 55 AND 80 THEN 1 WHEN close < bottom AND close < ema_200 AND atr > atr_sma AND rsi BETWEEN 20 AND 45 THEN -1 END AS dir FROM q),
s AS (SELECT symbol, ts, dir, 1.5 * atr AS stop_dist, 2.5 * atr AS target_dist, 0.55 + 0.25 * least(abs(rsi - 50) / 30, 1.0) + 0.2 * least(greatest(atr / atr_sma - 1, 0.0), 1.0) AS score, 24 AS max_hold FROM q1 WHERE dir IS NOT NULL)"""
REVERSION = f"""q AS (SELECT *, lag(rsi) OVER ({sql.W}) AS r1, lag(bb_lower) OVER ({sql.W}) AS low1, lag(bb_upper) OVER ({sql.W}) AS up1, close - min(low) {_THREE} + 0.5 * atr AS below, max(high) {_THREE} - close + 0.5 * atr AS above, abs(bb_middle - close) AS way_back FROM f),
q1 AS (SELECT *, CASE WHEN er <= 0.25 AND c1 < low1 AND close > bb_lower AND r1 <= 35 AND way_back >= 1.2 * below THEN 1 WHEN er <= 0.25 AND c1 > up1 AND close < bb_upper AND r1 >= 65 AND way_back >= 1.2 * above THEN -1 END AS dir FROM q),
s AS (SELECT symbol, ts, dir, CASE WHEN dir > 0 THEN below ELSE above END AS stop_dist, way_back AS target_dist, 0.55 + 0.45 * least(abs(50 - r1) / 50, 1.0) AS score, 16 AS max_hold FROM q1 WHERE dir IS NOT NULL)"""
STR_08_SQL, STR_09_SQL, STR_10_SQL = (f"WITH RECURSIVE {FX}, {rule} SELECT symbol, ts, dir, {sql.all_settled('stop_dist target_dist score')}, max_hold FROM s" for rule in (PULLBACK, BREAKOUT, REVERSION))


def sim_29_bracket_trades(spark, sf_dir):
    """Trades of the hourly breakout, pullback and reversion signals together, with stop, goal, time and pause exits."""
    bars = _fx(spark, sf_dir)
    f = fx.features(bars)
    found = None
    for name, rule in (("breakout", fx.breakout_signals), ("pullback", fx.pullback_signals), ("reversion", fx.reversion_signals)):
        trades = fx.bracket_trades(bars, rule(f)).withColumn("strategy", F.lit(name))
        found = trades if found is None else found.unionByName(trades)
    return rounded(found)


def renamed(name, rule):
    """A signal rule's CTEs under names of its own: <name>_s holds its signals."""
    return rule.replace("q1 ", f"{name}_q1 ").replace("FROM q1", f"FROM {name}_q1").replace("q AS", f"{name}_q AS").replace("FROM q)", f"FROM {name}_q)").replace("s AS (SELECT symbol", f"{name}_s AS (SELECT symbol")


def _trades(name, rule):
    """CTEs of one strategy's trades, t_<name>."""
    side = "dir * {0} * (1 - dir * 0.0001)"
    p = {c: side.format(f"b.{c}") for c in ("open", "close", "low", "high")}
    rules = (("stop_gap", "po <= stop", "po"), ("stop", "worst <= stop", "stop"), ("target_gap", "age > 1 AND po >= goal", "po"), ("target", "best >= goal", "goal"), ("time", "age >= max_hold", "pc"), ("weekend", "pause", "pc"))
    why, price = (" ".join(f"WHEN {holds} THEN {pick}" for holds, pick in cases) for cases in ([(h, f"'{r}'") for r, h, _ in rules], [(h, x) for _, h, x in rules]))
    return f"""{renamed(name, rule)},
o_{name} AS (SELECT s.*, b.i, e.ts AS entry_ts, e.day AS day0, e.open * (1 + dir * 0.0001) AS entry FROM {name}_s s JOIN b ON b.symbol = s.symbol AND b.ts = s.ts JOIN b e ON e.symbol = s.symbol AND e.i = b.i + 1 WHERE NOT b.pause AND stop_dist > 0 AND target_dist > 0),
p_{name} AS (SELECT o.*, b.i AS j, b.i - o.i AS age, b.ts AS exit_ts, b.pause, b.day, {p["open"]} AS po, {p["close"]} AS pc, CASE WHEN dir > 0 THEN {p["low"]} ELSE {p["high"]} END AS worst, CASE WHEN dir > 0 THEN {p["high"]} ELSE {p["low"]} END AS best, dir * entry - stop_dist AS stop, dir * entry + target_dist AS goal
  FROM o_{name} o JOIN b ON b.symbol = o.symbol AND b.i BETWEEN o.i + 1 AND o.i + max_hold),
e_{name} AS (SELECT *, CASE {why} END AS reason, dir * CASE {price} END AS exit FROM p_{name} WHERE CASE {why} END IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY age) = 1),
n_{name} AS MATERIALIZED (SELECT e.*, (SELECT min(k.i) FROM e_{name} k WHERE k.symbol = e.symbol AND k.i >= e.j) AS nxt, row_number() OVER (PARTITION BY symbol ORDER BY i) AS place FROM e_{name} e),
t_{name} AS (SELECT * FROM n_{name} WHERE place = 1 UNION ALL SELECT n.* FROM t_{name} t JOIN n_{name} n ON n.symbol = t.symbol AND n.i = t.nxt)"""


_NAMED = {"breakout": BREAKOUT, "pullback": PULLBACK, "reversion": REVERSION}
SIM_29_SQL = f"""WITH RECURSIVE {FX}, b AS MATERIALIZED (SELECT *, row_number() OVER ({sql.W}) AS i, coalesce(epoch(lead(ts) OVER ({sql.W})) - epoch(ts) > 7200, true) AS pause, CAST(timezone('America/New_York', timezone('UTC', ts)) + INTERVAL 7 HOUR AS DATE) AS day FROM hb),
{", ".join(_trades(k, v) for k, v in _NAMED.items())},
u AS ({" UNION ALL ".join(f"SELECT '{k}' AS strategy, * FROM t_{k}" for k in _NAMED)}),
c AS (SELECT *, day - day0 AS nights, 55.0 / stop_dist * entry AS notional, dir * (exit - entry) / stop_dist AS r_gross FROM u), r AS (SELECT *, (2 * greatest(2.0, 0.2e-4 * notional) + nights * 0.5e-4 * notional) / 55.0 AS r_cost FROM c)
SELECT strategy, symbol, ts AS signal_ts, dir, entry_ts, exit_ts, reason, CAST(age AS INTEGER) AS bars, CAST(nights AS INTEGER) AS nights, {sql.all_settled("entry exit r_gross r_cost")}, {sql.settled("r_gross - r_cost", "r_net")} FROM r"""


def sim_42_lifecycle(spark, sf_dir):
    """Moves between the statuses of a customer's orders, and which of them the table of moves forbids."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_orderstatus").alias("state"))
    w = Window.partitionBy("symbol").orderBy("ts", "o_orderkey")
    allowed = spark.createDataFrame([("O", "F"), ("O", "P"), ("P", "F"), ("O", "O"), ("P", "P"), ("F", "F")], "was string, state string").withColumn("legal", F.lit(True))
    moves = o.withColumn("was", F.lag("state").over(w)).where("was is not null")
    return moves.join(F.broadcast(allowed), ["was", "state"], "left").groupBy("was", "state").agg(F.count("*").alias("n"), F.count_if(F.col("legal").isNull()).alias("illegal"))


SIM_42_SQL = """WITH m AS (SELECT o_orderstatus AS state, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders)
SELECT was, state, count(*) AS n, count(*) FILTER (NOT ((was = 'O') OR (was = 'P' AND state IN ('P', 'F')) OR (was = 'F' AND state = 'F'))) AS illegal FROM m WHERE was IS NOT NULL GROUP BY was, state"""


# features and models


def ml_02_features(spark, sf_dir):
    return rounded(features.assemble(item_bars(spark, sf_dir)))


FEATURES = f"""{sql.BARS}, a AS (SELECT *, {", ".join(f"round(close / nullif(lag(close, {k}) OVER ({sql.W}), 0) - 1, 10) AS ret_{k}" for k in (1, 5, 20))}, lag(close) OVER ({sql.W}) AS c1, lead(close) OVER ({sql.W}) AS nxt, row_number() OVER ({sql.W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
b AS (SELECT *, {sql.full('stddev_samp(ret_1)', 'ret_1', 20)} AS vol_20, {sql.full('avg(close)', 'close', 50)} AS s50, {sql.full('avg(volume)', 'volume', 20, 'prior')} AS v20, sum(coalesce(sign(close - c1), 0) * volume) OVER ({sql.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS signed, sum(volume) OVER ({sql.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM a),
f AS (SELECT symbol, ts, ret_1, ret_5, ret_20, vol_20, {sql.ratio('close', 's50')} - 1 AS sma_gap_50, {sql.ratio('volume', 'v20')} AS relative_volume_20, CASE WHEN i >= 20 THEN {sql.ratio('signed', 'v')} END AS flow_20, CAST(nxt > close AS INTEGER) AS target,
  CASE WHEN i <= floor(n * 0.6) - 1 THEN 'train' WHEN i <= floor(n * 0.6) THEN 'purged' WHEN i <= floor(n * 0.8) - 1 THEN 'validation' WHEN i <= floor(n * 0.8) THEN 'purged' ELSE 'test' END AS period FROM b)"""
ML_02_SQL = f"WITH {FEATURES} SELECT symbol, ts, {sql.all_settled(' '.join(features.NAMES))}, target, period FROM f"


def ml_05_preprocess(spark, sf_dir):
    return rounded(features.preprocess(features.assemble(item_bars(spark, sf_dir)), features.NAMES))


ML_05_SQL = f"""WITH {FEATURES}, m AS (SELECT {", ".join(f"median({c}) FILTER (period = 'train') AS m_{c}" for c in features.NAMES)} FROM f),
g AS (SELECT symbol, ts, period, target, {", ".join(f"coalesce({c}, m_{c}) AS {c}, CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}_missing" for c in features.NAMES)} FROM f, m),
s AS (SELECT {", ".join(f"avg({c}) FILTER (period = 'train') AS a_{c}, stddev_pop({c}) FILTER (period = 'train') AS d_{c}" for c in features.NAMES)} FROM g)
SELECT symbol, ts, period, target, {", ".join(sql.settled(f"({c} - a_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END", c) + f", {c}_missing" for c in features.NAMES)} FROM g, s"""


def ml_06_logistic(spark, sf_dir):
    return features.logistic_probabilities(features.preprocess(features.assemble(item_bars(spark, sf_dir)), features.NAMES), features.NAMES)


def ml_07_forest(spark, sf_dir):
    return features.forest_probabilities(features.preprocess(features.assemble(item_bars(spark, sf_dir)), features.NAMES), features.NAMES)


QUERIES = {k: v for k, v in dict(globals()).items() if k[:3] in ("pa_", "sim", "str", "ml_", "win", "reg") and callable(v)}
QUERIES.pop("structure", None)
SQL = {"pa_08_zone_versions": zone_sql.VERSIONS_SQL, "pa_01_events": zone_sql.EVENTS_SQL, "pa_07_outcomes": zone_sql.OUTCOMES_SQL, "pa_10_zones": zone_sql.OPEN_SQL, "win_33_nearest": zone_sql.NEAREST_SQL, "sim_29_bracket_trades": SIM_29_SQL, "win_21_fx_features": WIN_21_SQL, "reg_06_fx_regime": REG_06_SQL, "str_08_pullback": STR_08_SQL, "str_10_reversion": STR_10_SQL, "sim_10_sizing": SIM_10_SQL, "str_09_momentum": STR_09_SQL, "sim_42_lifecycle": SIM_42_SQL, "ml_02_features": ML_02_SQL, "ml_05_preprocess": ML_05_SQL}
