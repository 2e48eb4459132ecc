"""Queries of decisions, order states, runs and accounts, with events as their records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.operators import desk, fx
from tidemark.plans import price_queries as price
from tidemark.plans import sql
from tidemark.sources.bars import table


def _orders(spark, sf_dir):
    """Users' events as those of orders: clicks attempt, sign-ups submit, views tell a status, errors fail, purchases pay."""
    kind, value = F.col("event_type"), F.col("value")
    event = F.when(kind == "click", "submit_attempted").when(kind == "signup", "submitted").when(kind == "view", "status").when(kind == "error", "failed").otherwise("note")
    told = F.when(value >= 80, "filled").when(value >= 20, "accepted")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), event.alias("event"), told.alias("broker_status"), F.when(kind == "purchase", value).alias("paid"), F.col("ts").alias("at"))


ORDERS = """o AS (SELECT user_id AS order_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'submit_attempted' WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'status' WHEN 'error' THEN 'failed' ELSE 'note' END AS event,
  CASE WHEN value >= 80 THEN 'filled' WHEN value >= 20 THEN 'accepted' END AS told, CASE WHEN event_type = 'purchase' THEN value END AS paid, ts AS sent FROM events)"""


def view_16_order_state(spark, sf_dir):
    return rounded(desk.order_state(_orders(spark, sf_dir), "paid"))


VIEW_16_SQL = f"""WITH {ORDERS}, k AS (SELECT *, CASE WHEN event IN ('failed', 'submit_attempted') THEN event WHEN event IN ('submitted', 'status') THEN told END AS sets FROM o)
SELECT order_id, coalesce(arg_max(sets, seq) FILTER (sets IS NOT NULL), 'intent') AS status, arg_max(event, seq) AS last_event, count(*) AS n, {sql.settled("arg_max(paid, seq) FILTER (paid IS NOT NULL)", "paid")} FROM k GROUP BY order_id"""


def view_16_submissions(spark, sf_dir):
    return desk.submissions(_orders(spark, sf_dir))


SUBMISSIONS_SQL = f"WITH {ORDERS} SELECT CAST(sent AS DATE) AS day, count(*) AS submitted FROM o WHERE event = 'submitted' GROUP BY 1"


def agg_41_runs(spark, sf_dir):
    """A user's events of a day as a run: each is a stage that lasts until the next, a purchase finishes it."""
    e = table(spark, sf_dir, "events").select(F.struct("user_id", F.to_date("ts").alias("day")).alias("run_id"), "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    after = F.lead("at").over(Window.partitionBy("run_id").orderBy("at", "event_id"))
    stages = e.select("run_id", F.when(F.col("event_type") == "purchase", "run_finished").otherwise("stage").alias("event"), F.col("event_type").alias("stage"), ((after - F.col("at")) / 1e6).alias("seconds"))
    return rounded(desk.stage_seconds(stages), 3)


AGG_41_SQL = f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, (lead(epoch_us(ts)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - epoch_us(ts)) / 1e6 AS seconds FROM events),
r AS (SELECT user_id, day, bool_or(event_type = 'purchase') AS done FROM e GROUP BY 1, 2), n AS (SELECT count(*) AS runs, count(*) FILTER (NOT done) AS interrupted_runs FROM r)
SELECT event_type AS stage, count(*) AS n, {sql.settled("avg(seconds)", "mean_seconds", 3)}, {sql.settled("max(seconds)", "max_seconds", 3)}, any_value(runs) AS runs, any_value(interrupted_runs) AS interrupted_runs FROM e, n WHERE event_type <> 'purchase' GROUP BY 1"""

RULES = {"breakout": fx.breakout_signals, "pullback": fx.pullback_signals, "reversion": fx.reversion_signals}
#: Agents whose signals may open a position, and the least score of one.
APPROVED, THRESHOLD = ("breakout", "pullback"), 0.65


def str_15_pair_decision(spark, sf_dir):
    """Decisions of each hour from the three signal sets, the regime's veto and the trades of these signals: the position of an hour is that of the trade which runs then (of several the
    first, by name at equal entries), owned by its strategy, which proposes to close it at the bar of its exit."""
    f = fx.features(price._fx(spark, sf_dir))
    trades = price.sim_29_bracket_trades(spark, sf_dir).select("symbol", "strategy", "dir", "entry_ts", "exit_ts")
    hours = trades.withColumn("ts", F.explode(F.sequence("entry_ts", "exit_ts", F.expr("interval 1 hour"))))
    running = hours.groupBy("symbol", "ts").agg(F.min_by(F.struct("strategy", "dir", (F.col("ts") == F.col("exit_ts")).alias("last")), F.struct("entry_ts", "strategy")).alias("x"))
    state = fx.regime(f).join(running, ["symbol", "ts"], "left").select("symbol", "ts", "veto", F.coalesce(F.col("x.dir") * 1000.0, F.lit(0.0)).alias("position"), F.col("x.strategy").alias("owner"), "x.last")
    proposals = state.where("last").select("symbol", "ts", F.col("owner").alias("agent"), F.lit("CLOSE").alias("action"), F.lit(0).alias("dir"), F.lit(1.0).alias("score"))
    for name, rule in RULES.items():
        proposals = proposals.unionByName(rule(f).select("symbol", "ts", F.lit(name).alias("agent"), F.lit("OPEN").alias("action"), "dir", "score"))
    return rounded(desk.pair_decisions(state.drop("last"), proposals, APPROVED, THRESHOLD))


STR_15_SQL = f"""{price.SIM_29_SQL[: price.SIM_29_SQL.index("c AS (SELECT *, day - day0")]}rg AS ({price.REG_06_SQL}),
p AS ({" UNION ALL ".join(f"SELECT '{k}' AS agent, symbol, ts, dir, score, '{k}' IN ('breakout', 'pullback') AND score >= 0.65 AS sound FROM {k}_s" for k in price._NAMED)}),
g AS (SELECT symbol, ts, count(*) FILTER (sound AND dir > 0) AS longs, count(*) FILTER (sound AND dir < 0) AS shorts, count(*) AS opens, arg_min({{'dir': dir, 'score': score, 'agent': agent}}, row(-score, agent)) FILTER (sound) AS lead FROM p GROUP BY symbol, ts),
hl AS (SELECT h.symbol, h.ts, arg_min({{'owner': strategy, 'dir': dir, 'last': h.ts = exit_ts}}, row(entry_ts, strategy)) AS x FROM hb h JOIN u ON u.symbol = h.symbol AND h.ts BETWEEN entry_ts AND exit_ts GROUP BY h.symbol, h.ts),
d AS (SELECT r.symbol, r.ts, x IS NOT NULL AS held, coalesce(x.last, false) AS closing, x.owner AS owner, x.dir AS way, veto, coalesce(longs, 0) AS longs, coalesce(shorts, 0) AS shorts, coalesce(opens, 0) AS opens, lead FROM rg r LEFT JOIN g ON g.symbol = r.symbol AND g.ts = r.ts LEFT JOIN hl ON hl.symbol = r.symbol AND hl.ts = r.ts),
w AS (SELECT *, CASE WHEN closing THEN 'owner' WHEN held THEN 'held' WHEN veto THEN 'veto' WHEN longs > 0 AND shorts > 0 THEN 'conflict' WHEN longs + shorts > 0 THEN 'signal' WHEN opens > 0 THEN 'watched' ELSE 'no_signal' END AS reason FROM d)
SELECT symbol, ts, CASE reason WHEN 'owner' THEN 'CLOSE' WHEN 'veto' THEN 'VETO' WHEN 'signal' THEN 'OPEN' ELSE 'HOLD' END AS action, CAST(CASE reason WHEN 'held' THEN way WHEN 'signal' THEN lead.dir ELSE 0 END AS INTEGER) AS dir,
  {sql.settled("CASE reason WHEN 'owner' THEN 1.0 WHEN 'signal' THEN lead.score ELSE 0.0 END", "score")}, CASE WHEN held THEN owner WHEN reason = 'signal' THEN lead.agent END AS agent, reason FROM w"""

#: Pairs of the event types (base, quoted currency), and frozen euros for a unit of a currency (fixed values).
PAIRS = {"click": ("EUR", "USD"), "error": ("USD", "JPY"), "purchase": ("USD", "CHF"), "signup": ("USD", "CAD"), "view": ("GBP", "USD")}
EUROS = {"EUR": 1.0, "USD": 1 / 1.10, "JPY": 1 / 165.0, "CHF": 1 / 0.94, "CAD": 1 / 1.50, "GBP": 1 / 0.85}


def _account(spark, sf_dir):
    """Each event trades a thousand units at its value: bought above 50, else sold; the last event of a type is its quote."""
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("value") > 50, 1000).otherwise(-1000)
    traded = e.groupBy(F.col("event_type").alias("pair")).agg(F.sum(side).cast("double").alias("units"), F.avg("value").alias("avg_price"), F.max_by("value", F.struct("ts", "event_id")).alias("mid"))
    names = spark.createDataFrame([(k, *v) for k, v in PAIRS.items()], "pair string, base string, quote string")
    rates = spark.createDataFrame(list(EUROS.items()), "ccy string, rate double")
    quotes = traded.select("pair", (F.col("mid") * 0.9999).alias("bid"), (F.col("mid") * 1.0001).alias("ask"))
    return desk.marked(traded.drop("mid").join(names, "pair"), quotes, rates, leverage=30.0)


ACCOUNT = f"""t AS (SELECT event_type AS pair, sum(CASE WHEN value > 50 THEN 1000.0 ELSE -1000.0 END)::DOUBLE AS units, avg(value) AS avg_price, arg_max(value, row(ts, event_id)) AS mid FROM events GROUP BY 1),
pr(pair, base, quote) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in PAIRS.items())}), rt(ccy, rate) AS (VALUES {", ".join(f"('{c}', {r!r}::DOUBLE)" for c, r in EUROS.items())}),
m AS (SELECT t.pair, base, quote, units, avg_price, CASE WHEN units > 0 THEN mid * 0.9999 ELSE mid * 1.0001 END AS mark, b.rate AS base_rate, q.rate AS quote_rate FROM t JOIN pr ON pr.pair = t.pair LEFT JOIN rt b ON b.ccy = base LEFT JOIN rt q ON q.ccy = quote)"""


def sim_34_account(spark, sf_dir):
    return rounded(_account(spark, sf_dir).select("pair", "units", "mark", "unrealized", "notional", "margin"), 4)


ACCOUNT_SQL = f"WITH {ACCOUNT} SELECT pair, {sql.settled('units', 'units', 4)}, {sql.settled('mark', 'mark', 4)}, {sql.settled('units * (mark - avg_price) * quote_rate', 'unrealized', 4)}, {sql.settled('abs(units) * base_rate', 'notional', 4)}, {sql.settled('abs(units) * base_rate / 30', 'margin', 4)} FROM m"


def sim_34_exposure(spark, sf_dir):
    return rounded(desk.currency_exposure(_account(spark, sf_dir)), 4)


EXPOSURE_SQL = f"WITH {ACCOUNT}, l AS (SELECT base AS ccy, units * base_rate AS amount FROM m UNION ALL SELECT quote, -units * base_rate FROM m) SELECT ccy, {sql.settled('sum(amount)', 'net', 4)}, count(*) AS legs FROM l GROUP BY ccy"

QUERIES = {f.__name__: f for f in (view_16_order_state, view_16_submissions, agg_41_runs, str_15_pair_decision, sim_34_account, sim_34_exposure)}
SQL = dict(zip(QUERIES, (VIEW_16_SQL, SUBMISSIONS_SQL, AGG_41_SQL, STR_15_SQL, ACCOUNT_SQL, EXPOSURE_SQL), strict=True))
