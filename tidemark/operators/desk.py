"""Decisions, orders, runs and accounts of a trading desk, as aggregates over their records.

Records with null keys form a group of their own; an empty input gives an empty result. Ties are decided as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events that are themselves a status, and events that carry the broker's status (fixed values).
SETTING, CARRYING = ("blocked", "submit_attempted", "unknown", "failed"), ("submitted", "status")


def order_state(events: DataFrame, *fields: str) -> DataFrame:
    """order_id, status, last_event, n and the latest defined value of each field, from events (order_id, seq, event,
    broker_status, fields). Only some events change the status; before the first of these it is intent."""
    status = F.when(F.col("event").isin(*SETTING), F.col("event")).when(F.col("event").isin(*CARRYING), F.col("broker_status"))
    latest = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("seq")))
    held = [latest(F.col(c)).alias(c) for c in fields]
    return events.groupBy("order_id").agg(F.coalesce(latest(status), F.lit("intent")).alias("status"), F.max_by("event", "seq").alias("last_event"), F.count("*").alias("n"), *held)


def submissions(events: DataFrame) -> DataFrame:
    """Orders submitted on each UTC day."""
    return events.where("event = 'submitted'").groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("submitted"))


def stage_seconds(events: DataFrame) -> DataFrame:
    """Mean and longest seconds of each stage, beside how many runs there are and how many never finished, from events (run_id,
    event, stage, seconds). A run is what its events say; without run_finished it is interrupted."""
    runs = events.groupBy("run_id").agg(F.max(F.when(F.col("event") == "run_finished", 1).otherwise(0)).alias("done"))
    total = runs.agg(F.count("*").alias("runs"), F.count_if(F.col("done") == 0).alias("interrupted_runs"))
    stages = events.where("event = 'stage'").groupBy("stage").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"))
    return stages.crossJoin(total)  # total is one row


def pair_decisions(state: DataFrame, proposals: DataFrame, approved: tuple[str, ...], threshold: float) -> DataFrame:
    """One decision for each row of state (symbol, ts, veto, position, owner): action, dir, score, agent and reason.

    With a position only its owner's CLOSE proposal ends it. Without one, a veto comes first; then opposed approved signals hold,
    as does the lack of any; else the strongest approved OPEN of at least the threshold is taken, by name at equal scores.
    proposals are (symbol, ts, agent, action, dir, score); those of no row of state decide nothing.
    """
    opens = F.col("action") == "OPEN"
    sound = opens & F.col("agent").isin(*approved) & (F.col("score") >= threshold)
    best = F.min_by(F.struct("dir", "score", "agent"), F.when(sound, F.struct(-F.col("score"), "agent")))
    found = proposals.groupBy("symbol", "ts").agg(best.alias("lead"), F.count_if(sound & (F.col("dir") > 0)).alias("__long"), F.count_if(sound & (F.col("dir") < 0)).alias("__short"), F.count_if(opens).alias("__opens"), F.collect_set(F.when(F.col("action") == "CLOSE", F.col("agent"))).alias("__closing"))
    s = state.join(found, ["symbol", "ts"], "left")
    held = F.coalesce(F.col("position"), F.lit(0.0)) != 0

    def out(action: str, reason: str, direction: Column = F.lit(0), score: Column = F.lit(0.0), agent: Column = F.lit(None).cast("string")) -> Column:
        return F.struct(F.lit(action).alias("action"), direction.cast("int").alias("dir"), score.cast("double").alias("score"), agent.alias("agent"), F.lit(reason).alias("reason"))

    none = F.lit(False)
    decision = (
        F.when(held & F.coalesce(F.array_contains("__closing", F.col("owner")), none), out("CLOSE", "owner", score=F.lit(1.0), agent=F.col("owner")))
        .when(held, out("HOLD", "held", F.signum("position"), agent=F.col("owner")))
        .when(F.coalesce("veto", none), out("VETO", "veto"))
        .when((F.col("__long") > 0) & (F.col("__short") > 0), out("HOLD", "conflict"))
        .when(F.col("__long") + F.col("__short") > 0, out("OPEN", "signal", F.col("lead.dir"), F.col("lead.score"), F.col("lead.agent")))
        .when(F.col("__opens") > 0, out("HOLD", "watched"))
        .otherwise(out("HOLD", "no_signal"))
    )
    return s.withColumn("__d", decision).select("symbol", "ts", "__d.*")


def marked(positions: DataFrame, quotes: DataFrame, rates: DataFrame, leverage: float) -> DataFrame:
    """Positions (pair, base, quote, units, avg_price) with mark, unrealized, notional and margin in the account's currency. Longs
    are marked at the bid, shorts at the ask; rates are (ccy, rate), the account's currency for one unit. Null without a quote or
    a rate."""
    p = positions.join(quotes.select("pair", "bid", "ask"), "pair", "left")
    for side in ("base", "quote"):
        p = p.join(rates.select(F.col("ccy").alias(side), F.col("rate").alias(f"{side}_rate")), side, "left")
    p = p.withColumn("mark", F.when(F.col("units") > 0, F.col("bid")).otherwise(F.col("ask")))
    p = p.withColumns({"unrealized": F.col("units") * (F.col("mark") - F.col("avg_price")) * F.col("quote_rate"), "notional": F.abs("units") * F.col("base_rate")})
    return p.withColumn("margin", F.col("notional") / leverage)


def currency_exposure(positions: DataFrame) -> DataFrame:
    """Net exposure of each currency over marked() positions: long the base, short the quoted one."""
    value = F.col("units") * F.col("base_rate")
    legs = F.array(F.struct(F.col("base").alias("ccy"), value.alias("amount")), F.struct(F.col("quote").alias("ccy"), (-value).alias("amount")))
    return positions.select(F.explode(legs).alias("l")).groupBy("l.ccy").agg(F.sum("l.amount").alias("net"), F.count("*").alias("legs"))
