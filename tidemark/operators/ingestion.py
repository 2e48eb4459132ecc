"""Deliveries of bars into a stored table: upserts, findings, summaries of runs, alerts about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality

BAR = (*quality.PRICES, "volume", "adj_close")
#: What a finding's severity becomes as an alert's (fixed values); others are information.
SEVERITY = {"info": "info", "warning": "warning", "error": "critical", "critical": "critical"}
#: Changes of a strategy's state that are alerts (fixed values).
TRANSITIONS = (("INSUFFICIENT_DATA", "LONG"), ("INSUFFICIENT_DATA", "FLAT"), ("FLAT", "LONG"), ("LONG", "FLAT"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], source: tuple[str, ...] = ()) -> DataFrame:
    """The table after the delivery, with change: inserted, updated (a value is distinct, nulls taken as values), unchanged or kept (not delivered). Columns source come from the
    row whose values stay. Keys are unique on either side; null keys match one another."""
    side = lambda df, n: df.select(*[F.col(k).alias(f"__{n}_{k}") for k in keys], F.struct(*values, *source).alias(n))
    same = reduce(lambda a, b: a & b, [F.col(f"__old_{k}").eqNullSafe(F.col(f"__new_{k}")) for k in keys])
    both = side(stored, "old").join(side(incoming, "new"), same, "full_outer")
    distinct = reduce(lambda a, b: a | b, [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in values])
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(distinct, "updated").otherwise("unchanged")
    stays = F.when(change.isin("inserted", "updated"), F.col("new")).otherwise(F.col("old"))
    key = [F.when(F.col("old").isNull(), F.col(f"__new_{k}")).otherwise(F.col(f"__old_{k}")).alias(k) for k in keys]
    return both.select(*key, stays.alias("__v"), change.alias("change")).select(*keys, "__v.*", "change")


def merge_bars(stored: DataFrame, accepted: DataFrame, noise: float = 1e-5) -> DataFrame:
    """symbol, ts, BAR after the delivery, change, raw (names of the raw values that a delivery changed), adjusted (relative change of adj_close) and ignored (whether a change of adj_close
    within the noise was ignored, which keeps the stored bar)."""
    side = lambda df, n: df.select("symbol", "ts", F.struct(*BAR).alias(n))
    both = side(stored, "old").join(side(accepted, "new"), ["symbol", "ts"], "full_outer")
    met = F.col("old").isNotNull() & F.col("new").isNotNull()
    raw = F.filter(F.array(*[F.when(met & ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in BAR[:-1]]), lambda c: c.isNotNull())
    old, new = F.col("old.adj_close"), F.col("new.adj_close")
    moved = F.abs(F.try_divide(new, old) - 1)
    adjusted = F.when(old.isNull() | new.isNull(), ~old.eqNullSafe(new)).when(old == 0, new != 0).otherwise(moved > noise)
    both = both.withColumns({"raw": raw, "__adjusted": met & adjusted})
    updated = (F.size("raw") > 0) | F.col("__adjusted")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(updated, "updated").otherwise("unchanged")
    stays = F.when(F.col("old").isNull() | (met & updated), F.col("new")).otherwise(F.col("old"))
    ignored = met & ~updated & ~old.eqNullSafe(new)
    return both.select("symbol", "ts", stays.alias("__v"), change.alias("change"), "raw", F.when(F.col("__adjusted"), moved).alias("adjusted"), F.col("__adjusted").alias("__restated"), ignored.alias("ignored")).select(
        "symbol", "ts", "__v.*", "change", "raw", "adjusted", F.col("__restated").alias("restated"), "ignored"
    )


def findings(validated: DataFrame, merged: DataFrame) -> DataFrame:
    """One row for each finding of a delivery: check, severity, action, symbol, ts, bars, value. Excluded rows one by one, revised bars one by one, restated adjustments a symbol: how many bars,
    the first, and the largest relative change."""
    out = validated.where("rule is not null").select(F.col("rule").alias("check"), F.lit("error").alias("severity"), F.lit("excluded").alias("action"), "symbol", "ts", F.lit(1).cast("long").alias("bars"), F.lit(None).cast("double").alias("value"))
    revised = merged.where("change = 'updated' and size(raw) > 0").select(F.lit("bar_revised").alias("check"), F.lit("warning").alias("severity"), F.lit("updated").alias("action"), "symbol", "ts", F.lit(1).cast("long").alias("bars"), F.size("raw").cast("double").alias("value"))
    restated = (
        merged.where("restated and size(raw) = 0").groupBy("symbol").agg(F.min("ts").alias("ts"), F.count("*").alias("bars"), F.max("adjusted").alias("value"))
        .select(F.lit("adj_close_restated").alias("check"), F.lit("info").alias("severity"), F.lit("updated").alias("action"), "symbol", "ts", "bars", "value")
    )
    return out.unionByName(revised).unionByName(restated)


def run_summary(run_id: int, rows: DataFrame, merged: DataFrame, found: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of a delivery's rows, their merge and their findings, where each excluded row is one, one row: run_id, status, how many bars came, were inserted, updated, unchanged, excluded or differed by noise only, sessions changed, and issues (check to number)."""
    counted = merged.agg(*[F.count_if(F.col("change") == c).alias(f"bars_{c}") for c in ("inserted", "updated", "unchanged")], F.count_if("ignored").alias("noise_ignored"))
    received = rows.agg(F.count("*").alias("bars_received")).join(found.agg(F.count_if(F.col("action") == "excluded").alias("bars_excluded")))
    changed = sessions.agg(F.count_if(F.col("change").isin("inserted", "updated")).alias("sessions_upserted"))
    by_check = found.groupBy("check").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("check", "n")))).alias("issues"))
    return received.join(counted).join(changed).join(by_check).select(F.lit(run_id).alias("run_id"), F.lit("succeeded").alias("status"), "bars_received", "bars_inserted", "bars_updated", "bars_unchanged", "bars_excluded", "noise_ignored", "sessions_upserted", "issues")


def append_run(rows: DataFrame, folder: str, run_id: int) -> None:
    """Write the rows of one run as its own part of a table partitioned by run; a repeated run replaces its part and nothing else."""
    rows.drop("run_id").write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")


def ingest(spark: SparkSession, folder: str, run_id: int, stored: DataFrame | None, rows: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """One delivery of rows (symbol, ts, BAR) into stored (none at first): validates, merges and appends findings, sessions and the run's summary below folder. The merged bars of the run are written there
    and returned; an error leaves no summary, and a repeated run replaces its parts."""
    accepted_schema = f"symbol string, ts timestamp_ntz, {', '.join(f'{c} double' for c in BAR)}"
    stored = spark.createDataFrame([], accepted_schema) if stored is None else stored
    checked = quality.validate(rows, as_of)
    merged = merge_bars(stored, quality.accept(checked))
    append_run(merged, f"{folder}/bars", run_id)
    written = spark.read.parquet(f"{folder}/bars/run_id={run_id}")
    append_run(findings(checked, written), f"{folder}/events", run_id)
    found = spark.read.parquet(f"{folder}/events/run_id={run_id}")
    append_run(sessions, f"{folder}/sessions", run_id)
    append_run(run_summary(run_id, rows, written, found, spark.read.parquet(f"{folder}/sessions/run_id={run_id}")), f"{folder}/runs", run_id)
    return written.select("symbol", "ts", *BAR)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(1)


def since(events: DataFrame, first: Column, run_id: int | None = None) -> DataFrame:
    """Findings from a time on, of runs after run_id if given; predicates reach the scan, runs are pruned as partitions."""
    out = events.where(F.col("ts") >= first)
    return out if run_id is None else out.where(F.col("run_id") > run_id)


def run_alerts(runs: DataFrame, events: DataFrame) -> DataFrame:
    """alert_id, kind, severity, subject of runs that did not succeed and of findings (check, severity, symbol, ts, run_id); a provider's failure is critical."""
    key = lambda *c: F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 16)
    failed = runs.where("status <> 'succeeded'").select(key(F.lit("DATA_INGESTION_FAILED"), "run_id").alias("alert_id"), F.lit("DATA_INGESTION_FAILED").alias("kind"), F.lit("critical").alias("severity"), F.col("run_id").cast("string").alias("subject"))
    down = F.col("check") == "provider_failure"
    kind = F.when(down, "DATA_PROVIDER_FAILURE").otherwise("DATA_QUALITY_EVENT")
    listed = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    told = events.select(key(kind, "run_id", "check", "symbol", "ts").alias("alert_id"), kind.alias("kind"), F.when(down, "critical").otherwise(F.coalesce(F.element_at(listed, F.col("severity")), F.lit("info"))).alias("severity"), F.concat_ws(" ", "symbol", "check").alias("subject"))
    return failed.unionByName(told)


def transition_alerts(states: DataFrame, allowed: tuple[tuple[str, str], ...] = TRANSITIONS) -> DataFrame:
    """symbol, strategy, ts, previous, current, alert_id of the allowed changes of state (symbol, ts, strategy, state, state_in_effect)."""
    is_one = reduce(lambda a, b: a | b, [(F.col("state_in_effect") == p) & (F.col("state") == c) for p, c in allowed])
    key = F.sha2(F.concat_ws("|", F.lit("STRATEGY_STATE_CHANGED"), "symbol", "strategy", F.date_format("ts", "yyyy-MM-dd"), "state_in_effect", "state"), 256)
    return states.where(is_one).select("symbol", "strategy", "ts", F.col("state_in_effect").alias("previous"), F.col("state").alias("current"), key.alias("alert_id"))
