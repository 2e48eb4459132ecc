"""Support and resistance zones, the events at them, and what became of breaks.

Only the zones depend on their own order: a fold over each instrument's few confirmed swings gives every zone's versions, each
valid for a range of bars. Everything else is joins of bars with versions: events at zones known at the close before, touches,
nearest zones, retests and outcomes. Bars and versions meet by blocks of bars, so that an instrument's history is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, lagged
from tidemark.operators import candles, structure


@dataclass(frozen=True)
class ZoneConfig:
    """Fixed values."""

    tolerance: float = 0.005
    max_width: float = 0.02
    break_distance: float = 0.001
    sweep_distance: float = 0.001
    wick: float = 0.5
    rejection_distance: float = 0.003
    window: int = 10
    retest: float = 0.002


CONFIG = ZoneConfig()
VERSIONS = "symbol string, zone_id long, low double, high double, from_idx long, to_idx long, evidence long, kinds string, merged_into long, root long"
#: Bars of a block in which bars and versions meet.
BLOCK = 64


class _Zones:
    """Zones of one instrument and the versions that they leave behind."""

    def __init__(self, cfg: ZoneConfig):
        self.cfg, self.open, self.versions, self.made = cfg, {}, [], 0

    def width(self, low: float, high: float) -> float:
        return (high - low) / ((high + low) / 2)

    def put(self, zone: int, value: dict, idx: int) -> None:
        self.end(zone, idx)
        self.open[zone] = value | {"from_idx": idx}

    def end(self, zone: int, idx: int, into: int | None = None) -> None:
        old = self.open.pop(zone, None)
        if old:
            self.versions.append({"zone_id": zone, "to_idx": idx, "merged_into": into, **old})

    def pivot(self, price: float, kind: str, idx: int) -> None:
        """A pivot joins the zone with the nearest middle that may hold it, else begins one; then close zones grow together."""
        near = price * self.cfg.tolerance
        fits = [(abs((z["low"] + z["high"]) / 2 - price), k) for k, z in self.open.items() if z["low"] - near <= price <= z["high"] + near and self.width(min(z["low"], price), max(z["high"], price)) <= self.cfg.max_width]
        if not fits:
            self.put(self.made, {"low": price, "high": price, "evidence": 1, "kinds": {kind}}, idx)
            self.made += 1
            return
        _, zone = min(fits)
        z = self.open[zone]
        self.put(zone, {"low": min(z["low"], price), "high": max(z["high"], price), "evidence": z["evidence"] + 1, "kinds": z["kinds"] | {kind}}, idx)
        while (other := self.neighbour(zone)) is not None:
            kept, gone = sorted((zone, other))
            a, b = self.open[kept], self.open[gone]
            self.end(gone, idx, kept)
            self.put(kept, {"low": min(a["low"], b["low"]), "high": max(a["high"], b["high"]), "evidence": a["evidence"] + b["evidence"], "kinds": a["kinds"] | b["kinds"]}, idx)
            zone = kept

    def neighbour(self, zone: int) -> int | None:
        z = self.open[zone]
        near = (z["low"] + z["high"]) / 2 * self.cfg.tolerance
        for k in sorted(self.open):
            o = self.open[k]
            if k != zone and o["low"] <= z["high"] + near and o["high"] >= z["low"] - near and self.width(min(z["low"], o["low"]), max(z["high"], o["high"])) <= self.cfg.max_width:
                return k
        return None


def zone_versions(swings: DataFrame, cfg: ZoneConfig = CONFIG) -> DataFrame:
    """VERSIONS: bounds of each zone from the close of bar from_idx up to that of to_idx (null: still open), and root, the zone that it is part of in the end."""

    def run(group):
        import pandas as pd

        zones = _Zones(cfg)
        for kind, price, idx in group.sort_values("swing_id")[["kind", "price", "confirmed_idx"]].itertuples(index=False, name=None):
            zones.pivot(price, kind, int(idx))
        heirs = {v["zone_id"]: v["merged_into"] for v in zones.versions if v["merged_into"] is not None}

        def root(zone: int) -> int:  # an heir is older than the zone that it takes over
            while zone in heirs:
                zone = heirs[zone]
            return zone

        rows = zones.versions + [{"zone_id": k, "to_idx": None, "merged_into": None, **z} for k, z in zones.open.items()]
        rows = [r for r in rows if r["to_idx"] != r["from_idx"] or r["merged_into"] is not None]
        out = pd.DataFrame([{**r, "root": root(r["zone_id"]), "kinds": "mixed" if len(r["kinds"]) > 1 else f"swing_{next(iter(r['kinds']))}"} for r in rows], columns=[c.split()[0] for c in VERSIONS.split(", ")])
        out["symbol"] = group["symbol"].iloc[0]
        return out.astype({"to_idx": "Int64", "merged_into": "Int64"})

    return swings.select("symbol", "swing_id", "kind", "price", "confirmed_idx").groupBy("symbol").applyInPandas(run, VERSIONS)


def indexed(bars: DataFrame) -> DataFrame:
    """What events read of a bar: idx, prices, the close before, wick ratios."""
    g = candles.geometry(bars).select("symbol", "ts", "high", "low", "close", "upper_wick_ratio", "lower_wick_ratio")
    return g.withColumns({"idx": (F.row_number().over(by()) - 1).cast("long"), "before": lagged("close")})


def at_versions(bars: DataFrame, versions: DataFrame, after: bool = False) -> DataFrame:
    """Bars with the versions that hold at them: known at the close before, or with after at their own close."""
    shift = 0 if after else 1
    last = bars.groupBy("symbol").agg(F.max("idx").alias("last"))
    z = versions.where("merged_into is null or to_idx > from_idx").join(last, "symbol")
    z = z.select("symbol", "zone_id", F.col("low").alias("zone_low"), F.col("high").alias("zone_high"), (F.col("from_idx") + shift).alias("a"), F.coalesce(F.col("to_idx") - 1 + shift, F.col("last")).alias("z"))
    spread = z.where("a <= z").withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor(F.col("z") / BLOCK))))
    return bars.withColumn("block", F.floor(F.col("idx") / BLOCK)).join(spread, ["symbol", "block"]).where("idx between a and z").drop("block", "a", "z")


def _from(price: Column, level: Column) -> Column:
    return F.round(F.try_divide(price, level) - 1, 10)


def events(bars: DataFrame, versions: DataFrame, cfg: ZoneConfig = CONFIG) -> DataFrame:
    """symbol, ts, idx, event_type, direction, zone_id, zone_low, zone_high, level, distance_pct, wick_ratio of each bar and zone."""
    met = at_versions(indexed(bars), versions).where("before is not null")
    zl, zh, c, pc = F.col("zone_low"), F.col("zone_high"), F.col("close"), F.col("before")
    upper, lower = F.col("upper_wick_ratio"), F.col("lower_wick_ratio")
    back, up = F.round(F.try_divide(F.col("high") - c, c), 10), F.round(F.try_divide(c - F.col("low"), c), 10)
    found = [
        ("breakout", "up", (pc <= zh) & (_from(c, zh) >= cfg.break_distance), zh, _from(c, zh), None),
        ("breakdown", "down", (pc >= zl) & (_from(c, zl) <= -cfg.break_distance), zl, _from(c, zl), None),
        ("sweep", "up", (pc <= zh) & (_from(F.col("high"), zh) >= cfg.sweep_distance) & (c <= zh), zh, _from(F.col("high"), zh), upper),
        ("sweep", "down", (pc >= zl) & (_from(F.col("low"), zl) <= -cfg.sweep_distance) & (c >= zl), zl, _from(F.col("low"), zl), lower),
        ("rejection", "down", (upper >= cfg.wick) & (back >= cfg.rejection_distance) & (zl > pc) & (F.col("high") >= zl) & (c < zl), zl, back, upper),
        ("rejection", "up", (lower >= cfg.wick) & (up >= cfg.rejection_distance) & (zh < pc) & (F.col("low") <= zh) & (c > zh), zh, up, lower),
    ]
    row = lambda kind, way, level, distance, wick: F.struct(F.lit(kind).alias("event_type"), F.lit(way).alias("direction"), level.alias("level"), distance.alias("distance_pct"), (F.lit(None).cast("double") if wick is None else wick).alias("wick_ratio"))
    each = F.filter(F.array(*[F.when(F.coalesce(holds, F.lit(False)), row(kind, way, level, distance, wick)) for kind, way, holds, level, distance, wick in found]), lambda x: x.isNotNull())
    flat = met.select("symbol", "ts", "idx", "close", "zone_id", "zone_low", "zone_high", F.explode(each).alias("e"))
    return flat.select("symbol", "ts", "idx", "close", "zone_id", "zone_low", "zone_high", "e.*")


def outcomes(found: DataFrame, bars: DataFrame, cfg: ZoneConfig = CONFIG) -> DataFrame:
    """Breaks with outcome failed (the close went back through the level within the window), held, or pending, when, and the
    first retest before it."""
    breaks = found.where(F.col("event_type").isin("breakout", "breakdown")).select("symbol", F.col("idx").alias("at"), F.col("ts").alias("event_ts"), "event_type", "direction", "zone_id", "level")
    after = indexed(bars).select("symbol", "idx", "ts", "high", "low", "close")
    steps = F.explode(F.sequence(F.lit(1), F.lit(cfg.window)))
    walked = breaks.withColumn("age", steps).withColumn("idx", F.col("at") + F.col("age")).join(after, ["symbol", "idx"], "left")
    up = F.col("direction") == "up"
    lost = F.when(up, F.col("close") < F.col("level")).otherwise(F.col("close") > F.col("level"))
    near = F.when(up, _from(F.col("low"), F.col("level")) <= cfg.retest).otherwise(_from(F.col("high"), F.col("level")) >= -cfg.retest)
    keys = ["symbol", "at", "event_ts", "event_type", "direction", "zone_id", "level"]
    done = walked.groupBy(*keys).agg(
        F.min(F.when(lost, F.col("age"))).alias("failed"), F.max(F.when(F.col("ts").isNotNull() & (F.col("age") == cfg.window), F.col("age"))).alias("whole"),
        F.min(F.when(near & ~lost & (F.col("age") < cfg.window), F.col("age"))).alias("touched"), F.map_from_entries(F.collect_list(F.when(F.col("ts").isNotNull(), F.struct("age", "ts")))).alias("times"),
    )
    end = F.coalesce("failed", "whole")
    outcome = F.when(F.col("failed").isNotNull(), "failed").when(F.col("whole").isNotNull(), "held").otherwise("pending")
    retest = F.when(F.col("touched") < F.coalesce(end, F.lit(cfg.window + 1)), F.col("touched"))
    return done.select(*keys, outcome.alias("outcome"), end.alias("bars_to_outcome"), F.try_element_at("times", end).alias("outcome_at"), F.try_element_at("times", retest).alias("retest_at"))


def nearest(bars: DataFrame, versions: DataFrame) -> DataFrame:
    """Support (highest zone below the close) and resistance (lowest above) at each bar's close, and the zones around it."""
    b = indexed(bars)
    met = at_versions(b.select("symbol", "ts", "idx", "close"), versions, after=True)
    below, above = F.col("zone_high") < F.col("close"), F.col("zone_low") > F.col("close")
    zone = F.struct("zone_id", "zone_low", "zone_high")
    g = met.groupBy("symbol", "ts", "close").agg(
        F.max_by(zone, F.when(below, F.struct("zone_high", -F.col("zone_id")))).alias("s"), F.min_by(zone, F.when(above, F.struct("zone_low", "zone_id"))).alias("r"), F.count("*").alias("active_zones"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~below & ~above, F.col("zone_id")))), lambda z: z.cast("string")), ",").alias("inside_zone_ids"),
    )
    return g.select("symbol", "ts", F.col("s.zone_id").alias("support_zone_id"), F.round(F.try_divide(F.col("close"), F.col("s.zone_high")) - 1, 10).alias("support_distance_pct"), F.col("r.zone_id").alias("resistance_zone_id"), F.round(F.try_divide(F.col("r.zone_low"), F.col("close")) - 1, 10).alias("resistance_distance_pct"), "active_zones", "inside_zone_ids")


def zones(bars: DataFrame, versions: DataFrame) -> DataFrame:
    """Open zones with evidence, sources and how many bars touched them since they were known, merged ones included."""
    touched = at_versions(indexed(bars), versions).where("zone_low <= high and zone_high >= low").groupBy("symbol", "zone_id").agg(F.count("*").alias("touches"), F.max("ts").alias("last_tested"))
    root = versions.select("symbol", "zone_id", "root").distinct()
    counts = touched.join(root, ["symbol", "zone_id"]).groupBy("symbol", F.col("root").alias("zone_id")).agg(F.sum("touches").alias("touch_count"), F.max("last_tested").alias("last_tested"))
    held = versions.where("to_idx is null").select("symbol", "zone_id", F.col("low").alias("zone_low"), F.col("high").alias("zone_high"), F.round((F.col("high") - F.col("low")) / ((F.col("high") + F.col("low")) / 2), 10).alias("width_pct"), "evidence", "kinds")
    return held.join(counts, ["symbol", "zone_id"], "left").withColumn("touch_count", F.coalesce("touch_count", F.lit(0)))


def analyse(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zone versions, events)."""
    versions = zone_versions(structure.swings(bars))
    return versions, events(bars, versions)
