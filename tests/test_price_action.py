import datetime as dt

import pytest

from tidemark.operators import price_action, structure
from tidemark.sources.bars import BAR_SCHEMA
from tests.causality import walk

CFG = structure.StructureConfig(left=2, right=2)


def bars(spark, rows):
    return spark.createDataFrame([("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), (h + lo) / 2, float(h), float(lo), float(c), 1.0, None) for i, (h, lo, c) in enumerate(rows)], BAR_SCHEMA)


#: A pivot high of 110 at bar 4 becomes a zone at bar 6.
BASE = [(104, 100, 102), (105, 101, 103), (106, 102, 104), (108, 104, 106), (110, 105, 108), (108, 104, 106), (107, 103, 105)]


def events_of(spark, more):
    b = bars(spark, BASE + more)
    versions = price_action.zone_versions(structure.swings(b, CFG)).where("kinds = 'swing_high'")
    return b, price_action.events(b, versions).orderBy("idx").collect(), price_action.events(b, versions)


def test_breakout_needs_its_distance_and_a_known_zone(spark):
    _, found, _ = events_of(spark, [(112, 104, 110.11)])
    assert [(e.event_type, e.direction, e.idx, e.level) for e in found] == [("breakout", "up", 7, 110.0)]
    _, found, _ = events_of(spark, [(110.05, 104, 110.05)])
    assert found == []


def test_sweep_and_rejection(spark):
    _, found, _ = events_of(spark, [(111, 104, 109)])
    assert ("sweep", "up") in [(e.event_type, e.direction) for e in found]
    _, found, _ = events_of(spark, [(110.5, 104, 105)])
    assert ("rejection", "down") in [(e.event_type, e.direction) for e in found]


@pytest.mark.parametrize(("later", "outcome", "after", "retested"), [([(113, 111, 112)] * 3 + [(112, 108, 109)], "failed", 4, False), ([(113, 111, 112)] * 10, "held", 10, False), ([(113, 110.1, 112)] * 4, "pending", None, True)])
def test_outcomes(spark, later, outcome, after, retested):
    b, _, df = events_of(spark, [(112, 104, 111), *later])
    (o,) = price_action.outcomes(df, b).where("event_type = 'breakout' and at = 7").collect()
    assert (o.outcome, o.bars_to_outcome, o.retest_at is not None) == (outcome, after, retested)


def test_events_and_zones_of_a_walk(spark):
    rows = walk(200, seed=4)
    df = spark.createDataFrame(rows, BAR_SCHEMA)
    versions = price_action.zone_versions(structure.swings(df, CFG)).cache()
    got = {(r.idx, r.zone_id, r.event_type, r.direction) for r in price_action.events(df, versions).collect()}
    held = versions.collect()
    want = set()
    for t in range(1, len(rows)):
        _, _, o, h, lo, c, *_ = rows[t]
        pc, span = rows[t - 1][5], h - lo
        upper, lower = round((h - max(o, c)) / span, 10), round((min(o, c) - lo) / span, 10)
        for z in held:
            if not z.from_idx < t <= (len(rows) if z.to_idx is None else z.to_idx):
                continue
            far = lambda x, y: round(x / y - 1, 10)
            checks = {
                ("breakout", "up"): pc <= z.high and far(c, z.high) >= 0.001, ("breakdown", "down"): pc >= z.low and far(c, z.low) <= -0.001,
                ("sweep", "up"): pc <= z.high and far(h, z.high) >= 0.001 and c <= z.high, ("sweep", "down"): pc >= z.low and far(lo, z.low) <= -0.001 and c >= z.low,
                ("rejection", "down"): upper >= 0.5 and round((h - c) / c, 10) >= 0.003 and z.low > pc and h >= z.low and c < z.low,
                ("rejection", "up"): lower >= 0.5 and round((c - lo) / c, 10) >= 0.003 and z.high < pc and lo <= z.high and c > z.high,
            }
            want |= {(t, z.zone_id, *k) for k, holds in checks.items() if holds}
    assert want and got == want
    assert all(r.touch_count >= 0 and r.width_pct <= 0.02 for r in price_action.zones(df, versions).collect())
    near = price_action.nearest(df, versions).where("support_zone_id is not null").collect()
    assert near and all(r.support_distance_pct > 0 for r in near)
