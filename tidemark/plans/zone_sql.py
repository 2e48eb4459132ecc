"""SQL of price-action zones and what happens at them: a recursion over each instrument's swings, whose state is the list of its open zones."""

from __future__ import annotations

from tidemark.plans import sql
from tidemark.plans.candle_queries import GEOMETRY
from tidemark.plans.indicator_queries import SWING_CTE

_ZONE = "STRUCT(id BIGINT, low DOUBLE, high DOUBLE, ev BIGINT, hi BOOLEAN, lo BOOLEAN, f BIGINT)"
_VERSION = "STRUCT(id BIGINT, low DOUBLE, high DOUBLE, ev BIGINT, hi BOOLEAN, lo BOOLEAN, f BIGINT, t BIGINT, heir BIGINT)"
_WIDTH = "(greatest({a}.high, {b}) - least({a}.low, {c})) / ((greatest({a}.high, {b}) + least({a}.low, {c})) / 2) <= 0.02"


def _ended(zone: str, heir: str) -> str:
    return f"{{'id': {zone}.id, 'low': {zone}.low, 'high': {zone}.high, 'ev': {zone}.ev, 'hi': {zone}.hi, 'lo': {zone}.lo, 'f': {zone}.f, 't': x, 'heir': {heir}}}"


#: zr: one step a row: a swing joins or begins a zone, or the zone that grew last (pend) takes over its first neighbour. vs: versions as (symbol, zone_id, low, high, evidence, kinds, from_idx, to_idx, merged_into, root).
ZONES = f"""{SWING_CTE},
sw AS MATERIALIZED (SELECT symbol, swing_id AS n, kind, price, confirmed_idx FROM swings),
zr AS (SELECT symbol, -1::BIGINT AS n, 0::BIGINT AS made, NULL::BIGINT AS pend, 0::BIGINT AS x, []::{_ZONE}[] AS zs, []::{_VERSION}[] AS log FROM (SELECT DISTINCT symbol FROM sw)
  UNION ALL
  SELECT symbol, n, CASE WHEN swing AND fit IS NULL THEN made + 1 ELSE made END, CASE WHEN swing THEN fit WHEN other IS NULL THEN NULL ELSE least(pend, other) END, x,
    CASE WHEN swing AND fit IS NULL THEN list_append(zs, {{'id': made, 'low': price, 'high': price, 'ev': 1, 'hi': kind = 'high', 'lo': kind = 'low', 'f': x}})
         WHEN swing THEN list_append(list_filter(zs, lambda q: q.id <> fit), {{'id': z.id, 'low': least(z.low, price), 'high': greatest(z.high, price), 'ev': z.ev + 1, 'hi': z.hi OR kind = 'high', 'lo': z.lo OR kind = 'low', 'f': x}})
         WHEN other IS NULL THEN zs
         ELSE list_append(list_filter(zs, lambda q: q.id <> pend AND q.id <> other), {{'id': least(pend, other), 'low': least(z.low, o.low), 'high': greatest(z.high, o.high), 'ev': z.ev + o.ev, 'hi': z.hi OR o.hi, 'lo': z.lo OR o.lo, 'f': x}}) END,
    CASE WHEN swing AND fit IS NOT NULL THEN list_append(log, {_ended('z', 'NULL')})
         WHEN NOT swing AND other IS NOT NULL THEN list_concat(log, [CASE WHEN pend < other THEN {_ended('o', 'pend')} ELSE {_ended('z', 'other')} END, CASE WHEN pend < other THEN {_ended('z', 'NULL')} ELSE {_ended('o', 'NULL')} END]) ELSE log END
  FROM (SELECT *, list_filter(zs, lambda q: q.id = other)[1] AS o FROM (
    SELECT *, CASE WHEN swing THEN NULL ELSE list_min(list_transform(list_filter(zs, lambda q: q.id <> z.id AND q.low <= z.high + (z.low + z.high) / 2 * 0.005 AND q.high >= z.low - (z.low + z.high) / 2 * 0.005 AND {_WIDTH.format(a='q', b='z.high', c='z.low')}), lambda q: q.id)) END AS other FROM (
      SELECT *, list_filter(zs, lambda q: q.id = CASE WHEN swing THEN fit ELSE pend END)[1] AS z FROM (
        SELECT zr.symbol, coalesce(s.n, zr.n) AS n, made, pend, zs, log, s.n IS NOT NULL AS swing, s.price, s.kind, coalesce(s.confirmed_idx, zr.x) AS x,
          CASE WHEN s.n IS NOT NULL THEN list_min(list_transform(list_filter(zs, lambda q: q.low - s.price * 0.005 <= s.price AND s.price <= q.high + s.price * 0.005 AND {_WIDTH.format(a='q', b='s.price', c='s.price')}), lambda q: {{'d': abs((q.low + q.high) / 2 - s.price), 'id': q.id}})).id END AS fit
        FROM zr LEFT JOIN sw s ON s.symbol = zr.symbol AND s.n = zr.n + 1 AND zr.pend IS NULL WHERE zr.pend IS NOT NULL OR s.n IS NOT NULL))))),
zl AS MATERIALIZED (SELECT symbol, zs, log FROM zr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, len(log) DESC, pend IS NULL DESC) = 1),
va AS MATERIALIZED (SELECT symbol, v.id AS zone_id, v.low, v.high, v.ev AS evidence, CASE WHEN v.hi AND v.lo THEN 'mixed' WHEN v.hi THEN 'swing_high' ELSE 'swing_low' END AS kinds, v.f AS from_idx, v.t AS to_idx, v.heir AS merged_into
  FROM (SELECT symbol, unnest(log) AS v FROM zl UNION ALL SELECT symbol, unnest(list_transform(zs, lambda q: {{'id': q.id, 'low': q.low, 'high': q.high, 'ev': q.ev, 'hi': q.hi, 'lo': q.lo, 'f': q.f, 't': NULL, 'heir': NULL}})) FROM zl)),
hr AS (SELECT DISTINCT symbol, zone_id, zone_id AS root FROM va UNION ALL SELECT hr.symbol, hr.zone_id, va.merged_into FROM hr JOIN va ON va.symbol = hr.symbol AND va.zone_id = hr.root AND va.merged_into IS NOT NULL),
vs AS MATERIALIZED (SELECT va.*, (SELECT min(root) FROM hr WHERE hr.symbol = va.symbol AND hr.zone_id = va.zone_id) AS root FROM va WHERE to_idx IS DISTINCT FROM from_idx OR merged_into IS NOT NULL),
ix AS MATERIALIZED (SELECT symbol, ts, high, low, close, upper_wick_ratio AS uw, lower_wick_ratio AS lw, row_number() OVER ({sql.W}) - 1 AS idx, lag(close) OVER ({sql.W}) AS before FROM g),
ls AS (SELECT symbol, max(idx) AS last FROM ix GROUP BY symbol),
vk AS (SELECT vs.symbol, zone_id, low AS zl, high AS zh, from_idx, to_idx, last FROM vs JOIN ls ON ls.symbol = vs.symbol WHERE merged_into IS NULL OR to_idx > from_idx),
mb AS (SELECT ix.*, zone_id, zl, zh FROM ix JOIN vk ON vk.symbol = ix.symbol AND idx BETWEEN from_idx + 1 AND coalesce(to_idx, last)),
ma AS (SELECT ix.*, zone_id, zl, zh FROM ix JOIN vk ON vk.symbol = ix.symbol AND idx BETWEEN from_idx AND coalesce(to_idx - 1, last))"""
BASE = f"WITH RECURSIVE {sql.BARS}, {GEOMETRY}, {ZONES}"

VERSIONS_SQL = f"{BASE} SELECT symbol, zone_id, {sql.settled('low', 'low')}, {sql.settled('high', 'high')}, from_idx, to_idx, evidence, kinds, merged_into, root FROM vs"

_OFF = lambda a, b: f"round({a} / nullif({b}, 0) - 1, 10)"
_BACK, _UP = "round((high - close) / nullif(close, 0), 10)", "round((close - low) / nullif(close, 0), 10)"
_KINDS = (
    ("breakout", "up", f"before <= zh AND {_OFF('close', 'zh')} >= 0.001", "zh", _OFF("close", "zh"), "NULL"), ("breakdown", "down", f"before >= zl AND {_OFF('close', 'zl')} <= -0.001", "zl", _OFF("close", "zl"), "NULL"),
    ("sweep", "up", f"before <= zh AND {_OFF('high', 'zh')} >= 0.001 AND close <= zh", "zh", _OFF("high", "zh"), "uw"), ("sweep", "down", f"before >= zl AND {_OFF('low', 'zl')} <= -0.001 AND close >= zl", "zl", _OFF("low", "zl"), "lw"),
    ("rejection", "down", f"uw >= 0.5 AND {_BACK} >= 0.003 AND zl > before AND high >= zl AND close < zl", "zl", _BACK, "uw"), ("rejection", "up", f"lw >= 0.5 AND {_UP} >= 0.003 AND zh < before AND low <= zh AND close > zh", "zh", _UP, "lw"),
)
EVENTS = f"{BASE}, ev AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT symbol, ts, idx, close, zone_id, zl, zh, '{k}' AS event_type, '{w}' AS direction, {level} AS level, {d} AS distance_pct, {r}::DOUBLE AS wick_ratio FROM mb WHERE before IS NOT NULL AND {holds}" for k, w, holds, level, d, r in _KINDS) + ")"
EVENTS_SQL = f"{EVENTS} SELECT symbol, ts, idx, zone_id, event_type, direction, {sql.settled('close', 'close')}, {sql.settled('zl', 'zone_low')}, {sql.settled('zh', 'zone_high')}, {sql.all_settled('level distance_pct wick_ratio')} FROM ev"

OUTCOMES_SQL = f"""{EVENTS}, br AS (SELECT * FROM ev WHERE event_type IN ('breakout', 'breakdown')),
wk AS (SELECT b.symbol, b.idx AS origin, b.ts AS event_ts, b.event_type, b.direction, b.zone_id, b.level, k.idx - b.idx AS age, k.ts AS ts, CASE WHEN b.direction = 'up' THEN k.close < b.level ELSE k.close > b.level END AS lost,
  CASE WHEN b.direction = 'up' THEN {_OFF('k.low', 'b.level')} <= 0.002 ELSE {_OFF('k.high', 'b.level')} >= -0.002 END AS near FROM br b LEFT JOIN ix k ON k.symbol = b.symbol AND k.idx BETWEEN b.idx + 1 AND b.idx + 10),
ag AS (SELECT symbol, origin, event_ts, event_type, direction, zone_id, level, min(age) FILTER (lost) AS failed, max(age) FILTER (age = 10) AS whole, min(age) FILTER (near AND NOT lost AND age < 10) AS touched FROM wk GROUP BY ALL),
fn AS (SELECT *, coalesce(failed, whole) AS fin, CASE WHEN touched < coalesce(failed, whole, 11) THEN touched END AS again FROM ag)
SELECT symbol, origin AS "at", event_ts, event_type, direction, zone_id, {sql.settled('level', 'level')}, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN whole IS NOT NULL THEN 'held' ELSE 'pending' END AS outcome, CAST(fin AS INTEGER) AS bars_to_outcome,
  (SELECT ts FROM ix WHERE ix.symbol = fn.symbol AND ix.idx = origin + fin) AS outcome_at, (SELECT ts FROM ix WHERE ix.symbol = fn.symbol AND ix.idx = origin + again) AS retest_at FROM fn"""

NEAREST_SQL = f"""{BASE}, nr AS (SELECT symbol, ts, any_value(close) AS close, arg_max({{'id': zone_id, 'z': zh}}, row(zh, -zone_id)) FILTER (zh < close) AS s, arg_min({{'id': zone_id, 'z': zl}}, row(zl, zone_id)) FILTER (zl > close) AS r, count(*) AS active_zones,
  coalesce(string_agg(CAST(zone_id AS VARCHAR), ',' ORDER BY zone_id) FILTER (NOT coalesce(zh < close, false) AND NOT coalesce(zl > close, false)), '') AS inside_zone_ids FROM ma GROUP BY symbol, ts)
SELECT symbol, ts, s.id AS support_zone_id, {sql.settled(_OFF('close', 's.z'), 'support_distance_pct')}, r.id AS resistance_zone_id, {sql.settled(_OFF('r.z', 'close'), 'resistance_distance_pct')}, active_zones, inside_zone_ids FROM nr"""

OPEN_SQL = f"""{BASE}, tc AS (SELECT symbol, zone_id, count(*) AS touches, max(ts) AS last_tested FROM mb WHERE zl <= high AND zh >= low GROUP BY symbol, zone_id),
rt AS (SELECT symbol, root AS zone_id, CAST(sum(touches) AS BIGINT) AS touch_count, max(last_tested) AS last_tested FROM tc JOIN (SELECT DISTINCT symbol, zone_id, root FROM vs) USING (symbol, zone_id) GROUP BY symbol, root)
SELECT v.symbol, v.zone_id, {sql.settled('low', 'zone_low')}, {sql.settled('high', 'zone_high')}, {sql.settled('round((high - low) / ((high + low) / 2), 10)', 'width_pct')}, evidence, kinds, coalesce(touch_count, 0) AS touch_count, last_tested
FROM vs v LEFT JOIN rt ON rt.symbol = v.symbol AND rt.zone_id = v.zone_id WHERE to_idx IS NULL"""
