"""SQL fragments that the queries' SQL shares: the derived bars and quotes, windows and rounding."""

BARS = """
bars AS (
  SELECT symbol, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(q) AS volume,
         arg_max(price, k) / CASE WHEN ts < TIMESTAMP '1995-01-01' THEN 2.0 ELSE 1.0 END AS adj_close
  FROM (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_quantity AS q, l_extendedprice / l_quantity AS price,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
  GROUP BY symbol, ts)"""

QUOTES = """
quotes AS (
  SELECT event_type AS symbol, ts, event_id, value AS mid, value * (1 - 0.0002 / 2) AS bid, value * (1 + 0.0002 / 2) AS ask FROM events)"""


def event_bars(hours: int, name: str = "ebars") -> str:
    return f"""
{name} AS (
  SELECT event_type AS symbol, epoch_ms(CAST(floor(epoch(ts) / {hours * 3600}) * {hours * 3600} AS BIGINT) * 1000) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events e GROUP BY event_type, floor(epoch(e.ts) / {hours * 3600}))"""


#: Orders each instrument's rows.
W = "PARTITION BY symbol ORDER BY ts"


def full(agg: str, x: str, n: int, frame: str = "trailing", part: str = W) -> str:
    """An aggregate over n rows, null until all of them are defined."""
    rows = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if frame == "trailing" else f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"CASE WHEN count({x}) OVER ({part} {rows}) = {n} THEN {agg} OVER ({part} {rows}) END"


def pos(num: str, den: str) -> str:
    """num / den rounded, null unless den > 0."""
    return f"CASE WHEN ({den}) > 0 THEN round(({num}) / ({den}), 10) END"


def ratio(num: str, den: str) -> str:
    return f"round(({num}) / nullif({den}, 0), 10)"


def settled(x: str, name: str | None = None, decimals: int = 6) -> str:
    return f"round({x} + 1e-9, {decimals})" + (f" AS {name}" if name else "")


def all_settled(names: str) -> str:
    """Settled columns of the same names."""
    return ", ".join(settled(n, n) for n in names.split())


def smooth(name: str, source: str, x: str, n: int, alpha: float) -> str:
    """CTEs: name(symbol, ts, y), the recursion that begins with the mean of the first n defined values."""
    return f"""
{name}_x AS MATERIALIZED (SELECT symbol, ts, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM {source} WHERE {x} IS NOT NULL),
{name} AS (SELECT symbol, ts, i, (SELECT avg(b.x) FROM {name}_x b WHERE b.symbol = a.symbol AND b.i <= {n}) AS y FROM {name}_x a WHERE i = {n}
  UNION ALL SELECT x.symbol, x.ts, x.i, {alpha!r} * x.x + (1.0 - {alpha!r}) * p.y FROM {name} p JOIN {name}_x x ON x.symbol = p.symbol AND x.i = p.i + 1)"""


def joined(names: list[str], source: str = "bars") -> str:
    """source with a column for each smoothed CTE."""
    return f"FROM {source} " + " ".join(f"LEFT JOIN {n} ON {n}.symbol = {source}.symbol AND {n}.ts = {source}.ts" for n in names)


#: Five-minute bars m5(symbol, ts, open, high, low, close, i) of the market that events move; a bar opens at the price in force.
M5 = f"""
m5_ticks AS (SELECT event_type AS symbol, ts AS seen_at, event_id,
    1000 + (sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE / 10000 AS price FROM events),
m5_seen AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, seen_at, TIMESTAMP '1970-01-01') AS ts, max(price) AS top, min(price) AS bottom, arg_max(price, row(seen_at, event_id)) AS last_price FROM m5_ticks GROUP BY ALL),
m5_grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 5 MINUTE)) AS ts FROM m5_seen GROUP BY symbol),
m5_held AS (SELECT symbol, ts, top, bottom, last_value(last_price IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS close FROM m5_grid LEFT JOIN m5_seen USING (symbol, ts)),
m5_open AS (SELECT *, coalesce(lag(close) OVER ({W}), 1000.0) AS open FROM m5_held),
m5 AS MATERIALIZED (SELECT symbol, ts, open, greatest(open, close, coalesce(top, close)) AS high, least(open, close, coalesce(bottom, close)) AS low, close, row_number() OVER ({W}) - 1 AS i FROM m5_open)"""
