"""Harness: an operator's rows up to T must not change when later bars go or change, nor with the order of rows, nor beside other
instruments."""

import datetime as dt
import random

from tidemark.sources.bars import BAR_SCHEMA


def walk(n, seed, symbol="A"):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        opened = price * (1 + rng.gauss(0, 0.004))
        price = opened * (1 + rng.gauss(0, 0.012))
        rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), opened, max(opened, price) * (1 + abs(rng.gauss(0, 0.004))), min(opened, price) * (1 - abs(rng.gauss(0, 0.004))), price, float(rng.randint(1, 9) * 1000), price))
    return rows


def settled(rows, until):
    keep = lambda v: round(v, 7) if isinstance(v, float) else v
    return sorted(str(tuple(map(keep, r))) for r in rows if r["ts"] <= until and r["symbol"] == "A")


def assert_causal(spark, op, rows):
    frame = lambda r: spark.createDataFrame(r, BAR_SCHEMA)
    whole = op(frame(rows)).collect()
    cut = rows[len(rows) * 2 // 3][1]
    before = [r for r in rows if r[1] <= cut]
    changed = before + [(*r[:2], *(x * 3 for x in r[2:6]), *r[6:]) for r in rows if r[1] > cut]
    other = [*random.Random(5).sample(rows, len(rows)), *walk(30, 9, "B")]
    want = settled(whole, cut)
    assert want
    assert settled(op(frame(before)).collect(), cut) == want, "earlier rows need later ones"
    assert settled(op(frame(changed)).collect(), cut) == want, "later rows reach earlier ones"
    assert settled(op(frame(other).repartition(3)).collect(), rows[-1][1]) == settled(whole, rows[-1][1]), "order or other instruments matter"
