import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, rate string, copies int"


def rows(seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "z", "hot", "hot", "hot", "tiny", None]
    out = [(i, "w " * int(rng.lognormvariate(3, 1.2)), rng.choice(sources), "x", 9) for i in range(1500)]
    out += [(5000 + i, "same text of a hot copy", "hot", "x", 9) for i in range(400)]
    out += [(9001, None, "a", "x", 9), (9002, "", None, "x", 9), (None, "\ta b c", "a", "x", 9), (9003, None, "void", "x", 9), (9004, "long " * 20_000, "z", "x", 9), out[0], out[0]]
    return out


def brute_targets(data):
    size = {}
    for _, text, source, *_ in data:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(size.values()), set(size), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 2 * size[s]}
        if not over:
            return size, out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = 2.0 * size[s]
            left -= out[s]
        open_ -= over
    return size, out


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df, mixing.mix(df.repartition(3)).collect()


def test_words_come_near_targets(mixed):
    _, out = mixed
    data = rows()
    size, target = brute_targets(data)
    assert len(out) == len(data)
    source = {r[0]: r[2] for r in data}
    got, longest = {}, {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        got[s] = got.get(s, 0) + r.taken
        longest[s] = max(longest.get(s, 0), r.size)
    for s in size:
        assert abs(got[s] - target[s]) <= 1.1 * longest[s] + 1, s
    assert {r.size for r in out if r.doc_id is None} == {2}


def test_rates_solve_the_constraints(mixed):
    _, out = mixed
    source = {r[0]: r[2] for r in rows()}
    words, target = {}, {}
    for r in out:
        words[source[r.doc_id]] = words.get(source[r.doc_id], 0) + r.rate * r.size
        target[source[r.doc_id]] = r.target
    for s in words:
        assert words[s] == pytest.approx(target[s], rel=1e-6, abs=1e-6)


def test_reruns_agree_whatever_the_partitions(mixed):
    df, out = mixed
    again = mixing.mix(df.orderBy(F.desc("doc_id")).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixture_repeats_rows(spark, mixed):
    df, out = mixed
    taken = mixing.mixture(df)
    assert taken.columns == df.columns
    want = {}
    for r in out:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {r["doc_id"]: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_rates(data):
    """Rates by (source, size): the tilt by bisection in plain floats."""
    size, target = brute_targets(data)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, source, *_ in data:
        sizes.setdefault(source, []).append(words(text))
    out = {}
    for s, mine in sizes.items():
        if target[s] >= 2 * size[s]:
            out |= {(s, n): 2.0 if n else 1.0 for n in mine}
            continue
        mean = max(size[s] / len(mine), 1e-9)
        rate = lambda tilt, n: 2 / (1 + math.exp(min(700.0, -tilt * n / mean)))  # noqa: B023, E731
        low, high = -4096.0, 4096.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(n * rate(middle, n) for n in mine) < target[s] else (low, middle)
        out |= {(s, n): rate(low, n) if n else 1.0 for n in mine}
    return out, sizes


def test_rates_and_copies_equal_a_plain_version(mixed):
    """Rates against a bisection; copies by the running sum of fractions along rising sizes, whole cells at a time."""
    _, out = mixed
    data = rows()
    want, sizes = plain_rates(data)
    source = {r[0]: r[2] for r in data}
    copies = {}
    for r in out:
        key = (source[r.doc_id], r.size)
        assert r.rate == pytest.approx(want[key], abs=1e-6) and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
        copies[key] = copies.get(key, 0) + r.copies
    for s, mine in sizes.items():
        rate = {r.size: r.rate for r in out if source[r.doc_id] == s}
        running, passed = mixing.ONE // 2, 0
        for n in sorted(set(mine)):
            count = mine.count(n)
            running += count * round((rate[n] - math.floor(rate[n])) * mixing.ONE)
            assert copies[s, n] == count * math.floor(rate[n]) + running // mixing.ONE - passed, (s, n)
            passed = running // mixing.ONE
