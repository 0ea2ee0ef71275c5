"""Ordinals, exact ranks, digests and shuffles against plain versions, under few and many partitions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import ordering as O


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordinals_meet_in_no_single_task(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b", "c"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, `_row` string").repartition(7)
    got = O.with_ordinal(df, ["_row", "id"], "place")
    assert "SinglePartition" not in plan_of(got)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [(r["id"], r["_row"]) for r in sorted(got.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, 501))
    assert O.with_ordinal(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 23])
def test_exact_ranks(spark, partitions, monkeypatch):
    monkeypatch.setattr(O, "SORTED", 20)
    rng = random.Random(2)
    groups = {
        "wide": [rng.uniform(-1e308, 1e308) for _ in range(300)], "dense": [1.0 + k * 2**-52 for k in range(200)], "ties": [rng.choice([1.5, 2.5]) for _ in range(500)],
        "skew": [math.exp(rng.uniform(0, 500)) for _ in range(400)], "tiny": [k * 5e-324 for k in range(6)], "few": [3.0], None: [2.0, None, float("nan"), 1.0], "none": [None, float("nan")], "inf": [5.0, 1.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(partitions)
    n = F.col("n")
    got = O.select_ranks(df, ["g"], "v", {"low": F.floor((n - 1) / 2), "p90": F.floor(0.9 * n), "first": F.lit(0), "beyond": n})
    found = {r.g: tuple(r)[1:] for r in got.collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        own = sorted(v for v in vs if v is not None and not math.isnan(v))
        k = len(own)
        want = (own[(k - 1) // 2], own[math.floor(0.9 * k)], own[0], None) if k else (None,) * 4
        assert found[g] == want, g
    assert O.select_ranks(df.limit(0), ["g"], "v", {"x": n}).count() == 0


def plain_digest(strings, leaves):
    counts = {}
    for s in strings:
        d = hashlib.sha256(s.encode()).hexdigest()
        counts[d] = counts.get(d, 0) + 1
    depth = 0
    while len(counts) > leaves * 16**depth:
        depth += 1

    def node(prefix):
        if len(prefix) == depth:
            own = sorted(d for d in counts if d.startswith(prefix))
            return hashlib.sha256("\n".join(f"{d}:{counts[d]}" for d in own).encode()).hexdigest() if own else None
        children = [(prefix + c, node(prefix + c)) for c in "0123456789abcdef"]
        known = [f"{p}:{s}" for p, s in children if s]
        return hashlib.sha256("\n".join(known).encode()).hexdigest() if known else None

    return node("")


def test_digest_hangs_on_content_alone(spark, monkeypatch):
    monkeypatch.setattr(O, "LEAVES", 4)
    rng = random.Random(3)
    groups = {"large": [str(rng.randint(0, 999)) for _ in range(900)], "small": ["x"], None: ["x", "x", "y"], "hot": ["same"] * 400}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("nulls", None)], "g string, v string")
    want = {g: plain_digest(vs, 4) for g, vs in groups.items()}
    for partitions in (3, 60):
        assert {r.g: r.fingerprint for r in O.set_digest(df.repartition(partitions), ["g"], F.col("v")).collect()} == want
    every = [v for vs in groups.values() for v in vs]
    assert O.set_digest(df, [], F.col("v"), 16).first().fingerprint == plain_digest(every, 4)[:16]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_shuffle_is_one_to_one(spark, n):
    got = spark.range(n).select("id", O.shuffled_place(F.col("id"), n, 5).alias("p"), O.shuffled_place(F.col("id"), n, 6).alias("q")).collect()
    assert sorted(r.p for r in got) == sorted(r.q for r in got) == list(range(n))
    if n >= 1000:
        assert sum(r.p == r.q for r in got) < 20 and sum(abs(r.p - r.id) for r in got) / n > n / 5


def test_level_of_modes_with_fixed_cases(spark):
    from lodestar.operators.metrics import fill_level

    rng = random.Random(4)
    for _ in range(6):
        sizes = [(rng.randint(0, n), n) for n in (rng.randint(1, 30) for _ in range(rng.randint(1, 12)))]
        df = spark.createDataFrame(sizes, "_fixed long, _n long")
        for kept in (0, sum(f for f, _ in sizes), rng.randint(0, sum(n for _, n in sizes)), sum(n for _, n in sizes) + 5):
            held = lambda q: sum(max(f, min(n, q)) for f, n in sizes)  # noqa: B023, E731
            levels = [q for q in range(max(n for _, n in sizes) + 1) if held(q) <= kept]
            level, total = fill_level(df, kept)
            assert total == (held(levels[-1]) if levels else held(0)) and held(level) == total
            assert not levels or held(level + 1) == total or held(level + 1) > kept
