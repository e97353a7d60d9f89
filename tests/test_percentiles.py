"""Percentiles by rounds beside the built-in aggregate."""

import random

import pytest
from pyspark.sql import functions as F

from mercato.operators import percentiles as P
from mercato.operators import stats

AT = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "p999": 0.999, "high": 1.0}


def counted(spark, rows):
    return spark.createDataFrame(rows, "g string, h int, v double, c long").repartition(7)


def values(df):
    return {(r.g, r.h, n): r[n] for r in df.collect() for n in AT}


def builtin(df):
    return values(df.where("v is not null").groupBy("g", "h").agg(*[F.percentile("v", F.lit(p), F.col("c")).alias(n) for n, p in AT.items()]))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [("hot", 1, float(v), rng.choice([1, 1, 2, 500])) for v in rng.sample(range(-10**6, 10**6), 3000)]
    rows += [("steep", 1, (-1) ** k * 10.0 ** (k / 5 - 150), 1 + k % 3) for k in range(1500)]
    rows += [("weighty", 2, float(k), 10**9 if k == 77 else 1) for k in range(400)]
    rows += [(None, 3, float(k), 1) for k in range(301)] + [("few", None, float(k), k + 1) for k in range(5)]
    rows += [("one", 1, 4.0, 9), ("none", 1, None, 3), ("hot", 1, None, 7)]
    return counted(spark, rows)


def test_rounds_give_the_built_in_result(mixed):
    want = builtin(mixed)
    assert len(want) == 6 * len(AT)
    for most in (1, 20, 300, 10**6):
        assert values(P.percentiles(mixed, ["g", "h"], AT, most)) == pytest.approx(want, rel=1e-12)


def test_joins_when_many_groups_are_large(mixed, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_GROUPS", 0)
    assert values(P.percentiles(mixed, ["g", "h"], AT, 50)) == pytest.approx(builtin(mixed), rel=1e-12)


def test_an_empty_table_has_no_percentiles(spark):
    found = P.percentiles(counted(spark, []), ["g", "h"], AT, 1)
    assert found.count() == 0 and found.columns == ["g", "h", *AT]


def test_no_task_holds_more_values_than_allowed(mixed, monkeypatch):
    """The rows that are left for the last step, by group and span."""
    seen = []
    real = P.cut
    monkeypatch.setattr(P, "cut", lambda df: seen.append(real(df)) or seen[-1])
    P.percentiles(mixed, ["g", "h"], AT, 40)
    assert seen[-1].columns == ["k", "rank", "lo", "hi", "d", "before"] and seen[-1].agg(F.max("d")).first()[0] <= 40


def test_price_stats_are_the_same_either_way(spark):
    rng = random.Random(8)
    rows = [("a", round(rng.lognormvariate(8, 1), 2)) for _ in range(2500)] + [("b", float(rng.randint(1, 40))) for _ in range(900)] + [("c", 5.0), ("a", -1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    plain, rounds = ({r.g: r.asDict() for r in stats.price_stats(df, ["g"], "v", 50, most).collect()} for most in (10**6, 30))
    assert plain.keys() == rounds.keys() == {"a", "b", "c"}
    for g in plain:
        assert {k: v for k, v in rounds[g].items() if k != "g"} == pytest.approx({k: v for k, v in plain[g].items() if k != "g"}, rel=1e-9)
