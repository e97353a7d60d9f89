"""Random outfits for many requests, and substring search by postings."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mercato.functions.draws import Keys
from mercato.operators import optimize as o
from mercato.operators import picks
from mercato.operators.substrings import SubstringIndex

ORDER = ["torso", "piernas"]
PRODUCTS = "slot string, url string, price double, score int, fit string, print string, color string, gender string, likes int, deal boolean, badges array<string>, trend string"
REQUESTS = "request long, seed long, budget double, gender string"


def products(n, seed=1):
    rng = random.Random(seed)
    pick = rng.choice
    return [
        (pick([*ORDER, "gorra"]), f"u{k}", float(rng.randint(10, 100)), rng.randint(0, 100), pick(["oversize", "slim", None]), pick(["estampado", "liso", None]), pick(["rojo", "verde", "azul", "negro", None]), pick(["hombre", "mujer", "unisex", " Hombre ", None]), rng.randint(0, 5), False, [], "")
        for k in range(n)
    ]


def naive(pool, seed, budget, gender, band=0.3, optional=(), complete=False):
    """The rule slot by slot over plain candidates."""
    budget, wanted = max(budget or 0.0, 0.0), (gender or "").strip().lower()
    fits = lambda c: wanted in ("", "unisex") or c.gender.strip().lower() in ("", "unisex", wanted)
    prices = sorted(c.price for c in pool if fits(c))
    centre, chosen, left = prices[len(prices) // 2] if prices else 0.0, [], budget
    for slot in [*ORDER, *optional]:
        own = [c for c in pool if c.slot == slot and (slot not in optional or fits(c))]
        own = [c for c in own if budget <= 0 or c.price <= left] or (own if complete else [])
        near = [c for c in own if fits(c) and abs(c.price - centre) <= centre * band and slot not in optional] or [c for c in own if fits(c)]
        if near:
            u = lambda c: (int(hashlib.md5(f"{seed}|{slot}|{c.url}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: B023, E731
            best = min(near, key=lambda c: (-math.log(u(c)) / o.pick_weight(c, chosen, centre, max(centre * band, 1.0)), c.url))
            chosen.append(best)
            left -= best.price
    return [c.url for c in chosen]


@pytest.mark.parametrize("complete", [False, True])
def test_outfits_follow_the_rule(spark, complete):
    rows = spark.createDataFrame(products(150), PRODUCTS)
    rng = random.Random(2)
    asked = [(k, k % 90, rng.choice([None, 0.0, -5.0, 15.0, 60.0, 120.0, 400.0]), rng.choice(["hombre", "Mujer ", "unisex", "", None, "otro"])) for k in range(200)]
    asked.append(asked[0])  # a request that repeats
    found = picks.weighted_outfits(spark.createDataFrame(asked, REQUESTS), rows, ORDER, optional=("gorra",), complete=complete).collect()
    assert len(found) == len(asked)
    pool = o.pools(rows)
    for r in found:
        assert [p.url for p in r.picks] == naive(pool, r.seed, r.budget, r.gender, optional=("gorra",), complete=complete)
        assert r.total == pytest.approx(sum(p.price for p in r.picks))
        assert complete or not (r.budget or 0) > 0 or r.total <= r.budget


def test_picks_are_as_frequent_as_their_weights(spark):
    rows = spark.createDataFrame([("torso", f"u{k}", 50.0 + k, 100 - 20 * k, "", "", "", "", k % 3, False, [], "") for k in range(5)], PRODUCTS)
    n = 6000
    requests = spark.range(n).select(F.col("id").alias("request"), F.col("id").alias("seed"), F.lit(0.0).alias("budget"), F.lit("").alias("gender"))
    got = Counter(r.picks[0].url for r in picks.weighted_outfits(requests, rows, ["torso"]).collect())
    weight = {c.url: o.pick_weight(c, [], 52.0, 52.0 * 0.3) for c in o.pools(rows)}
    for url, w in weight.items():
        share = w / sum(weight.values())
        assert abs(got[url] - n * share) < 5 * math.sqrt(n * share * (1 - share))


def test_requests_are_judged_by_their_own_rows(spark):
    """A join of 150,000 requests with the shortlists took minutes; now no plan joins them and each is drawn for once."""
    rows = spark.createDataFrame(products(150), PRODUCTS)
    requests = spark.range(300_000).selectExpr("id AS request", "id AS seed", "CASE WHEN id % 3 > 0 THEN 60D + id % 90 END AS budget", "CASE WHEN id % 2 = 0 THEN 'Mujer' END AS gender")
    found = picks.weighted_outfits(requests, rows, ORDER).select("request", F.explode("picks").alias("p"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("ArrowEvalPython") == 1
    assert found.select("request").distinct().count() > 290_000


def test_odd_seeds_and_budgets(spark):
    rows = spark.createDataFrame(products(60), PRODUCTS)
    asked = [(0, None, 50.0, None), (1, "", 50.0, None), (2, "ñ😀", None, "mujer"), (3, "x" * 200, 90.0, ""), (4, "a|b", float("nan"), ""), (5, "-7", float("inf"), "hombre"), (6, None, 50.0, None)]
    found = picks.weighted_outfits(spark.createDataFrame(asked, "request long, seed string, budget double, gender string"), rows, ORDER)
    pool, got = o.pools(rows), {r.request: [p.url for p in r.picks] for r in found.collect()}
    for k, seed, budget, gender in asked:
        if seed is not None:
            assert got[k] == naive(pool, seed, 1e9 if budget != budget else budget, gender)
    u = lambda c: (int(hashlib.md5(f"torso|{c.url}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    own, prices = [c for c in pool if c.slot == "torso"], sorted(c.price for c in pool)
    centre = prices[len(prices) // 2]
    near = [c for c in own if c.price <= 50 and abs(c.price - centre) <= centre * 0.3] or [c for c in own if c.price <= 50]
    assert got[0] == got[6] and got[0][0] == min(near, key=lambda c: -math.log(u(c)) / o.pick_weight(c, [], centre, max(centre * 0.3, 1.0))).url


def test_digests_are_those_of_hashlib():
    for length in (0, 1, 3, 4, 7, 8, 52, 55, 56, 63, 64, 119, 130):
        for ending in (b"", b"|torso|p1", b"y" * 55, b"z" * 140):
            keys = [bytes((7 * k + j) % 256 for j in range(length)) for k in range(3)]
            found = Keys(b"".join(keys), 3, length)
            want = [hashlib.md5(k + ending) for k in keys]
            assert [b"".join(int(x[k]).to_bytes(4, "little") for x in found.md5(ending)) for k in range(3)] == [w.digest() for w in want]
            assert list(found.uniform(ending)) == [(int(w.hexdigest()[:13], 16) + 0.5) / 2**52 for w in want]


def test_outfits_of_nothing(spark):
    rows = spark.createDataFrame([], PRODUCTS)
    requests = spark.createDataFrame([(1, None, None, None)], REQUESTS).withColumns({"total": F.lit("own"), "slot": F.lit("mine")})
    [r] = picks.weighted_outfits(requests, rows, ORDER).collect()
    assert r.picks == [] and r.total == 0 and r.slot == "mine"
    assert picks.weighted_outfits(requests.limit(0), rows, ORDER).count() == 0


NAMES = ["Remera Azul", "remera azul", "Remera Roja", "Zapatilla", None, "", "a", "ñandú 😀 azul", "azulazul", "x" * 50_000 + "needle", "100% algodón _ %"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(NAMES)], "k int, name string")
    return rows, SubstringIndex(spark, str(tmp_path_factory.mktemp("grams"))).create(rows)


def test_search_equals_contains(spark, index):
    rows, made = index
    needles = ["azul", "AZUL", "a", "ul", "remera r", "ú 😀", "xneedle", "%", "_ %", "nothing", "zzz", "", None, "ulaz", "remera azul y mas"]
    got = made.rows(rows, spark.createDataFrame([(x,) for x in needles], "needle string"))
    want = sorted((x, k) for x in {x.lower() for x in needles if x} for k, n in enumerate(NAMES) if n is not None and x in n.lower())
    assert sorted((r["__needle"], r.k) for r in got.collect()) == want


def test_few_names_are_candidates(spark, tmp_path):
    rng = random.Random(3)
    names = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3)) for _ in range(3000)]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    made = SubstringIndex(spark, str(tmp_path / "grams")).create(rows)
    needles = spark.createDataFrame([(names[7][2:9],), (names[8][5:13],)], "needle string")
    assert 2 <= made.candidates(needles).count() < 30
    plan = made.postings().where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_index_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "k int, name string")
    made = SubstringIndex(spark, str(tmp_path / "grams")).create(rows)
    assert made.rows(rows, spark.createDataFrame([("a",)], "needle string")).count() == 0
