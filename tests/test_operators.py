"""State transitions, thresholds and order-dependent operators against plain Python."""

import datetime
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mercato.functions.text import identity, significant_words
from mercato.operators import history, optimize, ranking, search, similarity, stats, upsert
from mercato.operators.search import CatalogFilter

D = datetime.date


def awkward(spark):
    rows = [
        ("u1", "Remera básica", 10.0, "Zapatilla", "Hombre", None, 1, True, ["S"], ["all_time_low"]),
        ("u2", "REMERA oversize", 20.0, "Zapatilla Running", "mujer", "", 1, True, ["m"], []),
        ("u3", "Short 50% off", 30.0, "Short", "", "premium", 3, True, None, None),
        ("u4", "Short 50 off", 30.0, "Zapatillas", None, "standard", 1, True, [], ["trending"]),
        ("u5", "oculta", 5.0, "Short", "mujer", "standard", 1, False, ["S"], []),
    ]
    return spark.createDataFrame(rows, "url string, name string, price double, category string, gender string, segment string, units int, active boolean, sizes array<string>, badges array<string>")


@pytest.mark.parametrize(
    ("f", "urls"),
    [
        (CatalogFilter(), ["u1", "u2", "u3", "u4"]),
        (CatalogFilter(text="50%"), ["u3"]),
        (CatalogFilter(text="_"), []),
        (CatalogFilter(categories=("zapatilla",)), ["u1", "u2"]),
        (CatalogFilter(categories=("Zapatilla Running Pro",)), ["u1", "u2"]),
        (CatalogFilter(segment="standard"), ["u1", "u2", "u4"]),
        (CatalogFilter(price_max=10.0), ["u1", "u3"]),
        (CatalogFilter(sizes=("M", "s")), ["u1", "u2"]),
        (CatalogFilter(badges=("trending",), gender=" "), ["u4"]),
        (CatalogFilter(packs=True), ["u3"]),
        (CatalogFilter(gender="HOMBRE"), ["u1"]),
    ],
)
def test_filters(spark, f, urls):
    assert sorted(r.url for r in search.matching(awkward(spark), f).collect()) == urls


def test_stats_follow_the_definition(spark):
    rng = random.Random(3)
    values = [(g, float(rng.randint(1, 50_000))) for g in ("a", "b") for _ in range(41)] + [("c", 7.0)]
    got = {r.g: r for r in stats.price_stats(spark.createDataFrame(values, "g string, v double"), ["g"], "v").collect()}
    for g in "abc":
        v = sorted(x for k, x in values if k == g)
        at = lambda p, v=v: v[int(p * (len(v) - 1))] + (p * (len(v) - 1) % 1) * (v[min(int(p * (len(v) - 1)) + 1, len(v) - 1)] - v[int(p * (len(v) - 1))])
        assert got[g].median == pytest.approx(at(0.5)) and got[g].q1 == pytest.approx(at(0.25)) and got[g].q3 == pytest.approx(at(0.75))
        mean = sum(v) / len(v)
        assert got[g].std == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)))
        dev = sorted(abs(x - at(0.5)) for x in v)
        assert got[g].mad == pytest.approx(dev[len(dev) // 2])
        width = max(5000, int((at(0.75) - at(0.25)) / 5))
        bins = {}
        for x in v:
            bins.setdefault(int(x // width), []).append(x)
        top = max(bins, key=lambda b: (len(bins[b]), -b))
        w = bins[top]
        assert got[g].mode == pytest.approx((w[(len(w) - 1) // 2] + w[len(w) // 2]) / 2)


@pytest.mark.parametrize(
    ("prices", "factor", "label"),
    [
        ([100, 120, 100], 1.0, "comprar_ahora"),
        ([100, 100], 1.0, "precio_normal"),
        ([100, 200, 112, 111, 112, 111], 1.3, "buen_momento"),
        ([50, 100, 200, 180, 140, 120], 3.0, "muy_buen_momento"),
        ([100, 100, 100, 120, 150], 1.0, "esperar"),
        ([100, 101, 102, 103], 1.0, "caro"),
    ],
)
def test_buy_signal(spark, prices, factor, label):
    rows = [("u", D(2024, 1, 1) + datetime.timedelta(k), float(p)) for k, p in enumerate(prices)]
    assert history.signal(spark.createDataFrame(rows, "url string, day date, price double"), factor).first().signal == label


def test_upsert_transitions(spark):
    state = spark.createDataFrame(
        [("a", "x", 10.0, "old", "slim", True, None), ("b", "x", 10.0, "old", "", False, "human"), ("c", "x", 10.0, "old", "", True, None), ("d", "y", 1.0, "old", "", True, None)],
        "url string, site string, price double, category string, fit string, active boolean, locked_by string",
    )
    batch = spark.createDataFrame(
        [(1, "a", "x", 10.005, "new", ""), (2, "b", "x", 12.0, "new", "wide"), (3, "e", "x", 5.0, "new", None), (4, "e", "x", 6.0, "newer", ""), (5, "", "x", 1.0, "no", ""), (6, None, "x", 1.0, "no", "")],
        "ord int, url string, site string, price double, category string, fit string",
    )
    got = {r.url: tuple(r)[2:] for r in upsert.upsert(state, batch).collect()}
    assert got == {"a": (10.005, "new", "slim", True, None), "b": (12.0, "old", "wide", True, "human"), "c": (10.0, "old", "", True, None), "d": (1.0, "old", "", True, None), "e": (6.0, "newer", "", True, None)}
    assert tuple(upsert.upsert_stats(state, batch).first()) == (1, 2, 1)
    past = spark.createDataFrame([("b", D(2024, 1, 1), 9.0)], "url string, day date, price double")
    points = {(r.url, r.price) for r in upsert.history_after(past, state, batch, F.lit(D(2024, 1, 1))).collect()}
    assert points == {("b", 9.0), ("e", 5.0)}
    assert {r.url for r in upsert.soft_delete(state, batch).where("not active").collect()} == {"b", "c"} - set() - {"b"} | {"b"}
    empty = batch.where("false")
    assert upsert.soft_delete(state, empty).where("active").count() == 3


def test_human_decisions_lock(spark):
    state = spark.createDataFrame([("a", "x", None), ("b", "x", "human")], "url string, category string, locked_by string")
    new = spark.createDataFrame([("a", "y"), ("b", "y")], "url string, new_category string")
    machine, audit = upsert.reclassify(state, new)
    assert {(r.url, r.category) for r in machine.collect()} == {("a", "y"), ("b", "x")} and audit.count() == 1
    human, audit = upsert.reclassify(state, new, human=True)
    assert {(r.url, r.category, r.locked_by) for r in human.collect()} == {("a", "y", "human"), ("b", "y", "human")} and audit.count() == 2


def naive_clusters(names, threshold=0.28):
    tf = []
    for n in names:
        f = {}
        for w in re.findall(similarity.TERM, n.lower()):
            if len(w) > 2 and w not in similarity.TERM_STOP:
                f[w] = f.get(w, 0) + 1
        tf.append(f)
    idf = lambda w: math.log((len(names) + 1) / (sum(w in f for f in tf) + 1)) + 1
    vecs = [{w: c / max(sum(f.values()), 1) * idf(w) for w, c in f.items()} for f in tf]
    cos = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / d if (d := math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))) else 0.0
    centres, sizes, out = [], [], []
    for v in vecs:
        best, most = -1, threshold
        for k, c in enumerate(centres):
            if (s := cos(v, c)) > most:
                best, most = k, s
        if best < 0:
            centres.append(dict(v))
            sizes.append(1)
            out.append(len(centres) - 1)
        else:
            sizes[best] += 1
            m = sizes[best]
            centres[best] = {w: (centres[best].get(w, 0) * (m - 1) + v.get(w, 0)) / m for w in {**centres[best], **v}}
            out.append(best)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_the_naive_algorithm(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(30)]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    assert similarity.greedy_clusters(names) == naive_clusters(names)


@pytest.mark.parametrize("seed", range(5))
def test_best_set_equals_brute_force(seed):
    rng = random.Random(seed)
    cs = [optimize.Candidate(s, f"{s}{k}", float(rng.randint(1, 60)), float(rng.randint(0, 100)), rng.choice(["slim", "oversize", ""]), rng.choice(["estampado", "liso"]), rng.choice([*optimize.WHEEL, "negro"])) for s in "abc" for k in range(4)]

    def value(picks):
        total, chosen = 0.0, []
        for c in picks:
            total += c.score - max(0.0, c.score) * (1 - optimize.coherence(c, chosen))
            chosen.append(c)
        return total

    options = [[None, *[c for c in cs if c.slot == s]] for s in "abc"]
    best = max(value([c for c in p if c]) for p in itertools.product(*options) if sum(c.price for c in p if c) <= 90)
    got = optimize.best_set(cs, 90.0)
    assert value(got) == pytest.approx(best) and sum(c.price for c in got) <= 90


def test_build_keeps_the_budget_and_pins():
    cs = [optimize.Candidate(s, f"{s}{k}", 10.0 + k, 50.0 - k) for s in "abc" for k in range(30)]
    pin = optimize.Candidate("b", "pin", 35.0, 0.0)
    for greedy, seed in itertools.product((False, True), (None, 1, 2)):
        got = optimize.build(cs, 60.0, ["a", "b", "c"], [pin, optimize.Candidate("b", "late", 1.0, 9.0)], seed, greedy)
        assert pin in got["picks"] and got["total"] <= 60 and len({c.slot for c in got["picks"]}) == len(got["picks"])
    assert sum(c.price for c in optimize.weighted_outfit(cs, 40.0, ["a", "b", "c"], 4)) <= 40


def test_gender_broadening(spark):
    rows = spark.createDataFrame([("a", "x", "mujer"), ("b", "x", "hombre"), ("c", "y", "hombre"), ("d", "y", "unisex"), ("e", "z", "hombre"), ("f", None, "")], "url string, category string, gender string")
    assert {r.url for r in ranking.broaden_gender(rows, "mujer").collect()} == {"a", "d", "e", "f"}


def test_classifier_beats_the_majority(spark):
    from mercato.operators import classify

    rng = random.Random(0)
    kinds = {"Remera": ["remera lisa", "remera rayada"], "Buzo": ["buzo canguro", "buzo frisa"], "Jean": ["jean mom", "jean recto"]}
    rows = [(f"u{k}", f"{rng.choice(n)} {rng.choice('abcdef') * 3}", c, True) for k in range(180) for c, n in [rng.choice(list(kinds.items()))]]
    df = spark.createDataFrame(rows, "url string, name string, category string, active boolean")
    train, test = classify.training_rows(df, ["Otros"]).randomSplit([0.7, 0.3], seed=1)
    got = classify.predict(classify.fit(train, 1 << 10), test, 0.0).select("guess", "category").collect()
    assert sum(r.guess == r.category for r in got) > 0.9 * len(got)


def supplements(spark):
    rows = [
        ("whey", "w1", "Whey 1kg", 100.0, "Otra", 50),
        ("whey", "w2", "Whey 2kg", 150.0, "Otra", 50),
        ("whey", "w3", "Whey 500 g", 90.0, "ENA", 50),
        ("whey", "w4", "Whey 1kg", 160.0, "ena", 50),
        ("creatina", "c1", "Creatina 300 g", 60.0, None, 10),
        ("creatina", "c2", "Creatina x 90 caps", 20.0, None, 10),
        ("creatina", "c3", "Creatina 200 g", 50.0, None, 10),
        ("barra", "b1", "Barra", 9.0, None, 70),
        ("barra", "b2", "Barra", 8.0, None, 20),
    ]
    df = spark.createDataFrame(rows, "kind string, url string, name string, price double, brand string, score int")
    return df.withColumns({"deal": F.lit(False), "trend": F.lit(""), "badges": F.array().cast("array<string>")})


def test_combo(spark):
    got = {r.kind: r.url for r in optimize.combo(supplements(spark), ["BSA", "ENA"]).collect()}
    assert got == {"whey": "w4", "creatina": "c1", "barra": "b2"}


def test_combo_within_a_budget(spark):
    kinds = ["whey", "creatina", "barra", "none"]
    assert optimize.combo_within(supplements(spark), ["ENA"], kinds, 150.0) == [("whey", "w3", 90.0), ("creatina", "c1", 60.0), ("barra", "b2", 8.0)]
    assert [u for _, u, _ in optimize.combo_within(supplements(spark), [], kinds, 1000.0, ["w2", "b1", "b2"])] == ["w1", "c1", "b2"]


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_the_naive_greedy_rule(spark, seed):
    rng = random.Random(seed)
    head = "alpha bravo carbon delta echo"
    rows = [(f"u{k}", k, f"s{rng.randint(0, 3)}", "Cat", "", " ".join([head, *rng.sample(["fox", "golf", "hotel", "india", "kilo"], rng.randint(0, 5))])) for k in range(120)]
    naive, free = {}, list(rows)
    while free:
        first, rest = free[0], []
        naive[first[0]] = first[0]
        for r in free[1:]:
            a, b = set(first[5].split()), set(r[5].split())
            if r[2] != first[2] and len(a & b) / len(a | b) >= similarity.JACCARD:
                naive[r[0]] = first[0]
            else:
                rest.append(r)
        free = rest
    df = spark.createDataFrame(rows, "url string, seq long, site string, category string, brand string, name string")
    assert {r.url: r.group_url for r in similarity.product_groups(df).collect()} == naive


def test_groups_of_one_identity_that_all_rows_share(spark):
    """Chains of likeness, repeated sets and many sites within one identity; the naive rule works on different sets and sites."""
    rng = random.Random(9)
    head, pool = "alpha bravo carbon delta echo", [f"word{k}" for k in range(40)]
    names = [" ".join([head, *rng.sample(pool, rng.randint(1, 6))]) for _ in range(150)]
    rows = [(f"u{k}", k, f"s{rng.randint(0, 60)}", "Cat", "", rng.choice(names)) for k in range(20_000)]
    seeds, want = [], {}
    for url, _, site, *_, name in rows:
        a = set(name.split())
        want[url] = next((u for u, s, b in seeds if s != site and len(a & b) / len(a | b) >= similarity.JACCARD), None) or url
        if want[url] == url:
            seeds.append((url, site, a))
    df = spark.createDataFrame(rows, "url string, seq long, site string, category string, brand string, name string").repartition(4)
    groups = similarity.product_groups(df)
    assert {r.url: r.group_url for r in groups.collect()} == want
    assert "Pandas" not in groups._jdf.queryExecution().toString()
    assert similarity.product_groups(df.limit(0)).count() == 0


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"u{k}", f"s{rng.randint(0, 3)}", "Cat", None, " ".join(rng.sample(["red", "blue", "shoe", "long", "tall", "and", "38"], rng.randint(0, 6)))) for k in range(120)]
    df = spark.createDataFrame(rows, "url string, site string, category string, brand string, name string")
    words = significant_words(F.concat_ws(" ", F.coalesce("brand", F.lit("")), "name"))
    told = df.select("url", "site", identity(F.col("category"), F.col("brand"), F.col("name")).alias("key"), words.alias("words")).collect()
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {(*sorted((x.url, y.url)), share(set(x.words), set(y.words))) for x, y in itertools.combinations(told, 2) if x.key == y.key and x.site != y.site}
    assert {tuple(r) for r in similarity.similar_pairs(df).collect()} == {x for x in want if x[2] >= similarity.JACCARD}


def test_cluster_blocks_follow_the_greedy_rule(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(20)]
    rows = [(f"u{k:03d}", k, " ".join(rng.choice(words) for _ in range(4)), rng.choice("xy")) for k in range(200)]
    got = {r.url: r.cluster for r in similarity.clusters(spark.createDataFrame(rows, "url string, seq long, name string, category string"), 50).collect()}
    for cat, block in itertools.product("xy", range(4)):
        part = [r for r in rows if r[3] == cat and r[1] // 50 == block]
        want = naive_clusters([r[2] for r in part])
        assert [got[r[0]] for r in part] == [f"{cat}/{block}/{k}" for k in want]


@pytest.mark.parametrize("sizes", [[1], [30, 20, 10, 9, 9, 8, 7, 5, 5, 4, 3, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1], [50] * 20, list(range(1, 101))])
def test_demand_threshold(spark, sizes):
    ranked = sorted(sizes, reverse=True)
    top = ranked[max(0, int(len(ranked) * 0.10) - 1)]
    middle = (ranked[(len(ranked) - 1) // 2] + ranked[len(ranked) // 2]) / 2
    got = similarity.demand_threshold(spark.createDataFrame([(s,) for s in sizes], "size int")).first().threshold
    assert got == max(8, min(top, middle * 3))
