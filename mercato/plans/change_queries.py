"""Queries over writes, grouping, similarity and budgets."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import measures
from mercato.functions.text import ACCENTED, PLAIN, STOP_WORDS, identity
from mercato.operators import history as hist
from mercato.operators import optimize, similarity, stats, upsert
from mercato.operators.graph import cut
from mercato.plans.adapter import CATALOG_SQL, HISTORY_SQL, catalog, history
from mercato.plans.price_queries import _DISCOUNTS, _SCORED, _TRENDS, _priced, _rounded

QUERIES: dict = {}
ORACLES: dict = {}
DAY = datetime.date(1998, 12, 31)


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_COLUMNS = ["url", "site", "name", "price", "category", "brand", "fit", "active", "locked_by"]


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current snapshot: a part of the catalog, some of it locked."""
    rows = catalog(spark, sf_dir).where("seq % 4 <> 3")
    return rows.withColumn("locked_by", F.when(F.col("seq") % 10 == 1, F.lit("human"))).select(*_COLUMNS)


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with new, unchanged, changed and repeated URLs."""
    rows = catalog(spark, sf_dir).where("seq % 3 = 0").select("seq", "url", "site", "name", "price", F.concat(F.lit("new "), F.coalesce("category", F.lit("-"))).alias("category"), F.lit("Acme").alias("brand"), F.when(F.col("seq") % 2 == 0, "").otherwise("wide").alias("fit"))
    price = F.when(F.col("seq") % 5 == 0, F.col("price") + 10).otherwise(F.col("price"))
    again = rows.where("seq % 15 = 0").withColumn("price", F.col("price") + 20).withColumn("ord", F.col("seq") + 10_000_000)
    return rows.withColumn("price", price).withColumn("ord", F.col("seq")).unionByName(again)


_STATE_SQL = f"state AS (SELECT *, CASE WHEN seq % 10 = 1 THEN 'human' END AS locked_by FROM catalog WHERE seq % 4 <> 3)"
_BATCH_SQL = """base AS (SELECT seq, url, site, name, price, 'new ' || coalesce(category, '-') AS category, 'Acme' AS brand, CASE WHEN seq % 2 = 0 THEN '' ELSE 'wide' END AS fit FROM catalog WHERE seq % 3 = 0),
    batch AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN price + 10 ELSE price END AS price), seq AS ord FROM base UNION ALL SELECT * REPLACE (price + 20 AS price), seq + 10000000 FROM base WHERE seq % 15 = 0)"""


@register(
    "upsert_snapshot",
    f"""WITH {CATALOG_SQL}, {_STATE_SQL}, {_BATCH_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord DESC) AS k FROM batch) WHERE k = 1)
    SELECT coalesce(s.url, l.url) AS url, CASE WHEN l.url IS NULL THEN s.site ELSE l.site END AS site, CASE WHEN l.url IS NULL THEN s.name ELSE l.name END AS name, coalesce(l.price, s.price) AS price,
      CASE WHEN l.url IS NOT NULL AND s.locked_by IS NULL THEN l.category ELSE s.category END AS category, CASE WHEN l.url IS NOT NULL AND s.locked_by IS NULL THEN l.brand ELSE s.brand END AS brand,
      CASE WHEN l.url IS NULL THEN s.fit ELSE coalesce(nullif(l.fit, ''), s.fit, '') END AS fit, l.url IS NOT NULL OR coalesce(s.active, false) AS active, s.locked_by FROM state s FULL JOIN l ON s.url = l.url""",
)
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert(_state(spark, sf_dir), _batch(spark, sf_dir).drop("seq"))


_CHANGES_SQL = f"{CATALOG_SQL}, {_STATE_SQL}, {_BATCH_SQL}, ch AS (SELECT b.url, b.ord, b.price, coalesce(lag(b.price) OVER (PARTITION BY b.url ORDER BY b.ord), s.price) AS prev FROM batch b LEFT JOIN state s USING (url)), kinds AS (SELECT *, CASE WHEN prev IS NULL THEN 'new' WHEN abs(prev - price) > 0.01 THEN 'updated' ELSE 'same' END AS change FROM ch)"


@register("upsert_stats", f"WITH {_CHANGES_SQL} SELECT count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'same') AS same FROM kinds")
def upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert_stats(_state(spark, sf_dir), _batch(spark, sf_dir))


@register(
    "history_after",
    f"WITH {_CHANGES_SQL}, {HISTORY_SQL}, f AS (SELECT url, arg_min(price, ord) AS price FROM kinds WHERE change <> 'same' GROUP BY url) SELECT url, CAST(day AS VARCHAR) AS day, floor(price * 10000 + 0.500001) / 10000 AS price FROM (SELECT url, day, price FROM history UNION ALL SELECT url, DATE '1998-12-31', price FROM f WHERE url NOT IN (SELECT url FROM history WHERE day = DATE '1998-12-31'))",
)
def history_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(upsert.history_after(history(spark, sf_dir), _state(spark, sf_dir), _batch(spark, sf_dir), F.lit(DAY)))


@register(
    "soft_delete",
    f"WITH {CATALOG_SQL}, {_STATE_SQL}, b AS (SELECT url, site FROM catalog WHERE seq % 3 = 0 AND site < 'Site 2') SELECT url, active AND NOT (site IN (SELECT site FROM b) AND url NOT IN (SELECT url FROM b)) AS active FROM state",
)
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.soft_delete(_state(spark, sf_dir), _batch(spark, sf_dir).where("site < 'Site 2'")).select("url", "active")


@register("reclassify_audit", f"WITH {CATALOG_SQL}, {_STATE_SQL} SELECT url, category AS before, 'Otros' AS after, 'machine' AS who FROM state WHERE CAST(substr(url, 2) AS BIGINT) % 2 = 0 AND locked_by IS NULL AND category IS DISTINCT FROM 'Otros'")
def reclassify_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = catalog(spark, sf_dir).where("seq % 2 = 0").select("url", F.lit("Otros").alias("new_category"))
    return upsert.reclassify(_state(spark, sf_dir), proposals, who="machine")[1]


@register("keyed_upsert", f"WITH {CATALOG_SQL}, {_STATE_SQL} SELECT url, price FROM state WHERE url NOT IN (SELECT url FROM catalog WHERE seq % 6 = 0) UNION ALL SELECT url, 1e0 FROM catalog WHERE seq % 6 = 0")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = catalog(spark, sf_dir).where("seq % 6 = 0").select("url", F.lit(1.0).alias("price"))
    return upsert.keyed_upsert(_state(spark, sf_dir).select("url", "price"), new, ["url"])


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_WORDS_SQL = "list_filter(list_transform(regexp_split_to_array(lower(%s), '[\\s\\-_/.,()]+'), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]{1,2}') AND NOT list_contains(" + _STOP_SQL + ", t))"


def _identity_sql(category: str, brand: str, name: str) -> str:
    words = _WORDS_SQL % f"trim(trim(coalesce({brand}, '')) || ' ' || trim({name}))"
    return f"regexp_replace(lower(trim(coalesce({category}, ''))), '[^a-z]', '', 'g') || '_' || array_to_string(({words})[1:5], '_')"


@register("identities", f"WITH {CATALOG_SQL} SELECT url, {_identity_sql('category', 'brand', 'name')} AS identity FROM catalog")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("url", identity(F.col("category"), F.col("brand"), F.col("name")).alias("identity"))


@register(
    "similar_pairs",
    f"""WITH {CATALOG_SQL}, r AS (SELECT url, site, {_identity_sql("category", "brand", "name")} AS key, list_distinct({_WORDS_SQL % "coalesce(brand, '') || ' ' || name"}) AS words FROM catalog),
    p AS (SELECT a.url AS left_url, b.url AS right_url, CASE WHEN len(a.words) + len(b.words) = 0 THEN 1e0 ELSE len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) END AS s FROM r a JOIN r b ON a.key = b.key AND a.url < b.url AND a.site <> b.site)
    SELECT left_url, right_url, floor(s * 10000 + 0.500001) / 10000 AS similarity FROM p WHERE s >= 0.55""",
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.similar_pairs(catalog(spark, sf_dir)).withColumnsRenamed({"left": "left_url", "right": "right_url"}))


_LIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1e0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END >= 0.55"


@register(
    "product_groups",
    f"""WITH RECURSIVE {CATALOG_SQL}, r AS (SELECT seq, url, site, price, name, {_identity_sql("category", "brand", "name")} AS key, list_distinct({_WORDS_SQL % "coalesce(brand, '') || ' ' || name"}) AS words FROM catalog),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM r), walk AS (
        SELECT key, k, [{{'url': url, 'site': site, 'words': words, 'k': k}}] AS seeds FROM n WHERE k = 1 UNION ALL
        SELECT n.key, n.k, CASE WHEN len(list_filter(w.seeds, lambda s: s.site <> n.site AND {_LIKE.format("s.words", "n.words")})) > 0 THEN w.seeds ELSE list_append(w.seeds, {{'url': n.url, 'site': n.site, 'words': n.words, 'k': n.k}}) END
        FROM walk w JOIN n ON n.key = w.key AND n.k = w.k + 1),
    ends AS (SELECT key, arg_max(seeds, k) AS seeds FROM walk GROUP BY key),
    g AS (SELECT n.*, coalesce(list_filter(seeds, lambda s: s.k < n.k AND s.site <> n.site AND {_LIKE.format("s.words", "n.words")})[1].url, n.url) AS group_url FROM n JOIN ends USING (key))
    SELECT group_url, count(*) AS n, count(DISTINCT site) AS sites, min(price) AS low, max(price) AS high, arg_min(name, (length(name), price, url)) AS name, CASE WHEN max(price) > 0 THEN (max(price) - min(price)) / max(price) * 100 ELSE 0e0 END AS saving_pct
    FROM g GROUP BY group_url HAVING count(DISTINCT site) >= 2""",
)
def product_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    return similarity.group_prices(rows, similarity.product_groups(rows), several_sites=True)


#: Cosine above which two names of the test tables are linked.
_LINK = 0.8
_TERMS_SQL = f"list_filter(regexp_extract_all(lower(text), '{similarity.TERM}'), lambda t: length(t) > 2 AND NOT list_contains([{', '.join(repr(w) for w in similarity.TERM_STOP)}], t))"


@register(
    "tf_idf",
    f"""WITH d AS (SELECT item_id, {_TERMS_SQL} AS ts FROM benchmark), x AS (SELECT item_id, unnest(ts) AS term FROM d), tf AS (SELECT item_id, term, count(*) AS f FROM x GROUP BY ALL),
    t AS (SELECT *, sum(f) OVER (PARTITION BY item_id) AS total, count(*) OVER (PARTITION BY term) AS df FROM tf)
    SELECT item_id, term, floor(f / total * (ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1) * 10000 + 0.500001) / 10000 AS weight FROM t""",
)
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.tf_idf(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text"))


@register("name_clusters")
def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.clusters(catalog(spark, sf_dir))


def _clusters_sql(text: str, least: float) -> str:
    """``seq, cluster`` of parts: the smallest label spreads over the cosine graph of different bags of terms."""
    return f"""WITH RECURSIVE raw AS (SELECT p_partkey AS seq, {_TERMS_SQL.replace("lower(text)", f"lower({text})")} AS ts FROM part), bag AS (SELECT seq, list_sort(ts) AS b FROM raw WHERE len(ts) > 0),
    head AS (SELECT min(seq) AS seq, b FROM bag GROUP BY b), x AS (SELECT seq, unnest(ts) AS term FROM raw), tf AS (SELECT seq, term, count(*) AS f FROM x GROUP BY ALL),
    t AS (SELECT *, sum(f) OVER (PARTITION BY seq) AS total, count(*) OVER (PARTITION BY term) AS df FROM tf), w AS (SELECT seq, term, f / total * (ln(((SELECT count(*) FROM part) + 1) / (df + 1)) + 1) AS w FROM t JOIN head USING (seq)),
    u AS (SELECT seq, term, w / sqrt(sum(w * w) OVER (PARTITION BY seq)) AS w FROM w), e AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b FROM u a JOIN u b USING (term) WHERE a.seq <> b.seq GROUP BY ALL HAVING sum(a.w * b.w) > {least}),
    low(a, c) USING KEY (a) AS (SELECT seq, seq FROM head UNION SELECT e.b, min(n.c) FROM low n JOIN e ON e.a = n.a JOIN recurring.low o ON o.a = e.b WHERE n.c < o.c GROUP BY e.b)
    SELECT raw.seq, coalesce(low.c, raw.seq) AS cluster FROM raw LEFT JOIN bag USING (seq) LEFT JOIN head ON bag.b = head.b LEFT JOIN low ON low.a = head.seq"""


def _clusters(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("text"))
    return similarity.linked_clusters(rows, "seq", "text", least)


@register("linked_clusters", _clusters_sql("p_type || ' ' || p_brand || ' ' || p_name", similarity.COSINE))
def linked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, similarity.COSINE)


@register("linked_clusters_near", _clusters_sql("p_type || ' ' || p_brand || ' ' || p_name", _LINK))
def linked_clusters_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, _LINK)


@register(
    "badges",
    f"""WITH {CATALOG_SQL}, {_SCORED}, {_DISCOUNTS}, {_TRENDS}, linked AS (SELECT * FROM ({_clusters_sql("p_name", _LINK)})), sizes AS (SELECT cluster, count(*) AS size FROM linked GROUP BY cluster),
    l AS (SELECT list(size ORDER BY size DESC) AS ordered, quantile_cont(size, 0.5) AS median, count(*) AS n FROM sizes), demand AS (SELECT 'p' || seq AS url, size >= (SELECT greatest(8, least(ordered[greatest(1, CAST(floor(n * 0.1) AS BIGINT))], 3 * median)) FROM l) AS high FROM linked JOIN sizes USING (cluster)),
    j AS (SELECT s.url, composite, mz, cheap_outlier, dear_outlier, ratio, discount_pct, significant, demand.high AS high, coalesce(at_low, false) AS at_low, coalesce(t.trend, 'estable') AS tr FROM scored s JOIN disc USING (url) JOIN demand USING (url) LEFT JOIN trends t USING (url))
    SELECT url, array_to_string(list_filter([CASE WHEN at_low AND composite <= 35 THEN 'all_time_low' END, CASE WHEN cheap_outlier OR (composite <= 20 AND mz <= -1.5) THEN 'below_market' END,
      CASE WHEN ratio >= 1.2 AND ratio <= 3.5 AND discount_pct >= 20 AND composite <= 40 AND significant THEN 'verified_deal' END, CASE WHEN high AND composite <= 65 THEN 'trending' END,
      CASE WHEN tr = 'bajando' AND composite <= 40 THEN 'price_dropping' END, CASE WHEN dear_outlier OR (composite >= 80 AND mz >= 1.5) THEN 'above_market' END, CASE WHEN ratio > 1 AND discount_pct < 12 THEN 'fake_discount' END], lambda x: x IS NOT NULL), ',') AS badges FROM j""",
)
def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand is high for names whose cluster of like names is large."""
    scored = stats.discounts(stats.score(_priced(spark, sf_dir), ["grp"], "v")).drop("trend", "badges")
    rows = scored.join(hist.trends(history(spark, sf_dir)).select("url", "trend", "at_low"), "url", "left")
    linked = cut(similarity.linked_clusters(catalog(spark, sf_dir).select("seq", "name"), "seq", "name", _LINK))
    sizes = linked.groupBy("cluster").agg(F.count("*").alias("size"))
    threshold = similarity.demand_threshold(sizes)  # one row
    demand = linked.join(sizes, "cluster").crossJoin(threshold).select("seq", (F.col("size") >= F.col("threshold")).alias("high"))
    found = stats.badges(F.coalesce("at_low", F.lit(False)), F.col("high"), F.coalesce("trend", F.lit("estable")), stats.real_deal(F.lit(True)))
    return rows.join(demand, "seq").select("url", F.array_join(found, ",").alias("badges"))


@register(
    "nearest_prototype",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS a FROM e), m AS (SELECT label, i, avg(a) AS a FROM x GROUP BY label, i),
    p AS (SELECT label, list(a ORDER BY i) AS v FROM m GROUP BY label), s AS (SELECT vec_id, p.label, list_cosine_similarity(e.v, p.v) AS c FROM e CROSS JOIN p), r AS (SELECT *, row_number() OVER w AS k, c - lead(c) OVER w AS margin FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY c DESC, label))
    SELECT vec_id, CASE WHEN c >= 0.2 AND margin >= 0.01 THEN label ELSE -1 END AS label, floor(c * 10000 + 0.500001) / 10000 AS cosine, floor(margin * 10000 + 0.500001) / 10000 AS margin FROM r WHERE k = 1""",
)
def nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    prototypes = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return _rounded(similarity.against_prototypes(vectors, prototypes, 0.2, 0.01).withColumn("label", F.coalesce("label", F.lit(-1))))


_PACKAGE_UNITS = [" g", " kg", " ml", " capsulas", " mg", " lb"]
_FACTORS = {family: ", ".join(f"'{u}': {x}e0" for u, x in units.items()) for family, units in (("count", measures.COUNT), ("mass", measures.MASS), ("volume", measures.VOLUME))}
_AMOUNT = "max(n * coalesce(element_at(MAP {{{0}}}, u)[1], 0e0))"


@register(
    "package_sizes",
    f"""WITH t AS (SELECT doc_id, translate(lower(coalesce(text, '') || ' ' || (n_chars % 900 + 1) || [{", ".join(repr(u) for u in _PACKAGE_UNITS)}][CAST(n_chars % 6 AS INT) + 1] || CASE WHEN n_chars % 4 = 0 THEN ' x 60 caps' ELSE '' END), '{ACCENTED}', '{PLAIN}') AS t FROM documents),
    m AS (SELECT doc_id, unnest(regexp_extract_all(t, '{measures.MEASURE}', 1)) AS raw, unnest(regexp_extract_all(t, '{measures.MEASURE}', 2)) AS u FROM t),
    p AS (SELECT doc_id, u, replace(raw, ',', '.') AS raw FROM m), q AS (SELECT doc_id, u, TRY_CAST(CASE WHEN regexp_full_match(raw, '\\d+\\.\\d{{3}}') AND NOT starts_with(raw, '0.') THEN replace(raw, '.', '') ELSE raw END AS DOUBLE) AS n FROM p),
    s AS (SELECT doc_id, {", ".join(f"{_AMOUNT.format(x)} AS {family}_" for family, x in _FACTORS.items())} FROM q GROUP BY doc_id)
    SELECT doc_id, CASE WHEN count_ > 0 THEN 'count' WHEN mass_ > 0 THEN 'mass' WHEN volume_ > 0 THEN 'volume' ELSE 'unknown' END AS family, CASE WHEN count_ > 0 THEN count_ WHEN mass_ > 0 THEN mass_ WHEN volume_ > 0 THEN volume_ ELSE 0e0 END AS amount FROM documents LEFT JOIN s USING (doc_id)""",
)
def package_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes named in whole texts, to each of which one more is added that follows from its length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    unit = F.element_at(F.array(*map(F.lit, _PACKAGE_UNITS)), (F.col("n_chars") % 6 + 1).cast("int"))
    more = F.concat(F.lit(" "), (F.col("n_chars") % 900 + 1).cast("string"), unit, F.when(F.col("n_chars") % 4 == 0, " x 60 caps").otherwise(""))
    return docs.select("doc_id", measures.package(F.concat(F.coalesce("text", F.lit("")), more)).alias("p")).select("doc_id", "p.family", "p.amount")


_SLOTS = "CASE seq % 3 WHEN 0 THEN 'torso' WHEN 1 THEN 'legs' ELSE 'feet' END"
_ELIGIBLE_SQL = f"el AS (SELECT *, {_SLOTS} AS slot, 100 - score + CASE WHEN deal THEN 25 ELSE 0 END + CASE WHEN list_contains(badges, 'verified_deal') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'all_time_low') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'below_market') THEN 10 ELSE 0 END + CASE WHEN coalesce(nullif(trim(trend), ''), 'estable') <> 'estable' THEN 8 ELSE 0 END AS opp FROM catalog WHERE lower(trim(coalesce(gender, ''))) IN ('', 'unisex', 'hombre'))"


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).withColumn("category", F.expr(_SLOTS))
    slots = spark.createDataFrame([("torso", "torso", False), ("legs", "legs", False), ("feet", "feet", False)], "category string, slot string, gated boolean")
    return optimize.eligible(rows, slots, "hombre")


@register("least_budget", f"WITH {CATALOG_SQL}, {_ELIGIBLE_SQL} SELECT sum(low) AS least FROM (SELECT slot, min(price) AS low FROM el GROUP BY slot)")
def least_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = spark.createDataFrame([("torso",), ("legs",), ("feet",)], "slot string")
    return optimize.least_budget(_eligible(spark, sf_dir), slots)


@register(
    "best_pairs",
    f"WITH {CATALOG_SQL}, {_ELIGIBLE_SQL}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY opp DESC, price, url) AS k FROM el) WHERE k <= 20) SELECT a.url AS a_url, b.url AS b_url, a.price + b.price AS total, a.opp + b.opp AS score FROM p a JOIN p b ON a.slot = 'torso' AND b.slot = 'legs' AND a.price + b.price <= 2400 ORDER BY score DESC, total, a_url, b_url LIMIT 1",
)
def best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.best_pairs(_eligible(spark, sf_dir), "torso", "legs", 2400.0)


def _penalty(a: str, b: str) -> str:
    apart = f"abs({a}.hue - {b}.hue)"
    return f"(CASE WHEN {a}.print = 'estampado' AND {b}.print = 'estampado' THEN 0.5e0 ELSE 1e0 END * CASE WHEN least({apart}, {len(optimize.WHEEL)} - {apart}) > {optimize.HARMONY} THEN 0.7e0 ELSE 1e0 END)"


@register(
    "best_set",
    f"""WITH {CATALOG_SQL}, {_ELIGIBLE_SQL}, k AS (SELECT *, list_position({optimize.WHEEL}, color) AS hue, row_number() OVER (PARTITION BY slot ORDER BY opp DESC, price, url) AS k FROM el), q AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY k) AS i FROM k WHERE k <= {optimize.SHORTLIST} AND price <= 4000),
    p AS (SELECT slot, i, url, price, CAST(opp AS DOUBLE) AS opp, print, hue FROM q WHERE i <= {optimize.POOL} UNION ALL SELECT s, 0, NULL, 0, 0, NULL, NULL FROM (VALUES ('torso'), ('legs'), ('feet')) v(s)),
    sets AS (SELECT a.url AS u1, b.url AS u2, c.url AS u3, a.price AS p1, b.price AS p2, c.price AS p3, a.opp + (b.opp - greatest(b.opp, 0) * (1 - {_penalty("b", "a")})) + (c.opp - greatest(c.opp, 0) * (1 - {_penalty("c", "a")} * {_penalty("c", "b")})) AS total, a.i AS i, b.i AS j, c.i AS l
        FROM p a, p b, p c WHERE a.slot = 'torso' AND b.slot = 'legs' AND c.slot = 'feet' AND a.price + b.price + c.price <= 4000), best AS (SELECT * FROM sets ORDER BY total DESC, i, j, l LIMIT 1)
    SELECT * FROM (SELECT 'torso' AS slot, u1 AS url, p1 AS price FROM best UNION ALL SELECT 'legs', u2, p2 FROM best UNION ALL SELECT 'feet', u3, p3 FROM best) WHERE url IS NOT NULL""",
)
def best_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = optimize.build(optimize.pools(_eligible(spark, sf_dir)), 4000.0, ["torso", "legs", "feet"])
    return spark.createDataFrame([(c.slot, c.url, c.price) for c in found["picks"]], "slot string, url string, price double")
