"""Queries over prices: statistics, scores, discounts, badges, histories, financing."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import prices
from mercato.operators import history as hist
from mercato.operators import stats
from mercato.operators.percentiles import percentiles
from mercato.plans.adapter import CATALOG_SQL, HISTORY_SQL, catalog, history

QUERIES: dict = {}
ORACLES: dict = {}
#: The test tables hold small prices: the bin of the mode is narrowed to match.
BIN = 50
TODAY = datetime.date(1998, 12, 31)


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _stable(x, digits: int = 4):
    """Rounding that two engines agree on: halves, and what is a hair below them, go up."""
    return F.floor(x * 10**digits + 0.500001) / 10**digits


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    kinds = {"double": lambda c: _stable(F.col(c), digits).alias(c), "date": lambda c: F.col(c).cast("string").alias(c)}
    return df.select(*[kinds.get(t, F.col)(c) for c, t in df.dtypes])


def _stats_sql(source: str, key: str) -> str:
    return f"""s AS (SELECT {key}, v FROM ({source}) WHERE v > 0),
    b AS (SELECT {key}, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, stddev_pop(v) AS std, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM s GROUP BY {key}),
    d AS (SELECT {key}, quantile_cont(abs(v - median), 0.5) AS mad FROM s JOIN b USING ({key}) GROUP BY {key}),
    w AS (SELECT {key}, floor(v / CASE WHEN iqr > 0 THEN greatest({BIN}, floor(iqr / 5)) ELSE {BIN} END) AS bin, v FROM s JOIN b USING ({key})),
    m AS (SELECT {key}, quantile_cont(v, 0.5) AS mode, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, bin) AS k FROM w GROUP BY {key}, bin),
    stats AS (SELECT b.*, mad, mode, CASE WHEN mean > 0 THEN std / mean * 100 ELSE 0 END AS cv, q1 - 1.5 * iqr AS fence_low, q3 + 1.5 * iqr AS fence_high, q1 - 3.0 * iqr AS fence_low_far, q3 + 3.0 * iqr AS fence_high_far FROM b JOIN d USING ({key}) JOIN m USING ({key}) WHERE k = 1)"""


_CATEGORY = "SELECT coalesce(nullif(trim(category), ''), 'Otros') AS grp, price / CASE WHEN units > 1 THEN units ELSE 1 END AS v, url FROM catalog"
_STAT_COLUMNS = ["mean", "median", "q1", "q3", "std", "iqr", "mad", "mode", "cv", "fence_low", "fence_high", "fence_low_far", "fence_high_far"]


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    return rows.withColumns({"grp": F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Otros")), "v": prices.unit_price(F.col("price"), F.col("units"))})


@register("price_stats", f"WITH {CATALOG_SQL}, {_stats_sql(_CATEGORY, 'grp')} SELECT grp, n, {', '.join(f'floor(({c}) * 10000 + 0.500001) / 10000 AS {c}' for c in _STAT_COLUMNS)} FROM stats")
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.price_stats(_priced(spark, sf_dir), ["grp"], "v", BIN))


@register("price_stats_lines", f"WITH {_stats_sql('SELECT l_partkey AS grp, l_extendedprice / l_quantity AS v FROM lineitem', 'grp')} SELECT grp, n, {', '.join(f'floor(({c}) * 10000 + 0.500001) / 10000 AS {c}' for c in _STAT_COLUMNS)} FROM stats")
def price_stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("grp"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return _rounded(stats.price_stats(lines, ["grp"], "v", BIN))


#: Different prices that a task may hold: little, so that the small test tables take rounds too.
_HELD = 500


@register(
    "price_quartiles",
    "SELECT l_returnflag, l_linestatus, floor(quantile_cont(v, 0.25) * 10000 + 0.500001) / 10000 AS q1, floor(quantile_cont(v, 0.5) * 10000 + 0.500001) / 10000 AS median, floor(quantile_cont(v, 0.75) * 10000 + 0.500001) / 10000 AS q3, floor(quantile_cont(v, 0.99) * 10000 + 0.500001) / 10000 AS p99 FROM (SELECT l_returnflag, l_linestatus, l_extendedprice / l_quantity AS v FROM lineitem) GROUP BY ALL",
)
def price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups with nearly unique prices each."""
    keys = ["l_returnflag", "l_linestatus"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(*keys, (F.col("l_extendedprice") / F.col("l_quantity")).alias("v")).agg(F.count("*").alias("c"))
    return _rounded(percentiles(lines, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}, _HELD))


_SCORED = f"""{_stats_sql(_CATEGORY, 'grp')},
    x AS (SELECT c.url, c.grp, c.v, rank() OVER (PARTITION BY c.grp ORDER BY c.v) - 1 AS below, stats.* EXCLUDE (grp) FROM ({_CATEGORY}) c JOIN stats USING (grp) WHERE c.v > 0),
    y AS (SELECT *, CASE WHEN n < 2 THEN 50 ELSE CAST(floor(100 * below / n) AS INT) END AS percentile, CASE WHEN n < 3 OR std = 0 THEN 0 ELSE (v - mean) / std END AS z FROM x),
    u AS (SELECT *, CASE WHEN n < 3 OR mad = 0 THEN z ELSE 0.6745e0 * (v - median) / mad END AS mz FROM y),
    scored AS (SELECT *, CASE WHEN n < 3 THEN percentile ELSE CAST(round_even(0.40e0 * percentile + 0.35e0 * least(100, greatest(0, (mz + 3) / 6 * 100)) + 0.25e0 * CASE WHEN iqr > 0 THEN least(100, greatest(0, ((v - median) / iqr + 2) / 4 * 100)) ELSE 50 END, 0) AS INT) END AS composite,
      CASE WHEN n < 3 THEN 'standard' WHEN v < q1 THEN 'budget' WHEN v <= q3 THEN 'standard' WHEN v <= fence_high THEN 'premium' ELSE 'luxury' END AS band,
      n >= 3 AND iqr > 0 AND v < fence_low AS cheap_outlier, n >= 3 AND iqr > 0 AND v > fence_high AS dear_outlier, CASE WHEN cv < 40 THEN 'alta' WHEN cv < 80 THEN 'media' ELSE 'baja' END AS quality FROM u)"""


@register("price_scores", f"WITH {CATALOG_SQL}, {_SCORED} SELECT url, percentile, floor((z) * 10000 + 0.500001) / 10000 AS z, floor((mz) * 10000 + 0.500001) / 10000 AS mz, composite, band, cheap_outlier, dear_outlier, quality FROM scored")
def price_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.score(_priced(spark, sf_dir), ["grp"], "v")
    return _rounded(found.select("url", "percentile", "z", "mz", "composite", "band", "cheap_outlier", "dear_outlier", "quality"))


_PARENTS = [("ECONOMY BURNISHED TIN", "ECONOMY"), ("PROMO BRUSHED STEEL", "ECONOMY")]


@register(
    "group_keys",
    f"""WITH {CATALOG_SQL}, named AS (SELECT *, lower(trim(coalesce(nullif(trim(category), ''), 'General'))) AS cat FROM catalog),
    counts AS (SELECT cat, count(*) AS n_cat FROM named GROUP BY cat),
    parents(category, parent) AS (VALUES {', '.join(f"('{a.lower()}', '{b.lower()}')" for a, b in _PARENTS)}),
    plan AS (SELECT c.cat, c.n_cat, CASE WHEN c.n_cat >= 400 THEN c.cat WHEN pc.n_cat >= 400 THEN p.parent ELSE c.cat END AS chosen FROM counts c LEFT JOIN parents p ON p.category = c.cat LEFT JOIN counts pc ON pc.cat = p.parent)
    SELECT url, CASE WHEN coalesce(vertical, '') = 'tecnologia' THEN 'tech|' || cat WHEN trim(coalesce(gender, '')) <> '' AND n_cat >= 300 THEN chosen || '|' || trim(gender) ELSE chosen END AS group_key FROM named JOIN plan USING (cat)""",
)
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = spark.createDataFrame(_PARENTS, "category string, parent string")
    return stats.group_keys(catalog(spark, sf_dir), parents, 400, 300).select("url", "group_key")


_DISCOUNTS = """known AS (SELECT category, original_price / nullif(price, 0) AS ratio FROM catalog WHERE price > 0 AND original_price / nullif(price, 0) >= 1.2 AND original_price / nullif(price, 0) <= 5.0),
    bycat AS (SELECT category, count(*) AS n_cat, quantile_cont(ratio, 0.5) AS med_cat FROM known GROUP BY category), overall AS (SELECT count(*) AS n_all, quantile_cont(ratio, 0.5) AS med_all FROM known),
    r AS (SELECT catalog.*, CASE WHEN price > 0 AND coalesce(original_price, 0) > price THEN original_price / price ELSE 1 END AS ratio FROM catalog),
    disc AS (SELECT r.*, CASE WHEN ratio > 1 THEN (1 - price / original_price) * 100 ELSE 0 END AS discount_pct,
      ratio > 1 AND CASE WHEN coalesce(n_cat, 0) >= 5 AND med_cat > 1.05 THEN ratio >= greatest(med_cat, 1.25) ELSE coalesce(n_all >= 5 AND med_all > 1.05 AND ratio >= greatest(med_all, 1.25), false) END AS significant
      FROM r LEFT JOIN bycat ON r.category IS NOT DISTINCT FROM bycat.category CROSS JOIN overall)"""


@register("discounts", f"WITH {CATALOG_SQL}, {_DISCOUNTS} SELECT url, floor((ratio) * 10000 + 0.500001) / 10000 AS ratio, floor((discount_pct) * 10000 + 0.500001) / 10000 AS discount_pct, significant FROM disc")
def discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.discounts(catalog(spark, sf_dir)).select("url", "ratio", "discount_pct", "significant"))


_TRENDS = f"""{HISTORY_SQL}, hb AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS back FROM history),
    tp AS (SELECT url, count(*) AS n, min(price) AS low, max(price) AS high, arg_max(price, day) AS last, arg_min(price, day) AS first, greatest(date_diff('day', min(day), max(day)), 1) AS days, avg(price) FILTER (WHERE back <= 7) AS mean7 FROM hb GROUP BY url),
    trends AS (SELECT url, n, low, high, last, mean7, CASE WHEN n < 2 THEN 'estable' WHEN (last - mean7) / mean7 * 100 <= -5 THEN 'bajando' WHEN (last - mean7) / mean7 * 100 >= 5 THEN 'subiendo' ELSE 'estable' END AS trend,
      CASE WHEN n < 2 THEN 0 ELSE (last - first) / first / days * 100 END AS velocity, n >= 3 AND low > 0 AND last <= low * 1.05 AS at_low FROM tp)"""


@register("trends", f"WITH {_TRENDS} SELECT url, n, floor((low) * 10000 + 0.500001) / 10000 AS low, floor((high) * 10000 + 0.500001) / 10000 AS high, floor((last) * 10000 + 0.500001) / 10000 AS last, floor((mean7) * 10000 + 0.500001) / 10000 AS mean7, trend, floor((round_even(velocity, 4)) * 1000 + 0.500001) / 1000 AS velocity, at_low FROM trends")
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hist.trends(history(spark, sf_dir)).withColumn("velocity", _stable(F.col("velocity"), 3)))


@register("badge_counts", f"WITH {CATALOG_SQL}, b AS (SELECT unnest(badges) AS badge FROM catalog) SELECT badge, count(*) AS n FROM b WHERE badge <> '' GROUP BY badge")
def badge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select(F.explode("badges").alias("badge")).where("badge <> ''").groupBy("badge").agg(F.count("*").alias("n"))


@register(
    "buy_signal",
    f"""WITH {HISTORY_SQL}, hb AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS back, count(*) OVER (PARTITION BY url) AS n FROM history),
    p AS (SELECT url, n, max(price) FILTER (WHERE back = 1) AS last, max(price) FILTER (WHERE back = 4) AS fourth, min(price) AS low, max(price) AS high, max(price) FILTER (WHERE back = least(n, 13)) AS old FROM hb GROUP BY url, n),
    q AS (SELECT *, (last - old * 1.04e0) / (old * 1.04e0) * 100 AS real_change, CASE WHEN high > low THEN (last - low) / (high - low) * 100 ELSE 50 END AS range_pct, coalesce((last - fourth) / fourth * 100, 0) AS nominal FROM p),
    s AS (SELECT *, CASE WHEN range_pct <= 10 THEN 'comprar_ahora' WHEN real_change < -8 AND nominal < -5 THEN 'muy_buen_momento' WHEN real_change < -3 THEN 'buen_momento' WHEN real_change > 10 AND nominal > 5 THEN 'esperar' WHEN range_pct >= 80 THEN 'caro' ELSE 'precio_normal' END AS signal FROM q)
    SELECT url, n, floor((last) * 10000 + 0.500001) / 10000 AS last, floor((low) * 10000 + 0.500001) / 10000 AS low, floor((high) * 10000 + 0.500001) / 10000 AS high, floor((real_change) * 10000 + 0.500001) / 10000 AS real_change, floor((range_pct) * 10000 + 0.500001) / 10000 AS range_pct, signal, CASE signal WHEN 'comprar_ahora' THEN 95 WHEN 'muy_buen_momento' THEN 85 WHEN 'buen_momento' THEN 70 WHEN 'esperar' THEN 20 WHEN 'caro' THEN 15 ELSE 50 END AS signal_score FROM s""",
)
def buy_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hist.signal(history(spark, sf_dir), 1.04))


@register(
    "history_overview",
    f"WITH {HISTORY_SQL}, o AS (SELECT url, count(*) AS n, min(price) AS low, max(price) AS high, avg(price) AS mean, arg_min(price, day) AS first, arg_max(price, day) AS last FROM history GROUP BY url HAVING count(*) >= 2) SELECT url, n, floor((low) * 10000 + 0.500001) / 10000 AS low, floor((high) * 10000 + 0.500001) / 10000 AS high, floor((mean) * 10000 + 0.500001) / 10000 AS mean, floor((first) * 10000 + 0.500001) / 10000 AS first, floor((last) * 10000 + 0.500001) / 10000 AS last, floor((floor((last - first) / first * 100 * 10 + 0.5e0) / 10) * 10000 + 0.500001) / 10000 AS change_pct FROM o",
)
def history_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hist.overview(history(spark, sf_dir)))


@register(
    "append_today",
    f"""WITH {CATALOG_SQL}, {HISTORY_SQL}, l AS (SELECT url, max(day) AS last_day, arg_max(price, day) AS last_price FROM history GROUP BY url),
    u AS (SELECT url, day, price FROM history UNION ALL SELECT c.url, DATE '1998-12-31', c.price FROM catalog c LEFT JOIN l USING (url) WHERE last_day IS NULL OR last_day <> DATE '1998-12-31' OR abs(last_price - c.price) > 0.01)
    SELECT url, CAST(day AS VARCHAR) AS day, floor((price) * 10000 + 0.500001) / 10000 AS price FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC, price) AS k FROM u) WHERE k <= 60""",
)
def append_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hist.append_today(history(spark, sf_dir), catalog(spark, sf_dir), F.lit(TODAY)))


@register("purge_history", f"WITH {HISTORY_SQL} SELECT url, CAST(day AS VARCHAR) AS day, floor((price) * 10000 + 0.500001) / 10000 AS price FROM history WHERE day >= DATE '1998-12-31' - 90 OR CAST(substr(url, 2) AS BIGINT) % 10 = 0")
def purge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    favourites = catalog(spark, sf_dir).where("seq % 10 = 0").select("url")
    return _rounded(hist.purge(history(spark, sf_dir), favourites, F.lit(TODAY)))


@register("history_of_urls", f"WITH {HISTORY_SQL} SELECT url, CAST(day AS VARCHAR) AS day, floor((price) * 10000 + 0.500001) / 10000 AS price FROM history WHERE url IN ('p1', 'p5', 'p77')")
def history_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hist.of_urls(history(spark, sf_dir), spark.createDataFrame([("p1",), ("p5",), ("p77",)], "url string")))


@register("latest_points", f"WITH {HISTORY_SQL} SELECT url, CAST(day AS VARCHAR) AS day, floor((price) * 10000 + 0.500001) / 10000 AS price FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS k FROM history) WHERE k <= 5")
def latest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hist.latest(history(spark, sf_dir), "url", "day", 5))


_INDEX_SQL = "ix AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(F.sum("o_totalprice").alias("value"))


@register("inflation", f"WITH {_INDEX_SQL} SELECT CAST(day AS VARCHAR) AS day, floor((value) * 100 + 0.500001) / 100 AS value, floor(((value / lag(value, 1) OVER w - 1) * 100) * 10000 + 0.500001) / 10000 AS monthly, floor(((value / lag(value, 3) OVER w - 1) * 100) * 10000 + 0.500001) / 10000 AS quarterly, floor(((value / lag(value, 12) OVER w - 1) * 100) * 10000 + 0.500001) / 10000 AS yearly FROM ix WINDOW w AS (ORDER BY day)")
def inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hist.inflation(_index(spark, sf_dir)).withColumn("value", _stable(F.col("value"), 2)))


@register(
    "financing",
    f"""WITH {CATALOG_SQL}, f AS (SELECT url, price, list_sum([price * (1 + (seq % 40) / 100e0) / (seq % 7) / pow(1.03e0, k) FOR k IN range(1, seq % 7 + 1)]) AS pv, seq % 7 AS k FROM catalog),
    g AS (SELECT *, (price - pv) / price * 100 AS s FROM f)
    SELECT url, CASE WHEN k = 0 THEN 'sin_datos' WHEN s > 5 THEN 'conviene_cuotas' WHEN s < -5 THEN 'conviene_contado' ELSE 'indistinto' END AS signal, CASE WHEN k = 0 THEN 0 ELSE floor((s) * 10000 + 0.500001) / 10000 END AS saving_pct, CASE WHEN k = 0 THEN 0 ELSE floor((pv) * 10000 + 0.500001) / 10000 END AS present_value FROM g""",
)
def financing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    instalments = (F.col("seq") % 7).cast("int")
    found = prices.financing(F.col("price"), (F.col("seq") % 40).cast("double"), F.when(instalments > 0, instalments).otherwise(F.lit(0)), F.lit(0.03))
    return _rounded(rows.select("url", found.alias("f")).select("url", "f.signal", "f.saving_pct", "f.present_value"))
