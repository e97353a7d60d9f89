"""Grouping of equal products, TF-IDF, clusters, embeddings against prototypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.functions.text import identity, jaccard, significant_words
from mercato.operators import graph

JACCARD, COSINE = 0.55, 0.28
#: Most prototypes that vectors are compared with.
PROTOTYPES = 1000
#: Catalog places in a block of the order-dependent clustering.
BLOCK_ROWS = 20_000
# Words left out of the term weights.
TERM_STOP = "de la el los las un una para con en y a zapatillas remera campera pantalon short buzo calza pollera mochila gorra medias bota ojota".split()
TERM = "[a-zA-ZáéíóúñÁÉÍÓÚÑ]+"


def similar_pairs(catalog: DataFrame, least: float = JACCARD) -> DataFrame:
    """``left, right, similarity`` of rows with one identity from different sites, word sets at least ``least`` alike.

    Different word sets are paired once each, by the rare words that they share; their rows follow by a join.
    """
    words = F.array_sort(F.array_distinct(significant_words(F.concat_ws(" ", F.coalesce("brand", F.lit("")), "name"))))
    rows = catalog.select("url", "site", identity(F.col("category"), F.col("brand"), F.col("name")).alias("key"), words.alias("words"))
    rows = rows.withColumn("set_id", F.md5(F.concat_ws(" ", "words")))
    sets = rows.groupBy("key", "set_id").agg(F.first("words").alias("words"))
    alike = alike_sets(sets, least).unionByName(sets.select("key", F.col("set_id").alias("a"), F.col("set_id").alias("b")))
    of = lambda c: rows.select("key", F.col("set_id").alias(c), F.struct("url", "site", "words").alias(f"{c}_row"))
    pairs = alike.join(of("a"), ["key", "a"]).join(of("b"), ["key", "b"]).where((F.col("a_row.site") != F.col("b_row.site")) & ((F.col("a") != F.col("b")) | (F.col("a_row.url") < F.col("b_row.url"))))
    return pairs.select(F.least("a_row.url", "b_row.url").alias("left"), F.greatest("a_row.url", "b_row.url").alias("right"), jaccard(F.col("a_row.words"), F.col("b_row.words")).alias("similarity"))


def alike_sets(sets: DataFrame, least: float = JACCARD) -> DataFrame:
    """``key, a, b``: pairs a < b of different word sets ``(key, set_id, words)`` of one key that are at least ``least`` alike.

    Two such sets share one of the rarest words of either, as many as a set can lack and still be alike (the
    prefix filter), and their sizes differ by no more than ``least`` allows. So only sets that share a rare word meet.
    """
    each = sets.select("key", "set_id", F.size("words").alias("m"), F.explode("words").alias("word"))
    often = each.groupBy("key", "word").agg(F.count("*").alias("n"))
    ranked = each.join(often, ["key", "word"]).groupBy("key", "set_id", "m").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    rare = F.slice("ranked", 1, (F.col("m") - F.ceil(F.col("m") * least - 1e-9) + 1).cast("int"))
    seeds = ranked.select("key", "set_id", "m", F.explode(rare).alias("r")).select("key", F.col("r.word").alias("word"), "set_id", "m")
    x, y = seeds.alias("x"), seeds.alias("y")
    near = (F.col("x.m") >= F.col("y.m") * least - 1e-9) & (F.col("y.m") >= F.col("x.m") * least - 1e-9)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.word") == F.col("y.word")) & (F.col("x.set_id") < F.col("y.set_id")) & near)
    met = met.select(F.col("x.key").alias("key"), F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
    words = lambda c: sets.select("key", F.col("set_id").alias(c), F.col("words").alias(f"{c}_words"))
    return met.join(words("a"), ["key", "a"]).join(words("b"), ["key", "b"]).where(jaccard(F.col("a_words"), F.col("b_words")) >= least).select("key", "a", "b")


def _first_two(rows: DataFrame, by: list[str]) -> DataFrame:
    """``first, first_site, second, second_site``: the least ``o`` and the least of another site, of ``rows(site, o)``."""
    sites = rows.groupBy(*by, "site").agg(F.min("o").alias("o"))
    ranked = sites.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("o", "site"))).where("k <= 2")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return ranked.groupBy(*by).agg(at(1, "o").alias("first"), at(1, "site").alias("first_site"), at(2, "o").alias("second"), at(2, "site").alias("second_site"))


def _nearest(nodes: DataFrame, of: DataFrame, alike: DataFrame, to: str) -> DataFrame:
    """``nodes`` with the least ``o`` in ``of`` of an alike set and another site.

    Sets pass on their two least of different sites only, so the join has some rows for each pair of sets, however many sites there are.
    """
    own = _first_two(of, ["key", "set_id"])
    told = F.array_compact(F.array(F.struct(F.col("first_site").alias("site"), F.col("first").alias("o")), F.when(F.col("second").isNotNull(), F.struct(F.col("second_site").alias("site"), F.col("second").alias("o")))))
    met = alike.join(own.select("key", F.col("set_id").alias("a"), F.explode(told).alias("t")), ["key", "a"])
    around = _first_two(met.select("key", F.col("b").alias("set_id"), "t.*"), ["key", "set_id"])
    joined = nodes.join(around, ["key", "set_id"], "left")
    return joined.select(*nodes.columns, F.when(F.col("first_site") != F.col("site"), F.col("first")).otherwise(F.col("second")).alias(to))


def product_groups(catalog: DataFrame, least: float = JACCARD, most_rounds: int = 100) -> DataFrame:
    """``url, group_url``: rows of one identity by greedy likeness to a seed, in catalog order (seq, then url).

    The rule is sequential: the first free row is a seed and takes all later free rows of other sites that are
    ``least`` alike. Here it is followed in parallel rounds: a row is taken once an earlier row like
    it is a seed, and becomes a seed once no earlier row like it is open. Nothing but pairs of
    different word sets is ever joined, so an identity that very many rows share is dealt to many tasks.

    Only the first row of each word set and site takes part. Later rows of the same
    words and site share its fate exactly: where it joined a seed they join the same one; where it is
    a seed, nothing else can take them, so that each is a group of its own.
    """
    words = F.array_sort(F.array_distinct(significant_words(F.concat_ws(" ", F.coalesce("brand", F.lit("")), "name"))))
    rows = catalog.select("url", F.coalesce("site", F.lit("")).alias("site"), F.struct("seq", "url").alias("o"), identity(F.col("category"), F.col("brand"), F.col("name")).alias("key"), words.alias("words"))
    rows = rows.withColumn("set_id", F.md5(F.concat_ws(" ", "words")))
    same = ["key", "set_id", "site"]
    firsts = graph.cut(rows.groupBy(*same).agg(F.min("o").alias("o"), F.first("words").alias("words")))
    sets = firsts.groupBy("key", "set_id").agg(F.first("words").alias("words"))
    pairs = alike_sets(sets, least)
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    alike = pairs.select("key", both.alias("p")).select("key", "p.*").unionByName(sets.select("key", F.col("set_id").alias("a"), F.col("set_id").alias("b")))
    alike = graph.cut(alike)
    seeds, open_ = None, firsts.select(*same, "o")
    for _ in range(most_rounds):
        judged = _nearest(open_, open_, alike, "open")
        judged = _nearest(judged, seeds, alike, "seed") if seeds is not None else judged.withColumn("seed", F.lit(None).cast(open_.schema["o"].dataType))
        taken = F.coalesce(F.col("seed") < F.col("o"), F.lit(False))
        free = F.coalesce(F.col("open") > F.col("o"), F.lit(True))
        judged = graph.cut(judged.select(*same, "o", taken.alias("taken"), (~taken & free).alias("is_seed")))
        new = judged.where("is_seed").select(*same, "o")
        seeds = new if seeds is None else seeds.unionByName(new)
        open_ = judged.where("not taken and not is_seed").select(*same, "o")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"groups did not settle in {most_rounds} rounds")
    seeds = graph.cut(seeds)
    found = _nearest(firsts.select(*same, "o"), seeds, alike, "seed").join(seeds.select(*same, F.lit(True).alias("is_seed")), same, "left")
    fate = found.select(*same, F.col("o").alias("first"), F.when(F.col("is_seed"), F.col("o")).otherwise(F.col("seed")).alias("group"))
    alone = (F.col("o") != F.col("first")) & (F.col("group") == F.col("first"))
    return rows.join(fate, same).select("url", F.when(alone, F.col("url")).otherwise(F.col("group.url")).alias("group_url"))


def group_prices(catalog: DataFrame, groups: DataFrame, several_sites: bool = True) -> DataFrame:
    """Per group: sites, cheapest, dearest, saving in percent, shortest name."""
    rows = catalog.join(groups, "url")
    out = rows.groupBy("group_url").agg(
        F.count("*").alias("n"),
        F.countDistinct("site").alias("sites"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.min_by("name", F.struct(F.length("name"), "price", "url")).alias("name"),
    )
    out = out.withColumn("saving_pct", F.when(F.col("high") > 0, (F.col("high") - F.col("low")) / F.col("high") * 100).otherwise(0.0))
    return out.where("sites >= 2") if several_sites else out


def tf_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, weight``: share of the term in the text times ln((n + 1) / (df + 1)) + 1."""
    terms = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(TERM_STOP))
    rows = docs.select(key, F.explode(terms).alias("term"))
    tf = rows.groupBy(key, "term").agg(F.count("*").alias("f")).withColumn("total", F.sum("f").over(Window.partitionBy(key)))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    return tf.join(df, "term").crossJoin(n).select(key, "term", (F.col("f") / F.col("total") * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))


def _term_weights(names: list[str]) -> pd.DataFrame:
    """``row, term, weight``: tf_idf of names that are on one machine; terms are numbered."""
    words = pd.Series(names, dtype=object).fillna("").str.lower().str.findall(TERM).explode().dropna()
    words = words[(words.str.len() > 2) & ~words.isin(TERM_STOP)]
    counts = words.groupby([words.index, words]).size().rename_axis(["row", "word"]).reset_index(name="n")
    df, total = counts.groupby("word")["n"].transform("size"), counts.groupby("row")["n"].transform("sum")
    counts["weight"] = counts["n"] / total * (np.log((len(names) + 1) / (df + 1)) + 1)
    counts["term"] = counts["word"].astype("category").cat.codes
    return counts[["row", "term", "weight"]]


def greedy_clusters(names: list[str], threshold: float = COSINE) -> list[int]:
    """Clusters in list order: a name joins the cluster whose mean is most similar, above the threshold, or starts one.

    The cosine with a mean is that with the sum of its members. Sums are kept by term: a column holds
    the clusters that have the term and what they have of it, so a name's inner products with all
    clusters are a few vector additions. The length of a sum follows from the inner product.
    """
    table = _term_weights(names)
    columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    none = (np.zeros(0, np.int64), np.zeros(0))
    square, inner, filled = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0
    out = np.zeros(len(names), np.int64)
    by_row = {r: (g["term"].to_numpy(), g["weight"].to_numpy()) for r, g in table.groupby("row")}
    for row in range(len(names)):
        terms, weights = by_row.get(row, (np.zeros(0, np.int64), np.zeros(0)))
        inner[:filled] = 0.0
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            held, part = columns.get(t, none)
            inner[held] += w * part
        own = float(weights @ weights)
        cosine = inner[:filled] / np.sqrt(np.maximum(square[:filled] * own, 1e-300))
        best = int(cosine.argmax()) if filled else -1
        if best < 0 or cosine[best] <= threshold:
            best, filled = filled, filled + 1
        square[best] += 2 * inner[best] + own if best < filled - 1 or inner[best] else own
        inner[best] = 0.0
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            held, part = columns.get(t, none)
            k = int(np.searchsorted(held, best))
            if k < len(held) and held[k] == best:
                part[k] += w
            else:
                columns[t] = np.insert(held, k, best), np.insert(part, k, w)
        out[row] = best
    return out.tolist()


def clusters(catalog: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``url, cluster``: greedy clusters in catalog order within blocks of a category.

    The greedy rule is sequential, so a whole catalog would be one task. It is applied to blocks of
    at most ``block_rows`` consecutive catalog places (seq, unique) of one category, in parallel, and
    term weights are those of the block: the result is the greedy one of each block by definition,
    not that of the whole catalog. For clusters over all rows use ``linked_clusters``.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        name = f"{rows['cat'].iloc[0]}/{rows['block'].iloc[0]}"
        return pd.DataFrame({"url": rows["url"], "cluster": [f"{name}/{k}" for k in greedy_clusters(rows["name"].tolist())]})

    rows = catalog.select("url", "seq", "name", F.coalesce("category", F.lit("")).alias("cat"), F.floor(F.col("seq") / block_rows).alias("block"))
    return rows.groupBy("cat", "block").applyInPandas(run, "url string, cluster string")


def cosine_pairs(docs: DataFrame, key: str, text: str, threshold: float = COSINE, only: DataFrame | None = None) -> DataFrame:
    """``left, right, cosine``: all pairs of texts with a cosine above the threshold, or of the texts whose keys ``only`` lists.

    Exact prefix filter: a text's terms are ordered from rare to common, and the rarest ones go into
    its prefix until what is left is too short a vector to reach the threshold alone. The rarest term
    that a pair above the threshold shares stands in both prefixes.
    """
    weights = tf_idf(docs, key, text)
    df = weights.groupBy("term").agg(F.count("*").alias("df"))
    weights = weights if only is None else weights.join(only, key, "left_semi")
    normed = weights.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))).join(df, "term")
    onward = Window.partitionBy(key).orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    prefix = normed.withColumn("ahead", F.sum(F.col("weight") * F.col("weight")).over(onward)).where(F.col("ahead") > threshold * threshold - 1e-9)
    a, b = prefix.select("term", F.col(key).alias("left")), prefix.select("term", F.col(key).alias("right"))
    seeds = a.join(b, "term").where("left < right").select("left", "right").distinct()
    vectors = normed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))
    both = seeds.join(vectors.select(F.col(key).alias("left"), F.col("v").alias("lv")), "left").join(vectors.select(F.col(key).alias("right"), F.col("v").alias("rv")), "right")
    dot = F.aggregate(F.map_keys("lv"), F.lit(0.0), lambda s, t: s + F.element_at("lv", t) * F.coalesce(F.element_at("rv", t), F.lit(0.0)))
    return both.select("left", "right", dot.alias("cosine")).where(F.col("cosine") > threshold)


def demand_threshold(sizes: DataFrame) -> DataFrame:
    """One row: max(8, min(size at the top tenth, three times the median size)) over ``sizes(size)``, one row per cluster.

    Works on one row for each different size.
    """
    whole = sizes.agg(F.count("*").alias("n"), F.percentile("size", F.lit(0.5)).alias("median"))
    down = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.groupBy("size").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(down)).crossJoin(whole)
    top = F.max(F.when(F.col("upto") >= F.greatest(F.floor(F.col("n") * 0.10), F.lit(1)), F.col("size")))
    return ranked.agg(F.greatest(F.lit(8.0), F.least(top.cast("double"), F.first("median") * 3)).alias("threshold"))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def against_prototypes(vectors: DataFrame, prototypes: DataFrame, least: float = 0.0, margin: float = 0.0) -> DataFrame:
    """``vec_id, label, cosine, margin`` of the nearest prototype; null label where it is too far or not clearly nearest.

    ``prototypes(label, vector)`` is broadcast; more than ``PROTOTYPES`` rows raise an error.
    """
    few = prototypes.limit(PROTOTYPES + 1).count()
    if few > PROTOTYPES:
        raise ValueError(f"more than {PROTOTYPES} prototypes: use a nearest-neighbour search")
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y.cast("double") * y)))
    scored = vectors.select("vec_id", unit(F.col("embedding")).alias("u")).crossJoin(F.broadcast(prototypes.select("label", unit(F.col("vector")).alias("p")))).select("vec_id", "label", dot("u", "p").alias("cosine"))
    order = Window.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "label")
    ranked = scored.withColumn("k", F.row_number().over(order)).withColumn("margin", F.col("cosine") - F.lead("cosine").over(order)).where("k = 1")
    sure = (F.col("cosine") >= least) & (F.coalesce("margin", F.lit(2.0)) >= margin)
    return ranked.select("vec_id", F.when(sure, F.col("label")).alias("label"), "cosine", "margin")


def linked_clusters(docs: DataFrame, key: str, text: str, threshold: float = COSINE) -> DataFrame:
    """``key, cluster``: connected components of the cosine graph, by the smallest key.

    Texts of one bag of terms are one node, so a group of copies of any size is one row in the search.
    Is not the greedy result of ``clusters``.
    """
    terms = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(TERM_STOP))
    bags = docs.select(key, text, F.md5(F.array_join(F.array_sort(terms), " ")).alias("bag"), (F.size(terms) > 0).alias("some"))
    heads = bags.where("some").groupBy("bag").agg(F.min(key).alias("head"))
    pairs = cosine_pairs(docs, key, text, threshold, only=heads.select(F.col("head").alias(key)))
    groups = graph.components(pairs.select(F.col("left").alias("src"), F.col("right").alias("dst")))
    named = heads.join(groups, F.col("head") == F.col("node"), "left").select("bag", F.coalesce("component", "head").alias("cluster"))
    return bags.join(named.withColumnRenamed("bag", "of"), F.col("some") & (F.col("bag") == F.col("of")), "left").select(key, F.coalesce("cluster", key).alias("cluster"))
