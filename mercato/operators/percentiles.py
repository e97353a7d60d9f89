"""Exact percentiles of groups of any size, without holding a group's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.operators.graph import cut

#: Different values of a group that one task may hold.
MOST_VALUES = 100_000
#: Pieces that a round cuts an open span into, and rounds after which something must be wrong.
PIECES, MOST_ROUNDS = 64, 20
#: Large groups whose spans are sent to all tasks; more of them are joined by shuffling.
BROADCAST_GROUPS = 10_000


def weighted(value: str | Column, at: float, count: str | Column) -> Column:
    return F.percentile(value, F.lit(at), count)


def large_groups(counted: DataFrame, keys: list[str], most: int = MOST_VALUES) -> DataFrame:
    """``k`` (struct of the keys), n, d, lo, hi of the groups with more than ``most`` different values."""
    sizes = counted.groupBy(F.struct(*keys).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return sizes.where(F.col("d") > most)


def percentiles(counted: DataFrame, keys: list[str], at: dict[str, float], most: int = MOST_VALUES) -> DataFrame:
    """``keys`` and a column for each name in ``at``: the percentile there, interpolated as Spark's ``percentile`` does.

    ``counted(keys, v, c)`` has one row for each different value of a group. Groups of up to ``most``
    values take the built-in aggregate. In a larger one every wanted rank starts with the whole span
    of values; a round cuts each open span at the marks of a sketch, counts the pieces exactly and
    keeps the piece that holds the rank, until no piece has more than ``most`` values. The sketch only
    proposes marks, so its error costs rounds, never exactness.

    Null values are ignored; null keys are groups of their own.
    """
    counted = cut(counted.where("v is not null"))
    large = cut(large_groups(counted, keys, most))
    plain = [weighted("v", p, F.col("c")).alias(name) for name, p in at.items()]
    n_large = large.count()
    if not n_large:
        return counted.groupBy(*keys).agg(*plain)
    small_size = n_large <= BROADCAST_GROUPS
    sent = F.broadcast if small_size else (lambda df: df)
    rows = counted.select(F.struct(*keys).alias("k"), "v", "c")
    small = rows.join(sent(large.select("k")), "k", "left_anti").groupBy("k").agg(*plain)

    place = {name: (F.col("n") - 1) * F.lit(p) for name, p in at.items()}
    ends = [end(x).cast("long") for x in place.values() for end in (F.floor, F.ceil)]
    spans = cut(large.select("k", F.explode(F.array_distinct(F.array(*ends))).alias("rank"), "lo", "hi", "d", F.lit(0).cast("long").alias("before")))
    for _ in range(MOST_ROUNDS):
        if spans.where(F.col("d") > most).isEmpty():
            break
        spans = cut(_narrowed(rows, spans, most, sent))
    else:
        raise RuntimeError(f"percentiles did not settle in {MOST_ROUNDS} rounds")

    one = spans.select("k", "lo", "hi", "before").distinct()
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("k", "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = rows.join(sent(one), "k").where("v between lo and hi").withColumn("upto", upto).select("k", "lo", "v", "c", "upto")
    found = held.join(sent(spans.select("k", "lo", "rank")), ["k", "lo"]).where("upto - c <= rank and rank < upto")
    by_rank = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))  # two ranks a percentile

    def between(x: Column) -> Column:
        low, high = (F.element_at("of", end(x).cast("long")) for end in (F.floor, F.ceil))
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    big = by_rank.join(large.select("k", "n"), "k").select("k", *[between(x).cast("double").alias(name) for name, x in place.items()])
    return small.unionByName(big).select(*[F.col("k")[c].alias(c) for c in keys], *at)


def _narrowed(rows: DataFrame, spans: DataFrame, most: int, sent) -> DataFrame:
    """The spans, those with more than ``most`` values cut down to the piece that holds their rank."""
    wide = spans.where(F.col("d") > most)
    inside = rows.join(sent(wide.select("k", "lo", "hi", "before").distinct()), "k").where("v between lo and hi")
    marks = inside.groupBy("k", "lo").agg(F.percentile_approx("v", [k / PIECES for k in range(1, PIECES)], PIECES * 16).alias("marks"))
    piece = F.size(F.filter("marks", lambda m: m < F.col("v")))
    pieces = (
        inside.join(sent(marks), ["k", "lo"])
        .groupBy("k", "lo", "before", piece.alias("piece"))
        .agg(F.sum("c").alias("held"), F.count("*").alias("d"), F.min("v").alias("from"), F.max("v").alias("to"))
    )
    earlier = Window.partitionBy("k", "lo").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # PIECES rows
    pieces = pieces.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    cut_down = wide.select("k", "lo", "rank").join(pieces, ["k", "lo"]).where("rank >= before and rank < before + held")
    cut_down = cut_down.select("k", "rank", F.col("from").alias("lo"), F.col("to").alias("hi"), "d", "before")
    return spans.where(F.col("d") <= most).unionByName(cut_down)
