"""Random outfits for a whole table of requests: a slot's pick is the smallest of weighted draws, found for thousands of requests at once.

A draw of one row with chance in proportion to its weight is the smallest of -ln(u) / weight, where u
comes from the request's seed, the slot and the product. So reruns agree and no state is passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.draws import Keys
from mercato.operators import optimize as o

_PICK = pa.struct([("slot", pa.string()), ("url", pa.string()), ("price", pa.float64()), ("fit", pa.string()), ("print", pa.string()), ("color", pa.string())])
_PICKS = "array<struct<slot:string,url:string,price:double,fit:string,print:string,color:string>>"
#: Requests that are drawn for together, so that their columns stay in a core's cache.
TOGETHER = 16_384
#: Places in which a candidate stands: fits and near the centre, fits, doesn't fit, isn't offered.
NEAR, FITTING, UNFIT, ABSENT = range(4)


class _Drawer:
    """Picks from shortlists for columns of seeds, budgets and genders."""

    def __init__(self, pool: list[o.Candidate], order: list[str], band: float, optional: tuple[str, ...], complete: bool):
        # Equal draws go to the first row.
        self.pool = sorted(pool, key=lambda c: (c.url, c.price, c.fit, c.print, c.color))
        self.slots, self.band, self.optional, self.complete = [*order, *optional], band, optional, complete
        # The last column stands for an empty slot.
        self.factors = np.array([[*(o.coherence(c, [x]) for x in self.pool), 1.0] for c in self.pool]).reshape(len(self.pool), len(self.pool) + 1)

    def _told(self, wanted: str) -> tuple[np.ndarray, np.ndarray]:
        """For a gender, the place of each candidate, if its slot is in the order, and what its nearness to the centre divides its weight by."""
        price, own = np.array([c.price for c in self.pool]), [c.gender.strip(" ").lower() for c in self.pool]
        fits = np.array([wanted in ("", "unisex") or x in ("", "unisex", wanted) for x in own], bool)
        centre = np.sort(price[fits])[fits.sum() // 2] if fits.any() else 0.0
        apart = np.abs(price - centre)
        return np.where(fits, np.where(apart <= centre * self.band, NEAR, FITTING), UNFIT), 1 + apart / max(centre * self.band, 1.0)

    def picks(self, keys: Keys, budget: np.ndarray, places: np.ndarray, far: np.ndarray, gender: np.ndarray) -> np.ndarray:
        """For each request and slot the number of its pick, or -1; ``gender`` numbers rows of ``places`` and ``far``."""
        left, chosen = budget.copy(), np.full((keys.n, len(self.slots)), -1)
        for k, slot in enumerate(self.slots):
            extra = slot in self.optional
            best, least, pick = np.full(keys.n, 2 * (ABSENT + 1)), np.full(keys.n, np.inf), np.full(keys.n, -1)
            for number, c in enumerate(self.pool):
                if c.slot != slot:
                    continue
                place = places[:, number]
                place = np.where(place == UNFIT, UNFIT if self.complete and not extra else ABSENT, np.maximum(place, FITTING) if extra else place)[gender]
                if (place == ABSENT).all():
                    continue
                over = ~np.isnan(left) if np.isnan(c.price) else c.price > left
                rank = np.where(place == ABSENT, best.max(initial=0) + 1, place + (ABSENT + 1) * (over & ~(budget <= 0)))
                fit = np.ones(keys.n)
                for earlier in chosen.T[:k]:
                    fit *= self.factors[number, earlier]
                weight = (1 + min(c.likes, o.MOST_LIKES) * o.LIKE_STEP) * min(max(c.score / o.NEUTRAL_SCORE, o.LEAST_FACTOR), o.MOST_FACTOR) * fit / far[gender, number]
                draw = -np.log(keys.uniform(f"{slot}|{c.url}".encode())) / weight
                draw[np.isnan(draw)] = np.inf
                better = (rank < best) | ((rank == best) & (draw < least))
                best, least, pick = np.where(better, rank, best), np.where(better, draw, least), np.where(better, number, pick)
            good = np.isin(best, [NEAR, FITTING, *([ABSENT + 1 + NEAR, ABSENT + 1 + FITTING] if self.complete else [])])
            chosen[:, k] = np.where(good, pick, -1)
            left = left - np.where(good, np.array([*(c.price for c in self.pool), 0.0])[chosen[:, k]], 0.0)
        return chosen

    def __call__(self, seeds: pa.Array, budgets: pa.Array, wanted: pa.Array) -> pa.Array:
        genders = wanted.dictionary_encode()
        told = [self._told(x) for x in genders.dictionary.to_pylist()]
        places, far = np.array([p for p, _ in told]), np.array([f for _, f in told])
        gender, budget = np.asarray(genders.indices), np.asarray(budgets)
        # A null seed leaves no bar.
        keys = [b"" if s is None else f"{s}|".encode() for s in seeds.to_pylist()]
        lengths, chosen = np.array([len(s) for s in keys], int), np.full((len(keys), len(self.slots)), -1)
        for length in np.unique(lengths):
            alike = np.flatnonzero(lengths == length)
            for at in (alike[k : k + TOGETHER] for k in range(0, len(alike), TOGETHER)):
                chosen[at] = self.picks(Keys(b"".join([keys[i] for i in at]), len(at), int(length)), budget[at], places, far, gender[at])
        picked = chosen >= 0
        ends = np.concatenate([[0], picked.sum(axis=1).cumsum()]).astype(np.int32)
        rows = pa.array([{n: getattr(c, n) for n in _PICK.names} for c in self.pool], _PICK)
        return pa.ListArray.from_arrays(ends, rows.take(pa.array(chosen[picked], pa.int64())))


def _draw(drawer: _Drawer) -> Callable:
    @F.arrow_udf(_PICKS)
    def draw(seed: pa.Array, budget: pa.Array, wanted: pa.Array) -> pa.Array:
        return drawer(seed, budget, wanted)

    # It isn't random, but filters on the picks, which an explode brings, would be moved below the repartition and draw a second time.
    return draw.asNondeterministic()


def weighted_outfits(requests: DataFrame, rows: DataFrame, order: list[str], band: float = 0.30, optional: tuple[str, ...] = (), complete: bool = False, shortlist: int = o.SHORTLIST) -> DataFrame:
    """``requests(request, seed, budget, gender)`` with picks (structs in the order of the slots) and total.

    The rule is that of ``optimize.weighted_outfit``, which see. The shortlists, ``shortlist`` rows a slot at most,
    are collected and go to every task; requests are dealt out evenly and each is judged by its own row, without a join.
    A null budget is none, like 0 or less; a null gender
    fits all; rows without a price are never picked; requests that repeat give equal picks; an empty
    catalog or slot gives no pick; extra columns of ``requests`` stay, but for picks and total.
    """
    pool = [replace(c, url=str(c.url), price=float(c.price), score=c.score or 0.0) for c in o.pools(rows.where("price is not null and url is not null"), shortlist)]
    draw = _draw(_Drawer(pool, order, band, optional, complete))
    spark = requests.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    budget = F.greatest(F.coalesce(F.col("budget").cast("double"), F.lit(0.0)), F.lit(0.0))
    picks = draw(F.col("seed").cast("string"), budget, F.lower(F.trim(F.coalesce("gender", F.lit("")))))
    return requests.drop("picks", "total").repartition(tasks).withColumn("picks", picks).withColumn("total", F.aggregate("picks", F.lit(0.0), lambda t, c: t + c["price"]))
