"""Exact optima over pairs of sites, greedy medians and Lloyd rounds as plans over all demand rows.

Candidates are a ranked list of a stated length, so what grows with its square (pairs) does not grow with the demand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.operators.service import pairs


def _by_rank(demand: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each demand row with the array of its distances by rank."""
    rows = pairs(demand.withColumn("__row", F.monotonically_increasing_id()), candidates.select("rank", "f", "flat", "flng"))
    return rows.groupBy("__row", "w").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "d"))), lambda s: s["d"]).alias("ds"))


def _pair_values(rows: DataFrame, n: int, value, *by: str) -> DataFrame:  # noqa: ANN001
    """(by, i, j, v) for each pair of ranks and each row."""
    ranks = f"flatten(transform(sequence(1, {n - 1}), i -> transform(sequence(i + 1, {n}), j -> struct(i, j))))" if n > 1 else "array()"
    at = rows.withColumn("p", F.explode(F.expr(ranks).cast("array<struct<i:int,j:int>>")))
    return at.select(*by, F.col("p.i").cast("long").alias("i"), F.col("p.j").cast("long").alias("j"), value(F.get("ds", F.col("p.i") - 1), F.get("ds", F.col("p.j") - 1)).alias("v"))


def best_cover_pair(demand: DataFrame, candidates: DataFrame, radii: Sequence[float]) -> DataFrame:
    """By radius the pair of ranks that covers most weight, the first of equals, and how many pairs were compared."""
    n = candidates.count()  # a ranked list of a stated length
    rows = _by_rank(demand, candidates).withColumn("radius_km", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    # rows with the same covering sites are one
    rows = rows.withColumn("ds", F.transform("ds", lambda d: F.when(d <= F.col("radius_km"), 0.0).otherwise(1.0))).groupBy("radius_km", "ds").agg(F.sum("w").alias("w"))
    every = _pair_values(rows, n, lambda a, b: F.when(F.least(a, b) == 0, F.col("w")).otherwise(0), "radius_km").groupBy("radius_km", "i", "j").agg(F.sum("v").alias("covered"))
    best = every.groupBy("radius_km").agg(F.max_by(F.struct("i", "j", "covered"), F.struct("covered", -F.col("i"), -F.col("j"))).alias("s"), F.count("*").alias("pairs"))
    return best.select("radius_km", F.col("s.i").alias("first"), F.col("s.j").alias("second"), "s.covered", "pairs")


def best_median_pair(demand: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pair of ranks with the least weighted distance to the nearer one; of equals (to 1e-6) the first."""
    n = candidates.count()
    sums = _pair_values(_by_rank(demand, candidates), n, lambda a, b: F.col("w") * F.least(a, b)).groupBy("i", "j").agg(F.sum("v").alias("cost"))
    best = sums.agg(F.min_by(F.struct("i", "j", "cost"), F.struct(F.round("cost", 6), "i", "j")).alias("s"))
    return best.where("s is not null").select(F.col("s.i").alias("first"), F.col("s.j").alias("second"), "s.cost")


def greedy_median(demand: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Adds the candidate that leaves the least weighted distance, k times: step, rank, cost. One row a step goes to the driver."""
    spark = demand.sparkSession
    rows, chosen, out = _by_rank(demand, candidates), [], []
    for step in range(1, k + 1):
        near = F.array_min(F.array(*[F.get("ds", F.lit(r - 1)) for r in chosen])) if chosen else F.lit(float("inf"))
        costs = rows.withColumn("best", near).select(F.col("w"), "best", F.posexplode("ds").alias("at", "d")).groupBy((F.col("at") + 1).alias("rank")).agg(F.sum(F.col("w") * F.least("d", "best")).alias("cost"))
        first = costs.orderBy(F.round("cost", 6), "rank").first()
        if first is None:
            break
        chosen.append(int(first["rank"]))
        out.append((step, int(first["rank"]), float(first["cost"])))
    return spark.createDataFrame(out, "step long, rank long, cost double")


def lloyd(demand: DataFrame, k: int, rounds: int) -> DataFrame:
    """Rounds of weighted Lloyd steps in degrees from the k heaviest points: no, clat, clng, w.

    The k centres, and nothing else, go to the driver between rounds; a centre that no row is nearest to goes away.
    """
    spark = demand.sparkSession
    heavy = demand.orderBy(F.desc("w"), "prefix").limit(k).collect()
    centres = [(n, r.lat, r.lng, r.w) for n, r in enumerate(heavy, 1)]
    for _ in range(rounds):
        if not centres:
            break
        options = [F.struct((F.pow(F.col("lat") - a, 2) + F.pow(F.col("lng") - b, 2)).alias("d"), F.lit(n).cast("long").alias("no")) for n, a, b, _ in centres]
        near = F.array_min(F.array(*options))["no"]
        sums = demand.groupBy(near.alias("no")).agg((F.sum(F.col("w") * F.col("lat")) / F.sum("w")).alias("a"), (F.sum(F.col("w") * F.col("lng")) / F.sum("w")).alias("b"), F.sum("w").alias("w"))
        centres = [tuple(r) for r in sums.orderBy("no").collect()]
    return spark.createDataFrame(centres, "no long, clat double, clng double, w long")
