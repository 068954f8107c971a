"""Assignment, coverage, quantiles and profiles of service."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, pi, radians, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflow.functions.geo import EARTH_KM, cover_target, haversine, haversine_atan2

#: Rows up to which the facility side is broadcast; beyond it both sides of the product stay distributed.
BROADCAST_ROWS = 200_000
#: Sites up to which the nearest one is found by the plain product, and how many a cell search expects within its radius.
PRODUCT_SITES, EXPECTED_NEAR = 300, 16


def pairs(demand: DataFrame, sites: DataFrame, metric=haversine) -> DataFrame:  # noqa: ANN001
    """All demand and site pairs with their distance d."""
    other = F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites
    return demand.crossJoin(other).withColumn("d", metric(F.col("lat"), F.col("lng"), F.col("flat"), F.col("flng")))


def cross_check(demand: DataFrame, sites: DataFrame, few: int = 1_000_000_000, tolerance: float = 1e-9, degrees: int = 5) -> DataFrame:
    """Number of demand and site pairs, and of those whose two great-circle forms differ by more than the tolerance (km).

    Both forms are functions of one number h; below a quarter of the globe (h up to 1/2) their conditions are below 2 and the
    JVM gives asin and atan2 to 1 and 2 units in the last place, so they differ by 1e-10 km at most. Up to ``few`` pairs all
    are computed. Beyond that those of two cells that lie within a quarter of the globe altogether are counted by the cells'
    rows, and all others computed: rows beyond 90 or 180 degrees too, which no cell holds.
    """
    if tolerance < 1e-10:
        raise ValueError("a tolerance below 1e-10 km needs every pair")
    apart = haversine(F.col("lat"), F.col("lng"), F.col("flat"), F.col("flng")) - haversine_atan2(F.col("lat"), F.col("lng"), F.col("flat"), F.col("flng"))
    n = demand.count() * sites.count()
    if n <= few:
        return pairs(demand, sites).agg(F.count("*").alias("n"), F.count_if(F.abs(apart) > tolerance).alias("disagree"))

    def cells(df: DataFrame, lat: str, lng: str, at: str) -> DataFrame:
        inside = (F.abs(lat) <= 90) & (F.abs(lng) <= 180)
        cell = [F.when(inside, F.floor(F.col(c) / degrees) * degrees + degrees / 2).alias(at + x) for c, x in ((lat, "y"), (lng, "x"))]
        return df.select(lat, lng, *cell).where(F.col(lat).isNotNull() & F.col(lng).isNotNull())

    left, right = cells(demand, "lat", "lng", "l"), cells(sites, "flat", "flng", "r")
    between = haversine(F.col("ly"), F.col("lx"), F.col("ry"), F.col("rx")) / EARTH_KM
    near = F.coalesce(between <= pi / 2 - radians(2 * degrees), F.lit(False))  # a cell's rows lie within 0.71 of its width of its centre
    far = left.select("ly", "lx").distinct().crossJoin(right.select("ry", "rx").distinct()).where(~near)
    far = far.select(*[F.col(c).alias("__" + c) for c in far.columns])
    some = left.join(far, F.col("ly").eqNullSafe(F.col("__ly")) & F.col("lx").eqNullSafe(F.col("__lx")))
    some = some.join(right, F.col("ry").eqNullSafe(F.col("__ry")) & F.col("rx").eqNullSafe(F.col("__rx")))
    return some.agg(F.lit(n).cast("long").alias("n"), F.count_if(F.abs(apart) > tolerance).alias("disagree"))


def _band_cells(band: Column, km: float) -> Column:
    """Cells around the globe in a band of latitude: each at least km wide there and one band farther from the equator."""
    size = km / 111.0
    far = F.least(F.lit(89.9), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * size)
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(far)) / (1.01 * size))).cast("long")


def within(demand: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """Pairs at most km apart, by an equi-join on cells: each site stands in its cell and the eight around it.

    Cells widen towards the poles and go around the globe, so 180 degrees is no border. Null coordinates pair with nothing;
    repeated rows each have their pairs.
    """
    return _cell_pairs(demand, sites, km, haversine, "inner").where(F.col("d") <= km)


def _cell_pairs(demand: DataFrame, sites: DataFrame, km: float, metric, how: str) -> DataFrame:  # noqa: ANN001
    """Pairs of neighbouring cells with their distance: all that are at most km apart, and some farther ones."""
    size = km / 111.0
    cell = lambda lng, n: F.floor((lng + 180.0) / 360.0 * n).cast("long")
    left = demand.withColumn("__y", F.floor(F.col("lat") / size).cast("long"))
    left = left.withColumn("__x", F.pmod(cell(F.col("lng"), _band_cells(F.col("__y"), km)), _band_cells(F.col("__y"), km)))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    right = sites.withColumn("__y", F.explode(F.transform(around, lambda k: F.floor(F.col("flat") / size).cast("long") + k))).withColumn("__n", _band_cells(F.col("__y"), km))
    right = right.withColumn("__x", F.explode(F.array_distinct(F.transform(around, lambda k: F.pmod(cell(F.col("flng"), F.col("__n")) + k, F.col("__n")))))).drop("__n")
    joined = left.join(right, ["__y", "__x"], how).drop("__y", "__x")
    return joined.withColumn("d", metric(F.col("lat"), F.col("lng"), F.col("flat"), F.col("flng")))


def _search_km(sites: DataFrame) -> float | None:
    """Radius in which sites spread evenly over their box would have EXPECTED_NEAR; None where the product serves."""
    box = sites.agg(F.count("*"), F.min("flat"), F.max("flat"), F.min("flng"), F.max("flng")).first()
    if box[0] <= PRODUCT_SITES:
        return None
    high, wide = (box[2] - box[1]) * 111.2, (box[4] - box[3]) * 111.2 * cos(radians((box[1] + box[2]) / 2))
    km = max(0.1, sqrt(EXPECTED_NEAR * max(high, 0.1) * max(wide, 0.1) / (pi * box[0])))
    return km if km < 2000 else None


def nearest(demand: DataFrame, sites: DataFrame, metric=haversine) -> DataFrame:  # noqa: ANN001
    """Each demand row with its nearest site f and distance d; of equal ones the least f. Repeated rows stay as many.

    Beyond PRODUCT_SITES sites the neighbouring cells are searched first. A site found within the radius is the nearest, as
    the cells hold all sites so near; rows without one are compared with all sites. Sites without coordinates are left
    out; a demand row without them has the least f and a null d. Metrics other than the spherical ones take the product.
    """
    keys = demand.columns
    once = demand.groupBy(*keys).agg(F.count("*").alias("__times"))
    sites = sites.where("flat is not null and flng is not null")
    km = _search_km(sites) if metric in (haversine, haversine_atan2) else None
    if km is None:
        best = _least(pairs(once, sites, metric), keys)
    else:
        first = _least(_cell_pairs(once, sites, km, metric, "left").withColumn("f", F.when(F.col("d") <= km, F.col("f"))), keys)
        rest = first.where("b.f is null").drop("b")
        best = first.where("b.f is not null").unionByName(_least(pairs(rest, sites, metric), keys))
    best = best.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int"))))
    return best.select(*keys, F.col("b.f").alias("f"), F.col("b.d").alias("d"))


def _least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least (d, f) of each demand row; a null struct where no f is given."""
    return rows.groupBy(*keys, "__times").agg(F.min(F.when(F.col("f").isNotNull(), F.struct("d", "f"))).alias("b"))


def coverage(assigned: DataFrame, radii: Sequence[float]) -> DataFrame:
    """By radius: orders, covered, outside, pct (null without orders), target and whether it is met. One pass over the rows."""
    rows = assigned.select("w", "d", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius_km"))
    out = rows.groupBy("radius_km").agg(F.sum("w").alias("orders"), F.sum(F.when(F.col("d") <= F.col("radius_km"), F.col("w")).otherwise(0)).alias("covered"))
    target = cover_target(F.col("orders"))
    return out.select("radius_km", "orders", "covered", (F.col("orders") - F.col("covered")).alias("outside"), F.round(F.try_divide(100.0 * F.col("covered"), F.col("orders")), 6).alias("coverage_pct"), target.alias("target"), (F.col("covered") >= target).alias("met"))


def empirical_quantiles(assigned: DataFrame, by: list[str], percents: Sequence[int] = (50, 95, 99, 100)) -> DataFrame:
    """Weighted inverse-CDF quantiles: the least d whose running weight reaches p percent. Equal distances are added up
    first, so a group's window holds distinct distances only."""
    at = assigned.groupBy(*by, "d").agg(F.sum("w").alias("w"))
    up = Window.partitionBy(*by).orderBy("d")
    run = at.withColumn("c", F.sum("w").over(up)).withColumn("n", F.sum("w").over(Window.partitionBy(*by)))
    return run.groupBy(*by).agg(*[F.round(F.min(F.when(F.col("c") * 100 >= F.col("n") * p, F.col("d"))), 6).alias(f"p{p}") for p in percents])


def metrics(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean and maximum, linear order-weighted and unweighted percentiles, coverage at 3, 5 and 10 km."""
    d, w = F.col("d"), F.col("w")
    cover = [F.round(100.0 * F.sum(F.when(d <= r, w).otherwise(0)) / F.sum(w), 6).alias(f"cover_{r}") for r in (3, 5, 10)]
    wp = [F.round(F.expr(f"percentile(d, {p / 100}, w)"), 6).alias(f"wp{p}") for p in (50, 95, 99)]
    up = [F.round(F.expr(f"percentile(d, {p / 100})"), 6).alias(f"up{p}") for p in (95, 99)]
    return assigned.groupBy(*by).agg(F.countDistinct("f").alias("sites_used"), F.sum("w").alias("orders"), F.round(F.sum(w * d) / F.sum(w), 6).alias("mean_km"), F.round(F.max("d"), 6).alias("max_km"), *wp, *up, *cover)


def loads(assigned: DataFrame, sites: DataFrame) -> DataFrame:
    """Orders of each site, zero kept."""
    used = assigned.groupBy("f").agg(F.sum("w").alias("orders"), F.count("*").alias("prefixes"))
    return sites.select("f").join(used, "f", "left").select("f", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("prefixes", F.lit(0)).alias("prefixes"))


def city_profile(assigned: DataFrame, radius: float, cities: DataFrame | None = None) -> DataFrame:
    """By city: orders, covered, outside, pct, mean and maximum; cities without demand kept if a list is given."""
    d, w = F.col("d"), F.col("w")
    out = assigned.groupBy("city").agg(F.sum(w).alias("orders"), F.sum(F.when(d <= radius, w).otherwise(0)).alias("covered"), F.sum(w * d).alias("s"), F.max("d").alias("m"))
    if cities is not None:
        out = cities.select("city").join(out, "city", "left")
    n, c = F.coalesce("orders", F.lit(0)), F.coalesce("covered", F.lit(0))
    return out.select("city", n.alias("orders"), c.alias("covered"), (n - c).alias("outside"), F.round(100.0 * F.col("covered") / F.col("orders"), 6).alias("pct"), F.round(F.col("s") / F.col("orders"), 6).alias("mean_km"), F.round("m", 6).alias("max_km"))


def city_summary(profile: DataFrame) -> DataFrame:
    """Cities with no covered order, below 80 %, and the orders in them."""
    zero, low = (F.col("covered") == 0) & (F.col("orders") > 0), F.col("pct") < 80
    return profile.agg(F.count_if(zero).alias("zero_cities"), F.sum(F.when(zero, F.col("orders")).otherwise(0)).alias("zero_orders"), F.count_if(low).alias("below80_cities"), F.sum(F.when(low, F.col("orders")).otherwise(0)).alias("below80_orders"))


def farthest(assigned: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("d"), "prefix")
    return assigned.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rank_candidates(demand: DataFrame, n: int | None = None, prefix_desc: bool = False) -> DataFrame:
    """Demand rows as candidates: weight down, then prefix; the first n."""
    order = [F.desc("w"), F.desc("prefix") if prefix_desc else F.asc("prefix")]
    top = demand.orderBy(*order).limit(n) if n else demand
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("rank", F.col("prefix").alias("f"), F.col("lat").alias("flat"), F.col("lng").alias("flng"), F.col("w").alias("fw"))


def rank_curve(demand: DataFrame, candidates: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Covered orders when the first k candidates are open, for every k: each demand row counts from the first rank
    that covers it on, so one pass over the pairs gives the whole curve."""
    near = within(demand, candidates, max(radii)).select("prefix", "w", "rank", "d", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius_km")).where("d <= radius_km")
    first = near.groupBy("radius_km", "prefix").agg(F.min("rank").alias("k"), F.first("w").alias("w"))
    gain = first.groupBy("radius_km", "k").agg(F.sum("w").alias("gain"))
    ks = candidates.select(F.col("rank").alias("k")).join(F.broadcast(candidates.sparkSession.createDataFrame([(float(r),) for r in radii], "radius_km double")))
    full = ks.join(gain, ["radius_km", "k"], "left")
    return full.select("radius_km", "k", F.sum(F.coalesce("gain", F.lit(0))).over(Window.partitionBy("radius_km").orderBy("k")).alias("covered"))


def first_feasible(curve: DataFrame, total: Column | int, by: Sequence[str] = ("radius_km",)) -> DataFrame:
    """The least k that meets the target; every smaller k must stand in the curve."""
    target = cover_target(F.lit(total) if isinstance(total, int) else total)
    out = curve.groupBy(*by).agg(F.min(F.when(F.col("covered") >= target, F.col("k"))).alias("k_selected"), F.max("covered").alias("ceiling"), F.max("k").alias("k_max"), F.countDistinct("k").alias("n"))
    status = F.when(F.col("n") != F.col("k_max"), "incomplete").when(F.col("k_selected").isNotNull(), "selected").otherwise("structurally_infeasible")
    return out.select(*by, F.col("k_selected"), "ceiling", status.alias("status"))
