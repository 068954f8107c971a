"""Preparation of orders and coordinate records: checks, joins, estimators, polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_items(items: DataFrame) -> DataFrame:
    """Items by order: count, price and freight."""
    return items.groupBy(F.col("l_orderkey").alias("order")).agg(F.count("*").alias("n_items"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum("l_tax"), 2).alias("freight"))


def split_orders(orders: DataFrame, located: DataFrame) -> DataFrame:
    """Delivered orders with a flag: does the customer stand in located(prefix)."""
    keys = located.select(F.col("prefix").alias("o_custkey"), F.lit(True).alias("found")).distinct()
    return orders.where("o_orderstatus = 'F'").join(keys, "o_custkey", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, rows beyond each first, and all rows of keys that repeat."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("after_first"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_repeats"))


def validate(records: DataFrame) -> DataFrame:
    """Records with lat as a number and status: valid, not_numeric or out_of_bounds."""
    lat = F.expr("try_cast(lat_text as double)")
    bad = lat.isNull() | F.isnan(lat) | F.col("lng").isNull() | F.isnan("lng")
    out = (F.abs(lat) > 90) | (F.abs("lng") > 180)
    return records.withColumn("lat", lat).withColumn("status", F.when(bad, "not_numeric").when(out, "out_of_bounds").otherwise("valid"))


def centroids(valid: DataFrame) -> DataFrame:
    """By prefix: records, means, medians, and means after full repeats are dropped."""
    one = valid.groupBy("prefix").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat_mean"), F.round(F.avg("lng"), 6).alias("lng_mean"), F.round(F.median("lat"), 6).alias("lat_median"), F.round(F.median("lng"), 6).alias("lng_median"))
    single = valid.select("prefix", "lat", "lng").distinct().groupBy("prefix").agg(F.count("*").alias("n_distinct"), F.round(F.avg("lat"), 6).alias("lat_dedup"))
    return one.join(single, "prefix")


def inside(points: DataFrame, edges: DataFrame, on: str = "poly") -> DataFrame:
    """Points with the number of their polygon's ring sides to the east and whether they lie on one: ``covers``, holes and
    boundaries counted. edges(poly, x1, y1, x2, y2) is a small table."""
    cross = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("lng") - F.col("x1"))
    on_edge = (cross == 0) & F.col("lng").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("lat").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    east = spans & (F.col("lng") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.when(F.col("y2") == F.col("y1"), 1.0).otherwise(F.col("y2") - F.col("y1")) + F.col("x1"))
    keys = points.columns
    # repeated points are asked once: their sides must not be counted together
    joined = points.groupBy(*keys).agg(F.count("*").alias("__times")).join(F.broadcast(edges))
    asked = joined.groupBy(*keys, "__times", on).agg(((F.count_if(east) % 2 == 1) | F.bool_or(on_edge)).alias("inside"))
    return asked.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).drop("__copy", "__times")


def boundary_km(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Kilometres in a local plane from each point to the nearest ring side; a side of no length is a point."""
    kx, ky = F.cos(F.radians("lat")) * 111.19508023, F.lit(111.19508023)
    ax, ay = (F.col("x1") - F.col("lng")) * kx, (F.col("y1") - F.col("lat")) * ky
    bx, by = (F.col("x2") - F.col("lng")) * kx, (F.col("y2") - F.col("lat")) * ky
    dx, dy = bx - ax, by - ay
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
    d = F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))
    return points.join(F.broadcast(edges)).groupBy(*points.columns).agg(F.round(F.min(d), 6).alias("boundary_km"))


def shares_inside(flagged: DataFrame) -> DataFrame:
    """By prefix: records, those inside, share and whether they are a majority or a tie."""
    g = flagged.groupBy("prefix").agg(F.count("*").alias("n"), F.count_if("inside").alias("n_inside"))
    share = F.col("n_inside") / F.col("n")
    return g.select("prefix", "n", "n_inside", F.round(share, 6).alias("share"), F.when(share > 0.5, "majority").when(share == 0.5, "tie").otherwise("minority").alias("verdict"))


def dispersion(valid: DataFrame, distance) -> DataFrame:  # noqa: ANN001
    """By prefix: median, 90 % and largest distance of its records to their mean."""
    by = Window.partitionBy("prefix")
    d = valid.withColumn("mlat", F.avg("lat").over(by)).withColumn("mlng", F.avg("lng").over(by))
    d = d.withColumn("d", distance(F.col("lat"), F.col("lng"), F.col("mlat"), F.col("mlng")))
    return d.groupBy("prefix").agg(F.count("*").alias("n"), F.round(F.percentile("d", F.lit(0.5)), 5).alias("p50"), F.round(F.percentile("d", F.lit(0.9)), 5).alias("p90"), F.round(F.max("d"), 5).alias("d_max"))
