"""Variants of a study: records that share their prefix's orders, changed candidate sets, agreement over variants, stretches
of routes outside a region, and long catalogues of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(demand: DataFrame, points: DataFrame) -> DataFrame:
    """Each prefix's orders spread evenly over its points(record, prefix, lat, lng); prefixes without points keep their place,
    with a null record."""
    n = points.groupBy(F.col("prefix").alias("p")).agg(F.count("*").alias("n"))
    known = demand.join(n, F.col("prefix") == F.col("p"), "left")
    kept = known.where("n is null").select(F.lit(None).cast(points.schema["record"].dataType).alias("record"), "prefix", "lat", "lng", F.col("w").cast("double").alias("w"))
    shares = known.where("n is not null").select("p", (F.col("w") / F.col("n")).alias("w"))
    return points.select("record", "prefix", "lat", "lng").join(shares, F.col("prefix") == F.col("p")).select("record", "prefix", "lat", "lng", "w").unionByName(kept)


def fractional_service(assigned: DataFrame, radius: float, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Coverage and inverse-CDF quantiles under fractional weights: the least distance whose running weight reaches the
    share of the total, and the largest distance where rounding keeps the running weight below it.

    Distances are first added up, rounded to 9 digits, so that the running sum goes over distinct ones."""
    at = assigned.groupBy(F.round("d", 9).alias("d")).agg(F.sum("w").alias("w"))
    run = running(at, "d", "w")
    total = run.agg(F.sum("w").alias("total"), F.max("d").alias("far"), F.sum(F.when(F.col("d") <= radius, F.col("w")).otherwise(0.0)).alias("covered"))
    rows = run.join(F.broadcast(total))  # one row
    least = [F.round(F.coalesce(F.min(F.when(F.col("c") >= F.col("total") * (p / 100) - 1e-9 * F.col("total"), F.col("d"))), F.max("far")), 6).alias(f"p{p}") for p in percents]
    return rows.agg(F.round(F.max("total"), 6).alias("orders"), F.round(F.max("covered"), 6).alias("covered"), F.round(100 * F.max("covered") / F.max("total"), 6).alias("pct"), *least)


def running(rows: DataFrame, by: str, weight: str, width: float = 0.5) -> DataFrame:
    """Rows with c, the sum of weight up to by. Stretches of width are summed first; a window over all rows would be one
    task, here only the stretches' totals are."""
    cells = rows.withColumn("__cell", F.floor(F.col(by) / width))
    totals = cells.groupBy("__cell").agg(F.sum(weight).alias("t"))
    before = totals.select(F.col("__cell"), F.coalesce(F.sum("t").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("b"))
    inside = F.sum(weight).over(Window.partitionBy("__cell").orderBy(by))
    return cells.withColumn("i", inside).join(before, "__cell").withColumn("c", F.col("b") + F.col("i")).drop("__cell", "b", "i")


def set_change(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of only one of two sets: entered or exited."""
    come = other.select(key).join(base.select(key), key, "left_anti").withColumn("change", F.lit("entered"))
    gone = base.select(key).join(other.select(key), key, "left_anti").withColumn("change", F.lit("exited"))
    return come.unionByName(gone)


def agreement(results: DataFrame, variants: int, by: str = "radius_km") -> DataFrame:
    """Pairs of methods at each radius over results(radius_km, variant, method, k): the range of k of each and whether the
    order holds in all variants. k is null where a variant has none; a pair that lacks one isn't classified."""
    span = results.groupBy(by, "method").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("k").alias("n"))
    one, two = [span.select(by, *[F.col(c).alias(c + side) for c in ("method", "lo", "hi", "n")]) for side in ("_a", "_b")]
    left, right = [results.select(by, "variant", F.col("method").alias("method" + side), F.col("k").alias("k" + side)) for side in ("_a", "_b")]
    signs = left.join(right, [by, "variant"]).where("method_a < method_b").groupBy(by, "method_a", "method_b").agg(F.count_if(F.col("k_a") < F.col("k_b")).alias("less"), F.count_if(F.col("k_a") > F.col("k_b")).alias("more"))
    overlap = (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))
    label = (
        F.when((F.col("n_a") < variants) | (F.col("n_b") < variants), "incomplete_variants_no_classification")
        .when(overlap, "absence_of_robust_descriptive_separation")
        .when((F.col("less") == variants) | (F.col("more") == variants), "stable_observed_order")
        .otherwise("order_changes_between_variants")
    )
    pairs = one.join(two, by).where("method_a < method_b").join(signs, [by, "method_a", "method_b"], "left")
    return pairs.select(by, "method_a", "method_b", "lo_a", "hi_a", "lo_b", "hi_b", label.alias("label"))


def outside_lengths(lines: DataFrame, edges: DataFrame, key: str = "line") -> DataFrame:
    """Length of lines(line, ax, ay, bx, by) outside the polygons of edges(x1, y1, x2, y2), all in metres of one plane.

    A line is cut where ring sides meet it; a piece is outside where its middle has an even number of sides to the east.
    Sides along the line add no cuts of their own: their ends are cuts by the sides that follow. The edges are a small
    table; lines are cut independently of each other."""
    px, py = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    qx, qy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    det = px * qy - py * qx
    safe = F.when(det == 0, F.lit(1.0)).otherwise(det)
    ox, oy = F.col("x1") - F.col("ax"), F.col("y1") - F.col("ay")
    t, u = (ox * qy - oy * qx) / safe, (ox * py - oy * px) / safe
    hit = F.when((det != 0) & u.between(0, 1) & (t > 0) & (t < 1), t)
    met = lines.join(F.broadcast(edges)).groupBy(*lines.columns).agg(F.collect_set(hit).alias("ts"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.col("ts"), F.array(F.lit(1.0)))))
    spans = met.withColumn("cuts", cuts).select(*lines.columns, F.explode(F.expr("transform(sequence(0, size(cuts) - 2), i -> struct(cuts[i] as s, cuts[i + 1] as e))")).alias("c"))
    middle = (F.col("c.s") + F.col("c.e")) / 2
    placed = spans.select(key, F.col("c.s").alias("s"), F.col("c.e").alias("e"), (F.col("ax") + middle * px).alias("mx"), (F.col("ay") + middle * py).alias("my"), F.sqrt(px * px + py * py).alias("len"))
    crosses = (F.col("y1") > F.col("my")) != (F.col("y2") > F.col("my"))
    east = crosses & (F.col("mx") < qx * (F.col("my") - F.col("y1")) / F.when(qy == 0, 1.0).otherwise(qy) + F.col("x1"))
    piece = placed.join(F.broadcast(edges)).groupBy(key, "s", "e", "len").agg((F.count_if(east) % 2 == 0).alias("out"))
    return piece.groupBy(key).agg(F.sum(F.when(F.col("out"), (F.col("e") - F.col("s")) * F.col("len")).otherwise(0.0)).alias("outside"), F.max("len").alias("length"))


def cohort(demand: DataFrame, shares: DataFrame, ties: bool) -> DataFrame:
    """Demand of prefixes whose records lie inside for the most part; with ties, half is enough."""
    most = shares.where("2 * n_inside >= n" if ties else "2 * n_inside > n").select("prefix")
    return demand.join(most, "prefix", "left_semi")


def catalogue(table: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """All numbers of a result as rows: keys, field, value, source."""
    numbers = [f.name for f in table.schema if f.name not in keys and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    wide = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in numbers])
    return wide.unpivot(keys, numbers, "field", "value").withColumn("source", name)


def content_hash(table: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """One row that does not depend on the order of rows: their number and a sum of row hashes modulo 2^63."""
    names = sorted(c for c in table.columns if c not in but)
    h = F.xxhash64(*names).cast("decimal(38,0)")
    return table.agg(F.count("*").alias("n"), F.pmod(F.coalesce(F.sum(h), F.lit(0)), F.expr("cast(9223372036854775808 as decimal(38,0))")).cast("long").alias("hash"))
