"""Registry of the facility-location queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflow.functions import geo
from siteflow.operators import compare, placement, prepare, service, variants
from siteflow.sources.tables import DEMAND_SQL, FACILITY_SQL, RECORD_SQL, demand, facilities, records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RADII = (10.0, 20.0, 40.0)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_H = "2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))))"
D_SQL = _H.format(a="lat", b="flat", c="lng", d="flng")
NEAR_SQL = f"""near AS (SELECT prefix, city, lat, lng, w, f, d FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY d, f) AS rn FROM (SELECT demand.*, f, {D_SQL} AS d FROM demand, facility)) WHERE rn = 1)"""
WITH_NEAR = f"WITH {DEMAND_SQL}, {FACILITY_SQL}, {NEAR_SQL} "
CAND_SQL = "cand AS (SELECT row_number() OVER (ORDER BY w DESC, prefix) AS rank, prefix AS f, lat AS flat, lng AS flng FROM demand ORDER BY w DESC, prefix LIMIT 60)"
CURVE_SQL = f"""curve AS (SELECT r.radius_km, c.rank AS k, CAST(sum(coalesce(g.gain, 0)) OVER (PARTITION BY r.radius_km ORDER BY c.rank) AS BIGINT) AS covered
  FROM cand c CROSS JOIN (SELECT unnest([10.0::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE]) AS radius_km) r
  LEFT JOIN (SELECT radius_km, k, sum(w) AS gain FROM (SELECT radius_km, prefix, min(rank) AS k, min(w) AS w FROM (SELECT demand.*, rank, {D_SQL} AS d FROM demand, cand) CROSS JOIN (SELECT unnest([10.0::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE]) AS radius_km) WHERE d <= radius_km GROUP BY ALL) GROUP BY ALL) g ON g.radius_km = r.radius_km AND g.k = c.rank)"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.nearest(demand(spark, sf_dir), facilities(spark, sf_dir))


@query(f"WITH {DEMAND_SQL} SELECT prefix, city, round(lat, 6) AS lat, round(lng, 6) AS lng, w FROM demand")
def demand_points(spark, sf_dir):
    return demand(spark, sf_dir).select("prefix", "city", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "w")


@query("SELECT o_orderkey AS \"order\", n_items, price, freight FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, round(sum(l_extendedprice), 2) AS price, round(sum(l_tax), 2) AS freight FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def order_items(spark, sf_dir):
    items = prepare.order_items(table(spark, sf_dir, "lineitem"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order")).join(items, "order", "left")


@query("SELECT found, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM (SELECT o_custkey, o_custkey IN (SELECT user_id FROM events) AS found FROM orders WHERE o_orderstatus = 'F') GROUP BY found")
def orders_with_coordinates(spark, sf_dir):
    split = prepare.split_orders(table(spark, sf_dir, "orders"), records(spark, sf_dir))
    return split.groupBy("found").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS after_first, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS in_repeats FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_items(spark, sf_dir):
    return prepare.duplicate_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey AS prefix, count(*) AS n_orders, round(sum(o_totalprice), 2) AS value, string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey")
def demand_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("prefix")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "; ").alias("states"))


@query(WITH_NEAR + "SELECT prefix, f, round(d, 6) AS d FROM near")
def nearest_facility(spark, sf_dir):
    return assigned(spark, sf_dir).select("prefix", "f", F.round("d", 6).alias("d"))


@query(f"WITH {DEMAND_SQL}, {FACILITY_SQL} SELECT count(*) AS n, 0::BIGINT AS disagree FROM demand, facility")
def distance_cross_check(spark, sf_dir):
    return service.cross_check(demand(spark, sf_dir), facilities(spark, sf_dir))


@query(WITH_NEAR + """SELECT radius_km, CAST(sum(w) AS BIGINT) AS orders, CAST(sum(CASE WHEN d <= radius_km THEN w ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN d <= radius_km THEN 0 ELSE w END) AS BIGINT) AS outside,
  round(100.0 * CAST(sum(CASE WHEN d <= radius_km THEN w ELSE 0 END) AS DOUBLE) / sum(w), 6) AS coverage_pct, CAST((sum(w) * 95 + 99) // 100 AS BIGINT) AS target, sum(CASE WHEN d <= radius_km THEN w ELSE 0 END) >= (sum(w) * 95 + 99) // 100 AS met
  FROM near CROSS JOIN (SELECT unnest([10.0::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE]) AS radius_km) GROUP BY radius_km""")
def coverage(spark, sf_dir):
    return service.coverage(assigned(spark, sf_dir), RADII)


@query(f"WITH {DEMAND_SQL}, {FACILITY_SQL} SELECT prefix, count(*) AS sites, round(min(d), 6) AS d_min FROM (SELECT prefix, {D_SQL} AS d FROM demand, facility) WHERE d <= 20 GROUP BY prefix")
def sites_within(spark, sf_dir):
    return service.within(demand(spark, sf_dir), facilities(spark, sf_dir), 20.0).groupBy("prefix").agg(F.count("*").alias("sites"), F.round(F.min("d"), 6).alias("d_min"))


@query(WITH_NEAR + """SELECT city, round(min(CASE WHEN c * 100 >= n * 50 THEN d END), 6) AS p50, round(min(CASE WHEN c * 100 >= n * 95 THEN d END), 6) AS p95, round(min(CASE WHEN c * 100 >= n * 99 THEN d END), 6) AS p99, round(min(CASE WHEN c * 100 >= n * 100 THEN d END), 6) AS p100
  FROM (SELECT city, d, sum(w) OVER (PARTITION BY city ORDER BY d) AS c, sum(w) OVER (PARTITION BY city) AS n FROM near) GROUP BY city""")
def quantiles_by_city(spark, sf_dir):
    return service.empirical_quantiles(assigned(spark, sf_dir), ["city"])


@query(WITH_NEAR + """SELECT count(DISTINCT near.f) AS sites_used, CAST((SELECT sum(w) FROM near) AS BIGINT) AS orders, round((SELECT sum(w * d) / sum(w) FROM near), 6) AS mean_km, round(max(d), 6) AS max_km,
  round(quantile_cont(d, 0.5), 6) AS wp50, round(quantile_cont(d, 0.95), 6) AS wp95, round(quantile_cont(d, 0.99), 6) AS wp99, round((SELECT quantile_cont(d, 0.95) FROM near), 6) AS up95, round((SELECT quantile_cont(d, 0.99) FROM near), 6) AS up99,
  round((SELECT 100.0 * CAST(sum(CASE WHEN d <= 3 THEN w ELSE 0 END) AS DOUBLE) / sum(w) FROM near), 6) AS cover_3, round((SELECT 100.0 * CAST(sum(CASE WHEN d <= 5 THEN w ELSE 0 END) AS DOUBLE) / sum(w) FROM near), 6) AS cover_5, round((SELECT 100.0 * CAST(sum(CASE WHEN d <= 10 THEN w ELSE 0 END) AS DOUBLE) / sum(w) FROM near), 6) AS cover_10
  FROM near, LATERAL (SELECT unnest(range(w)))""")
def service_metrics(spark, sf_dir):
    return service.metrics(assigned(spark, sf_dir), [])


_PROFILE = """profile AS (SELECT n_nationkey AS city, coalesce(orders, 0) AS orders, coalesce(covered, 0) AS covered, coalesce(orders - covered, 0) AS outside, round(100.0 * CAST(covered AS DOUBLE) / orders, 6) AS pct, round(s / orders, 6) AS mean_km, round(m, 6) AS max_km
  FROM nation LEFT JOIN (SELECT city, CAST(sum(w) AS BIGINT) AS orders, CAST(sum(CASE WHEN d <= 20 THEN w ELSE 0 END) AS BIGINT) AS covered, sum(w * d) AS s, max(d) AS m FROM near GROUP BY city) ON city = n_nationkey) """


def _profile(spark, sf_dir):
    cities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("city"))
    return service.city_profile(assigned(spark, sf_dir), 20.0, cities)


@query(WITH_NEAR + "," + _PROFILE + "SELECT CAST(city AS BIGINT) AS city, orders, covered, outside, pct, mean_km, max_km FROM profile")
def city_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(WITH_NEAR + "," + _PROFILE + "SELECT count(*) FILTER (covered = 0 AND orders > 0) AS zero_cities, CAST(coalesce(sum(orders) FILTER (covered = 0 AND orders > 0), 0) AS BIGINT) AS zero_orders, count(*) FILTER (pct < 80) AS below80_cities, CAST(coalesce(sum(orders) FILTER (pct < 80), 0) AS BIGINT) AS below80_orders FROM profile")
def city_summary(spark, sf_dir):
    return service.city_summary(_profile(spark, sf_dir))


@query(WITH_NEAR + "SELECT facility.f, CAST(coalesce(sum(w), 0) AS BIGINT) AS orders, count(w) AS prefixes FROM facility LEFT JOIN near ON near.f = facility.f GROUP BY facility.f")
def facility_loads(spark, sf_dir):
    return service.loads(assigned(spark, sf_dir), facilities(spark, sf_dir))


@query(WITH_NEAR + "SELECT city, prefix, round(d, 6) AS d, rank FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY d DESC, prefix) AS rank FROM near) WHERE rank <= 3")
def farthest_by_city(spark, sf_dir):
    return service.farthest(assigned(spark, sf_dir), ["city"]).select("city", "prefix", F.round("d", 6).alias("d"), "rank")


@query(f"WITH {DEMAND_SQL} SELECT rank, f, w FROM (SELECT row_number() OVER (ORDER BY w DESC, prefix) AS rank, prefix AS f, w FROM demand) WHERE rank <= 300")
def candidates_300(spark, sf_dir):
    return service.rank_candidates(demand(spark, sf_dir), 300).select("rank", "f", F.col("fw").alias("w"))


@query(f"WITH {DEMAND_SQL} SELECT rank, f, w FROM (SELECT row_number() OVER (ORDER BY w DESC, prefix DESC) AS rank, prefix AS f, w FROM demand) WHERE rank <= 300")
def candidates_300_reverse(spark, sf_dir):
    return service.rank_candidates(demand(spark, sf_dir), 300, prefix_desc=True).select("rank", "f", F.col("fw").alias("w"))


@query(f"WITH {DEMAND_SQL}, {CAND_SQL}, {CURVE_SQL} SELECT * FROM curve")
def coverage_curve(spark, sf_dir):
    d = demand(spark, sf_dir)
    return service.rank_curve(d, service.rank_candidates(d, 60), RADII)


@query(f"WITH {DEMAND_SQL}, {CAND_SQL}, {CURVE_SQL} SELECT radius_km, min(k) FILTER (covered >= t) AS k_selected, max(covered) AS ceiling, CASE WHEN min(k) FILTER (covered >= t) IS NULL THEN 'structurally_infeasible' ELSE 'selected' END AS status FROM curve, (SELECT (sum(w) * 95 + 99) // 100 AS t FROM demand) GROUP BY radius_km")
def first_feasible_k(spark, sf_dir):
    d = demand(spark, sf_dir)
    total = d.agg(F.sum("w")).first()[0] or 0
    return service.first_feasible(service.rank_curve(d, service.rank_candidates(d, 60), RADII), int(total))


@query()
def mclp_trajectory(spark, sf_dir):
    d = demand(spark, sf_dir)
    return placement.trajectories(d, service.rank_candidates(d, 300), RADII)


@query()
def mclp_first_feasible_k(spark, sf_dir):
    """A row for each radius, and a second one of scope all_candidates where the 300 candidates miss the target."""
    d = demand(spark, sf_dir)
    total = d.agg(F.sum("w")).first()[0] or 0
    return service.first_feasible(mclp_trajectory(spark, sf_dir), int(total), ("radius_km", "scope"))


_SCEN = f"""scen AS (SELECT radius_km, k, seed, covered + (k * 13 + seed * 7) % 5 * 40 AS covered, covered + (k * 13 + seed * 7) % 5 * 40 >= t AS ok FROM curve, (SELECT (sum(w) * 95 + 99) // 100 AS t FROM demand), (SELECT unnest(range(5)) AS seed))"""


def _seeded(spark, sf_dir):
    d = demand(spark, sf_dir)
    total = int(d.agg(F.sum("w")).first()[0] or 0)
    curve = service.rank_curve(d, service.rank_candidates(d, 60), RADII)
    jitter = curve.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("covered", F.col("covered") + (F.col("k") * 13 + F.col("seed") * 7) % 5 * 40)
    return jitter.withColumn("ok", F.col("covered") >= (total * 95 + 99) // 100)


@query(f"WITH {DEMAND_SQL}, {CAND_SQL}, {CURVE_SQL}, {_SCEN} SELECT radius_km, min(k) FILTER (good) AS k_selected, count(*) FILTER (good) AS feasible_k, min(lo) AS covered_min, max(hi) AS covered_max FROM (SELECT radius_km, k, bool_and(ok) AND count(DISTINCT seed) = 5 AS good, min(covered) AS lo, max(covered) AS hi FROM scen GROUP BY radius_km, k) GROUP BY radius_km")
def seeds_all_feasible(spark, sf_dir):
    return compare.all_seeds(_seeded(spark, sf_dir), ["radius_km"], 5)


@query(f"WITH {DEMAND_SQL}, {CAND_SQL}, {CURVE_SQL}, {_SCEN} SELECT radius_km, CAST(seed AS INTEGER) AS seed, min(k) FILTER (ok) AS k_first, count(*) FILTER (was AND NOT ok) AS regressions, bool_or(n = 1 AND ok) AS left_censored FROM (SELECT *, lag(ok) OVER v AS was, row_number() OVER v AS n FROM scen WINDOW v AS (PARTITION BY radius_km, seed ORDER BY k)) GROUP BY radius_km, seed")
def seed_regressions(spark, sf_dir):
    return compare.regressions(_seeded(spark, sf_dir), ["radius_km", "seed"])


_DMU_SQL = WITH_NEAR + ", dmu AS (SELECT f % 5 AS g, f AS dmu, CAST(count(*) AS DOUBLE) AS x1, sum(w * d) / sum(w) + 0.1 AS x2, CAST(sum(w) AS DOUBLE) AS y FROM near GROUP BY f), pr AS (SELECT a.g, a.dmu, a.y, b.y AS py, b.x1 / a.x1 AS r1, b.x2 / a.x2 AS r2, (b.x1 / b.y) / (a.x1 / a.y) AS u, (b.x2 / b.y) / (a.x2 / a.y) AS v FROM dmu a JOIN dmu b ON a.g = b.g) "


def _dmus(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return a.groupBy((F.col("f") % 5).alias("g"), F.col("f").alias("dmu")).agg(F.count("*").cast("double").alias("x1"), (F.sum(F.col("w") * F.col("d")) / F.sum("w") + 0.1).alias("x2"), F.sum("w").cast("double").alias("y"))


@query(_DMU_SQL + "SELECT g, dmu, round(min(greatest(r1, r2)), 6) AS h_fdh FROM pr WHERE py >= y - 1e-6 GROUP BY g, dmu")
def dea_fdh(spark, sf_dir):
    return compare.fdh(_dmus(spark, sf_dir))


@query(_DMU_SQL + "SELECT g, dmu, round(min(h), 6) AS h_ccr FROM (SELECT g, dmu, greatest(u, v) AS h FROM pr UNION ALL SELECT a.g, a.dmu, (a.u * b.v - b.u * a.v) / (a.u - b.u + b.v - a.v) FROM pr a JOIN pr b ON a.g = b.g AND a.dmu = b.dmu AND a.u > a.v AND b.u < b.v) GROUP BY g, dmu")
def dea_ccr(spark, sf_dir):
    return compare.ccr(_dmus(spark, sf_dir))


@query(_DMU_SQL + "SELECT g, dmu, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM dmu a WHERE NOT EXISTS (SELECT 1 FROM dmu b WHERE b.g = a.g AND b.x1 <= a.x1 AND b.x2 <= a.x2 AND (b.x1 < a.x1 OR b.x2 < a.x2))")
def pareto_front(spark, sf_dir):
    return compare.pareto(_dmus(spark, sf_dir), "g", "x1", "x2", "dmu").select("g", "dmu", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


_VALID = RECORD_SQL + ", chk AS (SELECT *, TRY_CAST(lat_text AS DOUBLE) AS lat, CASE WHEN TRY_CAST(lat_text AS DOUBLE) IS NULL THEN 'not_numeric' WHEN abs(TRY_CAST(lat_text AS DOUBLE)) > 90 THEN 'out_of_bounds' ELSE 'valid' END AS status FROM rec), ok AS (SELECT * FROM chk WHERE status = 'valid')"


@query(f"WITH {_VALID} SELECT status, count(*) AS n, count(DISTINCT prefix) AS prefixes FROM chk GROUP BY status")
def record_status(spark, sf_dir):
    return prepare.validate(records(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("prefix").alias("prefixes"))


@query(f"WITH {_VALID} SELECT a.*, n_distinct, lat_dedup FROM (SELECT prefix, count(*) AS n, round(avg(lat), 6) AS lat_mean, round(avg(lng), 6) AS lng_mean, round(median(lat), 6) AS lat_median, round(median(lng), 6) AS lng_median FROM ok GROUP BY prefix) a JOIN (SELECT prefix, count(*) AS n_distinct, round(avg(lat), 6) AS lat_dedup FROM (SELECT DISTINCT prefix, lat, lng FROM ok) GROUP BY prefix) b ON a.prefix = b.prefix")
def coordinate_estimators(spark, sf_dir):
    return prepare.centroids(prepare.validate(records(spark, sf_dir)).where("status = 'valid'"))


#: A square with a square hole.
RINGS = [[(-44.0, -24.0), (-42.0, -24.0), (-42.0, -22.0), (-44.0, -22.0)], [(-43.45, -22.95), (-43.42, -22.95), (-43.42, -22.92), (-43.45, -22.92)]]


def edges(spark: SparkSession) -> DataFrame:
    rows = [("region", *a, *b) for ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return spark.createDataFrame(rows, "poly string, x1 double, y1 double, x2 double, y2 double")


_IN = "(lng BETWEEN -44.0 AND -42.0 AND lat BETWEEN -24.0 AND -22.0 AND NOT (lng > -43.45 AND lng < -43.42 AND lat > -22.95 AND lat < -22.92))"


@query(f"WITH {_VALID} SELECT prefix, count(*) AS n, count(*) FILTER {_IN.replace('(', '(', 1)} AS n_inside, round(CAST(count(*) FILTER {_IN} AS DOUBLE) / count(*), 6) AS share, CASE WHEN 2 * count(*) FILTER {_IN} > count(*) THEN 'majority' WHEN 2 * count(*) FILTER {_IN} = count(*) THEN 'tie' ELSE 'minority' END AS verdict FROM ok GROUP BY prefix")
def inside_shares(spark, sf_dir):
    points = prepare.validate(records(spark, sf_dir)).where("status = 'valid'").select("record", "prefix", "lat", "lng")
    return prepare.shares_inside(prepare.inside(points, edges(spark)))


@query("SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{k}-%') AS p{k}" for k in range(1, 6)) + " FROM orders GROUP BY o_orderstatus")
def status_by_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("p", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    return o.groupBy("o_orderstatus").pivot("p", [f"p{k}" for k in range(1, 6)]).agg(F.count("o_orderkey")).na.fill(0)


@query(f"WITH {DEMAND_SQL} SELECT CAST(least(floor(w / 2.0), 49) AS BIGINT) + 1 AS bin, count(*) AS prefixes FROM demand GROUP BY 1")
def weight_histogram(spark, sf_dir):
    return demand(spark, sf_dir).groupBy((F.least(F.floor(F.col("w") / 2.0), F.lit(49)).cast("long") + 1).alias("bin")).agg(F.count("*").alias("prefixes"))


@query("SELECT r_name AS region, year(o_orderdate) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def orders_by_region_year(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").where("o_orderstatus = 'F'")
    return o.join(t("customer"), o.o_custkey == F.col("c_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("region"), F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("SELECT c_custkey AS prefix, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS key5, lower(trim(c_mktsegment)) AS segment FROM customer WHERE c_custkey < 100000")
def text_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("prefix"), geo.prefix_key(F.col("c_custkey").cast("string")).alias("key5"), geo.city_key(F.col("c_mktsegment")).alias("segment"))


@query()
def geodesic_error(spark, sf_dir):
    a = assigned(spark, sf_dir).join(F.broadcast(facilities(spark, sf_dir)), "f")
    g = geo.geodesic(F.col("lat"), F.col("lng"), F.col("flat"), F.col("flng"))
    return a.agg(F.round(F.max(F.abs(g - F.col("d"))), 6).alias("largest_km"), F.round(F.max(F.abs(g / F.col("d") - 1)), 6).alias("largest_ratio"))


@query()
def placements(spark, sf_dir):
    d = demand(spark, sf_dir)
    top = service.rank_candidates(d, 300)
    some = spark.createDataFrame([("mclp", 10, 20.0, 0), ("p_median", 10, 0.0, 0), ("k_means", 10, 0.0, 42), ("ward", 10, 0.0, 0), ("complete", 10, 0.0, 0), ("average", 10, 0.0, 0), ("dbscan", 0, 3.0, 0)], "method string, k int, radius_km double, seed int")
    return placement.place(d, top, some)


_SPREAD = f"""{DEMAND_SQL}, {FACILITY_SQL}, {_VALID[_VALID.index("rec AS"):]}, cnt AS (SELECT prefix, count(*) AS n FROM ok GROUP BY prefix),
  pts AS (SELECT row_number() OVER () AS id, * FROM (SELECT ok.lat, ok.lng, demand.w / CAST(n AS DOUBLE) AS w FROM ok JOIN demand USING (prefix) JOIN cnt USING (prefix) UNION ALL SELECT lat, lng, CAST(w AS DOUBLE) FROM demand WHERE prefix NOT IN (SELECT prefix FROM cnt))),
  far AS (SELECT any_value(w) AS w, round(min({D_SQL}), 9) AS d FROM pts, facility GROUP BY id), run AS (SELECT d, w, sum(w) OVER (ORDER BY d) AS c FROM far), tot AS (SELECT sum(w) AS t FROM far)"""


@query(f"WITH {_SPREAD} SELECT round(max(t), 6) AS orders, round(sum(CASE WHEN d <= 20 THEN w ELSE 0 END), 6) AS covered, round(100 * sum(CASE WHEN d <= 20 THEN w ELSE 0 END) / max(t), 6) AS pct, " + ", ".join(f"round(coalesce(min(d) FILTER (c >= t * {p / 100}::DOUBLE - 1e-9 * t), max(d)), 6) AS p{p}" for p in (50, 95, 99)) + " FROM run, tot")
def fractional_service(spark, sf_dir):
    points = prepare.validate(records(spark, sf_dir)).where("status = 'valid'")
    return variants.fractional_service(service.nearest(variants.spread(demand(spark, sf_dir), points), facilities(spark, sf_dir)), 20.0)


_CAND2_SQL = CAND_SQL.replace("cand AS", "cand2 AS").replace("prefix) AS rank", "prefix DESC) AS rank").replace("prefix LIMIT", "prefix DESC LIMIT")


@query(f"WITH {DEMAND_SQL}, {CAND_SQL}, {_CAND2_SQL} SELECT f, 'entered' AS change FROM cand2 WHERE f NOT IN (SELECT f FROM cand) UNION ALL SELECT f, 'exited' FROM cand WHERE f NOT IN (SELECT f FROM cand2)")
def candidate_change(spark, sf_dir):
    d = demand(spark, sf_dir)
    return variants.set_change(service.rank_candidates(d, 60), service.rank_candidates(d, 60, prefix_desc=True), "f")


_RES = f"""res AS (SELECT radius_km, method, v AS variant, min(k) FILTER (covered * 100 >= v * t) AS k FROM (SELECT *, 'ranked' AS method FROM curve UNION ALL SELECT *, 'reversed' FROM curve2), (SELECT sum(w) AS t FROM demand), (SELECT unnest([1, 4, 8]) AS v) GROUP BY ALL),
  span AS (SELECT radius_km, method, min(k) AS lo, max(k) AS hi, count(k) AS n FROM res GROUP BY ALL)"""


@query(f"""WITH {DEMAND_SQL}, {CAND_SQL}, {_CAND2_SQL}, {CURVE_SQL}, {CURVE_SQL.replace("curve AS", "curve2 AS").replace("cand", "cand2")}, {_RES}
  SELECT a.radius_km, a.method AS method_a, b.method AS method_b, a.lo AS lo_a, a.hi AS hi_a, b.lo AS lo_b, b.hi AS hi_b, CASE WHEN a.n < 3 OR b.n < 3 THEN 'incomplete_variants_no_classification' WHEN a.lo <= b.hi AND b.lo <= a.hi THEN 'absence_of_robust_descriptive_separation'
    WHEN (SELECT bool_and(x.k < y.k) OR bool_and(x.k > y.k) FROM res x JOIN res y USING (radius_km, variant) WHERE x.radius_km = a.radius_km AND x.method = a.method AND y.method = b.method) THEN 'stable_observed_order' ELSE 'order_changes_between_variants' END AS label
  FROM span a JOIN span b ON a.radius_km = b.radius_km AND a.method < b.method""")
def method_agreement(spark, sf_dir):
    """Two candidate orders as methods, three coverage shares as variants."""
    d = demand(spark, sf_dir)
    total = int(d.agg(F.sum("w")).first()[0] or 0)
    curve = lambda desc, name: service.rank_curve(d, service.rank_candidates(d, 60, prefix_desc=desc), RADII).withColumn("method", F.lit(name))
    both = curve(False, "ranked").unionByName(curve(True, "reversed")).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in (1, 4, 8)])))
    least = both.groupBy("radius_km", "method", "variant").agg(F.min(F.when(F.col("covered") * 100 >= F.col("variant") * total, F.col("k"))).cast("long").alias("k"))
    return variants.agreement(least, 3)


@query(f"WITH {DEMAND_SQL}, {_VALID[_VALID.index('rec AS'):]} SELECT prefix, city, w FROM demand WHERE prefix IN (SELECT prefix FROM ok GROUP BY prefix HAVING 2 * count(*) FILTER {_IN} >= count(*))")
def cohort_inside(spark, sf_dir):
    points = prepare.validate(records(spark, sf_dir)).where("status = 'valid'").select("record", "prefix", "lat", "lng")
    return variants.cohort(demand(spark, sf_dir), prepare.shares_inside(prepare.inside(points, edges(spark))), ties=True).select("prefix", "city", "w")


@query(WITH_NEAR + "," + _PROFILE + " UNION ALL ".join(f"SELECT CAST(city AS BIGINT) AS city, '{c}' AS field, CAST({c} AS DOUBLE) AS value, 'city_profile' AS source FROM profile" for c in ("orders", "covered", "outside", "pct", "mean_km", "max_km")))
def profile_catalogue(spark, sf_dir):
    return variants.catalogue(_profile(spark, sf_dir), ["city"], F.lit("city_profile"))
