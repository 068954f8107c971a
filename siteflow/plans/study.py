"""Queries of a study's steps around its networks, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteflow.functions import geo
from siteflow.operators import compare, prepare, service, study
from siteflow.plans.catalogue import _DMU_SQL, CAND_SQL, CURVE_SQL, RADII, WITH_NEAR, _dmus, assigned, query
from siteflow.sources.tables import DEMAND_SQL, FACILITY_SQL, demand, facilities, records, table

STATES = {"F": "delivered", "O": "open"}
FLAGS = ("R", "A")


@query("SELECT n_name AS city, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'ASIA') AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_6') GROUP BY n_name")
def customers_in_scope(spark, sf_dir):
    """Membership of region and city."""
    cities = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name").isin("AMERICA", "ASIA") & F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3", "NATION_6"))
    return table(spark, sf_dir, "customer").join(cities, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city")).agg(F.count("*").alias("customers"))


@query("SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def orders_outside_scope(spark, sf_dir):
    scope = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    cohort = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return study.outside_scope(table(spark, sf_dir, "orders"), scope, cohort, "o_custkey", "o_orderkey").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@query(WITH_NEAR + "SELECT count(*) FILTER (d IS NULL) AS lost, 0::BIGINT AS ambiguous, count(*) AS rows FROM orders LEFT JOIN near ON prefix = o_custkey")
def distance_lookup_loss(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("prefix"))
    return study.lookup(orders, assigned(spark, sf_dir).select("prefix", "d"), "prefix")[1]


@query(f"WITH {DEMAND_SQL} SELECT count(*) AS rows, CAST(sum(w) AS BIGINT) AS orders, count(*) FILTER (w IS DISTINCT FROM n) AS differ FROM demand FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = prefix")
def order_conservation(spark, sf_dir):
    """The orders of the demand table against the orders themselves, key by key."""
    counted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("prefix")).agg(F.count("*").alias("n"))
    both = demand(spark, sf_dir).select("prefix", "w").join(counted, "prefix", "full")
    return both.agg(F.count("*").alias("rows"), F.sum("w").alias("orders"), F.count_if(~F.col("w").eqNullSafe(F.col("n"))).alias("differ"))


_REVIEW_SQL = """WITH need AS (SELECT event_id AS record, user_id AS prefix, value FROM events WHERE event_id % 97 < 2),
  dec AS (SELECT event_id AS record, user_id AS prefix, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 97 < 3 AND event_id % 11 <> 0)
  SELECT (SELECT count(*) FROM need WHERE EXISTS (SELECT 1 FROM dec WHERE dec.record = need.record AND dec.prefix = need.prefix AND dec.value = need.value)) AS matched,
  (SELECT count(*) FROM need WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.record = need.record AND dec.prefix = need.prefix AND dec.value = need.value)) AS missing,
  (SELECT count(*) FROM dec WHERE NOT EXISTS (SELECT 1 FROM need WHERE dec.record = need.record AND dec.prefix = need.prefix AND dec.value = need.value)) AS unused"""


@query(_REVIEW_SQL)
def review_completeness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("record"), F.col("user_id").alias("prefix"), "value")
    dec = e.where("record % 97 < 3 and record % 11 != 0").withColumn("value", F.when(F.col("record") % 5 == 0, F.col("value") + 1).otherwise(F.col("value"))).withColumn("decision", F.lit("keep"))
    return study.reviewed(e.withColumn("needed", F.col("record") % 97 < 2), dec, ["record", "prefix", "value"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_linenumber) AS no FROM lineitem) WHERE no = 1")
def first_item_by_flag(spark, sf_dir):
    """Deduplication after a sort by a custom order of categories."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return study.first_by_priority(items, ["l_orderkey"], [study.category_rank(F.col("l_returnflag"), FLAGS), F.col("l_linenumber")])


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS state, string_agg(DISTINCT o_orderpriority, '/' ORDER BY o_orderpriority) AS priorities, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (regexp_matches(o_orderpriority, 'HIGH|LOW')) AS high_or_low FROM orders GROUP BY 1")
def labelled_states(spark, sf_dir):
    """Codes as labels, the union of labels of a group, filters by pattern."""
    state, p = study.label_of(F.col("o_orderstatus"), STATES).alias("state"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(state).agg(F.array_join(F.sort_array(F.collect_set(p)), "/").alias("priorities"), F.count_if(p.startswith("1")).alias("urgent"), F.count_if(p.rlike("HIGH|LOW")).alias("high_or_low"))


@query("SELECT c_mktsegment AS segment, count(*) FILTER (c_nationkey % 3 = 0) AS g0, count(*) FILTER (c_nationkey % 3 = 1) AS g1, count(*) FILTER (c_nationkey % 3 = 2) AS g2, round(avg(c_acctbal) FILTER (c_nationkey % 3 = 0), 4) AS b0 FROM customer GROUP BY 1")
def segment_pivot(spark, sf_dir):
    """Group sizes and a mean, spread over columns."""
    c = table(spark, sf_dir, "customer").withColumn("g", (F.col("c_nationkey") % 3).cast("int"))
    p = c.groupBy(F.col("c_mktsegment").alias("segment")).pivot("g", [0, 1, 2]).agg(F.count("c_custkey").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("b"))
    n = lambda k: F.coalesce(f"{k}_n", F.lit(0)).alias(f"g{k}")
    return p.select("segment", n(0), n(1), n(2), F.col("0_b").alias("b0"))


@query("SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 3 THEN CAST(s_suppkey AS VARCHAR) ELSE lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END AS key3, replace(printf('%.2f', CAST(s_acctbal AS DOUBLE)), '.', ',') AS balance, 'J' || CAST(s_nationkey AS VARCHAR) || '_R' || CAST(s_suppkey % 7 AS VARCHAR) || '_T' || replace(CAST(CAST(s_suppkey % 40 AS DOUBLE) / 8 AS DECIMAL(6,3))::DOUBLE::VARCHAR, '.0', '').replace('.', 'p') AS scenario FROM supplier")
def text_formats(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    limit = (F.col("s_suppkey") % 40).cast("double") / 8
    return s.select("s_suppkey", study.zfill(F.col("s_suppkey").cast("string"), 3).alias("key3"), study.decimal_comma(F.col("s_acctbal"), 2).alias("balance"), study.scenario_id(F.concat(F.lit("J"), F.col("s_nationkey").cast("string")), F.col("s_suppkey") % 7, limit).alias("scenario"))


_ACCENTED = "' São-'||n_name||' Ñandú Çø '"


@query(f"SELECT n_nationkey, replace(lower(trim(strip_accents({_ACCENTED}))), 'ø', '') AS ascii, lower(trim(strip_accents(replace({_ACCENTED}, 'ø', '~')))).replace('~', 'ø') AS letters, CASE WHEN n_nationkey % 3 = 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 5, '0') END AS strict FROM nation")
def accented_names(spark, sf_dir):
    """Names with accents in both normal forms, and keys that are refused."""
    name = F.concat(F.lit(" São-"), F.col("n_name"), F.lit(" Ñandú Çø "))
    key = F.col("n_nationkey").cast("string")
    odd = F.when(F.col("n_nationkey") % 3 == 0, key).when(F.col("n_nationkey") % 3 == 1, F.concat(key, F.lit("-000"))).otherwise(F.concat(key, F.lit("123456")))
    return table(spark, sf_dir, "nation").select("n_nationkey", geo.city_key(name).alias("ascii"), geo.city_key(name, ascii_only=False).alias("letters"), geo.prefix_key(odd).alias("strict"))


_NATIVE = """nat AS (SELECT near.prefix, near.w, near.f AS nearest_f, near.d, facility.f, 2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(flat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(flat)) * pow(sin(radians(flng - lng) / 2), 2))))) AS native_d
  FROM near JOIN facility ON facility.f = near.prefix % (SELECT count(*) FROM facility) + 1)"""


def _native(spark, sf_dir):
    """An assignment that isn't the nearest one: by a remainder of the key."""
    sites, d = facilities(spark, sf_dir), demand(spark, sf_dir)
    own = d.join(sites, F.col("f") == F.col("prefix") % sites.count() + 1).withColumn("native_d", geo.haversine(F.col("lat"), F.col("lng"), F.col("flat"), F.col("flng")))
    return study.native_against_nearest(own, assigned(spark, sf_dir))


@query(WITH_NEAR + f", {_NATIVE} SELECT count(*) AS prefixes, count(*) FILTER (f <> nearest_f) AS moved, round(sum(w * native_d) / sum(w), 6) AS native_mean, round(sum(w * d) / sum(w), 6) AS nearest_mean, CAST(sum(CASE WHEN f <> nearest_f THEN w ELSE 0 END) AS BIGINT) AS moved_orders FROM nat")
def native_against_nearest(spark, sf_dir):
    w = F.col("w")
    return _native(spark, sf_dir).agg(F.count("*").alias("prefixes"), F.count_if("moved").alias("moved"), F.round(F.sum(w * F.col("native_d")) / F.sum(w), 6).alias("native_mean"), F.round(F.sum(w * F.col("d")) / F.sum(w), 6).alias("nearest_mean"), F.sum(F.when(F.col("moved"), w).otherwise(0)).alias("moved_orders"))


@query(WITH_NEAR + f", {_NATIVE} SELECT f, prefix, round(native_d - d, 6) AS gain, rank FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY native_d - d DESC, prefix) AS rank FROM nat) WHERE rank <= 3")
def largest_reductions(spark, sf_dir):
    rows = _native(spark, sf_dir).select("f", "prefix", F.col("gain").alias("d"))
    return service.farthest(rows, ["f"]).select("f", "prefix", F.round("d", 6).alias("gain"), "rank")


def _two_fifths(spark, sf_dir):
    d = demand(spark, sf_dir)
    total = int(d.agg(F.sum("w")).first()[0] or 0)
    return study.along_k(service.rank_curve(d, service.rank_candidates(d, 60), RADII), ["radius_km"], total * 2 // 5)


@query(f"WITH {DEMAND_SQL}, {CAND_SQL}, {CURVE_SQL} SELECT radius_km, min(k) AS k, min_by(margin, k) AS margin, min_by(before, k) AS margin_before FROM (SELECT radius_km, k, covered - t AS margin, lag(covered - t) OVER (PARTITION BY radius_km ORDER BY k) AS before FROM curve, (SELECT CAST(sum(w) * 2 // 5 AS BIGINT) AS t FROM demand)) WHERE margin >= 0 GROUP BY radius_km")
def margin_before_first_k(spark, sf_dir):
    return _two_fifths(spark, sf_dir)


@query(WITH_NEAR + """SELECT r.radius_km, m.metric, m.e AS expected, m.e AS observed, true AS ok FROM (SELECT radius_km, CAST(sum(w) AS DOUBLE) AS orders, CAST(sum(CASE WHEN d <= radius_km THEN w ELSE 0 END) AS DOUBLE) AS covered
  FROM near CROSS JOIN (SELECT unnest([10.0::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE]) AS radius_km) GROUP BY radius_km) r, LATERAL (SELECT unnest(['orders', 'covered']) AS metric, unnest([orders, covered]) AS e) m""")
def coverage_checks(spark, sf_dir):
    """Coverage by the registered operator against coverage recomputed with the other distance and another plan."""
    far = service.nearest(demand(spark, sf_dir), facilities(spark, sf_dir), geo.haversine_atan2)
    again = [far.agg(F.lit(r).alias("radius_km"), F.sum("w").alias("orders"), F.sum(F.when(F.col("d") <= r, F.col("w")).otherwise(0)).alias("covered")) for r in RADII]
    observed = again[0].unionByName(again[1]).unionByName(again[2])
    return study.checks(service.coverage(assigned(spark, sf_dir), RADII), observed, ["radius_km"], ["orders", "covered"])


@query("WITH m AS (SELECT user_id AS prefix, avg(-23.0 + CAST((event_id * 7919) % 100000 AS DOUBLE) / 1e6) AS lat, avg(-43.5 + CAST((event_id * 104729) % 100000 AS DOUBLE) / 1e6) AS lng FROM events WHERE event_id % 97 > 1 GROUP BY user_id) SELECT count(*) AS prefixes, count(*) FILTER (NOT (lat BETWEEN -22.96 AND -22.94 AND lng BETWEEN -43.46 AND -43.44)) AS outside FROM m")
def mean_audit(spark, sf_dir):
    """Means of a prefix's records outside a region are counted, not dropped."""
    valid = prepare.validate(records(spark, sf_dir)).where("status = 'valid'")
    means = valid.groupBy("prefix").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    return study.flagged_outside(means, (-22.96, -43.46, -22.94, -43.44)).agg(F.count("*").alias("prefixes"), F.count_if("outside").alias("outside"))


@query(f"WITH {DEMAND_SQL} SELECT rank, f, w, eligible FROM (SELECT row_number() OVER (ORDER BY w DESC, prefix) AS rank, 'postal_' || CAST(prefix AS VARCHAR) AS f, w, true AS eligible FROM demand WHERE city % 4 <> 0)")
def eligible_candidates(spark, sf_dir):
    """Every eligible demand point as a candidate with its provenance in the id; demand itself isn't filtered."""
    rows = service.rank_candidates(demand(spark, sf_dir).where("city % 4 != 0"))
    return rows.select("rank", F.concat(F.lit("postal_"), F.col("f").cast("string")).alias("f"), F.col("fw").alias("w"), F.lit(True).alias("eligible"))


_FIXED = _DMU_SQL.replace("CAST(sum(w) AS DOUBLE) AS y", "CAST(1 AS DOUBLE) AS y")
_CCR_TAIL = "SELECT g, dmu, round(min(h), 6) AS h_ccr FROM (SELECT g, dmu, greatest(u, v) AS h FROM pr UNION ALL SELECT a.g, a.dmu, (a.u * b.v - b.u * a.v) / (a.u - b.u + b.v - a.v) FROM pr a JOIN pr b ON a.g = b.g AND a.dmu = b.dmu AND a.u > a.v AND b.u < b.v) GROUP BY g, dmu"


@query(_FIXED + _CCR_TAIL)
def dea_fixed_output(spark, sf_dir):
    return compare.ccr(_dmus(spark, sf_dir).withColumn("y", F.lit(1.0)))


@query(_DMU_SQL.replace("FROM near GROUP BY f)", "FROM near WHERE f % 2 = 0 GROUP BY f)") + _CCR_TAIL)
def dea_methods_only(spark, sf_dir):
    """Efficiency among a part of the units only."""
    return compare.ccr(_dmus(spark, sf_dir).where("dmu % 2 = 0"))


_SPREAD = """v AS (SELECT user_id AS prefix, CAST(CAST(-23.0 + CAST((event_id * 7919) % 100000 AS DOUBLE) / 1e6 AS DECIMAL(12,6)) AS DOUBLE) AS lat, -43.5 + CAST((event_id * 104729) % 100000 AS DOUBLE) / 1e6 AS lng FROM events WHERE event_id % 97 > 1),
  m AS (SELECT *, avg(lat) OVER (PARTITION BY prefix) AS flat, avg(lng) OVER (PARTITION BY prefix) AS flng FROM v),
  s AS (SELECT prefix, 2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(flat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(flat)) * pow(sin(radians(flng - lng) / 2), 2))))) AS d FROM m),
  p AS (SELECT prefix, count(*) AS n, round(quantile_cont(d, 0.5), 5) AS p50, round(quantile_cont(d, 0.9), 5) AS p90, round(max(d), 5) AS max FROM s GROUP BY prefix)"""


def _dispersion(spark, sf_dir):
    return prepare.dispersion(prepare.validate(records(spark, sf_dir)).where("status = 'valid'"), geo.haversine)


@query(f"WITH {_SPREAD} SELECT prefix, n, p50, p90, max FROM p")
def record_dispersion(spark, sf_dir):
    d = _dispersion(spark, sf_dir)
    return d.toDF("prefix", "n", "p50", "p90", "max", *d.columns[5:]).select("prefix", "n", "p50", "p90", "max")


@query(f"WITH {_SPREAD} SELECT t.km, count(*) FILTER (max > t.km) AS prefixes, CAST(sum(CASE WHEN max > t.km THEN n ELSE 0 END) AS BIGINT) AS records FROM p CROSS JOIN (SELECT unnest([2.0::DOUBLE, 5.0::DOUBLE, 7.0::DOUBLE]) AS km) t GROUP BY t.km")
def dispersion_thresholds(spark, sf_dir):
    """Prefixes, and records in them, whose farthest record lies beyond each threshold."""
    d = _dispersion(spark, sf_dir)
    d = d.toDF("prefix", "n", "p50", "p90", "max", *d.columns[5:]).withColumn("km", F.explode(F.array(F.lit(2.0), F.lit(5.0), F.lit(7.0))))
    return d.groupBy("km").agg(F.count_if(F.col("max") > F.col("km")).alias("prefixes"), F.sum(F.when(F.col("max") > F.col("km"), F.col("n")).otherwise(0)).alias("records"))


@query(WITH_NEAR + "SELECT a.prefix, b.prefix AS other, round(2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))), 6) AS d FROM near a JOIN near b ON a.prefix < b.prefix WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))) <= 2")
def demand_neighbours(spark, sf_dir):
    """Pairs of demand points at most 2 km apart, by cells."""
    d = demand(spark, sf_dir)
    other = d.select(F.col("prefix").alias("f"), F.col("lat").alias("flat"), F.col("lng").alias("flng"))
    return service.within(d, other, 2.0).where("prefix < f").select("prefix", F.col("f").alias("other"), F.round("d", 6).alias("d"))


@query("SELECT CASE WHEN n_returned > 0 THEN 'returned' ELSE 'kept' END AS kind, count(*) AS orders, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1) GROUP BY 1")
def order_shares(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    g = o.groupBy(F.when(F.col("n") > 0, "returned").otherwise("kept").alias("kind")).agg(F.count("*").alias("orders"))
    return g.crossJoin(g.agg(F.sum("orders").alias("total"))).select("kind", "orders", F.round(100.0 * F.col("orders") / F.col("total"), 6).alias("share"))


_EXCESS = "h AS (SELECT radius_km, min(k) FILTER (covered >= t) AS k FROM curve, (SELECT sum(w) * 2 // 5 AS t FROM demand) GROUP BY radius_km), ref AS (SELECT radius_km, k, least(k, radius_km / 10 + 1) AS lower FROM h)"


@query(f"WITH {DEMAND_SQL}, {CAND_SQL}, {CURVE_SQL}, {_EXCESS} SELECT a.radius_km, b.radius_km AS other, a.k - b.lower AS gap, round(100.0 * (a.k - b.lower) / b.lower, 6) AS excess_pct, a.k <= b.k + 1e-9 AS no_more_sites FROM ref a JOIN ref b ON a.radius_km <= b.radius_km")
def cardinality_excess(spark, sf_dir):
    """Network sizes against lower bounds at the same and larger radii: gap, excess in percent, dominance within a tolerance."""
    first = _two_fifths(spark, sf_dir).select("radius_km", "k")
    ref = first.withColumn("lower", F.least(F.col("k").cast("double"), F.col("radius_km") / 10 + 1))
    other = ref.select(F.col("radius_km").alias("other"), F.col("k").alias("other_k"), F.col("lower").alias("bound"))
    gap = F.col("k") - F.col("bound")
    return ref.join(other, F.col("radius_km") <= F.col("other")).select("radius_km", "other", gap.alias("gap"), F.round(100.0 * gap / F.col("bound"), 6).alias("excess_pct"), (F.col("k") <= F.col("other_k") + 1e-9).alias("no_more_sites"))
