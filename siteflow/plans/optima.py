"""Queries of envelopment details, exact optima over pairs of sites and stepwise placement, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteflow.operators import compare, optima, service
from siteflow.plans.catalogue import _DMU_SQL, D_SQL, RADII, _dmus, query
from siteflow.sources.tables import DEMAND_SQL, demand

CANDIDATES = 30
_CAND = f"cand AS (SELECT row_number() OVER (ORDER BY w DESC, prefix) AS rank, prefix AS f, lat AS flat, lng AS flng FROM demand ORDER BY w DESC, prefix LIMIT {CANDIDATES})"
_FAR = f"far AS (SELECT prefix, w, f, rank, {D_SQL} AS d FROM demand, cand)"
_HEAD = f"WITH {DEMAND_SQL}, {_CAND}, {_FAR}"


@query(_DMU_SQL + """, c AS (SELECT g, dmu, greatest(u, v) AS h, u AS a, v AS b FROM pr UNION ALL SELECT a.g, a.dmu, (a.u * b.v - b.u * a.v) / (a.u - b.u + b.v - a.v) AS h, h, h FROM pr a JOIN pr b ON a.g = b.g AND a.dmu = b.dmu AND a.u > a.v AND b.u < b.v),
  best AS (SELECT g, dmu, h, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g, dmu ORDER BY round(h, 12), round(a + b, 12)) AS no FROM c) WHERE no = 1),
  s AS (SELECT best.g, best.dmu, h, x1, x2, CASE WHEN (h - a) * x1 < 1e-9 THEN 0.0::DOUBLE ELSE (h - a) * x1 END AS s1, CASE WHEN (h - b) * x2 < 1e-9 THEN 0.0::DOUBLE ELSE (h - b) * x2 END AS s2 FROM best JOIN dmu ON dmu.g = best.g AND dmu.dmu = best.dmu)
  SELECT g, dmu, round(h, 6) AS h, round(s1, 6) AS s1, round(s2, 6) AS s2, round(h * x1 - s1, 6) AS target1, round(h * x2 - s2, 6) AS target2, CASE WHEN h <= 1 - 1e-6 THEN 'ineficiente' WHEN greatest(s1, s2) < 1e-4 THEN 'Pareto eficiente' ELSE 'fracamente eficiente' END AS class FROM s""")
def dea_slacks(spark, sf_dir):
    """Second phase of CCR: slacks, targets, classes."""
    r = lambda c: F.round(c, 6).alias(c)
    return compare.ccr_full(_dmus(spark, sf_dir)).select("g", "dmu", *map(r, ("h", "s1", "s2", "target1", "target2")), "class")


_BCC = """, q AS (SELECT a.g, a.dmu, b.dmu AS p, b.x1 / a.x1 AS a, b.x2 / a.x2 AS b, b.x1 / a.x1 - b.x2 / a.x2 AS d, b.y - a.y AS e FROM dmu a JOIN dmu b ON a.g = b.g),
  one AS (SELECT g, dmu, greatest(a, b) AS h FROM q WHERE e >= 0),
  pair AS (SELECT i.g, i.dmu, i.a AS ia, i.b AS ib, i.d AS id, i.e AS ie, j.a AS ja, j.b AS jb, j.d AS jd, j.e AS je FROM q i JOIN q j ON i.g = j.g AND i.dmu = j.dmu AND i.p < j.p),
  level AS (SELECT g, dmu, s * ia + (1 - s) * ja AS h FROM (SELECT *, jd / (jd - id) AS s FROM pair WHERE id * jd < 0) WHERE s * ie + (1 - s) * je >= -1e-9),
  tight AS (SELECT g, dmu, greatest(s * ia + (1 - s) * ja, s * ib + (1 - s) * jb) AS h FROM (SELECT *, je / (je - ie) AS s FROM pair WHERE ie * je < 0)),
  tri AS (SELECT p.g, p.dmu, ia, ja, k.a AS ka, jd * k.e - k.d * je AS wi, k.d * ie - id * k.e AS wj, id * je - jd * ie AS wk FROM pair p JOIN q k ON k.g = p.g AND k.dmu = p.dmu WHERE abs(jd * k.e - k.d * je + k.d * ie - id * k.e + id * je - jd * ie) > 1e-12),
  three AS (SELECT g, dmu, (wi * ia + wj * ja + wk * ka) / (wi + wj + wk) AS h FROM tri WHERE wi / (wi + wj + wk) >= 0 AND wj / (wi + wj + wk) >= 0 AND wk / (wi + wj + wk) >= 0)
  SELECT g, dmu, round(min(h), 6) AS h_bcc FROM (SELECT * FROM one UNION ALL SELECT * FROM level UNION ALL SELECT * FROM tight UNION ALL SELECT * FROM three) GROUP BY g, dmu"""


@query(_DMU_SQL + _BCC)
def dea_bcc(spark, sf_dir):
    return compare.bcc(_dmus(spark, sf_dir))


_NETS = "net AS (SELECT f % 5 AS g, f AS dmu, x1 AS k, x2 AS mean, x1 + x2 AS far FROM (SELECT f, dmu.x1, dmu.x2 FROM dmu JOIN (SELECT DISTINCT f FROM near) ON f = dmu)) "


@query(_DMU_SQL.rstrip() + f", {_NETS} SELECT g, dmu, bool_or(o.k <= n.k + 1e-9 AND o.far <= n.far + 1e-9 AND (o.k < n.k - 1e-9 OR o.far < n.far - 1e-9)) AS by_k_max, bool_or(o.k <= n.k + 1e-9 AND o.mean <= n.mean + 1e-9 AND o.far <= n.far + 1e-9 AND (o.k < n.k - 1e-9 OR o.mean < n.mean - 1e-9 OR o.far < n.far - 1e-9)) AS by_all FROM net n JOIN (SELECT g AS og, k, mean, far FROM net) o ON og = g GROUP BY g, dmu")
def profile_dominance(spark, sf_dir):
    """Whether some network of the profile is as good in every measure and better in one, for two sets of measures."""
    nets = _dmus(spark, sf_dir).select("g", "dmu", F.col("x1").alias("k"), F.col("x2").alias("mean"), (F.col("x1") + F.col("x2")).alias("far"))
    return compare.dominance_flags(nets, "g", "dmu", {"by_k_max": ["k", "far"], "by_all": ["k", "mean", "far"]})


@query(_HEAD + """, r AS (SELECT unnest([10.0::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE]) AS radius_km), hit AS (SELECT radius_km, prefix, w, rank FROM far, r WHERE d <= radius_km),
  p AS (SELECT radius_km, a.rank AS i, b.rank AS j FROM r, cand a, cand b WHERE a.rank < b.rank), alone AS (SELECT radius_km, rank, sum(w) AS c FROM hit GROUP BY ALL),
  twice AS (SELECT a.radius_km, a.rank AS i, b.rank AS j, sum(a.w) AS c FROM hit a JOIN hit b ON a.radius_km = b.radius_km AND a.prefix = b.prefix AND a.rank < b.rank GROUP BY ALL),
  v AS (SELECT p.radius_km, p.i, p.j, coalesce(x.c, 0) + coalesce(y.c, 0) - coalesce(t.c, 0) AS c FROM p LEFT JOIN alone x ON x.radius_km = p.radius_km AND x.rank = p.i LEFT JOIN alone y ON y.radius_km = p.radius_km AND y.rank = p.j LEFT JOIN twice t ON t.radius_km = p.radius_km AND t.i = p.i AND t.j = p.j)
  SELECT radius_km, i AS first, j AS second, CAST(c AS BIGINT) AS covered, pairs FROM (SELECT *, row_number() OVER (PARTITION BY radius_km ORDER BY c DESC, i, j) AS no, count(*) OVER (PARTITION BY radius_km) AS pairs FROM v) WHERE no = 1""")
def exact_cover_pair(spark, sf_dir):
    """The two of the heaviest candidates that cover most, proven by every pair."""
    d = demand(spark, sf_dir)
    return optima.best_cover_pair(d, service.rank_candidates(d, CANDIDATES), RADII)


@query(_HEAD + " SELECT i AS first, j AS second, round(c, 4) AS cost FROM (SELECT a.rank AS i, b.rank AS j, sum(a.w * least(a.d, b.d)) AS c FROM far a JOIN far b ON a.prefix = b.prefix AND a.rank < b.rank GROUP BY ALL) ORDER BY round(c, 6), i, j LIMIT 1")
def exact_median_pair(spark, sf_dir):
    """The two of the heaviest candidates with the least weighted distance, proven by every pair."""
    d = demand(spark, sf_dir)
    return optima.best_median_pair(d, service.rank_candidates(d, CANDIDATES)).select("first", "second", F.round("cost", 4).alias("cost"))


def _greedy_sql(steps: int) -> str:
    parts = [_HEAD, ", b0 AS (SELECT prefix, CAST('infinity' AS DOUBLE) AS best FROM demand)"]
    for k in range(1, steps + 1):
        parts.append(f", s{k} AS (SELECT rank, sum(w * least(d, best)) AS c FROM far JOIN b{k - 1} USING (prefix) GROUP BY rank ORDER BY round(c, 6), rank LIMIT 1)")
        parts.append(f", b{k} AS (SELECT prefix, least(best, d) AS best FROM b{k - 1} JOIN far USING (prefix) WHERE rank = (SELECT rank FROM s{k}))")
    return "".join(parts) + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, rank, round(c, 4) AS cost FROM s{k}" for k in range(1, steps + 1))


@query(_greedy_sql(4))
def pmedian_greedy_steps(spark, sf_dir):
    d = demand(spark, sf_dir)
    return optima.greedy_median(d, service.rank_candidates(d, CANDIDATES), 4).select("step", "rank", F.round("cost", 4).alias("cost"))


def _lloyd_sql(k: int, rounds: int) -> str:
    parts = [f"WITH {DEMAND_SQL}, c0 AS (SELECT row_number() OVER (ORDER BY w DESC, prefix) AS no, lat AS clat, lng AS clng FROM demand ORDER BY w DESC, prefix LIMIT {k})"]
    for r in range(1, rounds + 1):
        parts.append(f", a{r} AS (SELECT prefix, any_value(lat) AS lat, any_value(lng) AS lng, any_value(demand.w) AS w, min_by(no, (lat - clat) * (lat - clat) + (lng - clng) * (lng - clng)) AS no FROM demand, c{r - 1} GROUP BY prefix)")
        parts.append(f", c{r} AS (SELECT no, sum(w * lat) / sum(w) AS clat, sum(w * lng) / sum(w) AS clng, sum(w) AS w FROM a{r} GROUP BY no)")
    return "".join(parts) + f" SELECT no, round(clat, 6) AS lat, round(clng, 6) AS lng, CAST(w AS BIGINT) AS w FROM c{rounds}"


@query(_lloyd_sql(5, 4))
def kmeans_lloyd_fixed_init(spark, sf_dir):
    """Weighted Lloyd rounds from the heaviest demand points."""
    rows = optima.lloyd(demand(spark, sf_dir), 5, 4)
    return rows.select("no", F.round("clat", 6).alias("lat"), F.round("clng", 6).alias("lng"), "w")
