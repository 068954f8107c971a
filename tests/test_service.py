from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siteflow.functions import geo
from siteflow.operators import compare, placement, prepare, service, variants


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_distances(spark):
    at = [F.lit(float(x)) for x in (0, 0, 0, 1)]
    assert one(spark, geo.geodesic(*at)) == pytest.approx(111.31949079327357, abs=1e-9)
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(np.pi * 6371.0088)
    assert one(spark, geo.haversine_atan2(*at)) == pytest.approx(one(spark, geo.haversine(*at)), abs=1e-9)
    e, n = geo.to_utm(F.lit(-22.9), F.lit(-43.2))
    lat, lng = geo.from_utm(e, n)
    assert (one(spark, lat), one(spark, lng)) == (pytest.approx(-22.9, abs=1e-8), pytest.approx(-43.2, abs=1e-8))


def test_text_and_targets(spark):
    assert [one(spark, geo.cover_target(F.lit(n))) for n in (9691, 20, 21)] == [9207, 19, 20]
    assert one(spark, geo.city_key(F.lit(" São João "))) == "sao joao"
    assert [one(spark, geo.prefix_key(F.lit(x))) for x in ("123", "123456", "1a")] == ["00123", None, None]
    assert [one(spark, geo.prefix_lenient(F.lit(x))) for x in ("123.0", "123456", "1a")] == ["00123", "123456", "1a"]


def line(spark, km, w):
    return spark.createDataFrame([(i, 1, 0.0, geo.arc_degrees(x), int(n)) for i, (x, n) in enumerate(zip(km, w))], "prefix long, city long, lat double, lng double, w long")


def sites(spark, km):
    return spark.createDataFrame([(i, 0.0, geo.arc_degrees(x)) for i, x in enumerate(km)], "f long, flat double, flng double")


def test_metrics_on_a_line(spark):
    a = service.nearest(line(spark, [0, 1, 2, 10], [97, 1, 1, 1]), sites(spark, [0]))
    m = service.metrics(a, []).first()
    assert (m.wp50, m.wp95, m.wp99, m.up95, m.up99, m.mean_km) == (0, 0, pytest.approx(2.08), pytest.approx(8.8), pytest.approx(9.76), pytest.approx(0.13))
    q = service.empirical_quantiles(service.nearest(line(spark, [1, 3.1], [19, 1]), sites(spark, [0])), ["city"]).first()
    assert q.p95 == pytest.approx(1)
    near = service.within(line(spark, range(0, 60, 3), [1] * 20), sites(spark, [0, 30.5]), 7.0)
    assert near.count() == sum(abs(x - s) <= 7 for x in range(0, 60, 3) for s in (0, 30.5))


def test_first_feasible(spark):
    curve = spark.createDataFrame([(1.0, k, c) for k, c in enumerate([94, 96, 93, 98], 1)], "radius_km double, k int, covered long")
    assert service.first_feasible(curve, 100).first().k_selected == 2
    assert service.first_feasible(curve.where("k != 2"), 100).first().status == "incomplete"


def test_polygon(spark):
    pts = [(-43.0, -23.0), (-44.0, -23.0), (-43.435, -22.93), (-43.45, -22.93), (-41.0, -23.0)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "record long, lng double, lat double")
    from siteflow.plans.catalogue import edges

    got = {r.record: r.inside for r in prepare.inside(df, edges(spark)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}
    assert prepare.boundary_km(df.where("record = 1"), edges(spark)).first().boundary_km == pytest.approx(0, abs=1e-6)


def test_kernels_against_enumeration():
    r = np.random.default_rng(1984)
    for _ in range(20):
        d, w = r.uniform(0, 10, (12, 7)), r.integers(1, 9, 12)
        target = 0.8 * w.sum()
        got, ok = placement.smallest_cover(d <= 4, w, target)
        sizes = [k for k in range(1, 8) for s in itertools.combinations(range(7), k) if w[(d[:, s] <= 4).any(1)].sum() >= target]
        assert ok == bool(sizes) and (not ok or len(got) == sizes[0])
        cost = lambda s: (w * d[:, s].min(1)).sum()
        assert cost(placement.p_median(d, w, 1)) == pytest.approx(placement.enumerate_best(d, w, 1)[1])
        assert cost(placement.p_median(d, w, 3)) <= 1.2 * placement.enumerate_best(d, w, 3)[1]
        full = placement.max_cover(d, w, 4, 7)
        assert all(placement.max_cover(d, w, 4, k) == full[:k] for k in range(1, 8))


def test_clusterings():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.01, (20, 2)) for c in (0, 1, 2)])
    truth = np.repeat([0, 1, 2], 20)
    same = lambda a: len({(p, q) for p, q in zip(a, truth)}) == 3
    sq = ((x[:, None] - x[None]) ** 2).sum(2)
    assert same(placement.k_means(x, np.ones(60), 3, 1)) and same(placement.agglomerate(sq, "ward", 3))
    assert same(placement.agglomerate(np.sqrt(sq), "average", 3)) and same(placement.agglomerate(np.sqrt(sq), "complete", 3)) and same(placement.dbscan(np.sqrt(sq), 0.05))


def test_envelopment(spark):
    r = random.Random(3)
    rows = [(0, i, r.uniform(1, 9), r.uniform(1, 9), r.uniform(1, 9)) for i in range(9)]
    df = spark.createDataFrame(rows, "g long, dmu long, x1 double, x2 double, y double")
    ccr = {x.dmu: x.h_ccr for x in compare.ccr(df).collect()}
    fdh = {x.dmu: x.h_fdh for x in compare.fdh(df).collect()}
    assert max(ccr.values()) == 1 and all(ccr[k] <= fdh[k] + 1e-6 for k in ccr)
    for g, i, a, b, y in rows:  # the same as a linear programme over a grid of mixes
        best = min(max((t * p[2] / p[4] + (1 - t) * q[2] / q[4]) / (a / y), (t * p[3] / p[4] + (1 - t) * q[3] / q[4]) / (b / y)) for p in rows for q in rows for t in np.linspace(0, 1, 201))
        assert ccr[i] == pytest.approx(best, abs=0.01) and ccr[i] <= best + 1e-6


@pytest.mark.parametrize("name", sorted(entry.catalogue.ORACLE))
def test_queries_equal_sql(spark, name):
    import glob
    import os

    import duckdb
    import pandas as pd

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(entry.catalogue.ORACLE[name]).df()
    got = entry.catalogue.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(str(tuple(None if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else x for x in row)) for row in df[cols].itertuples(index=False))
    assert len(got) > 0 and key(got) == key(want)


def test_placements(spark):
    rows = entry.queries()["placements"](spark, "/root/testdata/sf0.001").collect()
    assert {r.method for r in rows} == {"mclp", "p_median", "k_means", "ward", "complete", "average", "dbscan"}


def test_placements_use_every_row(spark):
    """Sites and centres of sf0.01 equal those of the whole-matrix kernels over all demand rows and 300 candidates."""
    from siteflow.sources.tables import demand

    sf = "/root/testdata/sf0.01"
    p = demand(spark, sf).orderBy("prefix").toPandas()
    assert len(p) > 400
    c = p.sort_values(["w", "prefix"], ascending=[False, True]).head(300)
    lat, lng, w = (p[x].to_numpy(float) for x in ("lat", "lng", "w"))
    d = placement.distances(lat, lng, c.lat.to_numpy(), c.lng.to_numpy())
    full = placement.distances(lat, lng, lat, lng)
    xy = np.column_stack([lat, lng])
    labels = {"k_means": placement.k_means(xy, w, 10, 42), "dbscan": placement.dbscan(full, 3.0), "ward": placement.agglomerate(((xy[:, None] - xy[None]) ** 2).sum(2), "ward", 10)}
    labels |= {m: placement.agglomerate(full, m, 10) for m in ("complete", "average")}
    mean = lambda x, g: [np.average(x[g == i], weights=w[g == i]) for i in range(g.max() + 1)]
    got = {}
    for r in entry.queries()["placements"](spark, sf).orderBy("method", "step").collect():
        got.setdefault(r.method, []).append((r.site, r.flat, r.flng))
    assert [s for s, _, _ in got["mclp"]] == list(c.prefix.iloc[placement.max_cover(d, w, 20.0, 10)])
    assert [s for s, _, _ in got["p_median"]] == list(c.prefix.iloc[placement.p_median(d, w, 10)])
    for m, g in labels.items():
        assert np.allclose([x[1:] for x in got[m]], np.column_stack([mean(lat, g), mean(lng, g)]), atol=1e-9), m


def test_trajectories(spark):
    """61 far places need 58 sites; 20 candidates miss the target, all of them reach it. Prefixes equal max_cover."""
    d = line(spark, range(0, 6100, 100), [1] * 61)
    rows = placement.trajectories(d, service.rank_candidates(d, 20), (10.0, 150.0)).orderBy("radius_km", "scope", "k").collect()
    found = {(r.radius_km, r.scope): r for r in service.first_feasible(spark.createDataFrame(rows), 61, ("radius_km", "scope")).collect()}
    assert set(found) == {(10.0, "main"), (10.0, "all_candidates"), (150.0, "main"), (150.0, "all_candidates")}
    assert (found[10.0, "main"].status, found[10.0, "main"].ceiling, found[10.0, "all_candidates"].k_selected) == ("structurally_infeasible", 20, 58)
    assert found[150.0, "main"].ceiling == 21 and found[150.0, "all_candidates"].k_selected == 20
    r = np.random.default_rng(4)
    for _ in range(10):
        lat, lng, w = r.uniform(-23, -22, 80), r.uniform(-44, -43, 80), r.integers(1, 9, 80)
        m = placement.distances(lat, lng, lat[:30], lng[:30])
        chosen, covered = placement.cover_trajectory(lat, lng, w, lat[:30], lng[:30], 20.0)
        assert chosen == placement.max_cover(m, w, 20.0, 30)
        assert covered == [w[(m[:, chosen[:k]] <= 20).any(1)].sum() for k in range(1, len(chosen) + 1)]


def test_first_feasible_takes_300_candidates(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.radius_km, r.scope): r for r in entry.queries()["mclp_first_feasible_k"](spark, sf).collect()}
    ranked = {r.radius_km: r for r in entry.queries()["first_feasible_k"](spark, sf).collect()}
    assert ranked[10.0].status == "structurally_infeasible" and got[10.0, "main"].status == "selected"
    assert all(got[x, "main"].ceiling >= r.ceiling for x, r in ranked.items())


def test_text_keys_keep_long_keys(spark, tmp_path):
    rows = [(7, " BUILDING "), (99999, "MACHINERY"), (100000, "MACHINERY"), (1234567, "BUILDING")]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.prefix: (r.key5, r.segment) for r in entry.queries()["text_keys"](spark, str(tmp_path)).collect()}
    assert got == {7: ("00007", "building"), 99999: ("99999", "machinery"), 100000: (None, "machinery"), 1234567: (None, "building")}


def test_nearest_beyond_the_broadcast_bound(spark, monkeypatch):
    d, f = line(spark, range(0, 60, 3), [1] * 20), sites(spark, [0, 30.5, 31.5])
    want = sorted(service.nearest(d, f).collect())
    monkeypatch.setattr(service, "BROADCAST_ROWS", 2)
    assert sorted(service.nearest(d, f).collect()) == want and len(want) == 20


def test_outside_lengths(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6)]
    edges = [(*map(float, a), *map(float, b)) for r in (ring, hole) for a, b in zip(r, r[1:] + r[:1])]
    lines = [(1, -5.0, 5.0, 15.0, 5.0), (2, 1.0, 1.0, 3.0, 1.0), (3, 20.0, 0.0, 20.0, 4.0), (4, -5.0, 1.0, 5.0, 1.0), (5, 2.0, 2.0, 2.0, 2.0)]
    found = variants.outside_lengths(spark.createDataFrame(lines, "line int, ax double, ay double, bx double, by double"), spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")).collect()
    assert {r.line: round(r.outside, 9) for r in found} == {1: 12.0, 2: 0.0, 3: 4.0, 4: 5.0, 5: 0.0}


def test_spread_keeps_orders_and_hash_ignores_order(spark):
    d = line(spark, [0, 3], [5, 2])
    points = spark.createDataFrame([(7, 0, 0.0, 0.0), (8, 0, 0.0, 0.0)], "record long, prefix long, lat double, lng double")
    out = variants.spread(d, points)
    assert sorted(r.w for r in out.collect()) == [2.0, 2.5, 2.5]
    assert variants.content_hash(d).first() == variants.content_hash(d.orderBy(F.desc("prefix"))).first()
    assert variants.content_hash(d).first().hash != variants.content_hash(d.where("prefix = 0")).first().hash


def test_agreement(spark):
    rows = [(5.0, v, m, k) for v, a, b, c in ((1, 3, 7, 1), (2, 4, 8, None)) for m, k in (("a", a), ("b", b), ("c", c))]
    found = variants.agreement(spark.createDataFrame(rows, "radius_km double, variant int, method string, k int"), 2).collect()
    assert {r.method_a + r.method_b: r.label for r in found} == {"ab": "stable_observed_order", "ac": "incomplete_variants_no_classification", "bc": "incomplete_variants_no_classification"}


def test_cross_check_counts_every_pair(spark):
    """Beyond the bound on pairs, far cells are still computed: near the antipode the two forms differ."""
    r = np.random.default_rng(9)
    places = [(float(a), float(b)) for a, b in zip(r.uniform(-90, 90, 60), r.uniform(-180, 180, 60))] + [(90.0, 180.0), (-90.0, -180.0), (95.0, 10.0), (10.0, 200.0)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(99, None, 1.0)], "prefix long, lat double, lng double")
    s = spark.createDataFrame([(i, -a + 1e-6 * (i % 3), b - 180.0 if b > 0 else b + 180.0) for i, (a, b) in enumerate(places)] + [(99, 1.0, None)], "f long, flat double, flng double")
    want = service.cross_check(d, s).first()
    assert want.n == 65 * 65 and want.disagree > 0
    assert service.cross_check(d, s, few=0).first() == want
    home = spark.createDataFrame([(1, -22.5, -43.2)], "f long, flat double, flng double")
    assert tuple(service.cross_check(spark.range(1000).selectExpr("id prefix", "-23 + id / 1000 lat", "-44 + id / 900 lng"), home, few=0).first()) == (1000, 0)


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_chains_by_cells(linkage):
    """Clusters equal the whole-matrix ones however few are left to the matrix; 5,000 rows hold far less than 4 n^2 bytes."""
    import tracemalloc

    r = np.random.default_rng(12)
    lat, lng = r.uniform(-23, -22, 250), r.uniform(-44, -42, 250)
    lat[:9], lng[:9] = lat[9], lng[9]
    d = ((lat[:, None] - lat) ** 2 + (lng[:, None] - lng) ** 2) if linkage == "ward" else placement.distances(lat, lng, lat, lng)
    for dense, k in ((1, 4), (9, 10), (60, 25), (1000, 10)):
        pairs = set(zip(placement.chain(lat, lng, linkage, k, dense), placement.agglomerate(d, linkage, k)))
        assert len(pairs) == k
    lat, lng = r.uniform(-23, -22, 5000), r.uniform(-44, -42, 5000)
    tracemalloc.start()
    placement.chain(lat, lng, linkage, 10, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000


def test_medians_without_a_matrix(monkeypatch):
    r = np.random.default_rng(2)
    lat, lng, w = r.uniform(-23, -22, 200), r.uniform(-44, -43, 200), r.integers(1, 9, 200).astype(float)
    d = placement.distances(lat, lng, lat[:40], lng[:40])
    want = placement.p_median(d, w, 5)
    monkeypatch.setattr(placement, "BLOCK", 1000)
    assert placement.p_median(placement.Apart(lat, lng, lat[:40], lng[:40]), w, 5) == want
    assert placement.cover_trajectory(lat, lng, w, lat[:40], lng[:40], 20.0, 3)[0] == placement.max_cover(d, w, 20.0, 3)


def test_dbscan_without_all_near_pairs():
    """Clumps of rows within the radius need no list of their pairs; labels equal the whole-matrix ones at any radius."""
    import tracemalloc

    r = np.random.default_rng(6)
    for eps in (0.0, 1e-3, 0.5, 3.0, 300.0, 1500.0, 30000.0):
        lat, lng = r.uniform(-90, 90, 500), r.uniform(-180, 180, 500)
        lat[:40], lng[:40] = lat[40], lng[40]
        lat[40:200], lng[40:200] = r.normal(-22.5, 0.02, 160), r.normal(-43, 0.02, 160)
        lat[200:240], lng[240:280] = r.uniform(89.9, 90, 40), r.choice([-180, 180], 40)
        assert (placement.dbscan_near(lat, lng, eps) == placement.dbscan(placement.distances(lat, lng, lat, lng), eps)).all(), eps
    lat, lng = np.concatenate([r.normal(-22.5, 0.003, 4000), [-22.0]]), np.concatenate([r.normal(-43, 0.003, 4000), [-43.0]])
    tracemalloc.start()
    got = placement.dbscan_near(lat, lng, 3.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[:-1] == 0).all() and got[-1] == -1 and peak < 30_000_000


def test_average_linkage_of_far_clusters_by_series():
    """Clusters that stand apart need no distances of their points; the series gives the same means."""
    r = np.random.default_rng(7)
    for wide, some in ((1, True), (6, True), (40, False)):
        lat, lng = -23 + wide * r.uniform(0, 1, 2500), -44 + wide * r.uniform(0, 1.7, 2500)
        found = placement.Clusters(lat, lng, "average")
        found.search(np.arange(len(found)))
        while len(found) > 100:
            found.merge()
            found.search(found.stale)
        got, ends, waves = found.matrix(), np.cumsum(found.many), placement.Waves(found)
        part = [found.points[b - n : b] for n, b in zip(found.many, ends)]
        want = np.array([[placement.R * 2 * np.arcsin(np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) / 2 / placement.R).mean() for y in part] for x in part])
        np.fill_diagonal(want, 0)
        assert np.allclose(got, want, rtol=1e-8, atol=1e-9)
        assert any(waves.apart(a, np.arange(a + 1, len(found))).any() for a in range(len(found) - 1)) == some
    lat, lng = r.normal(-22.5, 0.3, 400), r.normal(-43, 0.3, 400)
    lat[:100], lng[:100] = lat[100], lng[100]  # a place of many rows
    d = placement.distances(lat, lng, lat, lng)
    for m in ("complete", "average"):
        assert len(set(zip(placement.chain(lat, lng, m, 12, 40), placement.agglomerate(d, m, 12)))) == 12


def test_medians_make_near_distances_only(monkeypatch):
    r = np.random.default_rng(8)
    lat, lng, w = r.uniform(-23, -22, 6000), r.uniform(-44, -42, 6000), r.integers(1, 9, 6000).astype(float)
    made, of = [], placement.Apart.of
    monkeypatch.setattr(placement, "BLOCK", 6000)
    monkeypatch.setattr(placement.Apart, "of", lambda self, rows, columns: made.append(of(self, rows, columns)) or made[-1])
    some, all_ = (placement.Apart(lat, lng, lat[:60], lng[:60]) for _ in range(2))
    all_.low[:] = -np.inf
    got = placement.p_median(some, w, 12)
    few = sum(x.size for x in made)
    assert got == placement.p_median(all_, w, 12) == placement.p_median(placement.distances(lat, lng, lat[:60], lng[:60]), w, 12)
    assert few < 0.5 * (sum(x.size for x in made) - few)
