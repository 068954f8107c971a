"""Envelopment, nearest sites by cells and exact optima against plain enumeration."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from siteflow.operators import compare, optima, service


def _far(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("lat0", [0.0, 75.0])
def test_nearest_by_cells(spark, lat0):
    rnd = random.Random(5)
    sites = [(k, lat0 + rnd.random() * 2, -180 + rnd.random() * 2 if k % 2 else 178 + rnd.random() * 2) for k in range(400)]
    sites += [(1000 + k, f[1], f[2]) for k, f in enumerate(sites[:20])]  # equal places: the least f
    rows = [(k, lat0 + rnd.random() * 2, -180 + rnd.random() * 2, 1) for k in range(60)] + [(60, lat0 - 20.0, 0.0, 2)] * 3 + [(61, None, 1.0, 1)]
    rows += [(100 + k, s[1], s[2], 1) for k, s in enumerate(sites[:20])]
    demand = spark.createDataFrame(rows, "prefix long, lat double, lng double, w long")
    table = spark.createDataFrame([*sites, (5000, None, None)], "f long, flat double, flng double")
    got = service.nearest(demand, table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.lat is None:
            assert r.d is None
            continue
        d, f = min((_far((r.lat, r.lng), s[1:]), s[0]) for s in sites)
        assert abs(r.d - d) < 1e-9 and r.f == f


def _bcc_by_triples(x, y, o):
    """All mixes of up to three units that meet a vertex condition."""
    a, b, e = x[:, 0] / x[o, 0], x[:, 1] / x[o, 1], y - y[o]
    best = min(max(a[j], b[j]) for j in range(len(y)) if e[j] >= 0)
    for i, j in itertools.combinations(range(len(y)), 2):
        for u, v in (((a - b)[i], (a - b)[j]), (e[i], e[j])):
            if u * v < 0:
                s = v / (v - u)
                if s * e[i] + (1 - s) * e[j] >= -1e-12:
                    best = min(best, max(s * a[i] + (1 - s) * a[j], s * b[i] + (1 - s) * b[j]))
    for t in itertools.combinations(range(len(y)), 3):
        m = np.array([(a - b)[list(t)], e[list(t)], [1, 1, 1]])
        if abs(np.linalg.det(m)) > 1e-12:
            s = np.linalg.solve(m, [0, 0, 1])
            if s.min() >= -1e-12:
                best = min(best, s @ a[list(t)])
    return best


def test_envelopment_against_enumeration(spark):
    rnd = random.Random(8)
    units = [(g, k, float(rnd.randint(1, 30)), rnd.uniform(1, 9), float(rnd.randint(90, 110))) for g in range(3) for k in range(9)]
    units += [(3, k, 4.0, 2.0 + k, 10.0) for k in range(3)]  # the first beats the others in one input only
    table = spark.createDataFrame(units, "g long, dmu long, x1 double, x2 double, y double")
    bcc = {(r.g, r.dmu): r.h_bcc for r in compare.bcc(table).collect()}
    full = {(r.g, r.dmu): r for r in compare.ccr_full(table).collect()}
    short = {(r.g, r.dmu): r.h_ccr for r in compare.ccr(table).collect()}
    for g in range(4):
        mine = [u for u in units if u[0] == g]
        x, y = np.array([u[2:4] for u in mine]), np.array([u[4] for u in mine])
        for o, u in enumerate(mine):
            r = full[u[:2]]
            assert bcc[u[:2]] == pytest.approx(_bcc_by_triples(x, y, o), abs=2e-6)
            a, b = x[:, 0] / y * y[o] / x[o, 0], x[:, 1] / y * y[o] / x[o, 1]
            singles = np.maximum(a, b).min()
            pairs = [(a[i] * b[j] - a[j] * b[i]) / (a[i] - a[j] + b[j] - b[i]) for i in range(len(y)) for j in range(len(y)) if a[i] > b[i] and a[j] < b[j]]
            assert r.h == pytest.approx(min([singles, *pairs]), abs=1e-9) and short[u[:2]] == pytest.approx(r.h, abs=2e-6)
            at = {v[1]: v for v in mine}
            assert sum(p.weight * at[p.peer][2] for p in r.peers) == pytest.approx(r.target1, abs=1e-6)
            assert sum(p.weight * at[p.peer][3] for p in r.peers) == pytest.approx(r.target2, abs=1e-6)
            assert sum(p.weight * at[p.peer][4] for p in r.peers) == pytest.approx(u[4], abs=1e-6)
    assert [full[3, k]["class"] for k in range(3)] == ["Pareto eficiente", "fracamente eficiente", "fracamente eficiente"]
    assert [full[3, k].s2 for k in range(3)] == pytest.approx([0, 1, 2])


def test_dominance_flags(spark):
    nets = spark.createDataFrame([(1, 1, 3.0, 5.0), (1, 2, 3.0, 6.0), (1, 3, 2.0, 9.0), (2, 4, 9.0, 9.0)], "g long, n long, k double, m double")
    got = {r.n: (r.k_m, r.k_only) for r in compare.dominance_flags(nets, "g", "n", {"k_m": ["k", "m"], "k_only": ["k"]}).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (False, False), 4: (False, False)}


def test_pairs_and_steps_against_enumeration(spark):
    rnd = random.Random(4)
    rows = [(k, -23 + rnd.random(), -44 + rnd.random(), rnd.randint(1, 9)) for k in range(40)]
    demand = spark.createDataFrame(rows, "prefix long, lat double, lng double, w long")
    cand = service.rank_candidates(demand, 8)
    places = {r["rank"]: (r.flat, r.flng) for r in cand.collect()}
    d = {(r[0], k): _far(r[1:3], p) for r in rows for k, p in places.items()}
    pairs = list(itertools.combinations(sorted(places), 2))
    best = optima.best_cover_pair(demand, cand, (20.0, 45.0)).collect()
    assert len(best) == 2
    for b in best:
        value = lambda p, r=b.radius_km: sum(x[3] for x in rows if min(d[x[0], p[0]], d[x[0], p[1]]) <= r)
        want = min(pairs, key=lambda p: (-value(p), p))
        assert (b["first"], b["second"], b.covered, b.pairs) == (*want, value(want), 28)
    cost = lambda s: sum(x[3] * min(d[x[0], k] for k in s) for x in rows)
    m = optima.best_median_pair(demand, cand).first()
    assert (m["first"], m["second"]) == min(pairs, key=cost) and m.cost == pytest.approx(cost((m["first"], m["second"])))
    chosen = []
    for r in optima.greedy_median(demand, cand, 3).orderBy("step").collect():
        want = min(places, key=lambda k: (round(cost([*chosen, k]), 6), k))
        chosen.append(r["rank"])
        assert r["rank"] == want and r.cost == pytest.approx(cost(chosen))


def test_empty_tables(spark):
    demand = spark.createDataFrame([], "prefix long, lat double, lng double, w long")
    cand = service.rank_candidates(demand, 5)
    assert optima.best_median_pair(demand, cand).count() == optima.greedy_median(demand, cand, 2).count() == optima.lloyd(demand, 2, 2).count() == 0
    assert optima.best_cover_pair(demand, cand, (1.0,)).count() == 0


def test_frontier_of_fractions_is_small(spark):
    """Ratios below 1 apart: every unit was once a peer of its group, and each pair of them a row."""
    rnd = random.Random(4)
    rows = [(0, k, rnd.uniform(0.1, 0.9), rnd.uniform(0.1, 0.9)) for k in range(300)] + [(0, 300, 0.05, 0.5), (0, 301, 0.05, 0.5), (0, 302, 0.5, 0.05), (0, 303, 0.5, 0.06)]
    got = {r.dmu for r in compare.pareto(spark.createDataFrame(rows, "g long, dmu long, a double, b double"), "g", "a", "b", "dmu").collect()}
    beats = lambda p, q: p[2] <= q[2] and p[3] <= q[3] and p[2:] != q[2:]
    assert got == {q[1] for q in rows if not any(beats(p, q) for p in rows)} and len(got) < 60


def test_slacks_of_a_large_group(spark):
    rnd = random.Random(6)
    units = [(0, k, float(rnd.randint(1, 40)), rnd.uniform(0.1, 20), float(rnd.randint(20, 900))) for k in range(400)]
    full = {r.dmu: r for r in compare.ccr_full(spark.createDataFrame(units, "g long, dmu long, x1 double, x2 double, y double")).collect()}
    x, y = np.array([u[2:4] for u in units]), np.array([u[4] for u in units])
    for o, u in list(enumerate(units))[::10]:
        a, b = x[:, 0] / y * y[o] / u[2], x[:, 1] / y * y[o] / u[3]
        i, j = np.flatnonzero(a > b), np.flatnonzero(a < b)
        ai, bi, aj, bj = a[i][:, None], b[i][:, None], a[j], b[j]
        pairs = (ai * bj - aj * bi) / (ai - aj + bj - bi)
        assert full[o].h == pytest.approx(min(np.maximum(a, b).min(), pairs.min(initial=9)), abs=1e-9)


def test_bcc_of_a_large_group(spark):
    """Units of several chunks against all peers of the group; only the extreme ones are compared."""
    r = np.random.default_rng(5)
    x1, x2, y = r.integers(1, 40, 1500).astype(float), r.uniform(0.1, 20, 1500), r.integers(20, 900, 1500).astype(float)
    some = compare.extreme(x1, x2, y)
    assert len(some) < 100
    table = spark.createDataFrame([(0, k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x1, x2, y))], "g long, dmu long, x1 double, x2 double, y double")
    got = {u.dmu: u.h_bcc for u in compare.bcc(table, chunk=400).collect()}
    assert len(got) == 1500
    for o in range(0, 1500, 25):
        assert got[o] == pytest.approx(compare.least_scale(x1 / x1[o], x2 / x2[o], y - y[o]), abs=2e-6)
    same = np.ones(3)
    assert len(compare.extreme(same, same, same)) == 1
