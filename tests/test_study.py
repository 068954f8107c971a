"""Steps of a study, and what service and geometry do with repeated, polar and empty rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from siteflow.operators import compare, prepare, service, study


def test_within_near_the_poles_and_across_the_date_line(spark):
    r = 6371.0088

    def far(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * r * math.asin(min(1.0, math.sqrt(h)))

    points = [(lat + k * 0.11, lng) for lat in (-89.8, -75.0, 0.0, 60.0, 74.9, 88.9) for k in range(4) for lng in (-180.0, -179.9, -178.0, 0.0, 0.3, 1.2, 90.0, 179.8, 179.99, 180.0)]
    points = [p for p in points if abs(p[0]) <= 90]
    demand = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, None)], "prefix long, lat double, lng double")
    sites = demand.toDF("f", "flat", "flng")
    got = {(x.prefix, x.f) for x in service.within(demand, sites, 40.0).collect()}
    assert got == {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if far(p, q) <= 40.0}


def test_repeated_rows_stay(spark):
    demand = spark.createDataFrame([(1, 0.0, 0.0, 3)] * 4 + [(2, 0.5, 0.5, 1)], "prefix long, lat double, lng double, w long")
    sites = spark.createDataFrame([(7, 0.0, 0.1), (8, 0.5, 0.4)], "f long, flat double, flng double")
    assert sorted(r.f for r in service.nearest(demand, sites).collect()) == [7, 7, 7, 7, 8]
    square = [(0, 0.0, 0.0, 1.0, 0.0), (0, 1.0, 0.0, 1.0, 1.0), (0, 1.0, 1.0, 0.0, 1.0), (0, 0.0, 1.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "poly long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(0.5, 0.5)] * 2 + [(2.0, 2.0)], "lat double, lng double")
    assert sorted(r.inside for r in prepare.inside(points, edges).collect()) == [False, True, True]
    assert prepare.boundary_km(points, edges).where("boundary_km is null").count() == 0


def test_nothing_is_divided_by_zero(spark):
    none = spark.createDataFrame([(0, 1.0)], "w long, d double")
    assert service.coverage(none, (2.0,)).first().coverage_pct is None
    units = spark.createDataFrame([(0, 1, 1.0, 1.0, 0.0), (0, 2, 1.0, 1.0, 1.0)], "g long, dmu long, x1 double, x2 double, y double")
    assert {r.dmu: r.h_ccr for r in compare.ccr(units).collect()} == {1: None, 2: 1.0}


def test_lookup_counts_what_is_lost(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "key long")
    values = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "key long, v string")
    out, loss = study.lookup(rows, values, "key")
    assert out.count() == 4 and tuple(loss.first()) == (1, 2, 4)


def test_reviews_both_ways(spark):
    records = spark.createDataFrame([(1, 0.1, True), (2, 0.2, True), (3, 0.3, False), (4, None, True)], "record long, lat double, needed boolean")
    decisions = spark.createDataFrame([(1, 0.1), (2, 0.20000001), (3, 0.3), (4, None)], "record long, lat double")
    assert tuple(study.reviewed(records, decisions, ["record", "lat"]).first()) == (1, 2, 3)


def test_checks_tell_missing_and_unequal(spark):
    one = spark.createDataFrame([(1, 1.0, None), (2, 5.0, 1.0), (3, 1.0, 1.0)], "k long, a double, b double")
    two = spark.createDataFrame([(1, 1.0 + 1e-12, None), (2, 5.1, 1.0), (4, 1.0, 1.0)], "k long, a double, b double")
    got = {(r.k, r.metric): r.ok for r in study.checks(one, two, ["k"], ["a", "b"]).collect()}
    assert got == {(1, "a"): True, (1, "b"): True, (2, "a"): False, (2, "b"): True, (3, "a"): False, (3, "b"): False, (4, "a"): False, (4, "b"): False}


@pytest.mark.parametrize(("value", "want"), [("7", "00007"), ("12345", "12345"), ("1234567", "1234567"), ("", "00000"), (None, None)])
def test_zfill(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(study.zfill(F.col("v"))).first()[0] == want


def test_labels_orders_and_formats(spark):
    rows = spark.createDataFrame([("b", 1234.5, 3.0), ("a", 0.125, 4.65), ("x", -1.0, 10.0)], "c string, v double, t double")
    got = {r.c: tuple(r) for r in rows.select("c", study.label_of(F.col("c"), {"a": "first"}), study.category_rank(F.col("c"), ["b", "a"]), study.decimal_comma(F.col("v"), 2), study.scenario_id(F.lit("J825"), F.lit(3), F.col("t"))).collect()}
    assert got["a"][1:3] == ("first", 2) and got["b"] == ("b", "b", 1, "1234,50", "J825_R3_T3") and got["x"][2:] == (3, "-1,00", "J825_R3_T10") and got["a"][4] == "J825_R3_T4p65"


def test_margins_along_k(spark):
    curve = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 12), ("b", 1, 20), ("c", 1, 1)], "m string, k long, covered long")
    assert {tuple(r) for r in study.along_k(curve, ["m"], 9).collect()} == {("a", 2, 0, -4), ("b", 1, 11, None)}
