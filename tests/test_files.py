"""Files of a study: what is written comes back, what is wrong is refused."""

from __future__ import annotations

import hashlib
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from siteflow.sources import files


def test_typed_and_text_scans(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("prefix,n,x,note\n00123,1,0.1,NA\n01000,2,1e-300,\n")
    rows = files.read_csv(spark, str(path), text=["prefix"])
    assert rows.dtypes[0] == ("prefix", "string") and [tuple(r)[:3] for r in rows.collect()] == [("00123", 1, 0.1), ("01000", 2, 1e-300)]
    assert [tuple(r) for r in files.read_text_csv(spark, str(path)).collect()] == [("00123", "1", "0.1", "NA"), ("01000", "2", "1e-300", "")]


def test_rows_are_numbered_over_blocks_and_files(spark, tmp_path):
    for name, start in (("b.csv", 1000), ("a.csv", 0)):
        (tmp_path / name).write_text("k,pad\n" + "".join(f"{start + i},{'x' * (i % 50)}\n" for i in range(1000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        rows = files.numbered(spark, str(tmp_path), "k long, pad string")
        assert rows.rdd.getNumPartitions() > 0 and {(r.k, r.source_row_number) for r in rows.collect()} == {(k, k + 2) for k in range(2000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_floats_keep_every_bit_and_files_are_replaced(spark, tmp_path):
    values = [0.1, 1 / 3, math.pi * 1e-200, 12345678901234567.0, -0.0, 5e-324]
    target = f"file://{tmp_path}/out.csv"
    for shift in (1, 0):  # the second run replaces the first one's file
        files.csv_file(spark.createDataFrame([(k + shift, v) for k, v in enumerate(values)], "k long, v double"), target, order=[F.desc("k")])
    back = {r.k: r.v for r in files.read_csv(spark, target).collect()}
    assert [back[k] for k in range(len(values))] == values
    with open(tmp_path / "out.csv") as f:
        lines = f.read().splitlines()
    assert lines[0] == "k,v" and lines[1].startswith("5,") and lines[-1] == "0,0.10000000000000001"
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["out.csv"]


def test_locale_sink_and_empty_table(spark, tmp_path):
    target = f"file://{tmp_path}/l.csv"
    files.csv_file(spark.createDataFrame([("é", 1.5, None)], "a string, b double, c double"), target, sep=";", comma=True, mark=True)
    assert (tmp_path / "l.csv").read_bytes() == "﻿a;b;c\né;1,5;\n".encode()
    files.csv_file(spark.createDataFrame([], "a string, b double"), target)
    assert (tmp_path / "l.csv").read_text() == "a,b\n"


def _feature(code, kind, coordinates):
    return {"type": "Feature", "properties": {"codarea": code}, "geometry": {"type": kind, "coordinates": coordinates}}


SQUARE = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def test_regions(spark, tmp_path):
    path = tmp_path / "g.json"
    good = [_feature("1", "Polygon", [SQUARE, [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]]), _feature(2, "MultiPolygon", [[SQUARE], [SQUARE]]), _feature("3", "Point", [1, 1])]
    path.write_text("﻿" + json.dumps({"type": "FeatureCollection", "features": good}))
    edges = files.read_regions(spark, str(path), ["1", 2])
    assert {(r.poly, r["count"]) for r in edges.groupBy("poly").count().collect()} == {("1", 7), ("2", 8)}
    assert edges.where("poly = '2'").select("part").distinct().count() == 2
    with pytest.raises(ValueError, match="missing.*9"):
        files.read_regions(spark, str(path), ["1", "9"])
    with pytest.raises(ValueError, match="invalid geometry: 3"):
        files.read_regions(spark, str(path))


@pytest.mark.parametrize("ring", [SQUARE[:4], SQUARE[:2] + SQUARE[:1], [[0, 0], [1, 1], [2, 2], [0, 0]], []])
def test_rings_that_are_open_short_or_flat_are_refused(spark, tmp_path, ring):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [_feature("1", "Polygon", [ring])]}))
    with pytest.raises(ValueError, match="invalid geometry: 1"):
        files.read_regions(spark, str(path), ["1"])


def test_other_json_is_refused(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"type": "Feature", "features": []}))
    with pytest.raises(ValueError, match="FeatureCollection"):
        files.read_regions(spark, str(path))


def test_manifest_and_changes(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    files.json_file(spark, {"b": 1, "a": "é"}, f"{folder}/x.json")
    files.text_file(spark, "one", f"{folder}/y.json")
    assert files.read_json(spark, f"{folder}/x.json").first().asDict() == {"a": "é", "b": 1}
    before = spark.createDataFrame(files.manifest(spark, folder, "*.json").collect())
    assert {r.file: r.sha256 for r in before.collect()}["y.json"] == hashlib.sha256(b"one").hexdigest()
    files.text_file(spark, "two", f"{folder}/y.json")
    files.text_file(spark, "new", f"{folder}/z.json")
    assert {tuple(r) for r in files.changed(before, files.manifest(spark, folder, "*.json")).collect()} == {("y.json", "changed"), ("z.json", "added")}


def test_signatures_and_fits(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "a long, b string")
    assert rows.select(files.signature("a", "b")).first()[0] == hashlib.sha256(b'{"a":1,"b":null}').hexdigest()
    store = f"file://{tmp_path}/fits"
    assert files.get_fit(spark, store, "k70") is None
    files.put_fit(rows, store, "k70")
    assert files.get_fit(spark, store, "k70").collect() == rows.collect()
