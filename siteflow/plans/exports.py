"""Queries that write a study's files and read them back, with the SQL for the rows that must come back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siteflow.operators import prepare, study
from siteflow.plans.catalogue import query
from siteflow.sources import files
from siteflow.sources.tables import table


@query("SELECT CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 5 THEN CAST(s_suppkey AS VARCHAR) ELSE lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS prefix, CAST(s_nationkey AS INTEGER) AS nation, CAST(s_acctbal AS DOUBLE) / 7 AS share FROM supplier")
def typed_csv(spark, sf_dir):
    """Text keys keep their zeros and floats all their bits on the way through a CSV."""
    path = files.work_folder(spark, "typed") + ".csv"
    rows = table(spark, sf_dir, "supplier").select(study.zfill(F.col("s_suppkey").cast("string")).alias("prefix"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal").cast("double") / 7).alias("share"))
    files.csv_file(rows, path)
    return files.read_csv(spark, path, text=["prefix"]).select("prefix", F.col("nation").cast("int").alias("nation"), "share")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'NA' END AS note, lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS region FROM nation")
def text_csv(spark, sf_dir):
    path = files.work_folder(spark, "text") + ".csv"
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("NA").alias("note"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0").alias("region"))
    files.csv_file(n, path)
    return files.read_text_csv(spark, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, replace(CAST(s_suppkey % 64 AS DOUBLE) / 64 + 1 || '', '.', ',') AS value FROM supplier WHERE s_suppkey % 64 <> 0")
def locale_csv(spark, sf_dir):
    """Semicolons, decimal commas and a byte order mark."""
    path = files.work_folder(spark, "locale") + ".csv"
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 64 != 0")
    files.csv_file(s.select(F.col("s_suppkey").alias("key"), ((F.col("s_suppkey") % 64).cast("double") / 64 + 1).alias("value")), path, sep=";", comma=True, mark=True)
    rows = files.read_text_csv(spark, path, sep=";")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


@query("SELECT c_custkey AS key, row_number() OVER (ORDER BY c_acctbal, c_custkey) + 1 AS source_row_number FROM customer")
def numbered_rows(spark, sf_dir):
    path = files.work_folder(spark, "numbered") + ".csv"
    files.csv_file(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal"), path, order=["c_acctbal", "key"])
    return files.numbered(spark, path, "key long, c_acctbal double").select("key", "source_row_number")


def _regions(spark, sf_dir) -> str:
    """A box for each nation, every third as two boxes of a MultiPolygon, every fifth with a hole."""
    path = files.work_folder(spark, "regions") + ".json"
    box = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    features = []
    for (k,) in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect():
        rings = [box(3.0 * k, 0.0, 2.0)] + ([box(3.0 * k + 0.5, 0.5, 0.5)] if k % 5 == 0 else [])
        shape = {"type": "MultiPolygon", "coordinates": [rings, [box(3.0 * k, 10.0, 1.0)]]} if k % 3 == 0 else {"type": "Polygon", "coordinates": rings}
        features.append({"type": "Feature", "properties": {"codarea": str(k)}, "geometry": shape})
    files.text_file(spark, "﻿" + json.dumps({"type": "FeatureCollection", "features": features}), path)
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS poly, 4 + CASE WHEN n_nationkey % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 0 END AS edges, 1 + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS parts, CAST(4.0 + CASE WHEN n_nationkey % 5 = 0 THEN 0.25 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 THEN 1.0 ELSE 0 END AS DOUBLE) AS ring_area FROM nation WHERE n_nationkey <> 7")
def region_edges(spark, sf_dir):
    """GeoJSON as edges, by code; the areas of a region's rings."""
    codes = [str(r[0]) for r in table(spark, sf_dir, "nation").where("n_nationkey != 7").select("n_nationkey").collect()]
    e = files.read_regions(spark, _regions(spark, sf_dir), codes)
    rings = e.groupBy("poly", "part", "ring").agg(F.count("*").alias("n"), (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a"))
    return rings.groupBy("poly").agg(F.sum("n").cast("int").alias("edges"), F.countDistinct("part").cast("int").alias("parts"), F.round(F.sum("a"), 6).alias("ring_area"))


_POINT = "(3.0 * s_nationkey + (s_suppkey % 8) / 4.0 + 0.125)"


@query(f"SELECT s_suppkey, (s_suppkey % 8) < 8 AND NOT (s_nationkey % 5 = 0 AND {_POINT} - 3.0 * s_nationkey > 0.5 AND {_POINT} - 3.0 * s_nationkey < 1.0) AS inside FROM supplier")
def inside_regions(spark, sf_dir):
    """Points against the union of a GeoJSON's regions, holes left out."""
    e = files.read_regions(spark, _regions(spark, sf_dir)).withColumn("poly", F.lit("all")).select("poly", "x1", "y1", "x2", "y2")
    lng = F.lit(3.0) * F.col("s_nationkey") + (F.col("s_suppkey") % 8) / F.lit(4.0) + 0.125
    points = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(0.75).alias("lat"), lng.alias("lng"))
    return prepare.inside(points, e).select("s_suppkey", "inside")


_TEXT = "n_nationkey || ':' || n_name || chr(10)"


@query(f"SELECT 'n' || n_nationkey || '.txt' AS file, CAST(length({_TEXT}) AS BIGINT) AS bytes, sha256({_TEXT}) AS sha256 FROM nation")
def file_manifest(spark, sf_dir):
    folder = files.work_folder(spark, "manifest")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # a file for each nation
        files.text_file(spark, f"{r.n_nationkey}:{r.n_name}\n", f"{folder}/n{r.n_nationkey}.txt")
    return files.manifest(spark, folder, "*.txt")


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS signature FROM nation""")
def row_signatures(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", files.signature("n_nationkey", "n_name").alias("signature"))
