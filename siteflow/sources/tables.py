"""The relational tables seen as demand, facilities, orders and coordinate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: Column, nation: Column, a: int, b: int, c: int, d: int) -> tuple[Column, Column]:
    """Coordinates from keys."""
    k, n = key.cast("long"), nation.cast("long")
    lat = F.lit(-23.15) + ((k * a + n * b) % 1000000).cast("double") / 1e6
    lng = F.lit(-44.15) + ((k * c + n * d) % 1700000).cast("double") / 1e6
    return lat, lng


def demand(spark: SparkSession, sf_dir: str, status: str = "F") -> DataFrame:
    """A row for each customer with orders of the status: prefix, city, lat, lng, w (number of orders)."""
    counts = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count("*").alias("w"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    lat, lng = place(F.col("c_custkey"), F.col("c_nationkey"), 7919, 104729, 15485863, 32452843)
    return customers.join(counts, customers.c_custkey == counts.o_custkey).select(F.col("c_custkey").alias("prefix"), F.col("c_nationkey").cast("long").alias("city"), lat.alias("lat"), lng.alias("lng"), "w")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = place(F.col("s_suppkey"), F.col("s_nationkey"), 49979687, 86028121, 67867967, 122949823)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("f"), lat.alias("flat"), lng.alias("flng"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate records by prefix, some of them invalid: event_id % 97 = 0 has text, = 1 a latitude of 91."""
    e = F.col("event_id")
    lat = -23.0 + ((e * 7919) % 100000).cast("double") / 1e6
    lng = -43.5 + ((e * 104729) % 100000).cast("double") / 1e6
    text = F.when(e % 97 == 0, F.lit("bad")).when(e % 97 == 1, F.lit("91.0")).otherwise(lat.cast("decimal(12,6)").cast("string"))
    return table(spark, sf_dir, "events").select(e.alias("record"), F.col("user_id").alias("prefix"), text.alias("lat_text"), lng.alias("lng"))


#: The same views for DuckDB, as the head of a WITH.
DEMAND_SQL = """demand AS (SELECT c_custkey AS prefix, CAST(c_nationkey AS BIGINT) AS city,
  CAST(-23.15 AS DOUBLE) + CAST((CAST(c_custkey AS BIGINT) * 7919 + CAST(c_nationkey AS BIGINT) * 104729) % 1000000 AS DOUBLE) / 1e6 AS lat,
  CAST(-44.15 AS DOUBLE) + CAST((CAST(c_custkey AS BIGINT) * 15485863 + CAST(c_nationkey AS BIGINT) * 32452843) % 1700000 AS DOUBLE) / 1e6 AS lng, o.w
  FROM customer JOIN (SELECT o_custkey, count(*) AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o_custkey = c_custkey)"""
FACILITY_SQL = """facility AS (SELECT s_suppkey AS f,
  CAST(-23.15 AS DOUBLE) + CAST((CAST(s_suppkey AS BIGINT) * 49979687 + CAST(s_nationkey AS BIGINT) * 86028121) % 1000000 AS DOUBLE) / 1e6 AS flat,
  CAST(-44.15 AS DOUBLE) + CAST((CAST(s_suppkey AS BIGINT) * 67867967 + CAST(s_nationkey AS BIGINT) * 122949823) % 1700000 AS DOUBLE) / 1e6 AS flng FROM supplier)"""
RECORD_SQL = """rec AS (SELECT event_id AS record, user_id AS prefix,
  CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 97 = 1 THEN '91.0' ELSE CAST(CAST(CAST(-23.0 AS DOUBLE) + CAST((event_id * 7919) % 100000 AS DOUBLE) / 1e6 AS DECIMAL(12,6)) AS VARCHAR) END AS lat_text,
  CAST(-43.5 AS DOUBLE) + CAST((event_id * 104729) % 100000 AS DOUBLE) / 1e6 AS lng FROM events)"""
