"""Steps of a study around its networks: scopes, reviews, lookups with checks, tolerant comparisons, labels and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outside_scope(rows: DataFrame, scope: DataFrame, cohort: DataFrame, key: str, cohort_key: str) -> DataFrame:
    """Rows whose key is neither in scope(key) nor, by cohort_key, in cohort already. Null keys are in neither."""
    return rows.join(scope.select(key), key, "left_anti").join(cohort.select(cohort_key), cohort_key, "left_anti")


def lookup(rows: DataFrame, values: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows with the columns of values(key, ...), and how many rows found none or a key that is given twice."""
    once = values.groupBy(key).agg(*[F.first(c).alias(c) for c in values.columns if c != key], F.count("*").alias("__times"))
    out = rows.join(once, key, "left")
    loss = out.agg(F.count_if(F.col("__times").isNull()).alias("lost"), F.count_if(F.col("__times") > 1).alias("ambiguous"), F.count("*").alias("rows"))
    return out.drop("__times"), loss


def reviewed(records: DataFrame, decisions: DataFrame, identity: Sequence[str]) -> DataFrame:
    """How far decisions cover the records that need one: both ways, by exact identity.

    records(*identity, needed), decisions(*identity, decision). Floats are compared as they are; a null identity never
    agrees. Returns a row of counts: matched, missing (needed, no decision) and unused (a decision for no needed record).
    """
    need = records.where("needed").select(*identity)
    matched = need.join(decisions, list(identity), "left_semi").agg(F.count("*").alias("matched"))
    missing = need.join(decisions, list(identity), "left_anti").agg(F.count("*").alias("missing"))
    unused = decisions.join(need, list(identity), "left_anti").agg(F.count("*").alias("unused"))
    return matched.crossJoin(missing).crossJoin(unused)  # one row each


def first_by_priority(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key's rows the first in the given order, which has to tell all rows apart."""
    return df.withColumn("__no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__no = 1").drop("__no")


def category_rank(value: Column, categories: Sequence[str]) -> Column:
    """Place of the value in a custom order; others come last."""
    at = F.array_position(F.array(*map(F.lit, categories)), value)
    return F.when(at > 0, at).otherwise(F.lit(len(categories) + 1)).cast("long")


def label_of(value: Column, labels: Mapping[str, str]) -> Column:
    """The label of a code; codes without one stay."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(table, value), value) if labels else value


def zfill(value: Column, width: int = 5) -> Column:
    """Zeros in front up to the width; longer strings stay whole, which lpad would cut."""
    return F.when(F.length(value) >= width, value).otherwise(F.lpad(value, width, "0"))


def decimal_comma(value: Column, digits: int) -> Column:
    """1234.5 as '1234,50': no thousands mark."""
    return F.translate(F.format_string(f"%.{digits}f", value.cast("double")), ".", ",")


def scenario_id(candidates: Column, radius: Column, limit: Column) -> Column:
    """J825_R3_T4p65 of 'J825', 3, 4.65."""
    short = lambda c: F.replace(F.regexp_replace(c.cast("string"), r"\.0+$", ""), F.lit("."), F.lit("p"))
    return F.concat(candidates, F.lit("_R"), short(radius), F.lit("_T"), short(limit))


def same(expected: Column, observed: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Equal within the greater of both tolerances; nulls are equal to nulls only."""
    near = F.abs(expected - observed) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(expected), F.abs(observed)))
    return F.when(expected.isNull() | observed.isNull(), expected.isNull() & observed.isNull()).otherwise(near)


def checks(expected: DataFrame, observed: DataFrame, keys: Sequence[str], metrics: Sequence[str], relative: float = 1e-9, absolute: float = 0.0) -> DataFrame:
    """A row (keys, metric, expected, observed, ok) for each metric; a key that one side lacks fails all of them."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"), F.lit(True).alias("there")) for m in metrics])).alias("s")).select(*keys, "s.metric", F.col("s.v").alias(name), F.col("s.there").alias(f"__{name}"))
    both = long(expected, "expected").join(long(observed, "observed"), [*keys, "metric"], "full")
    ok = F.col("__expected").isNotNull() & F.col("__observed").isNotNull() & same(F.col("expected"), F.col("observed"), relative, absolute)
    return both.select(*keys, "metric", "expected", "observed", ok.alias("ok"))


def native_against_nearest(native: DataFrame, nearest: DataFrame) -> DataFrame:
    """Rows (prefix, w, f, native_d, nearest_f, d, moved, gain): a method's own assignment beside the nearest site's."""
    best = nearest.select("prefix", F.col("f").alias("nearest_f"), "d")
    return native.select("prefix", "w", "f", "native_d").join(best, "prefix").select("*", (F.col("f") != F.col("nearest_f")).alias("moved"), (F.col("native_d") - F.col("d")).alias("gain"))


def along_k(curve: DataFrame, by: Sequence[str], target: int) -> DataFrame:
    """Each curve's first feasible k with the margin there and at k - 1 (null where it starts there)."""
    at = Window.partitionBy(*by).orderBy("k")
    rows = curve.withColumn("margin", F.col("covered") - F.lit(target)).withColumn("margin_before", F.lag(F.col("covered") - F.lit(target)).over(at))
    first = rows.where("margin >= 0").groupBy(*by).agg(F.min(F.struct("k", "margin", "margin_before")).alias("s"))
    return first.select(*by, "s.k", "s.margin", "s.margin_before")


def flagged_outside(means: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Aggregated means outside a box (south, west, north, east) are flagged, never dropped; the edge is inside."""
    south, west, north, east = region
    return means.withColumn("outside", ~(F.col("lat").between(south, north) & F.col("lng").between(west, east)))
