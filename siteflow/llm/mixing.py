"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand by size and then doc_id; each expects target / source size copies. A prefix sum
of these expectations plus one offset for the source crosses integers, and each crossing is a copy. Ranks come from
counts by (source, size) and by (source, size, range of doc_id), so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, n_words, others, range_of, tick

ONE = 2**32  # rates and offsets in units of 2**-32, so that prefix sums are exact


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add weight and target to sizes(source, source_size): share of all sizes by weight, at most cap times the source's
    size, the excess shared again by weight. A row for each source, nulls last in code point order."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("__no", F.row_number().over(by_name)).withColumn("weight", w)
    df = df.withColumn("__full", cap * F.col("source_size") / F.col("weight"))
    # the sources that fill up first come first; the level is that of the first which doesn't fill up
    before = Window.orderBy("__full", "__no").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    df = df.withColumn("__level", level).withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__no", "__level"))).over(every).getField("__level"))
    target = F.least(cap * F.col("source_size"), F.coalesce(F.col("__level") * F.col("weight"), cap * F.col("source_size")))
    return df.withColumn("target", target.cast("double")).drop("__no", "__full", "__level")


def copies_of(rank: Column, rate: Column, offset: Column) -> Column:
    """Integers that the prefix sum crosses at this rank (from 1)."""
    # whole numbers all through: a quotient of decimals would be rounded first
    at = lambda k: F.call_function("div", k.cast("decimal(19,0)") * rate.cast("decimal(12,0)") + offset.cast("decimal(12,0)"), F.lit(ONE).cast("decimal(11,0)"))
    return (at(rank) - at(rank - 1)).cast("long")


def mix_documents(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, bucket_rows: int = 100_000) -> DataFrame:
    """Add size, source_size, target, copies and taken to docs(doc_id, text, source).

    Null texts have size 0; null is a source of its own, last in order; null doc_ids stand first. Rows of equal
    doc_id and size stand by a hash of the text; whole repeats are alike in either order. An empty table stays empty.
    Columns of the new names are replaced.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    docs = docs.select(*map(tick, others(docs, *new))).withColumn("size", n_words(F.col("text")))
    spark = docs.sparkSession
    n = docs.select("doc_id").count()
    probes = [i / (n // bucket_rows) for i in range(1, min(n // bucket_rows, 100_000))]
    # ranges of about equal numbers of rows, wherever the ids lie
    edges = sorted({int(e) for e in docs.where("doc_id is not null").approxQuantile("doc_id", probes, 0.5 / (len(probes) + 1))}) if probes else []
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_of(F.col("doc_id").cast("long"), edges)).cast("int")
    keyed = docs.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("__range", place)
    keys = ["__source", "size", "__range"]
    groups = keep(keyed.groupBy("source", *keys).agg(F.count("*").alias("__n")), "mix-counts")
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("__n")).alias("source_size"))
    # a row for each source
    t = spark.createDataFrame(targets(sources, weights, share, cap).toArrow())
    t = t.withColumn("__rate", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * ONE), F.lit(0)).cast("long"))
    t = t.withColumn("__offset", F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long"))
    by_size = groups.groupBy("__source", "size").agg(F.sum("__n").alias("__n"))
    up = lambda *part, order: F.coalesce(F.sum("__n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = by_size.select("__source", "size", up("__source", order="size").alias("__base"))
    starts = groups.select(*keys, up("__source", "size", order="__range").alias("__start")).join(sizes, ["__source", "size"])
    starts = starts.select(*keys, (F.col("__base") + F.col("__start")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")))
    ranked = keyed.withColumn("__place", place).join(starts, keys)
    t = t.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).select("__source", "source_size", "target", "__rate", "__offset")
    out = ranked.join(F.broadcast(t) if t.count() <= 100_000 else t, "__source")
    out = out.withColumn("copies", copies_of(F.col("__before") + F.col("__place"), F.col("__rate"), F.col("__offset")))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*map(tick, docs.columns), "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, **more: float) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    # the row as it is, so that its columns can have any names
    packed = docs.select("doc_id", "text", "source", F.struct(*map(tick, docs.columns)).alias("__row"))
    out = mix_documents(packed, **more).where("copies > 0")
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


#: The same rows for DuckDB: documents is a table of doc_id, text, source.
MIX_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE))
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lev
  FROM f WINDOW b AS (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT lev FROM l WHERE lev <= full_at ORDER BY full_at, no LIMIT 1) * weight) AS target FROM l),
r AS (SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0) * 4294967296) AS HUGEINT), 0) AS rate,
  CAST(('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8)) AS HUGEINT) AS shift FROM t),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS i FROM d)
SELECT k.doc_id, k.size, r.source_size, r.target,
  CAST((k.i * r.rate + r.shift) // 4294967296 - ((k.i - 1) * r.rate + r.shift) // 4294967296 AS BIGINT) * k.size AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""
