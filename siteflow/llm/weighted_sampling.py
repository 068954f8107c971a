"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words, weighted by their counts. For each of the samples a term draws r and c from gamma(2, 1)
and b from the unit interval, by its hash; with t = floor(ln(weight) / r + b) the term's value is
ln(c) - r * (t - b + 1), and the term of least value and its t are the sample. Two texts share a sample with the
probability of their generalised Jaccard similarity, sum of min counts / sum of max counts.

A draw from gamma(2, 1) is the sum of two exponential ones; these come from a table of 4096 quantiles, made by rule.

Texts meet their neighbours in descending doc_id within ranges of doc_id; only the ends of ranges meet by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, keep, range_of

GROUP = 8  # samples computed by one row: with more, the generated code is too long to be compiled


#: Exponential quantiles: two of them added are a draw from gamma(2, 1).
EXPONENTIAL = "transform(sequence(0, 4095), i -> -ln((i + 0.5D) / 4096))"


def sample_value(term: Column, log_weight: Column, seed: Column, table: Column) -> Column:
    """The term's value: the least over all terms is the sample. Another term or t gives another value, so it names the sample."""
    h = F.xxhash64(term, seed)
    draw = lambda at: F.get(table, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(0xFFF)).cast("int"))
    r, c = draw(0) + draw(12), draw(24) + draw(36)
    b = F.shiftrightunsigned(h, 48) * (1 / 65536) + 0.5 / 65536
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + 1)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", edited: str | None = None, samples: int = 64) -> DataFrame:
    """keys and ``fingerprint`` (and ``edited_fingerprint``): arrays of samples, null for texts without words.

    keys name a row; texts should lie partitioned by the first of them, then nothing is dealt out again.
    """
    seeds = samples // GROUP
    table = texts.sparkSession.range(1).select(F.expr(EXPONENTIAL).alias("e")).scalar()
    # a word's hash with its text in the lowest bit: the arrays hold longs, and a row for each word holds nothing else
    words = lambda c, bit: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    terms = F.concat(words(F.col(text), 0), words(F.col(edited), 1)) if edited else words(F.col(text), 0)
    one = texts.select(*keys, F.explode(terms).alias("w"))
    second = F.col("w").bitwiseAND(F.lit(1))
    counted = one.groupBy(*keys, F.col("w").bitwiseAND(F.lit(-2)).alias("term")).agg(F.sum(1 - second).alias("n"), F.sum(second).alias("m"))
    # side 0: the text, 1: the edited one, 2: both, where equal counts have equal values
    of = lambda weight, side: F.struct(F.col(weight).alias("w"), F.lit(side).alias("side"))
    weights = F.when(F.col("n") == F.col("m"), F.array(of("n", 2))).when(F.col("m") == 0, F.array(of("n", 0))).when(F.col("n") == 0, F.array(of("m", 1))).otherwise(F.array(of("n", 0), of("m", 1)))
    rows = counted.select(*keys, "term", F.explode(weights).alias("s")).select(*keys, "term", F.log(F.col("s.w").cast("double")).alias("lw"), F.col("s.side").alias("side"))
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    values = rows.select(*keys, (F.col("g") * 4 + F.col("side")).alias("gs"), *[sample_value(F.col("term"), F.col("lw"), F.col("g") * GROUP + j, table).alias(f"v{j}") for j in range(GROUP)])
    sides = values.groupBy(*keys, "gs").agg(*[F.min(f"v{j}").alias(f"v{j}") for j in range(GROUP)])
    has = {"x": F.col("gs") % 4 != 1, "y": F.col("gs") % 4 != 0}
    least = [F.min(F.when(has[side], F.col(f"v{j}"))).alias(f"{side}{j}") for side in ("x", "y")[: 2 if edited else 1] for j in range(GROUP)]
    groups = sides.groupBy(*keys, F.shiftright("gs", 2).alias("g")).agg(*least)
    low = lambda side: F.array(*[F.when(F.col(f"{side}{j}").isNotNull(), F.xxhash64(f"{side}{j}").bitwiseAND(F.lit(0xFFFF)).cast("int")) for j in range(GROUP)])
    joined = lambda side: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", low(side).alias("v")))), lambda s: s.v))
    out = groups.groupBy(*keys).agg(joined("x").alias("fingerprint"), *([joined("y").alias("edited_fingerprint")] if edited else []))
    none = lambda c: F.when(F.get(c, F.lit(0)).isNotNull(), F.col(c)).alias(c)
    return out.select(*keys, *[none(c) for c in out.columns if c.endswith("fingerprint")])


def likeness(one: Column, two: Column) -> Column:
    """Share of equal samples; texts without words are alike."""
    same = F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda x: x)) / F.size(one)
    return F.when(one.isNull() & two.isNull(), F.lit(1.0)).when(one.isNull() | two.isNull(), F.lit(0.0)).otherwise(same).cast("double")


def as_string(fingerprint: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ""), F.lit(""))


def _deal(df: DataFrame, ranges: int) -> DataFrame:
    """Two ranges a partition, where Spark's own number would put more together: tasks grow in number, not in size."""
    parts = ranges // 2 + 1
    return df.repartition(parts, "__range") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Add ``__range`` (of doc_id, -1 for nulls) and ``__no`` (place in it by descending doc_id, equal ones by text)."""
    probes = [i / ranges for i in range(1, ranges)]
    edges = sorted({int(e) for e in docs.where("doc_id is not null").approxQuantile("doc_id", probes, 0.5 / ranges)}) if probes else []
    at = range_of(F.col("doc_id"), edges)
    docs = _deal(docs.withColumn("__range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at).cast("int")), ranges)
    inside = Window.partitionBy("__range").orderBy(F.desc_nulls_last("doc_id"), "text")
    return docs.withColumn("__no", F.row_number().over(inside))


def _follow(df: DataFrame, columns: list[str]) -> DataFrame:
    """next_<column> within ranges by lead, across their ends by a join of one row a range."""
    inside = Window.partitionBy("__range").orderBy("__no")
    last = F.lead("__no").over(inside).isNull()
    df = df.select("*", *[F.lead(c).over(inside).alias(f"__in_{c}") for c in columns], last.alias("__last"))
    heads = df.where("__no = 1").select(F.col("__range").alias("__from"), *[F.col(c).alias(f"__out_{c}") for c in columns])
    # the range that follows is the next lower one that has rows; after the lowest comes the highest
    order = Window.orderBy(F.desc("__from"))
    heads = heads.withColumn("__range", F.coalesce(F.lag("__from").over(order), F.min("__from").over(Window.partitionBy()))).drop("__from")
    out = df.join(heads, "__range", "left")
    names = [c for c in df.columns if not c.startswith("__in_") and c != "__last"]
    return out.select(*names, *[F.when(F.col("__last"), F.col(f"__out_{c}")).otherwise(F.col(f"__in_{c}")).alias(f"next_{c}") for c in columns])


def fingerprint_documents(docs: DataFrame, samples: int = 64, rows_per_range: int = 4000, chars_per_range: int = 2_000_000) -> DataFrame:
    """Fingerprint each text of docs(doc_id, text) and its edit: the last third gives way to the next text's beginning.

    Null texts are empty. Repeated rows each have a row. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. An empty table gives an empty one; other columns are left out. A text of
    any length is one row, whose words are counted before they are sampled. Null doc_ids stand last, in one range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    ranges = max(rows // rows_per_range, chars // chars_per_range) + 1
    placed = _follow(in_ranges(docs, ranges), ["text"])
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.when(third > 0, F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))")).otherwise(F.lit("")))
    both = placed.select("__range", "__no", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    prints = fingerprints(both, ["__range", "__no"], edited="edited", samples=samples)
    rows = both.select("__range", "__no", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")).join(prints, ["__range", "__no"], "left")
    near = _follow(_deal(keep(rows, "fingerprints"), ranges), ["fingerprint"])
    return near.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("fingerprint")).alias("fingerprint"), as_string(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
