"""Reading and writing the files of a study: CSV, GeoJSON, JSON, exports, manifests, signatures and kept fits.

What is written replaces the target in one rename, so a reader sees the old file or the new one. Paths are URIs of any store
that Hadoop opens. ``csv_file`` and ``json_file`` write one file through one task, as exports of a study's result tables
are; large tables go to Parquet.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
#: Seconds to wait before each new try of a rename.
WAITS = (0.05, 0.1, 0.2, 0.4, 0.8)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under spark.checkpoint.dir; a temporary folder serves local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="siteflow-files-"))
    return f"{base.rstrip('/')}/siteflow-{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def replace_file(spark: SparkSession, new: str, target: str) -> None:
    """Rename new to target, over what is there; tried again after each of WAITS."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    options = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    for wait in (*WAITS, None):
        try:
            source = hadoop.Path(new)
            context = hadoop.FileContext.getFileContext(source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(source, hadoop.Path(target), options)
            return
        except Exception:
            if wait is None:
                raise
            time.sleep(wait)


def read_csv(spark: SparkSession, path: str, text: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """A CSV with a header: types are inferred, but for the columns of ``text``, whose digits (zeros in front too) stay text."""
    reader = spark.read.option("header", True).option("sep", sep)
    inferred = reader.option("inferSchema", True).csv(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in inferred])
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def read_text_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every column as text; an empty field is an empty string, and 'NA' is 'NA'."""
    return spark.read.option("header", True).option("sep", sep).csv(path).na.fill("")


def numbered(spark: SparkSession, path: str, schema: str | None = None, first: int = 2, no: str = "source_row_number") -> DataFrame:
    """A CSV's rows with their numbers in the file (2 is the row under the header), without sorting them.

    Rows are numbered within each block that a task reads, and a table with a row for each block says where it starts.
    Files follow each other by name. Quoted fields must not hold line ends.
    """
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    names = rows.columns
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__file", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.join(starts, ["__file", "__block"]).select(*names, (F.col("__base") + F.col("__at") - F.col("__first") + first).alias(no))


GEO = "type string, features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
_RINGS = "array<array<array<double>>>"


def read_regions(spark: SparkSession, path: str, codes: Iterable[str] = (), code: str = "codarea", check: bool = True) -> DataFrame:
    """Edges (poly, part, ring, x1, y1, x2, y2) of a GeoJSON's polygons; ``codes`` picks regions, none takes all.

    A byte order mark is skipped. With ``check`` it is an error if the file is no FeatureCollection, a code is missing, a
    geometry is neither Polygon nor MultiPolygon, or a ring is open, has fewer than four points or no area; nothing is
    repaired. The edges of all regions together make the union for inside tests of regions that don't overlap.
    """
    wanted = sorted({str(c) for c in codes})
    raw = spark.read.schema(GEO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if check and raw.where("type = 'FeatureCollection'").count() != 1:
        raise ValueError("not a FeatureCollection")
    f = raw.select(F.explode("features").alias("f")).select(F.get_json_object("f.properties", f"$.{code}").alias("poly"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    f = f.where(F.col("poly").isin(wanted)) if wanted else f
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", _RINGS))).when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{_RINGS}>"))
    shapes = f.select("poly", "kind", parts.alias("parts"))
    rings = shapes.select("poly", F.posexplode("parts").alias("part", "rings")).select("poly", "part", F.posexplode("rings").alias("ring", "points"))
    edges = rings.select("poly", "part", "ring", F.explode(F.expr("transform(sequence(1, greatest(size(points) - 1, 1)), i -> struct(get(points, i - 1) as p, get(points, i) as q))")).alias("e"))
    edges = edges.select("poly", "part", "ring", F.get("e.p", F.lit(0)).alias("x1"), F.get("e.p", F.lit(1)).alias("y1"), F.get("e.q", F.lit(0)).alias("x2"), F.get("e.q", F.lit(1)).alias("y2"))
    if check:
        known = {r.poly for r in shapes.select("poly").distinct().collect()} if wanted else set()  # at most the codes asked for
        if set(wanted) - known:
            raise ValueError(f"regions missing: {sorted(set(wanted) - known)}")
        closed = F.expr("size(points) >= 4 and get(points, 0) = get(points, size(points) - 1)")
        area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
        wrong = [shapes.where("parts is null or size(parts) = 0").select("poly"), rings.where(~F.coalesce(closed, F.lit(False))).select("poly"), edges.groupBy("poly", "part", "ring").agg(area.alias("a")).where("a is null or abs(a) < 1e-18").select("poly")]
        bad = wrong[0].unionByName(wrong[1]).unionByName(wrong[2]).first()
        if bad:
            raise ValueError(f"invalid geometry: {bad.poly}; no automatic repair")
    return edges


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document as a row; its schema is inferred."""
    return spark.read.option("multiLine", True).json(path)


@F.pandas_udf(T.StringType())
def seventeen_digits(values: pd.Series) -> pd.Series:
    """Seventeen significant digits, enough for the same double on reading; '' for null."""
    return values.map(lambda v: "" if pd.isna(v) else f"{v:.17g}")


def csv_file(df: DataFrame, target: str, order: Sequence[str | Column] = (), sep: str = ",", comma: bool = False, mark: bool = False, digits17: bool = True) -> None:
    """One CSV file with a header. ``comma`` writes decimal commas, ``mark`` a byte order mark, ``order`` sorts the rows.

    Floats have seventeen significant digits unless ``digits17`` is off. An empty table gives the header alone.
    """
    spark = df.sparkSession
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    rows = df.coalesce(1).sortWithinPartitions(*order) if order else df.coalesce(1)

    def out(name: str) -> Column:
        value = F.col(f"`{name}`")
        if name in floats:
            value = seventeen_digits(value) if digits17 else value.cast("string")
            value = F.translate(value, ".", ",") if comma else value
        return value.alias(name)

    rows = rows.select(*map(out, df.columns))
    if mark and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])
    part = f"{target}.{uuid.uuid4().hex}"
    rows.write.option("header", True).option("sep", sep).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(part)
    store, folder = _store(spark, part)
    try:
        names = [s.getPath().toString() for s in store.listStatus(folder) if s.getPath().getName().endswith(".csv")]
        if names:
            replace_file(spark, names[0], target)
        else:  # no partition at all
            text_file(spark, ("﻿" if mark else "") + sep.join(df.columns) + "\n", target)
    finally:
        store.delete(folder, True)


def text_file(spark: SparkSession, text: str, target: str) -> None:
    part = f"{target}.{uuid.uuid4().hex}"
    store, path = _store(spark, part)
    out = store.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace_file(spark, part, target)


def json_file(spark: SparkSession, value: object, target: str) -> None:
    """A value as JSON with sorted keys."""
    text_file(spark, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n", target)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files under a folder, each at most 2 GB, as one cell holds a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose bytes differ between two manifests, or that one of them lacks: (file, change)."""
    old, new = before.select("file", F.col("sha256").alias("old")), after.select("file", F.col("sha256").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "file", "full").select("file", kind.alias("change")).where("change is not null")


def signature(*columns: str) -> Column:
    """SHA-256 of the row's JSON, keys in the order given; null fields stay as null."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def put_fit(fit: DataFrame, store: str, key: str) -> None:
    """Keep a fit's rows under its key; a repeated run replaces them."""
    fit.write.mode("overwrite").parquet(f"{store.rstrip('/')}/fit={key}")


def get_fit(spark: SparkSession, store: str, key: str) -> DataFrame | None:
    """The fit kept under the key, or None; a fit that was not written to its end counts as none."""
    files, path = _store(spark, f"{store.rstrip('/')}/fit={key}/_SUCCESS")
    return spark.read.parquet(f"{store.rstrip('/')}/fit={key}") if files.exists(path) else None
