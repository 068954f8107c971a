"""What several of the training-data operators share: the shared work folder, words and files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SQL = r"[^\\x20\\x09-\\x0D]+"

_OWN: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="siteflow-"))
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{work_root(spark)}/siteflow-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what keep() wrote for these, once nothing reads it any more."""
    for df in frames:
        spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle() -> None:
    """Give memory that this worker no longer uses back to the system: Spark keeps workers for other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *new: str | None) -> list[str]:
    """df's columns but for those named like the new ones; Spark doesn't tell capitals."""
    taken = {x.lower() for x in new if x}
    return [c for c in df.columns if c.lower() not in taken]


def range_of(value: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are at most the value; for many edges in two steps of an array each."""
    below = lambda array: F.size(F.filter(array, lambda e: e <= value))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    if not edges:
        return F.lit(0)
    if len(edges) <= 1000:
        return below(longs(edges))
    step = int(len(edges) ** 0.5) + 1
    parts = [edges[k : k + step] for k in range(0, len(edges), step)]
    part = below(longs([x[0] for x in parts])) - 1
    return F.when(part < 0, 0).otherwise(part * step + below(F.get(F.array(*map(longs, parts)), part)))


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def file_system(uri: str):
    """pyarrow's file system and path for a URI; any store that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else "file://" + os.path.abspath(uri))


def write_file(uri: str, data: bytes) -> None:
    """Write under a temporary name, then rename: a lost or repeated task leaves one whole file."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)
