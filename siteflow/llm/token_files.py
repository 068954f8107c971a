"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A shard holds documents in ascending doc_id order (nulls first, then equal ids by their tokens' bytes): a header, the documents'
ids and token counts, then two bits a token that tell its bytes (1 to 4) and, apart from them, the bytes. Tokens
are written as ranks by falling frequency over the whole corpus, so that the most frequent 256 take one byte each.
The rank table has a row for each id of the vocabulary; it lies beside the shards as Parquet.

Reading expands the control bytes by a table of 256 rows to a mask of the bytes in use and scatters the bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices, encoder
from .common import drop, keep, work_dir, write_file

MAGIC = b"RANKSVB1"
HEAD = struct.Struct("<8sqqq")  # magic, documents, tokens, data bytes
#: For each control byte, which of the 16 bytes of its four values are in use.
USED = np.array([[b <= (c >> (2 * v) & 3) for v in range(4) for b in range(4)] for c in range(256)], dtype=bool)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    mask = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[mask].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    mask = USED[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[mask] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def shard_bytes(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join((HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)), known.tobytes(), ids.tobytes(), np.array(counts, dtype="<i8").tobytes(), control, data))


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts, ranks."""
    magic, docs, tokens, size = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size
    known = np.frombuffer(raw, np.uint8, docs, at)
    ids = np.frombuffer(raw, "<i8", docs, at + docs)
    counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    n_control = -(-tokens // 4)
    if len(raw) != at + n_control + size:
        raise ValueError("token shard of the wrong length")
    ranks = unpack(raw[at : at + n_control], raw[at + n_control :], tokens)
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], counts, ranks


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = 8_000_000) -> DataFrame:
    """Write docs(doc_id, text) under path; the manifest (shard, pid, seq, docs, tokens) is returned, read back from path.

    Null and empty texts are one end id. Equal doc_ids stand side by side, by their tokens' bytes; whole
    repeats each have their place. A text of any length is one record. Other columns are not written, whatever their
    names. An empty table gives an empty manifest and no shards.
    """
    spark = docs.sparkSession
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<i4").tobytes()
        total = np.zeros(0, dtype=np.int64)
        for whole in batches:
            for batch in _slices(whole, 1):
                parts = [np.frombuffer(p + end, "<i4") for p in enc.encode(batch.column(1).to_pylist())]
                n = pa.array([len(p) for p in parts], pa.int64())
                c = np.bincount(np.concatenate(parts))
                if len(c) > len(total):
                    c, total = total, c.astype(np.int64)
                total[: len(c)] += c
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([p.astype("<u4" if p.max() > 0xFFFF else "<u2").tobytes() for p in parts], pa.binary())], names=["doc_id", "n_tokens", "ids"])

        # a row of its own for the task's counts: the ids in use and how often, of eight bytes each
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([np.concatenate([at, total[at]]).astype("<i8").tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    # ids of two bytes where they fit, else of four: the length and n_tokens tell which
    tokens = keep(coded.mapInArrow(encode, "doc_id long, n_tokens long, ids binary"), "tokens")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b.ids:
                at, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pd.DataFrame({"id": at, "n": n})

    # a row for each id in use, at most the vocabulary
    counted = tokens.where("n_tokens < 0").select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    order = np.array([r.id for r in counted], dtype=np.int64)
    total = sum(r.n for r in counted)
    spark.createDataFrame(pa.table({"rank": pa.array(range(len(order)), pa.int64()), "id": pa.array(order, pa.int64())})).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype="<u4")
    rank_of[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(rank_of)  # four bytes for each id of the vocabulary

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, seq, held, names, counts = TaskContext.get().partitionId(), 0, 0, [], []
        parts: list[np.ndarray] = []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal seq, held
            name = f"shard-{pid:06d}-{seq:05d}.svb"
            write_file(f"{path}/shards/{name}", shard_bytes(names, counts, np.concatenate(parts)))
            rows.append((name, pid, seq, len(names), held))
            seq, held = seq + 1, 0
            names.clear(), counts.clear(), parts.clear()

        for b in batches:
            for d, n, ids in zip(b.doc_id.astype(object).where(b.doc_id.notna(), None), b.n_tokens, b.ids, strict=True):
                names.append(None if d is None else int(d))
                counts.append(int(n))
                parts.append(sent.value[ids_of(ids, n)])
                held += int(n)
                if held >= shard_tokens:
                    close()
        if names:
            close()
        yield pd.DataFrame(rows, columns=["shard", "pid", "seq", "docs", "tokens"])

    n = int(max(1, min(total // 500_000 + 1, max(spark.sparkContext.defaultParallelism, total // shard_tokens + 1))))
    manifest = tokens.where("n_tokens >= 0").repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids").mapInPandas(write, "shard string, pid long, seq long, docs long, tokens long")
    manifest.write.parquet(f"{path}/manifest")
    drop(tokens)
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def ids_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit), from the files.

    No files give an empty table; null doc_ids come back as null.
    """
    order = np.array([r.id for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    sent = spark.sparkContext.broadcast(order)
    manifest = spark.read.schema("shard string, pid long, seq long, docs long, tokens long").parquet(f"{path}/manifest")
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    # a row for each shard of millions of tokens
    first = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("pid", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "base")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, counts, ranks = read_shard(raw.as_buffer().to_pybytes())
                values = sent.value[ranks]
                ends = np.concatenate([[0], np.cumsum(counts)])
                for lo in range(0, len(names), 2000):
                    hi = min(len(names), lo + 2000)
                    raws = [values[ends[k] : ends[k + 1]].tobytes() for k in range(lo, hi)]
                    cols = [pa.array([name] * (hi - lo)), pa.array(names[lo:hi], pa.int64()), pa.array(ends[lo:hi], pa.int64()), pa.array(counts[lo:hi], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array(raws, pa.binary())] if ids else []), names=fields.names)

    fields = T.StructType().add("shard", "string").add("doc_id", "long").add("at", "long").add("n_tokens", "long").add("ids_crc32", "long")
    fields = fields.add("ids", "binary") if ids else fields
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svb").load(f"{path}/shards").select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    # a file is a unit of work: shards are spread over the tasks by name
    rows = files.mapInArrow(decode, fields)
    return rows.join(first, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_file_digests(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs as token files and read them back: doc_id, start, n_tokens, ids_crc32. Odd rows are as in write_token_files."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path, ids=False)
