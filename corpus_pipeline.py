"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflow.llm.bpe import encode_documents
from siteflow.llm.common import keep
from siteflow.llm.jaccard_join import near_duplicates
from siteflow.llm.mixing import mixed
from siteflow.llm.quality import quality_rules
from siteflow.llm.queries import table, tokenizer_file
from siteflow.llm.secrets import scan_documents


def _names(docs: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest. Null and blank texts fail them; repeated rows pass or fail alike."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(*_names(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (nulls last), of equal ones by a hash of id and text.

    Null and blank texts are copies only of rows with the same doc_id and text; of such repeats one row stays too.
    """
    # rows are told by this hash, so null and repeated doc_ids need no care; the row is packed, so its columns have any names
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text", F.struct(*_names(docs)).alias("row"))
    found = keep(near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").distinct(), "found")
    ids = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("first"))
    stay = keep(first.select("first.key", "first.n"), "stay")
    out = keyed.join(stay.select("key"), "key", "left_semi")
    if stay.where("n > 1").take(1):
        out = out.groupBy("key").agg(F.first("row").alias("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with [secret] in place of each span; n_chars follows. Null texts stay null; every row stays."""
    out = scan_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), spans="__spans", redacted="text").drop("__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*_names(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them; those of size 0 not at all or as rows without words, as their place falls."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digest of the text that they decode to; null texts have no ids."""
    coded = encode_documents(docs.select("doc_id", "source", "text"), tokenizer_file("word_bpe_49k.json"), decoded="decoded")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("mixing", mixing), ("BPE encoding", encoding)]
#: A forest and a BPE encoder have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
