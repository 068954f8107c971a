"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, tokenizer_file("word_bpe_49k.json"), decoded="decoded")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op4_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import COUNTS, quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept", "score")


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_documents

    found = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.tiktoken"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "token")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


def _oracles() -> None:
    from .mixing import MIX_SQL

    ORACLE["op8_systematic_mix"] = MIX_SQL


_oracles()


@query
def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


#: Pages have no fetch time: page_id gives a day of 2024.
@query
def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_lists import filter_captures

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 7919, 366) as int))"))
    return filter_captures(captures, dated_list(pages)).select("page_id", "url", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", "decided_by", F.col("active_since").cast("string").alias("active_since"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Entries made by rule from the hosts, their parent domains and one path: added on one day, changed or removed later."""
    from .url_lists import url_host

    hosts = pages.select(url_host(F.col("url")).alias("host")).where("host <> ''").distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    keys = hosts.select(F.explode(F.array(F.col("host"), parent, F.concat("host", F.lit("/en")))).alias("key")).distinct()
    byte = lambda i: F.conv(F.substring(F.md5("key"), i, 2), 16, 10).cast("int")
    first = F.date_add(F.lit("2024-01-01").cast("date"), byte(1))
    kinds = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("block"), F.lit("remove")), byte(5) % 4 + 1)
    then = F.element_at(F.array(F.lit("remove"), F.lit("block"), F.lit("allow"), F.lit("block")), byte(7) % 4 + 1)
    log = F.array(F.struct(kinds.alias("action"), first.alias("date")), F.struct(then.alias("action"), F.date_add(first, byte(3) + 1).alias("date")))
    return keys.select("key", F.explode(log).alias("e")).select("key", "e.action", "e.date")


_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
_PATH = r"regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1)"
URL_SQL = f"""
WITH c AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host <> ''),
k AS (SELECT host AS key FROM h UNION SELECT regexp_replace(host, '^[^.]*\\.', '') FROM h UNION SELECT host || '/en' FROM h),
b AS (SELECT key, CAST('0x' || substr(md5(key), 1, 2) AS INTEGER) AS b1, CAST('0x' || substr(md5(key), 3, 2) AS INTEGER) AS b3, CAST('0x' || substr(md5(key), 5, 2) AS INTEGER) AS b5, CAST('0x' || substr(md5(key), 7, 2) AS INTEGER) AS b7 FROM k),
e AS (SELECT key, ['block', 'allow', 'block', 'remove'][b5 % 4 + 1] AS action, DATE '2024-01-01' + b1 AS since, DATE '2024-01-01' + b1 + b3 + 1 AS until FROM b
  UNION ALL SELECT key, ['remove', 'block', 'allow', 'block'][b7 % 4 + 1], DATE '2024-01-01' + b1 + b3 + 1, NULL FROM b),
q AS (SELECT page_id, fetched, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1), lambda i: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:i], '/')))) AS key
  FROM c WHERE host <> ''),
m AS (SELECT q.page_id, e.key, e.action, e.since, row_number() OVER (PARTITION BY q.page_id ORDER BY length(e.key) DESC, e.action, e.key) AS n
  FROM q JOIN e ON q.key = e.key AND e.action <> 'remove' AND e.since <= q.fetched AND (e.until IS NULL OR e.until > q.fetched))
SELECT c.page_id, c.url, c.host, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(m.action = 'block', false) AS blocked, m.key AS decided_by, CAST(m.since AS VARCHAR) AS active_since
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.n = 1
"""


def _more_oracles() -> None:
    from .warc import WARC_SQL

    ORACLE["op5_warc_salvage"] = WARC_SQL
    ORACLE["op10_url_lists"] = URL_SQL


_more_oracles()


@query
def op3_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_paths import extract_pages

    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weighted_sampling import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))
