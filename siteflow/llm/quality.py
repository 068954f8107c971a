"""Quality rules with an isolation forest on their statistics.

Each text's statistics (counts of words, symbols, repeated lines and so on) become rates; trees that split a random
rate at a random point isolate unusual documents after few splits. The threshold on the path-length score comes
from labelled rows: it rejects at most ``clean_loss`` of the rows labelled good.

Each tree's sample is mostly rows labelled good, with a few labelled bad among them, so that the bad are rare enough
to be isolated; rates are drawn in proportion to how much labelled junk they tell apart.

The forest is fitted on all labelled rows: each tree draws its sample from all of them, and rates' ranges, the junk that
they tell and the threshold are exact over all. All documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import drop, keep, others, settle, tick

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "marks")
MIN_WORDS, MAX_REPEATS = 50, 50


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts, and the rates made from them."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            lines += 1
            again += line in seen
            seen.add(line)
    no: dict[bytes, int] = {}
    ids = np.array([no.setdefault(w, len(no)) for w in words], dtype=np.int64)
    repeats = 0
    if n > 3:
        pair = np.unique(ids[:-1] * len(no) + ids[1:], return_inverse=True)[1]
        _, which, times = np.unique(pair[:-1] * len(no) + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        hit = np.zeros(n, dtype=bool)
        for k in range(3):
            hit[at + k] = True
        repeats = int(hit.sum())
    most = max(1, chars)
    capitals = sum(map(str.isupper, text)) if n else 0
    marks = text.count("!") + text.count("?")
    rates = [chars / max(1, n), symbols / most, again / max(1, lines), repeats / max(1, n), len(no) / max(1, n) ** 0.85, capitals / most, marks / most]
    return [n, chars, symbols, again, repeats], rates


class Forest(NamedTuple):
    """Trees of equal depth as arrays over (tree, node); the children of node k are 2k + 1 and 2k + 2."""

    rate: np.ndarray
    point: np.ndarray  # nan at a leaf
    length: np.ndarray  # path length at a leaf
    normal: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / its expectation): near 1 for the unusual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for rate, point, length in zip(self.rate, self.point, self.length, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                p = point[node]
                inner = ~np.isnan(p)
                if not inner.any():
                    break
                right = x[rows, rate[node]] >= p
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** -(total / len(self.rate) / self.normal)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow_trees(samples: list[np.ndarray], weight: np.ndarray, sample: int, seed: int = 7) -> Forest:
    """A tree from each sample of about so many rows; a rate is drawn in proportion to its weight. The threshold is 1."""
    rng = np.random.default_rng(seed)
    deep = int(np.ceil(np.log2(max(2, sample)))) + 2
    size = 2 ** (deep + 1) - 1
    rate = np.zeros((len(samples), size), dtype=np.int64)
    point = np.full((len(samples), size), np.nan)
    length = np.zeros((len(samples), size))

    def grow(t: int, node: int, depth: int, rows: np.ndarray) -> None:
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if depth == deep or len(rows) < 2 or not len(open_):
            length[t, node] = depth + _expected(len(rows))
            return
        k = int(rng.choice(open_, p=weight[open_] / weight[open_].sum()))
        cut = rng.uniform(low[k], high[k])
        cut = cut if cut > low[k] else high[k]
        rate[t, node], point[t, node] = k, cut
        below = rows[:, k] < cut
        grow(t, 2 * node + 1, depth + 1, rows[below])
        grow(t, 2 * node + 2, depth + 1, rows[~below])

    for t, rows in enumerate(samples):
        grow(t, 0, 0, rows)
    return Forest(rate, point, length, max(_expected(sample), 1e-9), 1.0)


def _least(rows: DataFrame, value: Column, many: int) -> np.ndarray:
    """The least values, so many of them, in order."""
    return rows.select(value.cast("double").alias("v")).orderBy("v").limit(many).toPandas().v.to_numpy()


def _low_quantile(rows: DataFrame, value: Column, n: int, q: float) -> float:
    """The exact quantile of n rows, between neighbours in proportion; what lies below it passes through the driver."""
    at = q * (n - 1)
    least = _least(rows, value, int(at) + 2)
    return float(least[int(at)] + (least[min(int(at) + 1, n - 1)] - least[int(at)]) * (at - int(at)))


def _samples(rows: DataFrame, n: int, trees: int, many: int) -> list[np.ndarray]:
    """For each tree many of the n rows(h, rates): those whose hash with the tree's number is least, so all are as likely."""
    share = (many + 8 * many**0.5 + 16) / max(1, n)
    while True:
        bound = F.lit(min(2**63 - 1, int(-(2**63) + min(1.0, share) * 2**64)))
        drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64("h", t) <= bound)
        got = rows.select("rates", "h", F.explode(drawn).alias("t")).select("t", F.xxhash64("h", "t").alias("u"), "rates").orderBy("t", "u", "rates").toPandas() if many else None
        out = [np.array(g.rates.tolist()[:many], dtype=float) for _, g in got.groupby("t")] if many else [np.zeros((0, len(RATES)))] * trees
        if share >= 1 or (len(out) == trees and min(map(len, out)) == many):
            return out
        share *= 2


def fit(rows: DataFrame, trees: int = 200, sample: int = 256, clean_loss: float = 0.002, contamination: float = 0.015, seed: int = 7) -> Forest | None:
    """Grow trees on rows(h, rates, good) and set the threshold from those labelled good; None without rows. Counts, quantiles
    and the threshold are those of all rows; a tree's sample is the method's own and drawn from all of them."""
    counts = {r.good: r.n for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if not n:
        return None
    sample = min(sample, n)
    if len(counts) < 2:
        return grow_trees(_samples(rows, n, trees, sample), np.ones(len(RATES)), sample, seed)
    clean, junk = rows.where("good"), rows.where("not good")
    # a rate is drawn as often as it tells labelled junk: the share of junk outside nearly all good rows' range
    each = [F.get("rates", F.lit(k)) for k in range(len(RATES))]
    low = [_low_quantile(clean, r, counts[True], clean_loss / 2) for r in each]
    high = [-_low_quantile(clean, -r, counts[True], clean_loss / 2) for r in each]
    told = junk.agg(*[F.avg(((r < a) | (r > b)).cast("double")) for r, a, b in zip(each, low, high, strict=True)]).first()
    rare = min(counts[False], int(np.ceil(sample * contamination)))  # what is to be isolated must be rare in a tree's sample
    usual = min(counts[True], sample - rare)
    drawn = zip(_samples(clean, counts[True], trees, usual), _samples(junk, counts[False], trees, rare), strict=True)
    forest = grow_trees([np.concatenate(x) for x in drawn], np.array(told) + 0.01, sample, seed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, len(RATES))
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x)), b.column(1)], names=["score", "good"])

    scored = keep(rows.select("rates", "good").mapInArrow(score, "score double, good boolean"), "scores")
    place = min(counts[True] - 1, int(np.ceil(counts[True] * (1 - clean_loss))))
    threshold = -float(_least(scored.where("good"), -F.col("score"), counts[True] - place)[-1])
    bad = _low_quantile(scored.where("not good"), F.col("score"), counts[False], 0.01)
    drop(scored)
    # midway, if nearly all labelled junk scores above that
    return forest._replace(threshold=max(threshold, (threshold + bad) / 2))


SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("rates", T.ArrayType(T.DoubleType())), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def score_documents(docs: DataFrame, forest: Forest | None = None, text: str = "text") -> DataFrame:
    """Add the counts, base_failed, rates, score and kept; columns of these names are replaced, all others pass.

    Null and empty texts have no words and fail the base rules. Without a forest the base rules alone decide. Whole texts
    count, however long; equal texts have equal results, repeated rows one each; an empty table gives an empty one.
    """
    names = others(docs, *SCHEMA.names)
    docs = docs.select(*map(tick, names))
    schema = T.StructType([docs.schema[c] for c in names] + list(SCHEMA))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                found = [statistics(t or "") for t in batch.column(at).to_pylist()]
                counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
                rates = np.array([r for _, r in found], dtype=float).reshape(-1, len(RATES))
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATS * counts[:, 0])
                score = forest.score(rates) if forest else np.zeros(len(rates))
                kept = ~failed & (score <= (forest.threshold if forest else 1.0))
                ends = pa.array(np.arange(len(rates) + 1, dtype=np.int32) * len(RATES))
                listed = pa.ListArray.from_arrays(ends, pa.array(rates.reshape(-1)), type=pa.list_(pa.field("element", pa.float64())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), listed, pa.array(score), pa.array(kept)], names=schema.names)
        settle()

    return docs.mapInArrow(run, schema)


def fit_forest(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000, **more: float) -> Forest | None:
    """A forest from all labelled documents that pass the base rules; None where there are none."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = some.count() <= broadcast_rows  # two numbers a row
    chosen = docs.select("doc_id", "text").join(F.broadcast(some) if few else some, "doc_id")
    passed = score_documents(chosen).where("not base_failed").select(F.xxhash64("doc_id", "rates").alias("h"), "rates", (F.col("quality") == 1).alias("good"))
    rows = keep(passed, "rates")
    forest = fit(rows, **more)
    drop(rows)
    return forest


def quality_rules(docs: DataFrame, labels: DataFrame, **more: float) -> DataFrame:
    return score_documents(docs, fit_forest(docs, labels, **more))
