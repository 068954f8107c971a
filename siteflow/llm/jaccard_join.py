"""Exact n-gram Jaccard self-join by partitioning the universe of shingles.

Sizes fall into bands; in each band a hash deals all shingles to a fixed number of segments. Two sets of similarity
t differ in at most ``2 * larger * (1 - t) / (1 + t)`` shingles, so that among one segment more than this, one at
least holds the same shingles in both (pigeonhole). A set is indexed by the subset of each segment, in its own band
and in the next one if sets there may be its partners; the larger set of a pair asks in its own band.

Allocation: a set need ask only as many segments as may differ, plus one. Asking costs as much as others have the
same subset, so it asks where that is rarest: segments whose subset nobody shares come first and cost nothing, and
subsets of passages that many documents hold come last, mostly never. A set with too few filled segments asks some
of them with one-deletion neighbourhoods: such a segment counts for two, as it also finds subsets that differ by one
shingle; bands with such a set index deletions too.

Equal sets are one node from the start. Within a bucket all nodes are first compared with one of them, its star; after
links are merged to components, only pairs across components remain. A large bucket is then narrowed: with d(x) the
shingles in which x and the star differ, x and y differ in ``|d(x)| + |d(y)| - 2 |d(x) & d(y)|``. What both lack of the
star is bounded by counts and 64 bits; of what both have beyond the star, only shingles that a node of another component
has too can be in both, so that only these are rows. So most nodes of a group of near copies drop
out by counts, without being paired; the pairs left are compared. Every linked pair is thus compared, or within one
component, or shown by counts to be none. Sets are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _slices
from .common import drop, keep, settle

PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)
A, B, C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
WHOLE, OWN, FORCED = 0, 1, 2  # roles of a row: index only, index and may ask, asks only
BOUND = ("surplus", "missing", "lacks", "reach", "bits")  # what narrow() adds for a node


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> C)) * A
    x = (x ^ (x >> C)) * B
    return x ^ (x >> C)


#: A random number for each byte, capitals as small letters; and which bytes are white space.
BYTES = mix(np.arange(256, dtype=np.uint64) * PRIMES[1] + PRIMES[2])
BYTES[65:91] = BYTES[97:123]
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(PRIMES[3])
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x))])) for x in (base, pow(base, -1, 1 << 64)))


_usual_powers = lru_cache(maxsize=1)(_powers)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts that lie one after another (ends: where each ends), and its text's number."""
    blank = BLANK[data]
    begin, last = ~blank, ~blank
    begin[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
    begin[cuts], last[cuts - 1] = ~blank[cuts], ~blank[cuts - 1]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(last) + 1
    # a word is a polynomial of its bytes' numbers: from sums up to its ends, shifted to its start
    up, down = _usual_powers(1 << 20) if len(data) <= 1 << 20 else _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo]), np.searchsorted(ends, lo, side="right")


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, one text after another, and where each text's begin and end.

    ASCII letters are lower-cased; a text of fewer words has all of them as one shingle, one without words none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    h, of = word_hashes(data, at[1:] - at[0])
    words = np.bincount(of, minlength=len(texts))
    first = np.cumsum(words) - words
    value, doc = [], []
    for k in range(1, n + 1):
        where = np.flatnonzero(of[: len(h) - n + 1] == of[n - 1 :]) if k == n and len(h) >= n else first[words == k] if k < n else first[:0]
        total = np.full(len(where), k, dtype=np.uint64)
        for i in range(k):  # words' hashes are random, so a sum with odd factors tells shingles apart
            total += h[where + i] * (PRIMES[i % 5] + np.uint64(2 * (i // 5)))
        value.append(mix(total))
        doc.append(of[where])
    value, doc = np.concatenate(value), np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    value, doc = value[order], doc[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[lo:hi].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), n)[0]


class Rule:
    """Threshold num / den, bands of sizes and segments of each band."""

    def __init__(self, num: int = 4, den: int = 5, ratio: float = 1.6, slack: float = 1.15, most: int = 1 << 40) -> None:
        self.num, self.den, self.slack = num, den, slack
        edges = [1]
        while edges[-1] < most:
            edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * ratio))))
        self.edges = np.array(edges, dtype=np.int64)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def need(self, size: int) -> int:
        """Segments to ask: the largest difference to an equal or smaller partner, and one."""
        return 2 * size * (self.den - self.num) // (self.den + self.num) + 1

    def segments(self, band: int) -> int:
        return int(np.ceil(self.slack * self.need(int(self.edges[band + 1]) - 1))) + 2

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def partner_bands(self, size: int) -> range:
        """Bands in which a partner that asks may be."""
        return range(self.band(size), self.band(size * self.den // self.num) + 1)


@lru_cache(maxsize=64)
def _seed(band: int) -> np.uint64:
    return mix(np.array([band + 1], dtype=np.uint64) * PRIMES[0])[0]


def places(value: np.ndarray, m: int) -> np.ndarray:
    """The segment of each value."""
    return ((value >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)


def subsets(hashes: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filled segments with their subset's sum and size, and all shingles' values and segments, in segment order."""
    value = mix(hashes + _seed(band))
    where = places(value, m)
    order = np.argsort(where, kind="stable")
    value, where = value[order], where[order]
    seg, first, size = np.unique(where, return_index=True, return_counts=True)
    return seg, np.add.reduceat(mix(value), first) if len(first) else value, size, mix(value), where


def signature(total: np.ndarray, seg: np.ndarray, band: int, kind: int) -> np.ndarray:
    return mix(total + mix((seg.astype(np.uint64) << np.uint64(10)) + np.uint64(2 * band + kind)))


def rows_of(hashes: np.ndarray, rule: Rule, deletions: frozenset[int]) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Signatures, their roles, the number of filled segments of the own band, and whether asking can't cover the need."""
    size = len(hashes)
    own, sigs, roles, filled, short = rule.band(size), [], [], 0, False
    for band in rule.partner_bands(size):
        seg, total, k, value, where = subsets(hashes, band, rule.segments(band))
        exact = signature(total, seg, band, 0)
        sigs.append(exact)
        roles.append(np.full(len(exact), OWN if band == own else WHOLE, dtype=np.int64))
        at = np.searchsorted(seg, where)
        if band in deletions:
            less = signature(total[at] - value, where, band, 1)
            sigs.append(less)
            roles.append(np.full(len(less), WHOLE, dtype=np.int64))
        if band == own:
            filled = len(seg)
            lack = rule.need(size) - filled
            if lack > 0:
                wide = np.flatnonzero(k >= 2)
                short = len(wide) < lack
                wide = wide[np.argsort(-k[wide], kind="stable")][:lack]
                some = np.isin(at, wide)
                # what the partner has one more of, and what it has one less of
                for part in (signature(total[wide], seg[wide], band, 1), signature(total[at[some]] - value[some], where[some], band, 0)):
                    sigs.append(part)
                    roles.append(np.full(len(part), FORCED, dtype=np.int64))
    return np.concatenate(sigs), np.concatenate(roles), filled, short


def set_key(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


class Segments:
    """The filled segments of many sets in one band: ``doc``, ``seg``, ``total`` (the subset's sum), ``filled`` (by set)."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, docs: int, band: int, m: int) -> None:
        value = mix(hashes + _seed(band))
        self.where = places(value, m)
        self.value = mix(value)
        self.key = of * m + self.where
        size = np.bincount(self.key, minlength=docs * m)
        # halves of 32 bits: their sums are exact in floating point
        low, high = (np.bincount(self.key, weights=x.astype(np.float64), minlength=docs * m) for x in (self.value & np.uint64(0xFFFFFFFF), self.value >> np.uint64(32)))
        self.sums = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
        at = np.flatnonzero(size)
        self.doc, self.seg, self.total = at // m, at % m, self.sums[at]
        self.filled = np.bincount(self.doc, minlength=docs)


def document_sets(docs: DataFrame, rule: Rule, n: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (key of the set, null if empty), deletions (band that needs them, else null), short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1, 500_000):
                value, bounds = shingle_sets(batch.column(1), n)
                sizes = np.diff(bounds)
                of, own = np.repeat(np.arange(len(sizes)), sizes), rule.bands(sizes)
                filled = np.zeros(len(sizes), dtype=np.int64)
                for band in np.unique(own[sizes > 0]).tolist():
                    mine = own == band
                    local = np.cumsum(mine) - 1
                    some = mine[of]
                    filled[mine] = Segments(value[some], local[of[some]], int(mine.sum()), band, rule.segments(band)).filled
                lacks = (sizes > 0) & (filled < rule.need(sizes))
                keys = [set_key(value[a:b]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                short = [bool(x) and rows_of(value[a:b], rule, frozenset())[3] for x, a, b in zip(lacks.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                cols = [pa.array(sizes), pa.array(keys, pa.int64()), pa.array(own, mask=~lacks), pa.array(short, pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_shingles", "node", "deletions", "short"])
        settle()

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, node long, deletions long, short boolean")


def signatures(docs: DataFrame, rule: Rule, deletions: frozenset[int], n: int = 5) -> DataFrame:
    """sig, node, meta (size << 32 | band << 26 | filled << 2 | role) of each set; equal sets of a task give their rows once."""
    most = (1 << 24) - 1  # a lower number of filled segments only asks for more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in _slices(whole, 0, 500_000):
                value, bounds = shingle_sets(batch.column(0), n)
                fresh = np.zeros(len(bounds) - 1, dtype=bool)
                keys = np.zeros(len(fresh), dtype=np.int64)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if b > a and (key := set_key(value[a:b])) not in seen:
                        seen.add(key)
                        fresh[k], keys[k] = True, key
                sizes = np.diff(bounds)
                of = np.repeat(np.arange(len(sizes)), sizes)
                own, last = rule.bands(sizes), rule.bands(sizes * rule.den // rule.num)
                need = rule.need(sizes)
                parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for band in range(int(own[fresh].min()), int(last[fresh].max()) + 1) if fresh.any() else ():
                    docs_ = np.flatnonzero(fresh & (own <= band) & (band <= last))
                    if not len(docs_):
                        continue
                    local = np.full(len(sizes), -1)
                    local[docs_] = np.arange(len(docs_))
                    some = local[of] >= 0
                    s = Segments(value[some], local[of[some]], len(docs_), band, rule.segments(band))
                    meta = sizes[docs_] << 32 | band << 26 | np.minimum(s.filled, most) << 2
                    role = np.where(own[docs_] == band, OWN, WHOLE)
                    parts.append((signature(s.total, s.seg, band, 0), keys[docs_][s.doc], (meta | role)[s.doc]))
                    if band in deletions:
                        doc = local[of[some]]
                        parts.append((signature(s.sums[s.key] - s.value, s.where, band, 1), keys[docs_][doc], (meta | WHOLE)[doc]))
                    for k in np.flatnonzero((own[docs_] == band) & (s.filled < need[docs_])).tolist():
                        sig, role, _, _ = rows_of(value[bounds[docs_[k]] : bounds[docs_[k] + 1]], rule, frozenset())
                        sig = sig[role == FORCED]
                        parts.append((sig, np.full(len(sig), keys[docs_[k]]), np.full(len(sig), meta[k] | FORCED)))
                if parts:
                    sig, node, meta = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(meta)], names=["sig", "node", "meta"])
        settle()

    return docs.select("text").mapInArrow(run, "sig long, node long, meta long")


def set_table(docs: DataFrame, wanted: DataFrame, n: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """node and its hashes (binary) for wanted(doc_id, node): one document stands for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in _slices(whole, 1, 500_000):
                rows = []
                value, bounds = shingle_sets(batch.column(1), n)
                for node, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    h = value[a:b]
                    # a doc_id may have several texts; a node of several rows is needed once
                    if node not in seen and len(h) and set_key(h) == node:
                        seen.add(node)
                        rows.append((node, h.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "hashes"])
        settle()

    few = wanted.count() <= broadcast_rows  # two longs a row
    wanted = wanted.withColumnRenamed("doc_id", "__doc")
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("node", "text")
    return texts.mapInArrow(run, "node long, hashes binary")


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of pairs(a, b) whose sets reach the threshold."""
    num, den = rule.num, rule.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, held = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, held = a, np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(den * both >= num * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        settle()

    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of links(a, b), by taking neighbours' labels and jumping."""
    links = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = keep(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = links.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = label.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = keep(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        drop(label)
        if not new.where("was != label").take(1):
            drop(links)
            return new
        label = new


def merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """label(node, label) after links(a, b) between nodes are followed; the old label is deleted if it was kept."""
    known = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
    across = links.join(known, "a").join(known.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b").where("la != lb")
    across = keep(across.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "across")
    if not across.take(1):
        drop(across)
        return label
    roots = components(across)
    merged = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    new = keep(label.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    drop(across, roots, *([label] if hasattr(label, "kept_at") else []))
    return new


def differences(ends: DataFrame, sets: DataFrame) -> DataFrame:
    """ends(star, star_size, node, size) with the shingles of the star that the node lacks, as a count and their places among 64, and the extra ones that the star lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, missing, lacks, extra = None, None, [], [], []
            for c, x, y in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(5), strict=True):
                if c != last:
                    last, held = c, np.frombuffer(y.as_buffer(), np.uint64)
                mine = np.frombuffer(x.as_buffer(), np.uint64)
                none = np.setdiff1d(held, mine, assume_unique=True)
                missing.append(len(none))
                lacks.append(np.bitwise_or.reduce(np.uint64(1) << (none & np.uint64(63)), initial=np.uint64(0)))
                extra.append(np.setdiff1d(mine, held, assume_unique=True).view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(e) for e in extra])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*extra, np.zeros(0, np.int64)])), type=pa.list_(pa.field("element", pa.int64())))
            counts = [pa.array(missing, pa.int64()), pa.array(np.array(lacks, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *counts, listed], names=["star", "star_size", "node", "size", "missing", "lacks", "extra"])
        settle()

    both = ends.join(sets.withColumnRenamed("hashes", "x"), "node").join(sets.select(F.col("node").alias("star"), F.col("hashes").alias("y")), "star")
    return both.select("star", "star_size", "node", "size", "x", "y").mapInArrow(run, "star long, star_size long, node long, size long, missing long, lacks long, extra array<long>")


def narrow(left: DataFrame, label: DataFrame, sets: DataFrame, rule: Rule, large: int, bounds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Compare all nodes of buckets of over ``large`` nodes with the star, follow these links, and drop what can have no others.

    left(sig, node, size, lone, asks, label, star) is returned without label and star, with one more of ``bounds``: a
    struct of BOUND's fields (0 in small buckets). surplus is (den + num) * |d(x)| - (den - num) * |x|; missing is how many
    shingles of the star x lacks, lacks their places among 64; reach is how many extra shingles of x nodes of other
    components of the star's buckets have too, bits their places. A linked pair has
    surplus(x) + surplus(y) <= 2 * (den + num) * |d(x) & d(y)|.
    """
    far, near = rule.den + rule.num, rule.den - rule.num
    left = left.withColumn("n", F.count("*").over(Window.partitionBy("sig")))
    # any set can stand as star: buckets of one group take the same, the most famous one that a member has as star
    chosen = left.where(F.col("n") > large).groupBy("node").agg(F.max("star").alias("chosen"))
    common = left.where(F.col("n") > large).select("sig", "node").join(chosen, "node").groupBy("sig").agg(F.max("chosen").alias("common"))
    left = left.join(common, "sig", "left").select("sig", "node", "size", "lone", "asks", *bounds[:-1], F.col("common.node").alias("star"), F.col("common.size").alias("star_size"))
    left = keep(left, "starred")
    apart = keep(differences(left.where("star is not null").select("star", "star_size", "node", "size").distinct(), sets), "differences")
    differ = F.col("missing") + F.size("extra")
    linked = apart.where(far * differ <= near * (F.col("size") + F.col("star_size")))
    label = merge(label, linked.where("star != node").select(F.col("star").alias("a"), F.col("node").alias("b")))
    each = apart.join(label, "node").select("star", "node", "label", F.explode("extra").alias("e"))
    shared = each.groupBy("star", "e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("star", "e")
    reach = each.select("star", "node", "e").join(shared, ["star", "e"], "left_semi").groupBy("star", "node").agg(F.count("*").alias("reach"), F.bit_or(F.expr("shiftleft(1L, cast(e & 63 as int))")).alias("bits"))
    bound = apart.select("star", "node", "missing", "lacks", (far * differ - near * F.col("size")).alias("surplus")).join(reach, ["star", "node"], "left").fillna(0, ["reach", "bits"]).select("star", "node", *BOUND)
    bound = keep(bound, "bounds")
    gain = 2 * far * (F.col("missing") + F.col("reach")) - F.col("surplus")
    most = bound.groupBy("star").agg(F.min("surplus").alias("least"), F.max(gain).alias("most"))
    able = bound.join(most, "star").where((gain >= F.col("least")) & (F.col("surplus") <= F.col("most")))
    able = able.select("star", "node", F.struct(*BOUND).alias(bounds[-1]))
    small = F.struct(*[F.lit(0).cast("long").alias(c) for c in BOUND])
    out = left.join(able, ["star", "node"], "left").withColumn(bounds[-1], F.when(F.col("star").isNull(), small).otherwise(F.col(bounds[-1]))).where(F.col(bounds[-1]).isNotNull())
    out = keep(out.select("sig", "node", "size", "lone", "asks", *bounds), "narrowed")
    drop(left, apart, bound)
    return out, label


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, n: int = 5, rounds: int = 8, narrowings: int = 1, large: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for each row of docs(doc_id, text).

    Null and blank texts have no shingles and are linked with nothing: component_id is their doc_id. Repeated rows give
    a row each. Null doc_ids take part in links but don't name components; a component of null doc_ids only has null.
    An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    rule = Rule(num, den)
    docs = docs.select("doc_id", "text")
    each = keep(document_sets(docs, rule, n), "sets")
    nodes = keep(each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.max("short").alias("short")), "nodes")
    deletions = frozenset(r[0] for r in each.where("deletions is not null").select("deletions").distinct().collect())  # at most the number of bands
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = signatures(docs, rule, deletions, n).repartition(max(parts, spark.sparkContext.defaultParallelism), "sig")
    role = F.col("meta").bitwiseAND(F.lit(3))
    shared = rows.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"), F.max(role).alias("asks")).where("lo != hi and asks > 0").select("sig", "n")
    bits = lambda at, n: F.shiftright("meta", at).bitwiseAND(F.lit((1 << n) - 1))
    members = rows.join(shared.hint("shuffle_hash"), "sig").select("sig", "node", "n", F.shiftright("meta", 32).alias("size"), bits(26, 6).alias("band"), bits(2, 24).alias("filled"), role.alias("role"))
    members = keep(members.dropDuplicates(["sig", "node", "role"]), "members")

    # allocation: segments nobody shares are asked for nothing, then the rarest
    need = F.expr(f"2 * size * {den - num} div {den + num} + 1")
    mine = members.where(f"role = {OWN}")
    by_node = Window.partitionBy("node")
    place = F.row_number().over(by_node.orderBy("n", "sig"))
    asking = mine.withColumn("place", place).withColumn("c", F.count("*").over(by_node)).where(F.col("place") <= need - (F.col("filled") - F.col("c")))
    asked = asking.select("sig").unionByName(members.where(f"role = {FORCED}").select("sig")).distinct()
    asker = asking.select("sig", "node", F.lit(True).alias("asks"))
    # a node differs from each partner of a band in as many shingles at least as it has segments there that nobody shares
    lone = F.col("filled") - F.sum((F.col("role") != FORCED).cast("int")).over(Window.partitionBy("node", "band"))
    held = members.withColumn("lone", F.greatest(lone, F.lit(0))).where(num * F.col("lone") <= (den - num) * F.col("size"))
    bucket = held.groupBy("sig", "node").agg(F.first("size").alias("size"), F.max("lone").alias("lone"), F.max(F.col("role") == FORCED).alias("forced")).join(asked, "sig", "left_semi")
    bucket = keep(bucket.join(asker, ["sig", "node"], "left").select("sig", "node", "size", "lone", (F.coalesce("asks", F.lit(False)) | F.col("forced")).alias("asks")), "buckets")

    alike = lambda x, y: (den * F.least(x, y)) >= (num * F.greatest(x, y))
    drop(members)
    label = nodes.select("node", F.col("node").alias("label"))
    if bucket.take(1):
        involved = nodes.join(bucket.select("node").distinct(), "node", "left_semi").select("doc_id", "node")
        sets = keep(set_table(docs, involved, n), "hashes")
        label = keep(bucket.select("node").distinct().select("node", F.col("node").alias("label")), "labels")
        left = starred(bucket, label, 0)
        for step in range(1, rounds + 1):
            rest = left.select("node").distinct().count()
            if _pairs_left(left) <= rest:
                break
            # each node is compared with the star that it meets most often
            star = F.col("star")
            star_pairs = left.where((star.getField("label") != F.col("label")) & alike(star.getField("size"), F.col("size"))).select(F.least("node", star.getField("node")).alias("a"), F.greatest("node", star.getField("node")).alias("b"), F.col("node").alias("of")).groupBy("of", "a", "b").agg(F.count("*").alias("times"))
            pairs = star_pairs.groupBy("of").agg(F.max(F.struct("times", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
            links = keep(verify(pairs, sets, rule), "verified")
            found = links.count()
            if found:
                label = merge(label, links)
                old, left = left, starred(left.select("sig", "node", "size", "lone", "asks"), label, step)
                drop(old)
            drop(links)
            if found <= 0.02 * rest:
                break
        bounds: list[str] = []
        for step in range(rounds + 1, rounds + 1 + narrowings):
            if not _pairs_left(left, large):
                break
            bounds.append(f"bound{step}")
            bounded, label = narrow(left, label, sets, rule, large, bounds)
            drop(left)
            left = starred(bounded, label, step)
            drop(bounded)
        if left.take(1):
            side = lambda of, low: [F.col(x).alias(x + of) for x in ("node", "size", "lone", "label", *bounds)] + [F.col(low).alias("low" + of)]
            # a pair is made in the first bucket in which it is asked for, as far as the nodes' first 16 buckets tell
            first = lambda c: F.slice(F.sort_array(F.collect_set(c)), 1, 16)
            rows = left.join(left.groupBy("node").agg(first(F.when(F.col("asks"), F.col("sig"))).alias("asked"), first(F.col("sig")).alias("all")), "node")
            one, two = rows.where("asks").select("sig", *side("1", "asked")), rows.select("sig", *side("2", "all"))
            met = (F.col("label1") != F.col("label2")) & (F.col("size2") <= F.col("size1")) & alike(F.col("size1"), F.col("size2"))
            met = met & ((den + num) * F.greatest("lone1", "lone2") <= (den - num) * (F.col("size1") + F.col("size2")))
            for x in bounds:
                met = met & (F.col(f"{x}1.surplus") + F.col(f"{x}2.surplus") <= 2 * (den + num) * _common(x))
            met = met & (F.coalesce(F.array_min(F.array_intersect("low1", "low2")), F.col("sig")) >= F.col("sig"))
            crossed = one.join(two, "sig").where(met)
            pairs = crossed.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
            links = keep(verify(pairs, sets, rule), "verified")
            label = merge(label, links)
            drop(links)
        drop(left, sets)
    drop(bucket)
    lonely = nodes.where("short").select("node", "size", "doc_id")
    if lonely.take(1):
        label = _compare_with_all(docs, nodes, lonely, label, rule, n)
    full = nodes.join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    root = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = full.join(root, "label").select("node", "component_id")
    return each.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def starred(left: DataFrame, label: DataFrame, step: int) -> DataFrame:
    """left with its nodes' labels and each bucket's star, without buckets of one component.

    Nodes in many large buckets are the likeliest to be near all others of them; every third step takes others.
    """
    left = left.join(label, "node")
    known = left.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).groupBy("node").agg(F.sum("n").alias("fame"))
    fame = F.col("fame") if step % 3 < 2 else F.lit(0)
    mixed = left.join(known, "node").groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("asks").alias("asked"), F.max(F.struct(fame.alias("fame"), F.xxhash64("node", F.lit(step)).alias("h"), "node", "size", "label")).alias("star")).where("lo != hi and asked")
    return keep(left.join(mixed.select("sig", "star"), "sig"), "open")


def _common(bound: str) -> Column:
    """At most so many shingles are in the d of both: of one's, places that the other lacks hold one each at least."""

    def most(count: str, bits: str) -> Column:
        side = lambda one, two: F.col(f"{bound}{one}.{count}") - F.bit_count(F.col(f"{bound}{one}.{bits}").bitwiseAND(F.bitwise_not(F.col(f"{bound}{two}.{bits}"))))
        return F.least(side("1", "2"), side("2", "1"))

    return most("missing", "lacks") + most("reach", "bits")


def _pairs_left(left: DataFrame, large: int = 0) -> int:
    """Pairs across components that would be compared at most, in buckets of over ``large`` nodes."""
    by = left.groupBy("sig", "label").agg(F.count("*").alias("m"), F.sum(F.col("asks").cast("int")).alias("q"))
    one = by.groupBy("sig").agg(F.sum("m").alias("n"), (F.sum("m") * F.sum("q") - F.sum(F.col("m") * F.col("q"))).alias("p"))
    return int(one.where(F.col("n") > large).select(F.sum("p")).first()[0] or 0)


def _compare_with_all(docs: DataFrame, nodes: DataFrame, lonely: DataFrame, label: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Sets that deletions can't serve (many shingles in very few segments; next to none) are compared with all of like size."""
    sizes = F.sequence(F.expr(f"(size * {rule.num} + {rule.den - 1}) div {rule.den}"), F.expr(f"size * {rule.den} div {rule.num}"))
    ask = lonely.select(F.col("node").alias("b"), F.explode(sizes).alias("size"))
    pairs = nodes.select(F.col("node").alias("a"), "size").join(ask, "size").where("a != b").select("a", "b")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = keep(verify(pairs, keep(set_table(docs, nodes.join(ends, "node", "left_semi").select("doc_id", "node"), n), "hashes"), rule), "verified")
    return merge(nodes.select("node").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")), links)
