"""Comparison of networks: dominance, envelopment efficiency, regressions along curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflow.sources.files import work_folder


def pareto(df: DataFrame, by: str, a: str, b: str, key: str) -> DataFrame:
    """Rows that none of their group is at least as good as in a and b and better in one (less is better). Of all rows up to
    one's a, the least b must be its own, and no smaller a may have it: a window instead of a self-join."""
    up = Window.partitionBy(by).orderBy(a)
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    marked = df.withColumn("__m", F.min(F.when(known, F.struct(F.col(b).alias("b"), F.col(a).alias("a")))).over(up))
    return marked.where(known & (F.col("__m.b") == F.col(b)) & (F.col("__m.a") == F.col(a))).drop("__m")


def _peers(dmus: DataFrame, group: str) -> DataFrame:
    """Units and all peers of their group; groups are profiles of some tens of networks."""
    peer = dmus.select(F.col(group).alias("__g"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("y").alias("py"))
    return dmus.join(peer, F.col(group) == F.col("__g")).drop("__g")


def fdh(dmus: DataFrame, group: str = "g", key: str = "dmu") -> DataFrame:
    """Free disposal hull, two inputs, one output: least largest input ratio to a peer with as much output."""
    ratio = F.greatest(F.col("p1") / F.col("x1"), F.col("p2") / F.col("x2"))
    return _peers(dmus, group).where(F.col("py") >= F.col("y") - 1e-6).groupBy(group, key).agg(F.round(F.min(ratio), 6).alias("h_fdh"))


def _frontier(dmus: DataFrame, group: str, key: str) -> DataFrame:
    """Peers by group (__g) with their inputs for an output of one, p1 and p2: those that no other beats in both."""
    each = dmus.select(F.col(group).alias("__g"), F.col(key).alias("peer"), F.try_divide("x1", "y").alias("p1"), F.try_divide("x2", "y").alias("p2"), F.col("y").alias("py")).where("p1 is not null and p2 is not null")
    return pareto(each, "__g", "p1", "p2", "peer")


def _ratios(dmus: DataFrame, group: str, key: str) -> DataFrame:
    """Units and the peers that may serve them, as inputs for an output of one relative to the unit's own: a and b.

    A mix of peers is no better for one that another peer beats in both inputs, so only the frontier of a group is joined.
    """
    peers = _frontier(dmus, group, key)
    joined = dmus.join(peers, F.col(group) == F.col("__g"), "left").drop("__g")
    return joined.withColumn("a", F.try_divide("p1", F.try_divide("x1", "y"))).withColumn("b", F.try_divide("p2", F.try_divide("x2", "y")))


def _held(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, as what makes the units (nearest sites of all demand) is read several times."""
    path = work_folder(df.sparkSession, "units")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _corners(g: pd.DataFrame) -> pd.DataFrame:
    """Of a frontier's rows (p1, p2), those on its lower hull, by rising p1."""
    g = g.sort_values(["p1", "p2", "peer"]).drop_duplicates(["p1", "p2"])
    x, y, kept = g.p1.to_numpy(), g.p2.to_numpy(), []
    for k in range(len(g)):
        while len(kept) > 1 and (y[kept[-1]] - y[kept[-2]]) * (x[k] - x[kept[-2]]) > (y[k] - y[kept[-2]]) * (x[kept[-1]] - x[kept[-2]]):
            kept.pop()
        kept.append(k)
    return g.iloc[kept]


def ccr_full(dmus: DataFrame, group: str = "g", key: str = "dmu") -> DataFrame:
    """Input-oriented CCR efficiency with two inputs and one output, in closed form: h, slacks, targets, peers and class.

    With inputs per output relative to the unit's own, (a, b), the best mix of peers lies at one peer or where the segment of
    two crosses the diagonal a = b; these two are neighbours on the lower hull of the group's peers. There no input has
    slack; at one peer the input with the smaller ratio has. The output never has any. As one slack at most is positive,
    weighting the slacks changes nothing. A peer without output serves nobody; a unit without output has a null efficiency.
    Peers are (peer, weight), weights in units of the peer's inputs. A group's hull is one row, which each unit meets; a
    unit's mixes are never rows.
    """
    units = _held(dmus.select(group, key, "x1", "x2", "y"))
    mine = [group, key, "x1", "x2", "y"]
    front = _frontier(units, group, key)
    hull = front.groupBy("__g").applyInPandas(_corners, front.schema).groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("p1", "p2", "py", "peer"))).alias("__hull"))
    u1, u2 = F.try_divide("x1", "y"), F.try_divide("x2", "y")
    at = F.transform("__hull", lambda p: F.struct(p.peer.alias("peer"), (F.col("y") / p.py).alias("weight"), F.try_divide(p.p1, u1).alias("a"), F.try_divide(p.p2, u2).alias("b")))
    p = units.join(F.broadcast(hull), F.col(group) == F.col("__g"), "left").select(*mine, at.alias("p"))

    def mix(h: Column, a: Column, b: Column, *peers: tuple[Column, Column]) -> Column:
        listed = F.array(*[F.struct(x.alias("peer"), w.alias("weight")) for x, w in peers])
        return F.struct(F.round(h, 12).alias("h12"), F.round(a + b, 12).alias("s12"), h.alias("h"), a.alias("a"), b.alias("b"), listed.alias("peers"))

    def crossing(two: Column, one: Column) -> Column:
        share = (two.b - two.a) / (one.a - one.b + two.b - two.a)  # of the one with a > b
        h = share * one.a + (1 - share) * two.a
        return mix(h, h, h, (one.peer, share * one.weight), (two.peer, (1 - share) * two.weight))

    single = F.transform("p", lambda x: mix(F.greatest(x.a, x.b), x.a, x.b, (x.peer, x.weight)))
    # a rises along the hull and b falls, so the diagonal is crossed once
    beside = F.arrays_zip(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("l"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("r"))
    edge = F.filter(beside, lambda e: (e["l"].a < e["l"].b) & (e["r"].a > e["r"].b))
    crossed = F.transform(edge, lambda e: crossing(e["l"], e["r"]))
    best = p.select(*mine, F.array_min(F.filter(F.concat(single, crossed), lambda s: s.h.isNotNull())).alias("s")).select(*mine, "s.h", "s.a", "s.b", "s.peers")
    clean = lambda c: F.when(c < 1e-9, 0.0).otherwise(c)
    s1, s2 = clean((F.col("h") - F.col("a")) * F.col("x1")), clean((F.col("h") - F.col("b")) * F.col("x2"))
    out = best.select(*mine, "h", s1.alias("s1"), s2.alias("s2"), F.sort_array("peers").alias("peers"))
    kind = F.when(F.col("h").isNull(), None).when(F.col("h") <= 1 - 1e-6, CLASSES[2]).when(F.greatest("s1", "s2") < 1e-4, CLASSES[0]).otherwise(CLASSES[1])
    return out.select("*", (F.col("h") * F.col("x1") - F.col("s1")).alias("target1"), (F.col("h") * F.col("x2") - F.col("s2")).alias("target2"), kind.alias("class"))


#: The classes' names.
CLASSES = ("Pareto eficiente", "fracamente eficiente", "ineficiente")


def ccr(dmus: DataFrame, group: str = "g", key: str = "dmu") -> DataFrame:
    """The efficiency of ccr_full() alone."""
    p = _ratios(dmus, group, key).select(group, key, "a", "b")
    single = p.groupBy(group, key).agg(F.min(F.greatest("a", "b")).alias("h"))
    one, two = p.where("a > b"), p.where("a < b").select(group, key, F.col("a").alias("a2"), F.col("b").alias("b2"))
    crossing = one.join(two, [group, key]).select(group, key, ((F.col("a") * F.col("b2") - F.col("a2") * F.col("b")) / (F.col("a") - F.col("a2") + F.col("b2") - F.col("b"))).alias("h"))
    return single.unionByName(crossing).groupBy(group, key).agg(F.round(F.min("h"), 6).alias("h_ccr"))


def _least_mix(c: np.ndarray, e: np.ndarray) -> tuple[float, int, int, float]:
    """Least cost of a mix of peers whose mean of e is at least 0: (cost, i, j, share of i). One of them is always at 0 or above."""
    up, down = np.flatnonzero(e >= 0), np.flatnonzero(e < 0)
    i = up[np.argmin(c[up])]
    best = (float(c[i]), int(i), int(i), 1.0)
    cheaper = down[c[down] < best[0]]
    if len(cheaper):
        # each peer below with each above: where their segment reaches 0
        share = e[cheaper][None, :] / (e[cheaper][None, :] - e[up][:, None])
        cost = share * c[up][:, None] + (1 - share) * c[cheaper][None, :]
        k = int(np.argmin(cost))
        if cost.flat[k] < best[0]:
            a, b = divmod(k, len(cheaper))
            best = (float(cost.flat[k]), int(up[a]), int(cheaper[b]), float(share.flat[k]))
    return best


def least_scale(a: np.ndarray, b: np.ndarray, e: np.ndarray) -> float:
    """Least max(mean a, mean b) over mixes with a mean of e of at least 0.

    The least mean of t a + (1 - t) b is concave and piecewise linear in t; its greatest value over t in [0, 1] is the answer.
    Two lines that bound it are kept, and their crossing is tried until it lies on it.
    """

    def line(t: float) -> tuple[float, float]:
        _, i, j, s = _least_mix(t * a + (1 - t) * b, e)
        return s * a[i] + (1 - s) * a[j], s * b[i] + (1 - s) * b[j]

    low, high = line(0.0), line(1.0)  # (value at t = 1, value at t = 0)
    while True:
        if low[0] <= low[1]:
            return float(low[1])
        if high[0] >= high[1]:
            return float(high[0])
        t = (high[1] - low[1]) / (low[0] - low[1] - high[0] + high[1])
        value = t * low[0] + (1 - t) * low[1]
        mid = line(t)
        if t * mid[0] + (1 - t) * mid[1] >= value - 1e-13:
            return float(value)
        if mid[0] >= mid[1]:
            low = mid
        else:
            high = mid


def extreme(x1: np.ndarray, x2: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of peers that no mix of the others serves as well as: with at most their inputs and at least their output."""
    order = np.lexsort((x2, x1, -y))
    kept: list[int] = []
    for k in order.tolist():  # those before have as much output
        if not kept or not ((x1[kept] <= x1[k]) & (x2[kept] <= x2[k])).any():
            kept.append(k)
    left = np.array(kept, dtype=int)
    for k in kept[::-1]:
        rest = left[left != k]
        if (y[rest] >= y[k]).any() and least_scale(x1[rest] / x1[k], x2[rest] / x2[k], y[rest] - y[k]) <= 1:
            left = rest
    return np.sort(left)


def bcc(dmus: DataFrame, group: str = "g", key: str = "dmu", chunk: int = 2000) -> DataFrame:
    """Input-oriented BCC efficiency (weights of peers add up to one), two inputs and one output. Inputs are above 0.

    A mix needs no peer that a mix of others replaces, so units are compared with their group's extreme peers only. These
    come from chunks of a group first, then from what the chunks left; units are compared chunk by chunk.
    """
    units = _held(dmus.select(group, key, "x1", "x2", "y"))
    most = units.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    chunks = most // chunk + 1
    units = units.withColumn("__chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))

    def reduce(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[extreme(*(g[c].to_numpy(float) for c in ("x1", "x2", "y")))]

    def each(g: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
        x1, x2, y = (peers[c].to_numpy(float) for c in ("x1", "x2", "y"))
        h = [least_scale(x1 / p, x2 / q, y - r) for p, q, r in zip(g.x1, g.x2, g.y, strict=True)]
        return pd.DataFrame({group: g[group], key: g[key], "h_bcc": np.round(h, 6)})

    peers = units.groupBy(group, "__chunk").applyInPandas(reduce, units.schema)
    peers = _held(peers.groupBy(group).applyInPandas(reduce, units.schema)).drop("__chunk")
    peers = peers.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in dmus.schema}
    found = units.groupBy(group, "__chunk").cogroup(peers.groupBy(group, "__chunk"))
    return found.applyInPandas(each, f"{group} {kinds[group]}, {key} {kinds[key]}, h_bcc double")


def dominance_flags(nets: DataFrame, group: str, key: str, sets: dict[str, list[str]], tolerance: float = 1e-9) -> DataFrame:
    """For each set of measures (less is better), whether some network of the group dominates the row beyond the tolerance.

    Networks of a group are compared with each other; groups are profiles of some tens of networks.
    """
    measures = sorted({m for ms in sets.values() for m in ms})
    other = nets.select(F.col(group).alias("__g"), *[F.col(m).alias(f"__{m}") for m in measures])

    def dominated(ms: list[str]) -> Column:
        no_worse, better = F.lit(True), F.lit(False)
        for m in ms:
            no_worse &= F.col(f"__{m}") <= F.col(m) + tolerance
            better |= F.col(f"__{m}") < F.col(m) - tolerance
        return no_worse & better

    return nets.join(other, F.col(group) == F.col("__g")).groupBy(group, key).agg(*[F.bool_or(dominated(ms)).alias(name) for name, ms in sets.items()])


def regressions(curve: DataFrame, by: list[str]) -> DataFrame:
    """By curve: first feasible k, steps from feasible to infeasible, and whether the first k is feasible already."""
    along = Window.partitionBy(*by).orderBy("k")
    rows = curve.withColumn("was", F.lag("ok").over(along)).withColumn("no", F.row_number().over(along))
    return rows.groupBy(*by).agg(F.min(F.when(F.col("ok"), F.col("k"))).alias("k_first"), F.count_if(F.col("was") & ~F.col("ok")).alias("regressions"), F.bool_or((F.col("no") == 1) & F.col("ok")).alias("left_censored"))


def all_seeds(curve: DataFrame, by: list[str], seeds: int) -> DataFrame:
    """The least k feasible for every one of the seeds."""
    each = curve.groupBy(*by, "k").agg(F.bool_and("ok").alias("all_ok"), F.countDistinct("seed").alias("n"), F.min("covered").alias("covered_min"), F.max("covered").alias("covered_max"))
    good = F.col("all_ok") & (F.col("n") == seeds)
    return each.groupBy(*by).agg(F.min(F.when(good, F.col("k"))).alias("k_selected"), F.sum(good.cast("long")).alias("feasible_k"), F.min("covered_min").alias("covered_min"), F.max("covered_max").alias("covered_max"))
