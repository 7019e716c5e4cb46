"""Clustering genes: correlation, distances and agglomeration over tables of gene pairs.

What reaches the driver grows with the genes, not with their pairs: names, merges, and the order of leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.shipping import by_value
from lattica.operators.stats import gene_correlation
from lattica.sources.files import positions, stored

by_value(__name__)

#: Numbers in a block of correlation rows (64 MB), of which a task holds two.
BLOCK_NUMBERS = 8_000_000


def correlations(expr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene, at: the genes numbered in their order; a, b, ia, ib, corr of all pairs of them, a before b)."""
    genes = positions(expr.select("gene").distinct(), [F.col("gene").asc()], "at")
    pairs = gene_correlation(expr).join(genes.toDF("a", "ia"), "a").join(genes.toDF("b", "ib"), "b")
    return genes, stored(pairs.select("a", "b", F.col("ia").cast("int").alias("ia"), F.col("ib").cast("int").alias("ib"), "corr"))


def row_distances(pairs: DataFrame, n: int) -> DataFrame:
    """a, b, d of all pairs a < b of ``n`` rows: Euclidean distances between rows of the matrix 1 - corr, whose diagonal is 0.

    Undefined correlations count as 0. Rows are packed to blocks, and each pair of blocks is one group, so a task holds
    2 x BLOCK_NUMBERS numbers whatever ``n``.
    """
    value = 1 - F.coalesce(F.nanvl("corr", F.lit(0.0)), F.lit(0.0))
    sides = pairs.select(F.col("ia").alias("i"), F.col("ib").alias("j"), value.alias("x")).unionAll(pairs.select("ib", "ia", value))
    rows = sides.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("s"))
    rows = stored(rows.select("i", F.transform("s", lambda s: s["x"]).alias("v")))
    side = max(16, min(512, BLOCK_NUMBERS // max(1, n)))
    blocks = -(-n // side)
    rows = rows.withColumn("blk", F.expr(f"cast(i div {side} as int)"))
    others = lambda low, high: F.explode(F.sequence(low, high))
    left = rows.select(F.col("blk").alias("p"), others(F.col("blk"), F.lit(max(blocks - 1, 0))).alias("q"), "i", "v")
    right = rows.select(others(F.lit(0), F.col("blk")).alias("p"), F.col("blk").alias("q"), "i", "v").toDF("p", "q", "i", "v")

    def whole(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and rows with the diagonal's 0 put in."""
        at = part["i"].to_numpy()
        return at, np.stack([np.insert(np.asarray(v), i, 0.0) for i, v in zip(at, part["v"], strict=True)])

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.empty(0, np.int32), "b": np.empty(0, np.int32), "d": np.empty(0)})]
        if len(a) and len(b):
            (i, x), (j, y) = whole(a), whole(b)
            for k in range(len(i)):
                d = np.sqrt(((y - x[k]) ** 2).sum(axis=1))
                keep = j > i[k]
                out.append(pd.DataFrame({"a": i[k], "b": j[keep], "d": d[keep]}))
        return pd.concat(out)

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(block, "a int, b int, d double")


def agglomerated(pairs: DataFrame, n: int) -> np.ndarray:
    """Merges (i, j, distance, size) of average linkage over ``pairs(a, b, d)`` of all a < b below ``n``, in order of distance.

    In each round all pairs that are each other's nearest merge at once, which for average linkage gives the merges that
    one at a time give; equal distances (to twelve digits) go by the smaller numbers. New distances are means over leaf pairs,
    summed by groupBy. Every round has the nearest pair of all, so it ends; the table shrinks with the square of the clusters.
    """
    one = F.lit(1).cast("long")
    table = stored(pairs.select("a", "b", "d", one.alias("na"), one.alias("nb")))
    merges: list[tuple[float, int, int, int, int]] = []
    turn = 0
    while len(merges) < n - 1:
        key = F.struct(F.round("d", 12).alias("d"), F.col("a").alias("lo"), F.col("b").alias("hi"))
        ends = table.select(F.explode(F.array("a", "b")).alias("c"), key.alias("key"), F.struct("d", "na", "nb").alias("is"))
        near = ends.groupBy("c").agg(F.min_by("is", "key").alias("is"), F.min("key").alias("key"))
        both = near.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.first("is").alias("is")).filter("c = 2")
        found = [(r["is"]["d"], turn, r["key"]["lo"], r["key"]["hi"], r["is"]["na"] + r["is"]["nb"]) for r in both.collect()]
        merges += found
        to = pairs.sparkSession.createDataFrame([x for _, _, lo, hi, size in found for x in ((lo, lo, size), (hi, lo, size))], "c int, rep int, size long")
        table = table.join(F.broadcast(to.toDF("a", "ra", "sa")), "a", "left").join(F.broadcast(to.toDF("b", "rb", "sb")), "b", "left")
        a, b = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        na, nb = F.coalesce("sa", "na"), F.coalesce("sb", "nb")
        swap = lambda x, y: F.when(a < b, x).otherwise(y)
        table = table.filter(a != b).select(swap(a, b).alias("a"), swap(b, a).alias("b"), (F.col("na") * F.col("nb")).alias("w"), "d", swap(na, nb).alias("na"), swap(nb, na).alias("nb"))
        weighted = (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("d")
        table = stored(table.groupBy("a", "b", "na", "nb").agg(weighted).select("a", "b", "d", "na", "nb"))
        turn += 1
    out, name = [], list(range(n))
    for step, (d, _, lo, hi, size) in enumerate(sorted(merges)):
        out.append((min(name[lo], name[hi]), max(name[lo], name[hi]), d, size))
        name[lo] = n + step
    return np.array(out).reshape(-1, 4)


def leaf_order(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each leaf in the dendrogram; distance at which the leaves at places p and p + 1 meet)."""
    n = len(links) + 1
    first, last, after, gap = list(range(n)), list(range(n)), [-1] * n, [0.0] * n
    for i, j, d, _ in links.tolist():
        a, b = int(i), int(j)
        after[last[a]], gap[last[a]] = first[b], d
        first.append(first[a])
        last.append(last[b])
    place, heights, at = np.zeros(n, np.int64), [], first[-1]
    for p in range(n):
        place[at] = p
        heights.append(gap[at])
        at = after[at]
    return place, np.array(heights[:-1])


class Highest:
    """Largest value of any stretch of a list, from maxima over stretches of lengths that are powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.maximum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over the places low to high - 1, at least one."""
        level = np.frexp(high - low)[1] - 1
        out = np.zeros(len(low))
        for k in np.unique(level).tolist():
            at = level == k
            row = self.rows[k]
            out[at] = np.maximum(row[low[at]], row[high[at] - (1 << k)])
        return out


def cophenetic_of(links: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distance at which leaves i and j meet: the largest gap between their places in the dendrogram."""
    place, heights = leaf_order(links)
    p, q = place[i], place[j]
    return Highest(heights).of(np.minimum(p, q), np.maximum(p, q))


def cophenetic(links: np.ndarray) -> np.ndarray:
    """The matrix of distances at which leaves meet, for few leaves; ``hierarchical`` has them as a table."""
    n = len(links) + 1
    i, j = np.triu_indices(n, 1)
    out = np.zeros((n, n))
    if n > 1:
        out[i, j] = out[j, i] = cophenetic_of(links, i, j)
    return out


def hierarchical(expr: DataFrame, genes: list | None = None) -> tuple[DataFrame, np.ndarray, list]:
    """(a, b, cophenet, corr of gene pairs; merges; genes): rows of 1 - correlation are the points that are linked.

    Merges, names and the order of leaves (a few numbers a gene) are on the driver and sent to the tasks; pairs stay in tables.
    """
    own = expr if genes is None else expr.filter(F.col("gene").isin(list(genes)))
    names, pairs = correlations(own)
    listed = [r[0] for r in names.orderBy("at").collect()]
    links = agglomerated(row_distances(pairs, len(listed)), len(listed)) if len(listed) > 1 else np.empty((0, 4))
    place, heights = leaf_order(links) if len(listed) > 1 else (np.zeros(1, np.int64), np.empty(0))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        highest = Highest(heights)
        for b in batches:
            p, q = place[b["ia"].to_numpy()], place[b["ib"].to_numpy()]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "cophenet": highest.of(np.minimum(p, q), np.maximum(p, q)) if len(b) else [], "corr": b["corr"]})

    return pairs.mapInPandas(meet, "a string, b string, cophenet double, corr double"), links, listed


def average_linkage(points: np.ndarray) -> np.ndarray:
    """``agglomerated`` for few points on the driver: merges (i, j, distance, size) of their rows, in memory of points squared."""
    n = len(points)
    d = np.full((n, n), np.inf)
    for i in range(n):
        d[i] = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((min(name[i], name[j]), max(name[i], name[j]), d[i, j], size[i] + size[j]))
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return np.array(out).reshape(-1, 4)


def _turned(x: np.ndarray, y: np.ndarray, q: float, pull: tuple[float, float], at: int) -> int | None:
    """The point that the best line through point ``at`` also goes through; None if all points have its x.

    Along the slopes of these lines the loss is convex and bends where the line meets a point, by that point's distance in x.
    """
    dx, dy = x - x[at], y - y[at]
    other = np.flatnonzero(dx != 0)
    if not len(other):
        return None
    size, slope = np.abs(dx[other]), dy[other] / dx[other]
    order = np.lexsort((other, slope))
    start = -(np.where(dx[other] > 0, q, 1 - q) * size).sum() + pull[1] - pull[0] * x[at]
    bent = start + np.cumsum(size[order])
    return int(other[order[min(int(np.searchsorted(bent, -1e-12 * size.sum())), len(order) - 1)]])


def quantile_regression(x: np.ndarray, y: np.ndarray, q: float, pull: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """(intercept, slope) of a q-quantile line of points in memory, with ``pull`` times them added to the loss; exact.

    An optimal line goes through two points. From a point on the line, the best line through it leads to the next point, until
    turning around none of the points on the line lowers the loss: along all edges at that vertex the convex loss then rises.
    """
    if not len(x):
        return 0.0, 0.0
    if (x == x[0]).all():
        return float(np.quantile(y, q, method="inverted_cdf")), 0.0

    def loss(b: tuple[float, float]) -> float:
        r = y - b[0] - b[1] * x
        return float(np.where(r >= 0, q * r, (q - 1) * r).sum() + pull[0] * b[0] + pull[1] * b[1])

    def through(i: int, j: int) -> tuple[float, float]:
        m = (y[i] - y[j]) / (x[i] - x[j])
        return float(y[i] - m * x[i]), float(m)

    at = int(np.argsort(y, kind="stable")[int(q * (len(y) - 1))])
    other = _turned(x, y, q, pull, at)
    best, least = through(at, other), loss(through(at, other))
    scale = 1e-12 * (np.abs(y).max() + 1e-300)
    while True:
        near = np.flatnonzero(np.abs(y - best[0] - best[1] * x) <= scale * 10)
        _, first = np.unique(np.column_stack([x[near], y[near]]), axis=0, return_index=True)
        found = None
        for i in near[np.sort(first)].tolist():
            j = _turned(x, y, q, pull, i)
            if j is not None and (now := loss(through(i, j))) < least - 1e-13 * max(abs(least), 1e-300):
                found, least = through(i, j), now
                break
        if found is None:
            return best
        best = found


#: Points that a fit takes to the driver, at least; of n points it takes about the n to the power 2/3, in a band around the line.
LEAST_POINTS = 4_000


def quantile_line(pairs: DataFrame, q: float, x: str = "cophenet", y: str = "corr") -> tuple[float, float]:
    """(intercept, slope) of the exact q-quantile line of all points of ``pairs``; rows with a null or NaN don't count.

    A line through a sample by hash gives a band that holds the line. Points below and above the band count as their sums, with
    those inside of it the line is fitted exactly; if then no point is on another side than it was counted, the line is the best
    of all points, else the band is widened (Portnoy and Koenker, 1997).
    """
    points = stored(pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop())
    n = points.count()
    size = max(LEAST_POINTS, int(2 * n ** (2 / 3)))
    key = F.xxhash64("x", "y", F.lit("quantile"))
    some = points if n <= size else points.filter((F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.lit(size / n))
    taken = some.toPandas()
    line = quantile_regression(taken["x"].to_numpy(), taken["y"].to_numpy(), q)
    if n <= size:
        return line
    left = np.sort(taken["y"].to_numpy() - line[0] - line[1] * taken["x"].to_numpy())
    half = 2.0 * len(left) ** -0.5 if len(left) else 1.0
    band = lambda h: tuple(np.quantile(left, [max(0.0, q - h), min(1.0, q + h)])) if len(left) else (0.0, 0.0)
    while True:
        low, high = (-np.inf, np.inf) if half >= 1 else band(half)
        r = F.col("y") - F.lit(line[0]) - F.lit(line[1]) * F.col("x")
        side = F.when(r < F.lit(float(low)), -1).when(r > F.lit(float(high)), 1).otherwise(0)
        marked = points.withColumn("side", side)
        sums = {s["side"]: s for s in marked.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")).collect()}
        of = lambda s: (sums[s]["n"], sums[s]["x"]) if s in sums else (0, 0.0)  # noqa: E731, B023
        (nb, xb), (na, xa) = of(-1), of(1)
        inside = marked.filter("side = 0").select("x", "y").toPandas()
        new = quantile_regression(inside["x"].to_numpy(), inside["y"].to_numpy(), q, ((1 - q) * nb - q * na, (1 - q) * xb - q * xa))
        now = F.col("y") - F.lit(new[0]) - F.lit(new[1]) * F.col("x")
        if len(inside) and marked.filter(((F.col("side") == -1) & (now > 0)) | ((F.col("side") == 1) & (now < 0))).isEmpty():
            return new
        half *= 2


def below(pairs: DataFrame, cophenet: float) -> DataFrame:
    """Pairs that meet below the distance; nulls drop."""
    return pairs.filter(F.col("cophenet") < cophenet)


def regression_points(pairs: DataFrame, cophenet_below: float, q: float = 0.1) -> DataFrame:
    """The pairs below the distance with ``line``, the q-quantile line at their distance: what a plot of the fit shows."""
    own = below(pairs, cophenet_below)
    intercept, slope = quantile_line(own, q)
    return own.withColumn("line", F.lit(intercept) + F.lit(slope) * F.col("cophenet"))


def cutoff(pairs: DataFrame, cophenet_below: float, correlation: float = 0.6, q: float = 0.1) -> tuple[float | None, float, float]:
    """(cophenetic distance at which the q-quantile line reaches the correlation, None if it is flat; intercept; slope)."""
    intercept, slope = quantile_line(below(pairs, cophenet_below), q)
    return (None if slope == 0 else (correlation - intercept) / slope), intercept, slope


def cut(links: np.ndarray, distance: float | None) -> list[int]:
    """Cluster number from 1 of each leaf after the merges up to the distance; -1 for all without one."""
    n = len(links) + 1
    if distance is None:
        return [-1] * n
    members = {i: [i] for i in range(n)}
    for step, (i, j, dist, _) in enumerate(links):
        if dist <= distance:
            members[n + step] = members.pop(int(i)) + members.pop(int(j))
        else:
            break
    label = [0] * n
    for k, own in enumerate(sorted(members.values(), key=min), 1):
        for leaf in own:
            label[leaf] = k
    return label


def add_clusters(genes_df: DataFrame, names: list, links: np.ndarray, distance: float | None, column: str = "correlation_cluster") -> DataFrame:
    rows = [(str(g), c) for g, c in zip(names, cut(links, distance), strict=True)]
    labels = genes_df.sparkSession.createDataFrame(rows, f"gene string, {column} int")
    return genes_df.join(F.broadcast(labels), "gene", "left")
