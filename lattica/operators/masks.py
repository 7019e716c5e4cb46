"""Expression masks: expressed genes, neighbourhoods, pairs."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.shipping import by_value
from lattica.sources.files import stored

by_value(__name__)


def binarize(expr: DataFrame, threshold: float = 0.0) -> DataFrame:
    return expr.withColumn("b", (F.col("x") > threshold).cast("int"))


#: Numbers in the pivots that every task gets (16 MB), whatever the number of cells.
PIVOT_NUMBERS = 1 << 21
#: Parts of balls, of which every task knows radius and size.
MOST_PARTS = 1 << 17
#: Where cells visit more than this share of the parts, parts are searched together in regions of up to REGION_NUMBERS numbers
#: (16 MB), and of a 16th of the cells: a cell is sent to a region once, and gets its nearest there.
REGION_SHARE = 0.25
REGION_NUMBERS = 1 << 21
#: Cells multiplied at once: rough distances of a tile stay in the cache.
TILE_ROWS = 256
TILE_COLUMNS = 4096


class _Index:
    """Balls around pivots, cut to parts of bounded size: what a task needs to tell which parts a cell must be compared with.

    ``centre``, ``low``, ``high`` and ``count`` of part p are its ball, the least and largest distance of its cells from the ball's
    pivot, and their number. By the triangle inequality a cell at distance d of the pivot is no nearer than max(d - high, low - d)
    to any of them. ``slack`` is above what rounding can do to these distances.
    """

    def __init__(self, pivots: np.ndarray, parts: pd.DataFrame):
        self.pivots, self.norms = pivots, (pivots * pivots).sum(axis=1)
        self.centre, self.low, self.high, self.count = (parts[c].to_numpy() for c in ("ball", "low", "high", "n"))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + self.norms - 2 * x @ self.pivots.T, 0))

    def slack(self, x: np.ndarray) -> np.ndarray:
        return 1e-6 * (np.sqrt((x * x).sum(axis=1)) + np.sqrt(self.norms.max()))

    def visits(self, x: np.ndarray, k: int, tau: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x, parts) to compare. Without ``tau`` those of the nearest balls that have more than ``k`` cells together;
        with it, all others that can hold a cell within ``tau``."""
        d = self.distances(x)[:, self.centre]
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, before <= k, axis=1)
        if tau is None:
            return np.nonzero(first)
        bound = np.maximum(d - self.high, self.low - d)
        return np.nonzero(~first & (bound <= tau[:, None] + self.slack(x)[:, None]))


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, (1 << 21) // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def _closest(own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, tau: np.ndarray) -> pd.DataFrame:
    """The ``k`` nearest of the cells ``ids``, which ascend, to each cell of ``own``, no farther than ``tau``; ties by id.

    Tiles of both are multiplied for rough distances. What lies within rounding of the k-th distance found so far is measured
    exactly, so ties at the end are all seen. Single precision does where its rounding is far below the distances.
    """
    middle = y.mean(axis=0)
    q, r = x - middle, y - middle
    norms, sizes = (r * r).sum(axis=1), (q * q).sum(axis=1)
    top, out = norms.max(), []
    # half the square of y's norm rides along as a column more
    right = np.column_stack([r, -0.5 * norms])
    rough32 = right.astype(np.float32) if 1e-20 < top < 1e30 else right
    for at in range(0, len(x), TILE_ROWS):
        c = slice(at, at + TILE_ROWS)
        part, size, held = x[c], sizes[c], own[c]
        left = np.column_stack([q[c], np.ones(len(part))])
        left32 = left.astype(np.float32) if size.max() < 1e30 else left
        # a bound of what rounding does to the squares of distances
        fine = 1e-11 * (size + top)
        coarse = 2.4e-7 * (y.shape[1] + 4) * (size + top)
        self_at = np.searchsorted(ids, held)
        limit = tau[c].copy()
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for low in range(0, len(y), TILE_COLUMNS):
            t = slice(low, min(low + TILE_COLUMNS, len(y)))
            single = rough32 is not right and left32 is not left and bool((coarse <= 0.01 * limit**2).all())
            margin = coarse if single else fine
            like = left32 @ rough32[t].T if single else left @ right[t].T  # half of what the squared distance is less than size
            least = 0.5 * (size - limit**2 - margin)
            if np.isinf(limit).any() and t.stop - low > k + 1:  # one may be the cell itself
                least = np.maximum(least, np.partition(like, t.stop - low - k - 1, axis=1)[:, t.stop - low - k - 1] - margin)
            least = np.nextafter(least.astype(like.dtype), like.dtype.type(-np.inf))
            row, col = np.divmod(np.flatnonzero(like >= least[:, None]), t.stop - low)
            col += low
            other = (col != self_at[row]) | (ids[col] != held[row])
            row, col = row[other], col[other]
            if not len(row):
                continue
            dist = np.concatenate([np.sqrt(((y[col[p]] - part[row[p]]) ** 2).sum(axis=1)) for p in _chunks(len(row), y.shape[1])])
            near = dist <= limit[row]
            row, col, dist = (np.concatenate([b, n[near]]) for b, n in zip(best, (row, col, dist), strict=True))
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = (row[place < k], col[place < k], dist[place < k])
            last = place == k - 1
            limit[row[last]] = dist[last]
        row, col, dist = best
        out.append(pd.DataFrame({"cell_id": held[row], "nbr_id": ids[col], "dist": dist}))
    return pd.concat(out)


def _searched(cells: DataFrame, members: DataFrame, index: _Index, k: int, block_cells: int) -> tuple[DataFrame, int]:
    """(cell_id, nbr_id, dist; number of pairs compared): candidates from the parts that ``cells(cell_id, v[, tau])`` visit.

    A part that many cells visit is copied for slices of these, so no group has more than about 4 x ``block_cells`` visits, or
    twice as many as a region has cells. Rows sent and found grow with cells x regions.
    """
    kind, later = dict(cells.dtypes)["cell_id"], "tau" in cells.columns
    parts = len(index.count)

    def of(b: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        x = np.stack(b["v"].to_numpy())
        tau = b["tau"].to_numpy() if later else None
        for c in _chunks(len(x), parts):
            yield c, *index.visits(x[c], k, tau[c] if later else None)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(parts, np.int64)
        for b in batches:
            if len(b):
                for _, _, part in of(b):
                    n += np.bincount(part, minlength=parts)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"part": some, "n": n[some]})

    n = np.zeros(parts, np.int64)
    for r in cells.mapInPandas(count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():
        n[r["part"]] = r["n"]
    # parts of a ball follow each other, so regions are of balls as far as they can be
    total, most, region = int(index.count.sum()), 4 * block_cells, np.arange(parts)
    if later and n.sum() > REGION_SHARE * total * parts:
        size = min(REGION_NUMBERS // index.pivots.shape[1], total // 16)
        region = np.cumsum(index.count) // max(block_cells, size)
        region = np.unique(region, return_inverse=True)[1]
        most = max(most, 2 * size)
    regions = int(region[-1]) + 1
    n = np.minimum(total, np.bincount(region, n, regions).astype(np.int64))
    held_there = np.bincount(region, index.count, regions).astype(np.int64)
    slices = np.maximum(1, -(-n // most))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                deal = pd.util.hash_array(b["cell_id"].to_numpy())
                for c, row, part in of(b):
                    row, part = np.divmod(np.unique(row * regions + region[part]), regions)
                    for p in _chunks(len(row), len(b["v"].iloc[0])):
                        took = b.iloc[c].iloc[row[p]]
                        yield pd.DataFrame({"part": part[p], "slice": (deal[c][row[p]] % slices[part[p]].astype(np.uint64)).astype(np.int64), "cell_id": took["cell_id"], "v": took["v"], "tau": took["tau"] if later else np.inf})

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"cell_id": a["cell_id"][:0], "nbr_id": a["cell_id"][:0], "dist": []})
        b = b.sort_values("cell_id")
        return _closest(a["cell_id"].to_numpy(), np.stack(a["v"].to_numpy()), b["cell_id"].to_numpy(), np.stack(b["v"].to_numpy()), k, a["tau"].to_numpy())

    asked = cells.mapInPandas(send, f"part int, slice long, cell_id {kind}, v array<double>, tau double")
    copies = members.sparkSession.createDataFrame([(p, int(r), int(slices[r])) for p, r in enumerate(region) if n[r]], "part int, region int, copies long")
    held = members.join(F.broadcast(copies), "part").drop("part").withColumnRenamed("region", "part").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    found = asked.groupBy("part", "slice").cogroup(held.groupBy("part", "slice")).applyInPandas(search, f"cell_id {kind}, nbr_id {kind}, dist double")
    return found, int((n * held_there).sum())


def _neighbours(expr: DataFrame, k: int, block_cells: int) -> tuple[DataFrame, int, int]:
    """(cell_id, nbr_id, dist; pairs compared; pairs there are)."""
    genes = F.array_sort(F.collect_list(F.struct("gene", "x")))
    cells = stored(expr.groupBy("cell_id").agg(F.transform(genes, lambda s: s["x"].cast("double")).alias("v")))
    kind = dict(expr.dtypes)["cell_id"]
    shape = cells.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("m")).first()
    n = shape["n"]
    if n < 2:
        return expr.sparkSession.createDataFrame([], f"cell_id {kind}, nbr_id {kind}, dist double"), 0, 0
    balls = max(1, min(-(-n // block_cells), PIVOT_NUMBERS // max(1, shape["m"])))
    pivots = np.array([r["v"] for r in cells.orderBy(F.xxhash64("cell_id"), "cell_id").limit(balls).select("v").collect()])
    around = _Index(pivots, pd.DataFrame({"ball": [0], "low": [0.0], "high": [0.0], "n": [0]}))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                for c in _chunks(len(x), len(pivots)):
                    d = around.distances(x[c])
                    yield pd.DataFrame({"cell_id": b["cell_id"].iloc[c], "v": b["v"].iloc[c], "ball": d.argmin(axis=1), "r": d.min(axis=1)})

    dealt = stored(cells.mapInPandas(assign, f"cell_id {kind}, v array<double>, ball int, r double"))
    size = max(block_cells, -(-n // MOST_PARTS))
    cut = dealt.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("cuts"))
    dealt = dealt.join(F.broadcast(cut), "ball").withColumn("cut", F.pmod(F.xxhash64("cell_id", F.lit("part")), F.col("cuts")))
    parts = dealt.groupBy("ball", "cut").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("ball", "cut").toPandas()
    parts["part"] = range(len(parts))
    numbers = expr.sparkSession.createDataFrame(parts[["ball", "cut", "part"]], "ball int, cut long, part int")
    members = stored(dealt.join(F.broadcast(numbers), ["ball", "cut"]).select("part", "cell_id", "v"))
    index = _Index(pivots, parts)
    first, compared = _searched(cells, members, index, k, size)
    first = stored(first)
    order = Window.partitionBy("cell_id").orderBy("dist", "nbr_id")
    near = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")
    if len(parts) == 1:
        return near, compared - n, n * (n - 1)
    # a cell that has fewer than k others so far has seen them all
    tau = near.groupBy("cell_id").agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("tau"))
    bounded = cells.join(tau.select("cell_id", F.when(F.col("c") >= k, F.col("tau")).otherwise(F.lit(float("inf"))).alias("tau")), "cell_id")
    rest, more = _searched(stored(bounded), members, index, k, size)
    # a region may also hold parts that came first, so a neighbour may be found twice
    both = near.unionByName(rest).withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k).drop("r").distinct()
    return stored(both), compared + more - n, n * (n - 1)


def nearest(expr: DataFrame, k: int, block_cells: int = 1000) -> DataFrame:
    """cell_id, nbr_id, dist: the exact k nearest other cells by Euclidean distance, ties by id.

    Cells form balls around pivots. Each is first compared with the nearest balls' cells, which bounds its k-th distance, then with
    every part of a ball that the triangle inequality can't rule out. Where all distances are much alike (many dimensions without
    clusters) nothing can be ruled out, and the work is that of all pairs, in groups of bounded size.
    """
    return _neighbours(expr, k, block_cells)[0]


def compared_pairs(expr: DataFrame, k: int, block_cells: int = 1000) -> tuple[int, int]:
    """(ordered pairs of cells that ``nearest`` compares, ordered pairs there are)."""
    return _neighbours(expr, k, block_cells)[1:]


def neighbourhood(expr: DataFrame, knn: DataFrame, required: int = 1, threshold: float = 0.0) -> DataFrame:
    """cell_id, gene, b: 1 where at least ``required`` neighbours express the gene; neighbours go both ways, self excluded."""
    both = knn.select("cell_id", "nbr_id").union(knn.select("nbr_id", "cell_id")).distinct()
    on = binarize(expr, threshold).filter("b = 1").select(F.col("cell_id").alias("nbr_id"), "gene")
    counts = both.join(on, "nbr_id").groupBy("cell_id", "gene").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= required).select("cell_id", "gene", F.lit(1).alias("b"))


def pair_mask(expressed: DataFrame) -> DataFrame:
    """cell_id, source, target of all ordered pairs of different genes that a cell has in ``expressed(cell_id, gene, b)``.

    Only pairs of expressed genes are made, and only the ones of value 1 are rows.
    """
    on = expressed.filter("b = 1")
    a, b = on.select("cell_id", F.col("gene").alias("source")), on.select("cell_id", F.col("gene").alias("target"))
    return a.join(b, "cell_id").filter("source <> target")


def mask_support(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """Edges with count_nonzero, the number of cells whose mask has them; edges without any have 0."""
    counts = mask.groupBy("source", "target").agg(F.count(F.lit(1)).alias("count_nonzero"))
    return edges.join(counts, ["source", "target"], "left").fillna(0, ["count_nonzero"])


def add_mask(expr: DataFrame, edges: DataFrame, strict: bool = False, k: int = 10, required: int = 5) -> tuple[DataFrame, DataFrame]:
    """(mask, edges with support): of cells that express both genes themselves (strict), or whose neighbours do."""
    mask = pair_mask(binarize(expr) if strict else neighbourhood(expr, nearest(expr, k), required))
    return mask, mask_support(edges, mask)


def mask_frame(mask: DataFrame, cells: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell_id, edge_idx, source, target, b: every cell's mask of the edges of ``order(edge_idx, source, target)`` that the mask
    has, 1 or 0; the edges of ``order`` that it lacks). Missing edges are reported, not made up."""
    known = mask.select("source", "target").distinct()
    kept = order.join(known, ["source", "target"], "left_semi")
    missing = order.join(known, ["source", "target"], "left_anti")
    if not missing.isEmpty():
        warnings.warn("the mask lacks some of the edges", stacklevel=2)
    on = mask.select("cell_id", "source", "target", F.lit(1).alias("b"))
    out = kept.crossJoin(cells.select("cell_id")).join(on, ["cell_id", "source", "target"], "left").fillna(0, ["b"])
    return out.select("cell_id", "edge_idx", "source", "target", "b"), missing


def apply_mask(grn: DataFrame, mask: DataFrame) -> DataFrame:
    """Weights outside of the mask become 0."""
    keys = ["cell_id", "source", "target"]
    return grn.join(mask.withColumn("__m", F.lit(True)), keys, "left").withColumn("w", F.when(F.col("__m"), F.col("w")).otherwise(F.lit(0.0))).drop("__m")


