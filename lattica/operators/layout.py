"""Low-dimensional layout of cells by their neighbours (UMAP): fuzzy graph, spectral start, sampling over blocks of links.

Cells are dealt to blocks. In a round each task moves its block's cells for some epochs, along sampled links and away from
sampled cells; it sees its own cells' places as they change, and all others' as they were at the start of the round. A table of few
links is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.shipping import by_value
from lattica.operators import krylov
from lattica.sources.files import stored

by_value(__name__)

#: Links of a block, which a task holds, and cells outside of the block from which it samples those to move away from.
BLOCK_LINKS = 500_000
POOL = 4_096
#: Sampled cells for each sampled link, the longest step, and the epochs.
NEGATIVE = 5
STEP = 4.0
EPOCHS = 200
ROUNDS = 10


def smoothed(near: np.ndarray, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) of rows of ascending distances: rho is the least positive distance, with sigma the memberships
    exp(-max(0, d - rho) / sigma) sum up to the logarithm of their number to base 2."""
    positive = np.where(near > 0, near, np.inf).min(axis=1)
    rho = np.where(np.isfinite(positive), positive, 0.0)
    over, goal = np.maximum(near - rho[:, None], 0), np.log2(max(near.shape[1], 2))
    low, high, mid = np.zeros(len(near)), np.full(len(near), np.inf), np.ones(len(near))
    for _ in range(steps):
        more = np.exp(-over / mid[:, None]).sum(axis=1) > goal
        high = np.where(more, mid, high)
        low = np.where(more, low, mid)
        mid = np.where(np.isfinite(high), (low + high) / 2, mid * 2)
        mid = np.minimum(mid, 1e300)
    return rho, np.maximum(mid, 1e-3 * np.maximum(near.mean(axis=1), 1e-12))


def fuzzy_graph(knn: DataFrame) -> DataFrame:
    """cell_id, nbr_id, w in both directions: probability that at least one of the two cells has the other as a neighbour, from
    ``knn(cell_id, nbr_id, dist)``, in which a cell has a bounded number of neighbours."""
    kind = dict(knn.dtypes)["cell_id"]
    rows = knn.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("dist", "nbr_id"))).alias("near"))
    rows = rows.select("cell_id", F.transform("near", lambda s: s["nbr_id"]).alias("nbr_id"), F.transform("near", lambda s: s["dist"].cast("double")).alias("dist"))

    def member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["dist"].map(len)):
                d = np.stack(part["dist"].to_numpy())
                rho, sigma = smoothed(d)
                w = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None])
                yield pd.DataFrame({"cell_id": part["cell_id"].repeat(d.shape[1]).to_numpy(), "nbr_id": np.concatenate([np.asarray(x) for x in part["nbr_id"]]), "w": w.ravel()})

    one = rows.mapInPandas(member, f"cell_id {kind}, nbr_id {kind}, w double").filter("cell_id <> nbr_id")
    both = one.unionAll(one.select("nbr_id", "cell_id", "w")).groupBy("cell_id", "nbr_id")
    # of two weights a and b: a + b - a b
    return both.agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.product("w")).otherwise(F.lit(0.0))).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) with which 1 / (1 + a d^2b) is nearest to 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond, by least
    squares over 300 distances up to three times the spread."""
    d = np.linspace(0, 3 * spread, 301)[1:]
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-2
    miss = lambda p: 1 / (1 + p[0] * d ** (2 * p[1])) - goal
    for _ in range(200):
        t = d ** (2 * p[1])
        common = -1 / (1 + p[0] * t) ** 2
        jac = np.column_stack([common * t, common * p[0] * t * 2 * np.log(d)])
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), jac.T @ miss(p))
        if (miss(np.maximum(p - step, 1e-6)) ** 2).sum() < (miss(p) ** 2).sum():
            p, damp = np.maximum(p - step, 1e-6), damp / 3
        else:
            damp *= 5
    return float(p[0]), float(p[1])


def _pull(delta: np.ndarray, a: float, b: float) -> np.ndarray:
    d2 = (delta * delta).sum(axis=1)
    size = np.where(d2 > 0, -2 * a * b * np.power(np.maximum(d2, 1e-300), b - 1) / (1 + a * d2**b), 0.0)
    return np.clip(size[:, None] * delta, -STEP, STEP)


def _push(delta: np.ndarray, a: float, b: float) -> np.ndarray:
    d2 = (delta * delta).sum(axis=1)
    return np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * delta, -STEP, STEP)


def moved(place: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, fixed: np.ndarray, pool: np.ndarray, epochs: range, total: int, ab: tuple[float, float], seed: int) -> np.ndarray:
    """Places of a block's cells after ``epochs`` of ``total``. ``head`` numbers cells of the block, ``tail`` these or, from their
    number on, rows of ``fixed``. A link of weight w is sampled in w of all epochs, the heaviest in each; steps shrink to zero.

    Links go in shuffled groups small enough that a cell is seldom twice in one; a link's other end in the block moves as well
    in its own turn, since links are given in both directions.
    """
    rng, (a, b), n = np.random.default_rng(seed), ab, len(place)
    every = np.vstack([place, fixed]) if len(fixed) else place.copy()
    away = np.vstack([place, pool]) if len(pool) else place
    often = w / max(w.max(initial=0), 1e-300)
    for e in epochs:
        rate = 1.0 - e / total
        due = np.flatnonzero(np.floor(often * (e + 1)) > np.floor(often * e))
        rng.shuffle(due)
        for at in range(0, len(due), max(1, n // 2)):
            part = due[at : at + max(1, n // 2)]
            h = head[part]
            step = _pull(every[h] - every[tail[part]], a, b)
            away[:n] = every[:n]
            for _ in range(NEGATIVE):
                other = rng.integers(0, len(away), len(part))
                far = _push(every[h] - away[other], a, b)
                far[other == h] = 0
                step += far
            np.add.at(every, h, rate * step)
    return every[:n]


#: Rows of a block: a cell, a link within it, a link to another block.
CELL, INNER, OUTER = range(3)


def _mover(pool: np.ndarray, epochs: range, total: int, ab: tuple[float, float], seed: int):
    """A function that moves the cells of a block's rows: of a cell its place in p0, p1 and on, of a link the other end's place where
    that is in another block."""
    names = [f"p{i}" for i in range(pool.shape[1])]

    def block(part: pd.DataFrame) -> pd.DataFrame:
        cells, edges = part[part["kind"] == CELL].sort_values("cell_id"), part[part["kind"] != CELL].sort_values(["cell_id", "nbr_id"])
        at, out = pd.Index(cells["cell_id"]), (edges["kind"] == OUTER).to_numpy()
        tail = np.empty(len(edges), np.int64)
        tail[~out] = at.get_indexer(edges["nbr_id"][~out])
        tail[out] = len(cells) + np.arange(out.sum())
        head = at.get_indexer(edges["cell_id"])
        new = moved(cells[names].to_numpy(), head, tail, edges["w"].to_numpy(), edges[names].to_numpy()[out], pool, epochs, total, ab, seed)
        return pd.DataFrame({"cell_id": cells["cell_id"], "umap": list(new)})

    return block


def umap(knn: DataFrame, dimensions: int = 2, min_dist: float = 0.5, seed: int = 0, epochs: int = EPOCHS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """cell_id, umap (array): a layout of the cells of ``knn(cell_id, nbr_id, dist)``, the same for the same input and seed.

    It starts from the leading eigenvectors of the graph's normalised matrix. Cells without neighbours have no place.
    """
    kind = dict(knn.dtypes)["cell_id"]
    links = stored(fuzzy_graph(knn))
    degree = links.groupBy("cell_id").agg(F.sum("w").alias("d"))
    entries = links.join(degree, "cell_id").join(degree.toDF("nbr_id", "e"), "nbr_id").select("cell_id", "nbr_id", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("x"))
    index = krylov.index_of(links, "cell_id")
    matrix = krylov.Blocks.of(entries.toDF("row", "col", "x"), index, index)
    found = krylov.leading(lambda v, width: matrix.times(v, width, keep=False), index, dimensions + 1, 1e-4, seed, basis=krylov.BASIS)
    start = krylov.unpacked(found, index, "cell_id", "v")
    most = start.agg(F.max(F.array_max(F.transform(F.slice("v", 2, dimensions), F.abs)))).first()[0] or 1.0
    # columns that a tiny graph lacks are zeros; a little noise by id tells cells of one place apart
    noise = lambda i: (F.pmod(F.xxhash64("cell_id", F.lit(seed), i), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5) * 1e-3
    place = stored(start.select("cell_id", F.transform(F.sequence(F.lit(2), F.lit(dimensions + 1)), lambda i: F.coalesce(F.get("v", i - 1), F.lit(0.0)) * (10.0 / most) + noise(i)).alias("umap")))
    blocks, ab = max(1, -(-links.count() // block_links)), curve(min_dist)
    rounds = min(ROUNDS, epochs) if blocks > 1 else 1
    for r in range(rounds):
        dealt = place.withColumn("blk", F.pmod(F.xxhash64("cell_id", F.lit(r)), F.lit(blocks)).cast("int"))
        pool = np.array([x[0] for x in dealt.orderBy(F.xxhash64("cell_id", F.lit(f"pool{r}")), "cell_id").limit(POOL).select("umap").collect()]) if blocks > 1 else np.zeros((0, dimensions))
        sides = links.join(dealt.select("cell_id", "blk"), "cell_id").join(dealt.select(F.col("cell_id").alias("nbr_id"), F.col("blk").alias("there"), F.col("umap").alias("p")), "nbr_id")
        outer = F.col("blk") != F.col("there")
        sides = sides.select("blk", "cell_id", "nbr_id", "w", F.when(outer, F.lit(OUTER)).otherwise(F.lit(INNER)).alias("kind"), *[F.when(outer, F.col("p")[i]).alias(f"p{i}") for i in range(dimensions)])
        own = dealt.select("blk", "cell_id", F.col("cell_id").alias("nbr_id"), F.lit(0.0).alias("w"), F.lit(CELL).alias("kind"), *[F.col("umap")[i].alias(f"p{i}") for i in range(dimensions)])
        span = range(r * epochs // rounds, (r + 1) * epochs // rounds)

        move = _mover(pool, span, epochs, ab, seed + 7919 * r)
        place = stored(own.unionAll(sides).groupBy("blk").applyInPandas(move, f"cell_id {kind}, umap array<double>"))
    return place
