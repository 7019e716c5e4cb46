"""Communities of a weighted graph by the Leiden method over an edge table.

Nodes are dealt to blocks by their labels. In a block one task moves its nodes one after the other, as it sees the labels and masses
of all others at the start of the round; a round's moves are kept only as far as the quality rises. Then blocks refine: within
each community, nodes merge to connected groups. Groups are the nodes of the next level. A graph of few links is one block, whose
task goes through all levels that are left.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.shipping import by_value
from lattica.sources.files import positions, stored

by_value(__name__)

#: Links of a block, which a task holds.
BLOCK_LINKS = 500_000
#: Gains below this share of the greatest link count as none.
EPS = 1e-9
#: Share of the links' weight below which a round of several blocks counts as the last of its level.
SETTLED = 1e-2


def moved(names: list, mass: list, label: list, inside: list[dict], outside: list[dict], weight: dict, gamma: float, fresh: str) -> list:
    """Labels after moving nodes one by one until none gains.

    A node's gain in a community is the weight of its links there less ``gamma`` times its mass and the community's; leaving for an
    empty community gains 0. The largest gain wins, then staying, then the least label. ``inside`` has the links between the
    nodes, ``outside`` the weight of links to each label of other nodes, ``weight`` the masses of communities.
    """
    label, weight, empty = list(label), dict(weight), 0
    queue, waits = deque(range(len(names))), [True] * len(names)
    least = EPS * max((w for g in (*inside, *outside) for w in g.values()), default=1.0)
    while queue:
        i = queue.popleft()
        waits[i] = False
        old = label[i]
        near = dict(outside[i])
        for j, w in inside[i].items():
            near[label[j]] = near.get(label[j], 0.0) + w
        stay = near.pop(old, 0.0) - gamma * mass[i] * (weight[old] - mass[i])
        best, gain = old, stay
        for c in sorted(near):
            g = near[c] - gamma * mass[i] * weight[c]
            if g > gain + least:
                best, gain = c, g
        if gain < -least:
            best, empty = f"{names[i]}{fresh}.{empty}", empty + 1
            weight[best] = 0.0
        if best != old:
            weight[old] -= mass[i]
            weight[best] += mass[i]
            label[i] = best
            for j in inside[i]:
                if not waits[j] and label[j] != best:
                    waits[j] = True
                    queue.append(j)
    return label


def refined(names: list, mass: list, label: list, inside: list[dict], outside: list[dict], weight: dict, gamma: float) -> list:
    """The group of each node, named by a member: a well connected single node joins the well connected group of its community,
    linked to it, with the largest positive gain; so groups are connected."""
    group, size, m = list(range(len(names))), [1] * len(names), list(mass)
    # links of a group to the rest of its community
    ties = [outside[i].get(label[i], 0.0) + sum(w for j, w in inside[i].items() if label[j] == label[i]) for i in range(len(names))]
    held = lambda c, own: ties[c] >= gamma * m[c] * (weight[own] - m[c]) - 1e-12
    for i in range(len(names)):
        if group[i] != i or size[i] > 1 or not held(i, label[i]):
            continue
        near: dict[int, float] = {}
        for j, w in inside[i].items():
            if label[j] == label[i]:
                near[group[j]] = near.get(group[j], 0.0) + w
        best, gain = i, 0.0
        for c in sorted(near):
            g = near[c] - gamma * m[i] * m[c]
            if c != i and g > gain and held(c, label[i]):
                best, gain = c, g
        if best != i:
            ties[best] += ties[i] - 2 * near[best]
            m[best] += m[i]
            size[best] += 1
            size[i] = 0
            group[i] = best
    return [names[g] for g in group]


def _graph(part: pd.DataFrame) -> tuple[list, list, list, list[dict], list[dict], dict]:
    """names, mass, label, inside, outside, weight of the rows of a block, as ``moved`` takes them."""
    nodes = part[part["kind"] == 0].sort_values("a")
    names = nodes["a"].tolist()
    at = {a: i for i, a in enumerate(names)}
    inside: list[dict] = [{} for _ in names]
    outside: list[dict] = [{} for _ in names]
    links = part[part["kind"] == 1]
    for a, b, w in zip(links["a"], links["b"], links["w"], strict=True):
        inside[at[a]][at[b]] = w
    links = part[part["kind"] == 2]
    for a, c, w in zip(links["a"], links["label"], links["w"], strict=True):
        outside[at[a]][c] = w
    known = part[part["kind"] != 1]
    return names, nodes["mass"].tolist(), nodes["label"].tolist(), inside, outside, dict(zip(known["label"], known["total"], strict=True))


def _block(part: pd.DataFrame, gamma: float, fresh: str) -> pd.DataFrame:
    """blk, node, label of the nodes of a block after their moves."""
    names, mass, label, inside, outside, weight = _graph(part)
    return pd.DataFrame({"blk": part["blk"].iloc[0], "node": names, "label": moved(names, mass, label, inside, outside, weight, gamma, fresh)})


def _refined_block(part: pd.DataFrame, gamma: float) -> pd.DataFrame:
    """blk, node, label, grp of the nodes of a block, none of which moves."""
    names, mass, label, inside, outside, weight = _graph(part)
    return pd.DataFrame({"blk": part["blk"].iloc[0], "node": names, "label": label, "grp": refined(names, mass, label, inside, outside, weight, gamma)})


def _levels(part: pd.DataFrame, gamma: float, fresh: str) -> pd.DataFrame:
    """blk, node, label of a whole graph that is one block: nodes move and are grouped, level by level, until no group forms."""
    names, mass, label, inside, _, weight = _graph(part)
    nodes, member, level = names, list(range(len(names))), 0
    while True:
        old, label = label, moved(names, mass, label, inside, [{}] * len(names), weight, gamma, f"{fresh}.{level}")
        for i, (was, now) in enumerate(zip(old, label, strict=True)):
            weight[was] -= mass[i]
            weight[now] = weight.get(now, 0.0) + mass[i]
        group = refined(names, mass, label, inside, [{}] * len(names), weight, gamma)
        place = {g: i for i, g in enumerate(sorted(set(group)))}
        if len(place) == len(names):
            return pd.DataFrame({"blk": part["blk"].iloc[0], "node": nodes, "label": [label[i] for i in member]})
        to = [place[g] for g in group]
        sums, own, links = [0.0] * len(place), [""] * len(place), [{} for _ in place]
        for i, g in enumerate(to):
            sums[g] += mass[i]
            own[g] = label[i]
            for j, w in inside[i].items():
                if to[j] != g:
                    links[g][to[j]] = links[g].get(to[j], 0.0) + w
        names, mass, label, inside, member, level = list(place), sums, own, links, [to[i] for i in member], level + 1


def _of(work: Callable[..., pd.DataFrame], *given) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda part: work(part, *given)


def _dealt(nodes: DataFrame, links: DataFrame, blocks: int, block_links: int, seed: str) -> DataFrame:
    """blk, kind, a, b, w, label, mass, total: rows of a block's nodes (0), links inside (1) and to labels outside (2).

    Nodes of one label share a block, as far as they have a quarter of its links or less; a label of more is dealt to several.
    ``nodes(node, mass, label, ends)`` with the number of links, ``links(a, b, w)`` in both directions.
    """
    total = nodes.groupBy("label").agg(F.sum("mass").alias("total"), F.ceil(F.sum("ends") * 4 / F.lit(block_links)).alias("parts"))
    known = nodes.join(total, "label")
    piece = F.pmod(F.xxhash64("node", F.lit(seed)), F.greatest("parts", F.lit(1)))
    own = known.withColumn("blk", F.pmod(F.xxhash64("label", piece, F.lit(seed)), F.lit(blocks)).cast("int"))
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    sides = links.join(own.select(F.col("node").alias("a"), "blk"), "a").join(own.select(F.col("node").alias("b"), F.col("blk").alias("there"), "label", "total"), "b")
    near = sides.filter("blk = there and a <> b").select("blk", F.lit(1).alias("kind"), "a", "b", "w", none.alias("label"), zero.alias("mass"), zero.alias("total"))
    far = sides.filter("blk <> there").groupBy("blk", "a", "label").agg(F.sum("w").alias("w"), F.first("total").alias("total"))
    far = far.select("blk", F.lit(2).alias("kind"), "a", none.alias("b"), "w", "label", zero.alias("mass"), "total")
    rows = own.select("blk", F.lit(0).alias("kind"), F.col("node").alias("a"), none.alias("b"), zero.alias("w"), "label", "mass", "total")
    return rows.unionByName(near).unionByName(far) if blocks > 1 else rows.unionByName(near)


def quality(nodes: DataFrame, links: DataFrame, gamma: float) -> float:
    """Weight of links within communities, in both directions, less ``gamma`` times the sum of squared masses."""
    names = nodes.select("node", "label")
    same = links.join(names.toDF("a", "la"), "a").join(names.toDF("b", "lb"), "b").filter("la = lb").agg(F.sum("w").alias("x"))
    mass = nodes.groupBy("label").agg(F.sum("mass").alias("m")).agg((F.sum(F.col("m") * F.col("m")) * F.lit(-gamma)).alias("x"))
    return same.unionAll(mass).agg(F.sum("x")).first()[0] or 0.0


def _settled(nodes: DataFrame, links: DataFrame, gamma: float, seed: str, blocks: int, block_links: int) -> DataFrame:
    """nodes with label and grp: rounds of all blocks until one raises the quality by less than SETTLED of all links' weight, then
    groups within the communities. What could still move does so at the next level."""
    ends = links.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("ends"))
    nodes, rounds = stored(nodes.join(ends, "node", "left").fillna(0, ["ends"])), 0
    before, least = quality(nodes, links, gamma), SETTLED * (links.agg(F.sum("w")).first()[0] or 0.0)
    while True:
        fresh = f"/{seed}.{rounds}"
        done = stored(_dealt(nodes, links, blocks, block_links, fresh).groupBy("blk").applyInPandas(_of(_block, gamma, fresh), "blk int, node string, label string"))
        now, parts = done.join(nodes.select("node", "mass", "ends", F.col("label").alias("was")), "node"), 1
        while True:  # the moves of a single block always gain
            label = F.when(F.col("blk") % parts == rounds % parts, F.col("label")).otherwise(F.col("was"))
            tried = stored(now.select("node", "mass", label.alias("label"), "ends"))
            after = quality(tried, links, gamma)
            if after > before or parts >= blocks:
                break
            parts *= 2
        # a round of some blocks only says nothing about the others
        settled = after <= before + least / parts
        if after > before:
            nodes, before = tried, after
        rounds += 1
        if settled:
            break
    rows = _dealt(nodes, links, blocks, block_links, f"/{seed}")
    grouped = rows.groupBy("blk").applyInPandas(_of(_refined_block, gamma), "blk int, node string, label string, grp string")
    return stored(grouped.join(nodes.select("node", "mass"), "node").select("node", "mass", "label", "grp"))


def leiden(links: DataFrame, cells: DataFrame, gamma: float, iterations: int = 2, block_links: int = BLOCK_LINKS) -> DataFrame:
    """cell_id, community of ``cells(cell_id, mass)`` linked by ``links(cell_id, nbr_id, w)``, given in both directions.

    Each iteration starts from the communities of the last one, levels follow until no group forms. Ids may be of any type.
    Communities are connected, and numbered by size, then by their least cell.
    """
    edges = stored(links.select(F.col("cell_id").cast("string").alias("a"), F.col("nbr_id").cast("string").alias("b"), F.col("w").cast("double").alias("w")))
    own = stored(cells.select("cell_id", F.col("cell_id").cast("string").alias("node"), "mass"))
    best = own.select("node", "mass", F.col("node").alias("label"))
    score = None
    for i in range(iterations):
        graph, nodes, member = edges, best, own.select("node", F.col("node").alias("grp"))
        level, count = 0, nodes.count()
        while True:
            blocks = max(1, -(-graph.count() // block_links))
            if blocks == 1:
                rows = _dealt(nodes.withColumn("ends", F.lit(0)), graph, 1, block_links, "")
                done = stored(rows.groupBy("blk").applyInPandas(_of(_levels, gamma, f"/{i}.{level}"), "blk int, node string, label string"))
                break
            done = _settled(nodes, graph, gamma, f"{i}.{level}", blocks, block_links)
            groups = done.select("grp").distinct().count()
            if groups == count:
                break
            of = done.select("node", "grp")
            member = stored(member.join(of.toDF("grp", "up"), "grp").select("node", F.col("up").alias("grp")))
            graph = stored(graph.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
            nodes = stored(done.groupBy(F.col("grp").alias("node")).agg(F.sum("mass").alias("mass"), F.min("label").alias("label")))
            level, count = level + 1, groups
        found = stored(own.join(member, "node").join(done.select(F.col("node").alias("grp"), "label"), "grp").select("node", "mass", "label"))
        reached = quality(found, edges, gamma)
        if score is not None and reached <= score + EPS * abs(score):
            break
        best, score = found, reached
    labelled = own.select("cell_id", "node").join(best.select("node", "label"), "node")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("cell_id").alias("least"))
    numbers = positions(sizes, [F.col("size").desc(), F.col("least").asc()], "community")
    return labelled.join(numbers.select("label", F.col("community").cast("int").alias("community")), "label").select("cell_id", "community")
