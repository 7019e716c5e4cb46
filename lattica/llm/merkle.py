"""Merkle manifest of a dataset by fractal traversal of aligned blocks.

Rows of a tree are numbered along its order and dealt to aligned blocks of 2^BLOCK nodes. In its block a task keeps two stacked
subtrees of SUBTREE levels for each level of the stack, the existing one that gives the present authentication path and the desired
one that grows by a few hashes a step and takes over at the next border; so it emits the paths of successive nodes one after the
other without holding the block's tree. The roots of blocks are the nodes of the next round, whose paths are the upper proofs and
are appended to the blocks' by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import by_value, numbered, placed, small_batches, source_key, table, written

by_value(__name__)

#: Levels of an aligned block (1,024 nodes, one group of a task) and of a subtree in its stack.
BLOCK = 10
SUBTREE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLING = "struct<left:boolean,other:string>"
PATHS = "tree string, pos long, node string, path array<string>, folded string, top string"


def digest(left: str | None, right: str | None) -> str | None:
    """The node above two neighbours; a node without a right neighbour is hashed alone, and above nothing is nothing."""
    return None if left is None else hashlib.sha256((left + (right or "")).encode()).hexdigest()


class Subtree:
    """The nodes of ``levels`` levels over the leaves from ``first`` on, built one leaf at a time in postorder (treehash)."""

    def __init__(self, first: int, low: int, levels: int):
        self.first, self.low, self.levels = first, low, levels
        self.rows: list[list[str | None]] = [[] for _ in range(levels + 1)]

    def add(self, node: str | None) -> None:
        """The next node of the subtree's lowest level, and all nodes that it completes."""
        for row in self.rows:
            row.append(node)
            if len(row) % 2:
                return
            node = digest(row[-2], row[-1])

    def done(self) -> bool:
        return len(self.rows[0]) == 1 << self.levels

    def sibling(self, level: int, index: int) -> str | None:
        return self.rows[level][(index ^ 1) & ((1 << (self.levels - level)) - 1)]


class Traversal:
    """Successive authentication paths in a tree of ``height`` levels over a list of nodes, absent ones at the end.

    For each stage of SUBTREE levels there is an existing subtree, and a desired one, the next at that stage, whose leaves are
    taken a few a step: as many as make it complete when the traversal enters it. At no time more than two subtrees a stage and
    one treehash stack a stage are held beside the nodes themselves.
    """

    def __init__(self, nodes: list[str], height: int, levels: int = SUBTREE):
        self.nodes, self.height = nodes, height
        lows = range(0, height, levels)
        self.stages = [(low, min(levels, height - low)) for low in lows]
        self.held: list[Subtree] = []
        self.next: list[Subtree | None] = []
        self.stacks: list[list[tuple[int, str | None]]] = []
        for low, up in self.stages:
            own = Subtree(0, low, up)
            self.held.append(own)
            while not own.done():
                self._grow(own, [], 1 << low)
            self.next.append(self._after(own))
            self.stacks.append([])

    def _after(self, tree: Subtree) -> Subtree | None:
        first = tree.first + (1 << (tree.low + tree.levels))
        return Subtree(first, tree.low, tree.levels) if first < 1 << self.height else None

    def _grow(self, tree: Subtree, stack: list[tuple[int, str | None]], steps: int) -> None:
        """Take ``steps`` further nodes by treehash; each node of the subtree's lowest level goes in as it is complete."""
        for _ in range(steps):
            if tree.done():
                return
            at = tree.first + (len(tree.rows[0]) << tree.low) + sum(1 << level for level, _ in stack)
            level, node = 0, self.nodes[at] if at < len(self.nodes) else None
            while stack and stack[-1][0] == level:
                level, node = level + 1, digest(stack.pop()[1], node)
            if level == tree.low:
                tree.add(node)
            else:
                stack.append((level, node))

    def root(self) -> str:
        return self.held[-1].rows[-1][0] if self.held else self.nodes[0]

    def paths(self) -> Iterator[list[str | None]]:
        """The siblings of each node from its own level up; None where there is none."""
        for at in range(len(self.nodes)):
            for k, (low, up) in enumerate(self.stages):
                if at and at % (1 << (low + up)) == 0:
                    tree, stack = self.next[k], self.stacks[k]
                    self._grow(tree, stack, 1 << (low + up))  # nothing is left to do but where the steps end just here
                    self.held[k], self.next[k], self.stacks[k] = tree, self._after(tree), []
            yield [self.held[k].sibling(level, at >> (low + level)) for k, (low, up) in enumerate(self.stages) for level in range(up)]
            for k in range(len(self.stages)):
                if self.next[k] is not None:
                    self._grow(self.next[k], self.stacks[k], 1)


def fold(node: str, at: int, path: list[str | None]) -> str:
    for level, other in enumerate(path):
        node = digest(other, node) if at >> level & 1 else digest(node, other)
    return node


def _levels(n: int) -> int:
    return max(0, n - 1).bit_length()


def _block(part: pa.Table) -> pa.Table:
    """Paths of one block; its rows come in any order and are few."""
    part = part.sort_by("pos")
    first, n = part["pos"][0].as_py(), part["n"][0].as_py()
    nodes, changed = part["node"].to_pylist(), part["changed"].to_pylist()
    walk = Traversal(nodes, min(BLOCK, _levels(n)))
    paths = list(walk.paths())
    mask = (1 << BLOCK) - 1
    folded = [fold(c or x, (first + i) & mask, p) for i, (x, c, p) in enumerate(zip(nodes, changed, paths, strict=True))]
    top = pa.array([walk.root()] + [None] * (len(nodes) - 1), pa.string())
    columns = [part["id"], part["tree"], part["pos"], part["node"], pa.array(paths, pa.list_(pa.string())), pa.array(folded, pa.string()), top]
    return pa.table(columns, names=["id", "tree", "pos", "node", "path", "folded", "top"])


def _side(pos: Column, path: Column) -> Column:
    """The path with, for each level, whether the sibling is the left one."""
    return F.transform(path, lambda s, i: F.struct((F.call_function("shiftright", pos, i).bitwiseAND(F.lit(1)) == 1).alias("left"), s.alias("other")))


def _proved(nodes: DataFrame, name: str) -> DataFrame:
    """One round: ``nodes(id, tree, pos, n, node, changed)`` with path and fold inside of their blocks; a block's first row has its top."""
    blocks = nodes.groupBy("tree", F.shiftright("pos", BLOCK).alias("block")).applyInArrow(_block, f"id {dict(nodes.dtypes)['id']}, {PATHS}")
    return written(blocks, name)


def _above(proved: DataFrame, sizes: DataFrame) -> DataFrame:
    """The next round's nodes: tops of the blocks."""
    blocks = F.shiftright(F.col("n") + F.lit((1 << BLOCK) - 1), BLOCK)
    none = F.lit(None).cast("string")
    tops = proved.filter("top is not null").select(none.alias("id"), "tree", F.shiftright("pos", BLOCK).alias("pos"), F.col("top").alias("node"), none.alias("changed"))
    return tops.join(sizes.select("tree", blocks.alias("n")), "tree")


def _trees(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(rounds of proved nodes from the leaves up, tree and root of each tree).

    Every round divides the nodes by 2^BLOCK, until each tree has one.
    """
    sizes = written(nodes.select("tree", "n").distinct(), f"{name}-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds = []
    while True:
        proved = _proved(nodes, f"{name}-{len(rounds)}")
        rounds.append(proved)
        nodes = _above(proved, sizes)
        if most <= 1 << BLOCK:
            return rounds, nodes.filter("pos = 0").select("tree", F.col("node").alias("root"))
        most = -(-most >> BLOCK)
        sizes = sizes.withColumn("n", F.shiftright(F.col("n") + F.lit((1 << BLOCK) - 1), BLOCK))


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, pos, upper: siblings above each block of the leaves' round; ``above(tree, up)`` has those above the trees."""
    found = None
    for proved in reversed(rounds[1:]):
        own = proved.select("tree", "pos", _side(F.col("pos"), F.col("path")).alias("path"))
        if found is None:
            own = own.join(above, "tree").select("tree", "pos", F.concat("path", "up").alias("upper"))
        else:
            own = own.withColumn("block", F.shiftright("pos", BLOCK)).join(found.toDF("tree", "block", "up"), ["tree", "block"])
            own = own.select("tree", "pos", F.concat("path", "up").alias("upper"))
        found = own
    return found


def encoded(value: Column) -> Column:
    """`-` for null, else its count of UTF-8 bytes, `:` and the value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def manifest(docs: DataFrame, tampered: Column, change: dict[str, Column]) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang, pos, proof of each row of ``docs``.

    A row is a leaf, the hash of FIELDS. Leaves form a tree a lang (null is a lang of its own, before all others), by doc_id, nulls
    first, then by leaf; equal rows are told apart by their place in the table. The trees' roots form the tree whose root stands for
    the dataset. ``proof`` lists the siblings up to the root, ``left`` says on which side each stands. Where ``tampered`` holds, the
    path is folded from the leaf of the row with ``change``; null counts as not. Columns beside FIELDS are ignored. An empty
    table has no tree and no rows.
    """
    small_batches(docs.sparkSession, 4096)
    rows = numbered(docs.select(*FIELDS), "merkle-docs").select("row.*", F.xxhash64("at").alias("salt"))
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf(**change))
    leaves = written(rows.select(source_key(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"), "salt", leaf().alias("node"), other.alias("changed")), "merkle-leaves")
    numbers = placed(leaves, ["id", "node", "salt"], "merkle-sorted").drop("salt")
    rounds, subroots = _trees(numbers, "merkle-tree")
    none = F.lit(None).cast("string")
    roots = subroots.select(F.col("tree").alias("id"), F.lit("all").alias("tree"), F.col("root").alias("node"), none.alias("changed"))
    upper_rounds, top = _trees(placed(roots, ["id"], "merkle-roots"), "merkle-top")
    top = F.broadcast(top)  # one row
    langs = upper_rounds[0].select("id", "tree", "pos", "node", _side(F.col("pos"), F.col("path")).alias("up")).join(top, "tree")
    if len(upper_rounds) > 1:
        over = _proofs(upper_rounds, top.select("tree", F.array().cast(f"array<{SIBLING}>").alias("up"))).select(F.col("pos").alias("block"), "upper")
        langs = langs.withColumn("block", F.shiftright("pos", BLOCK)).join(over, "block").withColumn("up", F.concat("up", "upper"))
    above = written(langs.select(F.col("id").alias("tree"), "up", F.col("node").alias("subroot"), "root"), "merkle-above")
    if len(rounds) > 1:
        upper = written(_proofs(rounds, above.select("tree", "up")).select("tree", F.col("pos").alias("block"), F.col("upper").alias("up")), "merkle-upper")
        inner = rounds[0].withColumn("block", F.shiftright("pos", BLOCK)).join(upper, ["tree", "block"]).join(above.drop("up"), "tree")
    else:
        inner = rounds[0].join(above, "tree")
    step = lambda node, s: F.sha2(F.when(s["left"], F.concat(s["other"], node)).otherwise(F.concat(node, F.coalesce(s["other"], F.lit("")))), 256)
    proof = F.concat(_side(F.col("pos"), F.col("path")), F.col("up"))
    out = inner.select("*", proof.alias("proof"), F.aggregate("up", F.col("folded"), step).alias("folded_root"))
    siblings = F.array_join(F.transform("proof", lambda s: s["other"]), "")
    return out.select(
        F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), F.when(F.col("tree") != "n", F.expr("substring(tree, 2)")).alias("lang"), "pos", "proof",
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents: where 7 divides the id's CRC, one more character is claimed."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return manifest(table(spark, sf_dir, "documents"), tampered, {"n_chars": more}).drop("lang", "pos", "proof")



ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
enc AS (SELECT doc_id, coalesce('s' || lang, 'n') AS tree, n_chars, CAST(doc_id AS VARCHAR) AS id,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
rows AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other,
    xor(4294967295, list_reduce(list_transform(range(1, strlen(id) + 1), lambda p: CAST(ascii(substr(id, p, 1)) AS BIGINT)),
        lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)]), 4294967295)) % 7 = 0 AS tampered FROM enc, tab),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows),
low AS (SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM leaves
    UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 2),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, pos, h, n FROM subs
    UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, pos // 2),
path AS (SELECT l.tree, l.pos, s.lvl, (l.pos >> s.lvl) % 2 = 1 AS is_left, x.h FROM leaves l JOIN (SELECT DISTINCT tree, lvl FROM low WHERE n > 1) s USING (tree)
        LEFT JOIN low x ON x.tree = l.tree AND x.lvl = s.lvl AND x.pos = xor(l.pos >> s.lvl, 1)
    UNION ALL SELECT l.tree, l.pos, 1000 + s.lvl, (u.pos >> s.lvl) % 2 = 1, x.h FROM leaves l JOIN subs u USING (tree), (SELECT DISTINCT lvl FROM high WHERE n > 1) s
        LEFT JOIN high x ON x.lvl = s.lvl AND x.pos = xor(u.pos >> s.lvl, 1)),
proofs AS (SELECT tree, pos, string_agg(coalesce(h, ''), '' ORDER BY lvl) AS siblings, list({'is_left': is_left, 'h': coalesce(h, '')} ORDER BY lvl) AS steps FROM path GROUP BY tree, pos),
folded AS (SELECT l.doc_id, l.leaf, u.h AS subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce([{'is_left': false, 'h': CASE WHEN coalesce(l.tampered, false) THEN l.other ELSE l.leaf END}] || coalesce(p.steps, []),
        lambda a, s: {'is_left': false, 'h': CASE WHEN s.is_left THEN sha256(s.h || a.h) ELSE sha256(a.h || s.h) END}).h AS folded_root
    FROM leaves l JOIN subs u USING (tree) JOIN high r ON r.n = 1 LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos)
SELECT *, folded_root = root AS verified FROM folded
"""
