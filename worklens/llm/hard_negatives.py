"""Hard negatives by bounds along spanning trees of anchors.

Anchors are joined to trees of short edges. For a candidate of norm ``c`` and an edge of
length ``e`` the scores (inner products) at both ends differ by ``e * c`` at most, so what is
known at a parent bounds the score at its child, and only candidates whose bounds overlap
the child's window are scored again. Roots are scored in full.

Vectors and anchors lie in blocks, and every group of vector blocks meets every group of
trees once: the stated query set against all rows, in blocks. A group's results are cut to
what a result can hold before they are shuffled, so that no task holds more than a group of
blocks and a group of trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.packing import pack, unpack
from worklens.llm.tables import give_back, kept

#: Vectors of a block, and blocks that meet a group of trees in one task.
BLOCK, BLOCKS = 2048, 8
#: Anchors of a tree, and trees of a group.
TREE, TREES = 512, 8
#: The id that stands for a null one: after all others.
LAST = 2**63 - 1
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53

PACKED = "number long, size int, data binary"


def _whole(vectors: pa.Array, scale: float) -> np.ndarray:
    """Rows of ``floor(scale * x)``, shorter vectors filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(
        flat, -(2.0**40), 2.0**40
    ).astype(np.int64)
    most = np.abs(out).max(initial=0)
    return out.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _matrix(found: dict) -> np.ndarray:
    return found["matrix"].reshape(len(found["id"]), -1)


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []

    def packed(rows: pa.Table) -> pa.RecordBatch:
        matrix = _whole(rows.column("vector"), scale)
        data = pack(
            {
                "id": rows.column("id").to_numpy(),
                "label": rows.column("label").to_numpy(),
                "anchor": rows.column("anchor").to_numpy().astype(np.int8),
                "matrix": matrix.reshape(-1),
            }
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([rows.num_rows], pa.int32()), pa.array([data])], ["size", "data"]
        )

    for batch in batches:
        waiting.append(batch)
        while sum(b.num_rows for b in waiting) >= BLOCK:
            rows = pa.Table.from_batches(waiting)
            yield packed(rows.slice(0, BLOCK))
            waiting = rows.slice(BLOCK).to_batches()
    rows = pa.Table.from_batches(waiting) if waiting else None
    if rows is not None and rows.num_rows:
        yield packed(rows)
    give_back()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of vector blocks, each with its largest component, so that those that
    point the same way come near each other."""
    for batch in batches:
        for number, data in zip(*(batch.column(c).to_pylist() for c in ("number", "data"))):
            found = unpack(data)
            matrix = _matrix(found).astype(np.int64)
            for at in np.flatnonzero(found["anchor"]):
                row = matrix[at]
                top = int(np.abs(row).argmax()) if len(row) else 0
                lead = 2 * top + int(len(row) > 0 and row[top] < 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lead]), pa.array([number]), pa.array([int(at)], pa.int32()),
                        pa.array([int(found["id"][at])]), pa.array([int(found["label"][at])]),
                        pa.array([row.tobytes()]),
                    ],
                    ["lead", "block", "place", "id", "label", "vector"],
                )


def spanning_tree(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest spanning tree: its nodes from the root on, and for each node its parent
    (the root's is itself) and the length of the edge to it."""
    rows = matrix.astype(np.float64)
    n = len(rows)
    gap = np.full(n, np.inf)
    parent = np.zeros(n, np.int64)
    order = np.zeros(n, np.int64)
    left = np.ones(n, bool)
    node = 0
    for i in range(n):
        order[i], left[node] = node, False
        new = ((rows - rows[node]) ** 2).sum(1)
        closer = left & (new < gap)
        gap[closer], parent[closer] = new[closer], node
        if i + 1 < n:
            node = int(np.where(left, gap, np.inf).argmin())
    gap[0] = 0
    return order, parent, np.sqrt(gap)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []

    def packed(rows: pa.Table) -> pa.RecordBatch:
        vectors = [np.frombuffer(v, np.int64) for v in rows.column("vector").to_pylist()]
        matrix = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
        for row, vector in zip(matrix, vectors):
            row[: len(vector)] = vector
        order, parent, edge = spanning_tree(matrix)
        arrays = {c: rows.column(c).to_numpy() for c in ("id", "label", "block", "place")}
        arrays |= {"order": order, "parent": parent, "edge": edge, "matrix": matrix.reshape(-1)}
        return pa.RecordBatch.from_arrays(
            [pa.array([rows.num_rows], pa.int32()), pa.array([pack(arrays)])], ["size", "data"]
        )

    for batch in batches:
        waiting.append(batch)
        while sum(b.num_rows for b in waiting) >= TREE:
            rows = pa.Table.from_batches(waiting)
            yield packed(rows.slice(0, TREE))
            waiting = rows.slice(TREE).to_batches()
    rows = pa.Table.from_batches(waiting) if waiting else None
    if rows is not None and rows.num_rows:
        yield packed(rows)
    give_back()


class Block:
    """Vectors as a task holds them."""

    def __init__(self, number: int, data: bytes):
        found = unpack(data)
        self.number, self.id, self.label = number, found["id"], found["label"]
        self.rows = _matrix(found).astype(np.float64)
        self.norm = np.sqrt((self.rows**2).sum(1))
        self.most = np.abs(self.rows).max(initial=0)


class Tree:
    """Anchors and the tree that joins them."""

    def __init__(self, number: int, data: bytes):
        found = unpack(data)
        self.number = number
        self.id, self.label = found["id"], found["label"]
        self.block, self.place = found["block"], found["place"]
        self.order, self.parent, self.edge = found["order"], found["parent"], found["edge"]
        self.rows = _matrix(found)

    def scan(self, block: Block, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor the candidates that ``wanted(node, low, high)`` asks for, given the
        bounds of their scores, and their exact scores."""
        width = min(self.rows.shape[1], block.rows.shape[1])
        rows, anchors = block.rows[:, :width], self.rows[:, :width]
        exact = float(np.abs(anchors).max(initial=0)) * block.most * max(width, 1) < EXACT
        if exact:
            anchors = anchors.astype(np.float64)
        whole = None if exact else rows.astype(np.int64).astype(object)
        n = len(self.order)
        low, high = np.empty((n, len(rows))), np.empty((n, len(rows)))
        for node in self.order:
            if node == self.order[0]:
                at = np.arange(len(rows))
                low[node], high[node] = -np.inf, np.inf
            else:
                reach = self.edge[node] * block.norm * (1 + 1e-9) + 1
                np.subtract(low[self.parent[node]], reach, out=low[node])
                np.add(high[self.parent[node]], reach, out=high[node])
                at = None
            asked = wanted(node, low[node], high[node])
            at = asked if at is None else at
            if exact:
                if 2 * len(at) > len(rows):  # gathering them would cost more than scoring all
                    every = rows @ anchors[node]
                    low[node] = high[node] = every
                    scores = every[asked]
                else:
                    low[node][at] = high[node][at] = scores = rows[at] @ anchors[node]
                yield node, asked, scores.astype(np.int64)
            else:
                scores = whole[at] @ anchors[node].astype(object) if width else np.zeros(len(at))
                near = scores.astype(np.float64)
                slack = np.abs(near) * 1e-9 + 1
                low[node][at], high[node][at] = near - slack, near + slack
                yield node, asked, scores[np.searchsorted(at, asked)]


def _long(score) -> int:
    return int(max(-(2**63), min(LAST, int(score))))


def _best(rows: list[tuple], most: int) -> list[tuple]:
    """Of ``(score, id)`` the first by falling score, then by id."""
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:most]


def _cell(rows: pa.Table) -> tuple[list[Block], list[dict]]:
    blocks, trees = [], []
    for row in rows.select(["kind", "number", "data", "positives"]).to_pylist():
        if row["kind"] == "vectors":
            blocks.append(Block(row["number"], row["data"]))
        else:
            trees.append({"tree": Tree(row["number"], row["data"]), "own": row["positives"]})
    return blocks, trees


def _positives(rows: pa.Table, most: int) -> pa.Table:
    """Each anchor's first rows of its own label among a group of blocks."""
    blocks, trees = _cell(rows)
    out = []
    for tree in (t["tree"] for t in trees):
        found: list[list[tuple]] = [[] for _ in tree.id]
        for block in blocks:

            def wanted(node, low, high):
                same = block.label == tree.label[node]
                if block.number == tree.block[node]:
                    same[tree.place[node]] = False
                at = np.flatnonzero(same)
                least = -np.inf
                if len(found[node]) == most:
                    least = float(found[node][-1][0]) * (1 - 1e-9 * np.sign(found[node][-1][0]))
                if len(at) > most:
                    least = max(least, np.partition(low[at], -most)[-most])
                return at[high[at] >= least]

            for node, at, scores in tree.scan(block, wanted):
                if len(at) > most:
                    first = np.lexsort((block.id[at], -scores))[:most]
                    at, scores = at[first], scores[first]
                new = list(zip(scores.tolist(), block.id[at].tolist()))
                found[node] = _best(found[node] + new, most)
        out += [
            (tree.number, node, _long(s), i)
            for node, kept_ in enumerate(found) for s, i in kept_
        ]
    columns = list(zip(*out)) if out else [()] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "node", "score", "id"]
    )


def _negatives(rows: pa.Table, most: int, window: tuple[int, int]) -> pa.Table:
    """For each anchor and positive the first rows of other labels within its window."""
    blocks, trees = _cell(rows)
    least, greatest = window
    out = []
    for entry in trees:
        tree = entry["tree"]
        own: list[list[dict]] = [[] for _ in tree.id]
        for positive in entry["own"] or []:
            own[positive["node"]].append(positive)
        spans = [
            [(p["score"] * least / 100, p["score"] * greatest / 100) for p in ps if p["score"] >= 0]
            for ps in own
        ]
        found: dict[tuple, list] = {}
        for block in blocks:

            def wanted(node, low, high):
                if not spans[node]:
                    return np.zeros(0, np.int64)
                floor = min(s[0] for s in spans[node]) * (1 - 1e-9) - 1
                ceiling = max(s[1] for s in spans[node]) * (1 + 1e-9) + 1
                other = block.label != tree.label[node]
                return np.flatnonzero(other & (high >= floor) & (low <= ceiling))

            for node, at, scores in tree.scan(block, wanted):
                if not len(at):
                    continue
                first = np.lexsort((block.id[at], -scores))
                scores, ids = scores[first], block.id[at][first]
                for p in own[node]:
                    inside = (least * p["score"] <= 100 * scores) & (
                        100 * scores <= greatest * p["score"]
                    )
                    at_most = np.flatnonzero(inside)[:most]
                    if len(at_most):
                        found.setdefault((node, p["place"]), []).extend(
                            zip(scores[at_most].tolist(), ids[at_most].tolist())
                        )
        for (node, place), pairs in found.items():
            out += [(tree.number, node, place, _long(s), i) for s, i in _best(pairs, most)]
    columns = list(zip(*out)) if out else [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        ["tree", "node", "place", "score", "id"],
    )


def hard_negatives(
    vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 10,
    window: tuple[int, int] = (30, 90), scale: int = 256, id_column: str = "vec_id",
    label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each
    anchor (rows for which the SQL ``anchor`` holds) and each of its ``positives`` first other
    rows of the same label, the ``negatives`` first rows of other labels whose score lies
    within ``window`` per cent of the positive's.

    Components are taken as ``floor(scale * x)``, a score is their inner product, a whole
    number; higher ones come first, ties by smaller id. Rows with a null label or vector, or
    a null or non-finite component, take no part. A null id comes last, is no anchor, and is
    returned as null; each of repeated rows is a row of its own. Of vectors of different
    lengths the missing components count as zero; quantised components are cut at 2 ** 40 and
    scores at the range of a long. An empty table gives no rows; other columns are ignored.
    """
    name = f"`{vector_column}`"
    usable = vectors.where(
        f"`{label_column}` IS NOT NULL AND {name} IS NOT NULL AND forall({name}, x -> x IS NOT"
        " NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    ).selectExpr(
        f"coalesce(CAST(`{id_column}` AS LONG), {LAST}L) AS id",
        f"CAST(`{label_column}` AS LONG) AS label",
        f"coalesce(CAST(({anchor}) AS BOOLEAN), false) AS anchor",
        f"{name} AS vector",
    )
    packed = usable.mapInArrow(lambda batches: _blocks(batches, scale), "size int, data binary")
    blocks = kept(packed.selectExpr("monotonically_increasing_id() AS number", "*"), "vectors")
    ordered = (
        blocks.mapInArrow(
            _anchors, "lead long, block long, place int, id long, label long, vector binary"
        )
        .repartitionByRange("lead", "block", "place")
        .sortWithinPartitions("lead", "block", "place")
    )
    grown = ordered.mapInArrow(_trees, "size int, data binary")
    trees = kept(grown.selectExpr("monotonically_increasing_id() AS number", "*"), "trees")
    block_groups = max(1, -(-blocks.count() // BLOCKS))
    tree_groups = max(1, -(-trees.count() // TREES))

    def cells(trees: DataFrame) -> DataFrame:
        """Every group of blocks with every group of trees."""
        group = "pmod(xxhash64(number), {})"
        one = blocks.selectExpr(
            "'vectors' AS kind", f"{group.format(block_groups)} AS v",
            f"explode(sequence(0, {tree_groups - 1})) AS t", "number", "data",
            "CAST(NULL AS array<struct<node:int,place:int,score:bigint>>) AS positives",
        )
        other = trees.selectExpr(
            "'trees' AS kind", f"explode(sequence(0, {block_groups - 1})) AS v",
            f"{group.format(tree_groups)} AS t", "number", "data", "positives",
        )
        both = [
            df.withColumns({c: F.col(c).cast("int") for c in ("v", "t")}) for df in (one, other)
        ]
        return both[0].union(both[1]).groupBy("v", "t")

    none = "CAST(NULL AS array<struct<node:int,place:int,score:bigint>>) AS positives"
    partial = cells(trees.selectExpr("number", "data", none)).applyInArrow(
        lambda rows: _positives(rows, positives), "tree long, node int, score long, id long"
    )
    own = kept(
        partial.selectExpr(
            "*", "row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, id) AS place"
        ).where(f"place <= {positives}"),
        "positives",
    )
    # At most a tree's anchors times the positives of one.
    listed = own.groupBy(F.col("tree").alias("number")).agg(
        F.expr("collect_list(struct(node, place, score)) AS positives")
    )
    found = cells(trees.join(listed, "number").select("number", "data", "positives")).applyInArrow(
        lambda rows: _negatives(rows, negatives, window),
        "tree long, node int, place int, score long, id long",
    )
    ranked = found.selectExpr(
        "tree", "node", "place", "score AS negative_score", "id AS negative_id",
        "row_number() OVER (PARTITION BY tree, node, place ORDER BY score DESC, id) AS rank",
    ).where(f"rank <= {negatives}")
    names = trees.mapInArrow(_names, "tree long, node int, anchor_id long")
    return (
        ranked.join(own.withColumnsRenamed({"score": "positive_score", "id": "positive_id"}),
                    ["tree", "node", "place"])
        .join(names, ["tree", "node"])
        .selectExpr(
            "anchor_id", f"nullif(positive_id, {LAST}L) AS positive_id", "rank",
            f"nullif(negative_id, {LAST}L) AS negative_id", "positive_score", "negative_score",
        )
    )


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, data in zip(*(batch.column(c).to_pylist() for c in ("number", "data"))):
            ids = unpack(data)["id"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), number)),
                    pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids),
                ],
                ["tree", "node", "anchor_id"],
            )
