"""Near-duplicates by SimHash, found by joining a binary trie of fingerprints to itself.

Two fingerprints within three bits of each other agree on at least one of four
16-bit blocks. So the trie is built four times, each time with another block on top,
and every block is the root of a subtree that joins with itself: pairs of nodes go down
together, add up the bits in which they differ, and stop once these exceed the budget.
A subtree with many fingerprints is first split into pairs of its own subtrees, in
Spark, so that no task gets a large one whole. Tasks return a spanning forest of the
links they find, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm.components import components
from worklens.llm.tables import give_back, kept

BUDGET = 3
BLOCK_BITS = 16
#: Fingerprints of a subtree above which it is split into pairs of subtrees.
SPLIT_ABOVE = 4096
#: Bits by which a split goes down.
SPLIT_BITS = 4
#: Node pairs with at most so many combinations are compared directly.
LEAF_PAIRS = 64
SLICE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The majority bits of the XXH64 of all word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        hashes = np.array(
            [digest(joined[s:e], seed) for s, e in zip(starts[at : at + SLICE], ends[at : at + SLICE])],
            dtype="<u8",
        )
        ones += np.unpackbits(
            hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint of each text (UTF-8 bytes), as a signed number of the same bits."""
    for texts in batches:
        values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
        yield pd.Series(values.view(np.int64))
        del texts
    give_back()


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Where the second child of each node (a range of sorted values) begins."""
    return hi - (upto[hi] - upto[lo])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of linked positions; a label points to the class's least position."""
    while len(a):
        ra, rb = label[a], label[b]
        while (label[ra] != ra).any() or (label[rb] != rb).any():
            ra, rb = label[ra], label[rb]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def trie_links(
    values: np.ndarray, roots: np.ndarray, budget: int = BUDGET
) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(root, position)`` of a spanning forest of all links within ``budget``.

    ``values``: unsigned 64-bit, sorted within each node. ``roots``: one row per pair of
    nodes, ``a_lo, a_hi, b_lo, b_hi, differing bits so far, depth``; equal ranges mean a
    node with itself.
    """
    label = np.arange(len(values))

    def compare(pairs: np.ndarray) -> None:
        counts = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        upto = np.cumsum(counts)
        at = 0
        while at < len(pairs):
            end = max(
                np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right"), at + 1
            )
            some, n = pairs[at:end], counts[at:end]
            which = np.repeat(np.arange(len(some)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = (some[:, 3] - some[:, 2])[which]
            a = some[which, 0] + k // width
            b = some[which, 2] + k % width
            near = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (a != b)
            _merge(label, a[near], b[near])
            at = end

    waiting = roots[np.argsort(roots[:, 5], kind="stable")]
    front = np.empty((0, 5), dtype=np.int64)
    for depth in range(int(waiting[0, 5]) if len(waiting) else 64, 65):
        begin = np.searchsorted(waiting[:, 5], depth + 1)
        front = np.concatenate((front, waiting[:begin, :5]))
        waiting = waiting[begin:]
        small = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2]) <= LEAF_PAIRS
        if depth == 64:
            small[:] = True
        compare(front[small])
        front = front[~small]
        if not len(front) and not len(waiting):
            break
        bit = ((values >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(bit)))
        a_lo, a_hi, b_lo, b_hi, differ = front.T
        a_mid, b_mid = _split(values, a_lo, a_hi, upto), _split(values, b_lo, b_hi, upto)
        same = a_lo == b_lo
        children = [
            np.stack((a_lo, a_mid, b_lo, b_mid, differ), 1),
            np.stack((a_mid, a_hi, b_mid, b_hi, differ), 1),
            np.stack((a_lo, a_mid, b_mid, b_hi, differ + 1), 1),
            np.stack((a_mid, a_hi, b_lo, b_mid, differ + 1), 1)[~same],
        ]
        front = np.concatenate(children)
        front = front[
            (front[:, 4] <= budget) & (front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3])
        ]
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return label[moved], moved


def _join_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``task, side, turned, turn, differ, depth`` sorted by task, side and value."""

    def work(table: pa.Table) -> pa.RecordBatch:
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        values = columns["turned"].view(np.uint64) ^ np.uint64(1 << 63)
        new = np.flatnonzero(
            np.concatenate(
                ([True], (np.diff(columns["task"]) != 0) | (np.diff(columns["side"]) != 0))
            )
        )
        ends = np.append(new[1:], len(values))
        side, task = columns["side"][new], columns["task"][new]
        own = side == 0
        first = np.flatnonzero(own | (side == 1))
        second = np.where(own[first], first, first + 1)
        paired = second < len(new)
        first, second = first[paired], second[paired]
        paired = (task[first] == task[second]) & ((side[second] == 2) | own[first])
        first, second = first[paired], second[paired]
        roots = np.stack(
            (
                new[first], ends[first], new[second], ends[second],
                columns["differ"][new[first]], columns["depth"][new[first]],
            ),
            1,
        ).astype(np.int64)
        root, member = trie_links(values, roots)
        turn = columns["turn"][member].astype(np.uint64)

        def back(at: np.ndarray) -> pa.Array:
            v = values[at]
            v = np.where(turn == 0, v, (v >> turn) | (v << ((np.uint64(64) - turn) % np.uint64(64))))
            return pa.array(v.view(np.int64))

        return pa.RecordBatch.from_arrays([back(root), back(member)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy()
        start = int(np.searchsorted(task, task[-1]))
        if start == 0 and (not held or held[-1].column("task")[-1].as_py() == task[-1]):
            held.append(batch)
            continue
        held.append(batch.slice(0, start))
        yield work(pa.Table.from_batches(held))
        held = [batch.slice(start)]
    if held:
        yield work(pa.Table.from_batches(held))


def _node(depth: str) -> str:
    """SQL: the first bits of ``turned``, as a number."""
    return f"shiftrightunsigned(turned, 64 - {depth})"


def trie_tasks(turned: DataFrame) -> DataFrame:
    """Fingerprints dealt to pairs of subtrees small enough for one task.

    ``turned``: columns ``turn`` and ``turned``. Returns a row per fingerprint and task
    with ``task, side`` (0: a subtree with itself, 1 and 2: two subtrees), ``differ`` and
    ``depth``. Counting nodes decides what to split; nothing but a flag per level
    reaches the driver.
    """
    sized = turned.groupBy("turn", F.expr(_node("16")).alias("node")).agg(F.count("*").alias("n"))
    large = kept(sized.where(f"n > {SPLIT_ABOVE}"), "large-nodes")
    plain = turned.withColumn("node", F.expr(_node("16")))
    if large.isEmpty():
        return plain.selectExpr(
            "xxhash64(turn, node) AS task", "0 AS side", "turned", "turn", "0 AS differ", "16 AS depth"
        )
    keys = large.selectExpr("turn AS l_turn", "node AS l_node")
    on = F.expr("turn = l_turn AND node = l_node")
    dealt = [
        plain.join(keys, on, "left_anti").selectExpr(
            "xxhash64(turn, node) AS task", "0 AS side", "turned", "turn", "0 AS differ", "16 AS depth"
        )
    ]
    crowded = kept(plain.join(keys, on, "left_semi").select("turn", "turned"), "crowded")
    pairs = large.selectExpr("turn", "node AS a", "node AS b")
    for depth in range(BLOCK_BITS + SPLIT_BITS, 65, SPLIT_BITS):
        nodes = kept(
            crowded.groupBy("turn", F.expr(_node(str(depth))).alias("node")).agg(
                F.count("*").alias("n")
            ),
            "nodes",
        )
        child = nodes.selectExpr(
            "turn", f"shiftrightunsigned(node, {SPLIT_BITS}) AS parent", "node", "n"
        )
        left = child.selectExpr("turn AS t_a", "parent AS p_a", "node AS c_a", "n AS n_a")
        right = child.selectExpr("turn AS t_b", "parent AS p_b", "node AS c_b", "n AS n_b")
        pairs = (
            pairs.join(left, F.expr("turn = t_a AND a = p_a"))
            .join(right, F.expr("turn = t_b AND b = p_b AND (a <> b OR c_a <= c_b)"))
            .selectExpr(
                "turn", "c_a AS a", "c_b AS b",
                "bit_count(c_a ^ c_b) AS differ", "n_a", "n_b",
            )
            .where(f"differ <= {BUDGET}")
        )
        pairs = kept(pairs, "pairs")
        done = f"n_a + n_b <= {SPLIT_ABOVE} OR {depth} = 64"
        ready = pairs.where(done)
        sides = ready.selectExpr(
            "turn AS r_turn",
            f"xxhash64(turn, a, b, {depth}) AS task",
            "differ",
            "explode(if(a = b, array(named_struct('side', 0, 'at', a)),"
            " array(named_struct('side', 1, 'at', a), named_struct('side', 2, 'at', b)))) AS s",
        )
        dealt.append(
            crowded.join(sides, F.expr(f"turn = r_turn AND {_node(str(depth))} = s.at")).selectExpr(
                "task", "s.side AS side", "turned", "turn", "differ", f"{depth} AS depth"
            )
        )
        pairs = pairs.where(f"NOT ({done})").select("turn", "a", "b")
        if pairs.isEmpty():
            break
    out = dealt[0]
    for more in dealt[1:]:
        out = out.union(more)
    return out


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect every pair of the fingerprints (column ``f``) within
    the budget: a spanning forest per task."""
    turns = ", ".join(
        f"named_struct('turn', {t}, 'turned', "
        + (f"shiftleft(f, {t}) | shiftrightunsigned(f, {64 - t})" if t else "f")
        + ")"
        for t in range(0, 64, BLOCK_BITS)
    )
    turned = kept(distinct.selectExpr(f"inline(array({turns}))"), "turned")
    # The sign bit is flipped so that signed order is the order of the unsigned values.
    return (
        trie_tasks(turned)
        .withColumn("turned", F.expr("turned ^ shiftleft(1L, 63)"))
        .repartition("task")
        .sortWithinPartitions("task", "side", "turned")
        .mapInArrow(_join_tasks, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``,
    the smallest id that links of at most three differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. A null id has no
    part in the minimum; a component of null ids only has a null one. Copies share a
    fingerprint and are never paired.
    """
    marked = kept(
        docs.select(
            F.col(f"`{id_column}`").alias("id"),
            fingerprints(F.col(f"`{text_column}`").cast("string").cast("binary")).alias("f"),
        ),
        "fingerprints",
    )
    distinct = marked.groupBy("f").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(distinct.select("f")))
    classes = distinct.join(roots, F.expr("f = node"), "left").selectExpr(
        "f AS c_f", "coalesce(root, f) AS root", "least"
    )
    least = classes.groupBy(F.col("root").alias("l_root")).agg(F.min("least").alias("component_id"))
    classes = kept(
        classes.join(least, F.expr("root = l_root")).select("c_f", "component_id"), "classes"
    )
    return marked.join(classes, F.expr("f = c_f")).selectExpr(
        f"id AS `{id_column}`", "lower(lpad(hex(f), 16, '0')) AS fingerprint", "component_id"
    )


def keep_one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component.

    Rows with a null id stay; of rows that repeat an id all stay or none.
    """
    found = near_duplicates(docs, id_column, text_column)
    gone = found.where(f"`{id_column}` <> component_id").select(F.col(f"`{id_column}`").alias("gone_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay = rows.join(gone.distinct(), F.expr(f"row.`{id_column}` = gone_id"), "left_anti")
    return stay.select("row.*")
