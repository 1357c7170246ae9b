"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

One inserted, deleted or replaced letter moves a word's letter counts by a squared distance
of 1 or 2, so NumPy products of blocks of letter counts show every possible pair; what is
left is verified letter by letter.

Blocks hold words of two adjacent lengths that can be near at all: letters fall into eight
classes, and two near words agree in their counts per class once one letter of the longer
word (of both, for a replacement) is taken away. A word goes to one block per class that it
has and to the block of its own counts, so a pair meets in one known block. A crowded block
is cut into parts that meet two by two, which leaves no pair out and keeps a task's memory
bounded. Words with their counts are the only thing that is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.tables import give_back, kept, slices

#: Classes of letters: the code point modulo this number.
CLASSES = 8
#: Words of a block part; a block of more is cut.
PART = 2048
#: Words whose products are taken at once, where whole blocks are smaller.
ROWS = 384
#: Words up to this length are verified as one matrix of letters.
SHORT = 64
#: Distinct words a task counts before it sends them on.
COUNTED = 300_000

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def _counted(
    batches: Iterator[pa.RecordBatch], least: int, garble: int | None
) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
    totals: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words, counts = list(totals), list(totals.values())
        totals.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"]
        )

    for batch in slices(batches, 256):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            start = zlib.crc32(("" if doc_id is None else f"{doc_id}").encode() + b":")
            found: Counter = Counter()
            for run, n in Counter(runs.findall(text or "")).items():
                found[run.lower() if run.isascii() else run.translate(_LOWER)] += n
            for word, n in found.items():
                if garble:
                    h = zlib.crc32(word.encode(), start)
                    if h % garble == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                if len(word) >= least:
                    totals[word] += n
            if len(totals) >= COUNTED:
                yield flush()
    yield flush()
    give_back()


def word_counts(
    docs: DataFrame,
    least_length: int = 7,
    garble: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``word, n`` of the maximal runs of Latin letters in whole texts, only A-Z lower-cased,
    of at least ``least_length`` letters.

    With ``garble`` a run loses its letter number ``h % length`` where ``garble`` divides
    ``h``, the crc32 of ``<id>:<run>``: known misspellings, by which results are measured.
    A null text has no words, a null id counts as empty text; repeated rows count each.
    """
    source = docs.select(
        F.col(f"`{id_column}`").cast("string").alias("id"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    parts = source.mapInArrow(
        lambda batches: _counted(batches, least_length, garble), "word string, n long"
    )
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of class counts."""
    out = np.full(len(counts), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for column in counts.T:
            out = (out ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _spread(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters as one array of code points, each one's word, and the words' lengths."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return letters, np.repeat(np.arange(len(words)), lengths), lengths


def _places(words: list[str]) -> dict[str, np.ndarray]:
    """A row for each block that a word goes to."""
    letters, owner, _ = _spread(words)
    counts = np.bincount(owner * CLASSES + letters % CLASSES, minlength=len(words) * CLASSES)
    counts = counts.reshape(len(words), CLASSES)
    own = _mixed(counts)
    key, word = [own], [np.arange(len(words))]
    first, longer = [np.zeros(len(words), bool)], [np.zeros(len(words), bool)]
    unseen = np.ones(len(words), bool)
    for c in range(CLASSES):
        at = np.flatnonzero(counts[:, c])
        less = counts[at]
        less[:, c] -= 1
        key.append(_mixed(less))
        word.append(at)
        first.append(unseen[at])
        longer.append(np.ones(len(at), bool))
        unseen[at] = False
    columns = (key, word, first, longer)
    found = dict(zip(("key", "word", "first", "longer"), map(np.concatenate, columns)))
    found["own"] = own[found["word"]]
    return found


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 16_384):
        words = batch.column("word")
        found = _places(words.to_pylist())
        at = pa.array(found["word"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found["key"]), words.take(at), batch.column("n").take(at),
                pa.array(found["first"]), pa.array(found["longer"]), pa.array(found["own"]),
            ],
            ["key", "word", "n", "first", "longer", "own"],
        )
    give_back()


def _block_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = sizes = None
    for batch in slices(batches, 65_536):
        new, n = np.unique(_places(batch.column("word").to_pylist())["key"], return_counts=True)
        if keys is not None:
            new, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([sizes, n])).astype(np.int64)
        keys, sizes = new, n
        if len(keys) > COUNTED:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes)], ["key", "size"])
            keys = sizes = None
    if keys is not None:
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes)], ["key", "size"])
    give_back()


def _one_edit(a: str, b: str) -> bool:
    """Whether two words of equal or adjacent lengths differ by exactly one edit."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and a[at + 1 :] == b[at + (len(a) == len(b)) :]


def _verified(
    words: list[str], matrix: np.ndarray | None, size: np.ndarray, u: np.ndarray, v: np.ndarray
) -> np.ndarray:
    """Which pairs differ by exactly one edit; ``u`` is never the shorter one."""
    if matrix is None:
        return np.fromiter((_one_edit(words[i], words[j]) for i, j in zip(u, v)), bool, len(u))
    out = np.zeros(len(u), bool)
    same = size[u] == size[v]
    out[same] = (matrix[u[same]] != matrix[v[same]]).sum(1) == 1
    a, b = matrix[u[~same]], matrix[v[~same]]
    at = (a != b).argmax(1)  # the first difference; the letter of the longer word that goes
    rest = np.arange(matrix.shape[1] - 1)[None, :] >= at[:, None]
    out[~same] = ~((a[:, 1:] != b[:, :-1]) & rest).any(1)
    return out


def _pairs_of(
    words: list[str], group: np.ndarray, part: np.ndarray, crossed: np.ndarray,
    own: np.ndarray, first: np.ndarray, longer: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within each group, by one product of letter counts."""
    letters, owner, size = _spread(words)
    used, letter = np.unique(letters, return_inverse=True)
    counts = np.bincount(owner * len(used) + letter, minlength=len(words) * len(used))
    # Products of counts are whole numbers: exact in float32 below 2 ** 24.
    kind = np.float32 if size.max() < 2000 else np.float64
    counts = counts.reshape(len(words), len(used)).astype(kind)
    norm = np.einsum("ij,ij->i", counts, counts)
    matrix = None
    if size.max() <= SHORT:
        matrix = np.zeros((len(words), int(size.max()) + 1), np.uint8)
        start = np.cumsum(size) - size
        matrix[owner, np.arange(len(letters)) - start[owner]] = letters
    us, vs = [], []
    for low in range(0, len(words), ROWS):
        to = slice(low, min(low + ROWS, len(words)))
        # Groups stand together: only the words of this stretch's groups can be near.
        reach = slice(
            int(np.searchsorted(group, group[low])),
            int(np.searchsorted(group, group[to.stop - 1], "right")),
        )
        gap = norm[to, None] + norm[None, reach] - 2 * (counts[to] @ counts[reach].T)
        u, v = np.nonzero(gap <= 2)
        u, v = u + low, v + reach.start
        both = longer[u] & longer[v]
        # A longer word meets the shorter ones once, another longer one in one order.
        keep = (group[u] == group[v]) & longer[u] & (~longer[v] | (u < v))
        # Words of equal class counts meet in several blocks and count in one.
        keep &= ~both | (own[u] != own[v]) | first[u]
        keep &= ~crossed[u] | (part[u] != part[v])
        u, v = u[keep], v[keep]
        good = _verified(words, matrix, size, u, v)
        us.append(u[good])
        vs.append(v[good])
    return np.concatenate(us), np.concatenate(vs)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the words of each task's blocks, how many near words they have there and the most
    frequent of them. Rows come block by block; small blocks are taken several at a time."""

    def found(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        words = table.column("word").to_pylist()
        n = table.column("n").to_numpy()
        own, first, longer, part, a, b = (
            table.column(c).to_numpy() for c in ("own", "first", "longer", "part", "a", "b")
        )
        u, v = _pairs_of(words, group, part, a != b, own, first, longer)
        u, v = np.concatenate([u, v]), np.concatenate([v, u])
        order = sorted(range(len(words)), key=words.__getitem__)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        by = np.lexsort((place[v], -n[v], u))
        u, v = u[by], v[by]
        starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, int)
        best = v[starts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[i] for i in u[starts]], pa.string()),
                pa.array(np.diff(np.r_[starts, len(u)])),
                pa.array(n[best]),
                pa.array([words[i] for i in best], pa.string()),
            ],
            ["word", "n_near", "best_n", "best"],
        )

    waiting: list[pa.RecordBatch] = []

    def groups(table: pa.Table) -> np.ndarray:
        key, a, b = (table.column(c).to_numpy() for c in ("key", "a", "b"))
        new = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.cumsum(np.r_[0, new])

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < 4 * PART:
            continue
        table = pa.Table.from_batches(waiting)
        group = groups(table)
        whole = int(np.searchsorted(group, group[-1]))  # the last block may go on
        if whole:
            yield found(table.slice(0, whole), group[:whole])
            waiting = table.slice(whole).to_batches()
    if waiting and sum(b.num_rows for b in waiting):
        table = pa.Table.from_batches(waiting)
        yield found(table, groups(table))
    give_back()


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """``word, n_near, best_n, best`` for each of the distinct ``word, n`` that has a word one
    edit away: how many, and the most frequent of them (ties: the smallest)."""
    rows = words.select("word", "n").mapInArrow(
        _block_rows, "key long, word string, n long, first boolean, longer boolean, own long"
    )
    sizes = words.select("word").mapInArrow(_block_sizes, "key long, size long")
    crowded = (
        sizes.groupBy(F.col("key").alias("at"))
        .agg(F.sum("size").alias("size"))
        .where(f"size > {part}")
        .selectExpr("at", f"CAST(ceil(size / {part}) AS INT) AS parts")
    )
    dealt = (
        rows.join(crowded, F.expr("key = at"), "left")
        .selectExpr(
            "key", "word", "n", "first", "longer", "own", "coalesce(parts, 1) AS parts",
            "CAST(pmod(xxhash64(word), coalesce(parts, 1)) AS INT) AS part",
        )
        .selectExpr("*", "explode(sequence(0, parts - 1)) AS other")
        .selectExpr(
            "key", "least(part, other) AS a", "greatest(part, other) AS b", "part", "word", "n",
            "first", "longer", "own",
        )
    )
    found = (
        dealt.repartition("key", "a", "b")
        .sortWithinPartitions("key", "a", "b")
        .mapInArrow(_near, "word string, n_near long, best_n long, best string")
    )
    return (
        found.groupBy("word")
        .agg(
            F.sum("n_near").alias("n_near"),
            F.expr("min(struct(-best_n AS less, best)) AS first"),
        )
        .selectExpr("word", "n_near", "-first.less AS best_n", "first.best AS best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` by jumps of doubling length along ``word, form``. A form is always
    more frequent than its word, so that there are no circles."""
    jumps = kept(forms.selectExpr("word", "form AS root"), "jumps")
    while True:
        on = jumps.selectExpr("word AS next", "root AS after")
        longer = kept(
            jumps.join(on, F.expr("root = next"), "left").selectExpr(
                "word", "coalesce(after, root) AS root", "after IS NOT NULL AS moved"
            ),
            "jumps",
        )
        jumps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return jumps


def spelling_forms(words: DataFrame, ratio: int = 10, part: int = PART) -> DataFrame:
    """Words and the forms they are variants of, from distinct words of Latin letters and
    their counts (columns ``word, n``; others are ignored, rows with a null are left out).

    One row a word: ``word, form, root, n, n_near, form_n``. ``form`` is the most frequent
    word one edit away (ties: the smallest), if it is ``ratio`` times as frequent; ``root``
    is the last word that forms lead to, the word itself if it has none. An empty table
    gives none. Words of any length are compared.
    """
    words = kept(words.selectExpr("word", "n").where("word IS NOT NULL AND n IS NOT NULL"), "words")
    near = near_words(words, part).withColumnRenamed("word", "near_word")
    formed = kept(
        words.join(near, F.expr("word = near_word"), "left").selectExpr(
            "word", "n", "coalesce(n_near, 0L) AS n_near",
            f"if(best_n >= {ratio} * n, best, NULL) AS form",
            f"if(best_n >= {ratio} * n, best_n, NULL) AS form_n",
        ),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL")).withColumnRenamed("word", "led")
    return formed.join(roots, F.expr("word = led"), "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n"
    )


def variants(
    docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10,
    garble: int | None = None, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """:func:`spelling_forms` of the words of ``docs`` that occur ``least_count`` times."""
    counts = word_counts(docs, least_length, garble, id_column, text_column)
    return spelling_forms(counts.where(f"n >= {least_count}"), ratio)
