"""Repeated passages against a table of all strings of the length."""

import random

import numpy as np
import pytest

from tests.llm.common import odd_rows, odd_table
from worklens.llm import suffix_levels
from worklens.llm.suffix_levels import LAST


def plain(rows, length=50):
    """Per row: its id, its bytes, the removed stretches, and what is left."""
    least = {}
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for at in range(len(b) - length + 1):
            s = b[at : at + length]
            least[s] = min(least.get(s, LAST), i)
    out = []
    for i, b in texts:
        mask = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if least[b[at : at + length]] < i:
                mask[at : at + length] = b"\x01" * length
        spans, at = [], 0
        while at < len(b):
            if mask[at]:
                end = at
                while end < len(b) and mask[end]:
                    end += 1
                spans.append((at, end))
                at = end
            else:
                at += 1
        left = bytes(x for x, m in zip(b, mask) if not m)
        out.append((None if i == LAST else i, len(b), tuple(spans), left))
    return sorted(out, key=str)


def found(df):
    return sorted(
        ((r[0], r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in df.collect()), key=str
    )


def made(seed, n=160, words=60):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdeéf ", k=random.randint(2, 9))) for _ in range(200)]
    def prose(k):
        return " ".join(random.choices(vocabulary, k=k))

    shared = [prose(30) for _ in range(6)] + ["-" * 400, "ab" * 90, prose(8)]
    rows = []
    for i in range(n):
        parts = [prose(random.randint(0, words))]
        for _ in range(random.randint(0, 3)):
            passage = random.choice(shared)
            cut = random.randint(0, len(passage) // 2)
            parts += [passage[cut : cut + random.randint(20, 300)], prose(random.randint(0, 20))]
        rows.append((i, "".join(parts), "en", "s", 1))
    for i in range(0, n, 9):  # copies, some with one letter changed
        text = rows[random.randrange(n)][1]
        at = random.randint(0, max(0, len(text) - 1))
        rows[i] = (i, text if i % 2 else text[:at] + "#" + text[at + 1 :], "en", "s", 1)
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches, crowd", [(1, 20_000), (4, 20_000), (7, 3)])
def test_all_strings(spark, monkeypatch, batches, crowd):
    monkeypatch.setattr(suffix_levels, "CHUNK", 6000)
    monkeypatch.setattr(suffix_levels, "CHUNKS_PER_BUCKET", 2)
    rows = made(1)
    docs = odd_table(spark, rows).repartition(3)
    got = found(suffix_levels.without_repeats(docs, batches=batches, crowd=crowd))
    want = plain(rows)
    assert got == want and sum(len(r[2]) for r in want) > 100


@pytest.mark.parametrize("length", [16, 33, 80])
def test_lengths(spark, length):
    rows = made(2, 60)
    got = found(suffix_levels.without_repeats(odd_table(spark, rows), length))
    assert got == plain(rows, length)


def test_odd_rows(spark):
    rows = odd_rows() + [
        (11, "x" * 49, "en", "s", 1), (12, "x" * 50, "en", "s", 1), (13, "ß" * 60, "en", "s", 1),
        (14, "\x00" * 80 + "ß" * 25, "en", "s", 1), (15, "\x00" * 51, "en", "s", 1),
        (-3, "x" * 60, "en", "s", 1), (12, "ß" * 25 + "\x00" * 60, "en", "s", 1),
    ]
    assert found(suffix_levels.without_repeats(odd_table(spark, rows))) == plain(rows)
    assert found(suffix_levels.without_repeats(odd_table(spark, []))) == []


def test_levels_double():
    family = suffix_levels.IndexFamily(suffix_levels.Rule())
    sizes = []
    for _ in range(6):
        family.add(suffix_levels._joined([], family.rule))
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]


def test_suffixes_are_sorted():
    rule = suffix_levels.Rule()
    random.seed(4)
    text = "".join(random.choices("ab", weights=[9, 1], k=20_000)).encode()
    chunk = suffix_levels.Chunk(
        suffix_levels.pack(
            {"id": np.array([1]), "size": np.array([len(text)]), "text": np.frombuffer(text, np.uint8)}
        ),
        rule,
    )
    hashes = np.unique(chunk.anchors().hash >> suffix_levels.SPARED)
    own = chunk.suffixes(np.ones(len(hashes), np.uint8)).sent
    own = own[own.order(rule)]
    after = [(h, bytes(b[o : o + 50])) for h, b, o in zip(own.hash, own.bytes, own.offset)]
    assert after == sorted(after) and len({a[1][:24] for a in after}) < len(after)
    # Every passage has its anchor: together they hold each place once.
    assert sum(chunk.anchors().passages) == len(text) - 49


def test_query(spark):
    from worklens.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = [
        (i, n, sum(e - s for s, e in spans), len(spans)) for i, n, spans, _ in plain(docs.collect())
    ]
    got = queries.op13_suffix_levels(spark, "/root/testdata/sf0.001")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans")
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == want
