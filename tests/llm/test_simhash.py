import random

import numpy as np
import xxhash

from tests.llm.common import SCHEMA, WORD, odd_rows, odd_table, roots
from worklens.llm import simhash
from worklens.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, budget=3):
    return [
        (i, j)
        for i in range(len(values))
        for j in range(i)
        if (values[i] ^ values[j]).bit_count() <= budget
    ]


def test_fingerprint():
    for _, text, *_ in odd_rows():
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


def clustered(random_, n):
    values = []
    for _ in range(n):
        base = random_.choice(values) if values and random_.random() < 0.6 else random_.getrandbits(64)
        for _ in range(random_.randint(0, 5)):
            base ^= 1 << random_.randrange(64)
        values.append(base)
    return sorted(set(values))


def test_trie_links():
    random_ = random.Random(1)
    for n in (1, 2, 30, 700):
        values = clustered(random_, n)
        root, member = simhash.trie_links(
            np.array(values, np.uint64), np.array([[0, len(values), 0, len(values), 0, 0]])
        )
        assert roots(len(values), zip(root.tolist(), member.tolist())) == roots(
            len(values), linked(values)
        )


def test_subtrees_split(spark, monkeypatch):
    """With a hot block, and subtrees split into pairs: the same components."""
    random_ = random.Random(2)
    values = clustered(random_, 300)
    hot = [(0xABCD << 48) | random_.getrandbits(20) for _ in range(300)]
    values = sorted({*values, *hot})
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", 25)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "f long")).collect()
    place = {v[0]: i for i, v in enumerate(signed)}
    got = roots(len(values), [(place[r.a], place[r.b]) for r in links])
    assert got == roots(len(values), linked(values))


def test_odd_rows(spark):
    rows = odd_rows()
    prints = [plain_fingerprint(r[1]) for r in rows]
    distinct = sorted(set(prints))
    root = dict(zip(distinct, roots(len(distinct), linked(distinct))))
    ids = {}
    for r, f in zip(rows, prints):
        if r[0] is not None:
            ids.setdefault(root[f], []).append(r[0])
    want = sorted(
        (str(r[0]), f"{f:016x}", min(ids[root[f]]) if root[f] in ids else None)
        for r, f in zip(rows, prints)
    )
    found = simhash.near_duplicates(odd_table(spark)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == want


def test_one_of_each_stays(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(i, text + " end" * (i % 2), "en", "s", 1) for i in (5, 3, 4)] + [(9, "other words", "en", "s", 1)]
    assert (plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[2][1])).bit_count() <= 3
    stay = simhash.keep_one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in stay.collect()) == [3, 9]


def test_components(spark):
    random_ = random.Random(4)
    for n, m in ((40, 25), (60, 60)):
        links = [(random_.randrange(n), random_.randrange(n)) for _ in range(m)]
        chain = [(n + i, n + i + 1) for i in range(50)] + [(n + 100, n + 100 + i) for i in range(40)]
        links += chain
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = roots(n + 200, links)
        touched = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: want[x] for x in touched}
