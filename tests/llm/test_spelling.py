"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tests.llm.common import odd_rows, odd_table
from worklens.llm import spelling


def plain_counts(rows, least, garble):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if garble and h % garble == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, ratio):
    form, near = {}, {}
    lengths = {}
    for w in counts:
        lengths.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        around = [
            v for size in (len(w) - 1, len(w), len(w) + 1) for v in lengths.get(size, [])
            if one_edit(w, v)
        ]
        near[w] = len(around)
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return out


def words_of(spark, counts):
    return spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, key int")


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def made(seed, letters, many, longest=9):
    random.seed(seed)
    counts = Counter()
    for _ in range(many):
        word = "".join(random.choices(letters, k=random.randint(7, longest)))
        counts[word] += random.choice([1, 2, 5, 60, 700, 8000])
    return counts


def test_all_pairs(spark):
    counts = made(1, "abcé", 600) + made(2, "abcdefghijklmnopqrstuvwxyzéß÷", 800)
    counts += Counter({"x" * 300: 5, "x" * 301: 900, "x" * 299 + "y": 7, "y" * 2000: 3})
    assert found(spelling.spelling_forms(words_of(spark, counts))) == plain_forms(counts, 10)


def test_crowded_blocks_are_cut(spark):
    counts = made(3, "aiqy", 700, 8)  # letters of one class: few blocks hold all words
    want = plain_forms(counts, 10)
    assert found(spelling.spelling_forms(words_of(spark, counts), part=40)) == want
    assert found(spelling.spelling_forms(words_of(spark, counts), part=100_000)) == want


def test_chain_of_forms(spark):
    counts = {"aaaaaaaa": 2, "aaaaaaab": 30, "aaaaaabb": 400, "aaaaabbb": 5000, "aaaabbbb": 60_000}
    got = {r.word: r.root for r in spelling.spelling_forms(words_of(spark, counts)).collect()}
    assert set(got.values()) == {"aaaabbbb"}


def test_odd_documents(spark):
    rows = odd_rows() + [(20, "Straße STRASSENBAHN straSSenbahn ÉCOLIERS écoliers abcdefg×hijk", "de", "s", 1)]
    for garble in (None, 3):
        got = found(spelling.variants(odd_table(spark, rows), least_count=1, garble=garble))
        assert got == plain_forms(plain_counts(rows, 7, garble), 10)
    assert spelling.variants(odd_table(spark, [])).count() == 0


def test_query(spark):
    from worklens.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    counts = {w: n for w, n in plain_counts(rows, 7, 31).items() if n >= 2}
    assert found(queries.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == plain_forms(counts, 10)
