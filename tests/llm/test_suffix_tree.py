import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tests.llm.common import SCHEMA, crc, odd_rows, odd_table
from worklens.llm import lm_suffix_tree as lm


def brute(rows, settings, hot_share=None):
    """The tree by counting n-grams of whole texts in dictionaries."""
    texts = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    held = [crc(i) % 7 == 2 for i, *_ in rows]
    grams = [Counter() for _ in range(3)]
    for words, out in zip(texts, held):
        for n in range(3):
            if not out:
                grams[n].update(tuple(words[i : i + n + 1]) for i in range(len(words) - n))
    total, distinct = sum(grams[0].values()), len(grams[0])

    def own(w):
        return (grams[0][(w,)] + 1) / (total + distinct + 1)

    def smoothed(context, w, shorter):
        n = grams[len(context) - 1][context]
        return (grams[len(context)][(*context, w)] + settings.smooth * shorter) / (n + settings.smooth)

    retained = set()

    def probability(context, w):
        p = own(w)
        for n in range(1, len(context) + 1):
            if context[-n:] in retained:
                p = smoothed(context[-n:], w, p)
        return p

    for n in (1, 2):
        found = set()
        following = {}
        for gram, times in grams[n].items():
            following.setdefault(gram[:-1], []).append((gram[-1], times))
        for context, nexts in following.items():
            occurs = grams[n - 1][context]
            if occurs < settings.least:
                continue
            gain = 0.0
            for w, times in nexts:
                shorter = probability(context[1:], w)
                left = (times - 1 + settings.smooth * shorter) / (occurs - 1 + settings.smooth)
                gain += times * math.log(left / shorter)
            if gain / occurs >= settings.gain:
                found.add(context)
        retained |= found
    scores = []
    for (doc_id, *_), words, out in zip(rows, texts, held):
        base = sum(math.log10(own(w)) for w in words)
        score = sum(
            math.log10(probability(tuple(words[max(i - 2, 0) : i]), w)) for i, w in enumerate(words)
        )
        known = sum(grams[0][(w,)] > 0 for w in words)
        scores.append((doc_id, out, len(words), known, total, base, score))
    return scores, retained


def corpus():
    random.seed(12)
    words = [f"w{i}" for i in range(40)]
    rows = odd_rows()
    for i in range(200):
        text = []
        while len(text) < 60:
            if random.random() < 0.3:
                text += ["New", "York", "City"]
            text.append(random.choice(words))
        rows.append((100 + i, " ".join(text), "en", "s", 1))
    return rows


@pytest.mark.parametrize("hot", [lm.HOT_SHARE, 1 << 40])
@pytest.mark.parametrize("chunk", [lm.CHUNK_TOKENS, 500])
def test_against_brute_force(spark, monkeypatch, hot, chunk):
    """Also over many chunks, and with every context spread over the buckets."""
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    settings = lm.SuffixTree(least=10)
    rows = corpus()
    want, retained = brute(rows, settings)
    assert any(len(c) == 1 for c in retained) and any(len(c) == 2 for c in retained)
    got = lm.suffix_tree_scores(odd_table(spark, rows), settings).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    for one, two in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert one[:5] == two[:5]
        assert one[5] == pytest.approx(two[5], rel=1e-9)
        assert one[6] == pytest.approx(two[6], rel=1e-6)


def test_no_training_texts(spark):
    held = next(i for i in range(99) if crc(i) % 7 == 2)
    rows = lm.suffix_tree_scores(spark.createDataFrame([(held, "a b", "en", "s", 3)], SCHEMA)).collect()
    assert [tuple(r) for r in rows] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_an_absolute_count_decides_at_every_size():
    """Contexts of 32 occurrences are tested, however many words there are."""
    rows = {
        "id": pa.array([[1]]),
        "held": pa.array([[False]]),
        "n": pa.array([[4]], pa.list_(pa.int32())),
        "tokens": pa.array([[1, 2, 1, 0]], pa.list_(pa.int32())),
        "words": pa.array([[3, 1 << 40, 5 << 50]], pa.list_(pa.uint64())),
    }
    model = {"tokens": 5e9, "distinct": 1e7, "buckets_log": 5, "hot": np.empty(0, np.uint64)}
    answer = lm.pack({"total": np.array([1000, 32, 31]), "wanted": np.zeros(3, np.uint8)})
    answers = pd.DataFrame({"level": [1], "chunk": [0], "bucket": [0], "data": [answer]})
    made = lm.Counted(0, lm.Chunk(pa.table(rows)), answers, model, lm.SuffixTree()).level(2)
    assert {1, 2} - set(made["context"].tolist()) == {2}  # 31 times
    assert 1 in made["context"]  # 32 times


@pytest.mark.parametrize("chunk", [lm.CHUNK_TOKENS, 500, 70])
def test_held_out_copies_of_words_that_occur_once_in_training(spark, monkeypatch, chunk):
    """Wherever the training text with the word falls, in the same chunk or another."""
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    random.seed(13)
    rows = corpus()
    held = [i for i in range(1000, 2000) if crc(i) % 7 == 2][:25]
    learnt = [i for i in range(1000, 2000) if crc(i) % 7 != 2][:25]
    for n, (one, two) in enumerate(zip(held, learnt)):
        text = f"w1 New York rare{n} w2 w3 New rare{n}b York City rare{n} New York City w{n} rare{n}c"
        rows += [(two, text, "en", "s", 1), (one, text + f" York rare{n}c City rare{n}b", "en", "s", 1)]
        rows.append((held[n] + 10**6, f"New York rare{n}", "en", "s", 1))
    random.shuffle(rows)
    settings = lm.SuffixTree(least=10)
    want, _ = brute(rows, settings)
    got = lm.suffix_tree_scores(odd_table(spark, rows), settings).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    for one, two in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert one[:5] == two[:5]
        assert one[6] == pytest.approx(two[6], rel=1e-6)


def test_requests_take_less_room_than_hashes_of_words():
    """An n-gram takes fewer bytes than its word's hash alone, contexts included."""
    rng = np.random.default_rng(7)
    words = 20_000
    tokens = np.minimum(rng.zipf(1.15, 300_000), words).astype(np.int32) - 1
    total = np.bincount(tokens, minlength=words) * 50 + rng.integers(0, 50, words)
    rows = {
        "id": pa.array([[1]]),
        "held": pa.array([[False]]),
        "n": pa.array([[len(tokens)]], pa.list_(pa.int32())),
        "tokens": pa.array([tokens], pa.list_(pa.int32())),
        "words": pa.array([np.sort(rng.integers(0, 1 << 63, words, np.uint64))], pa.list_(pa.uint64())),
    }
    model = {
        "tokens": float(total.sum()), "distinct": float(words), "buckets_log": 5,
        "hot": np.empty(0, np.uint64),
    }
    order = np.argsort(total, kind="stable")
    place = np.empty(words, np.int64)
    place[order] = np.arange(words) - np.searchsorted(total[order], total[order])
    answer = {"total": total, "wanted": np.zeros(words, np.uint8), "place": place * 32}
    answers = pd.DataFrame({"level": [1], "chunk": [0], "bucket": [0], "data": [lm.pack(answer)]})
    made = lm.Counted(0, lm.Chunk(pa.table(rows)), answers, model, lm.SuffixTree())
    asked = made.requests(2)
    size, count = asked["data"].map(len).sum(), sum(len(lm.unpack(x)["count"]) for x in asked["data"])
    assert count > 50_000
    assert size < 5 * count
