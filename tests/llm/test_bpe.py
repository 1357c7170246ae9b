import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.common import odd_rows, odd_table
from worklens.llm import bpe, pieces

RANKS = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
ALPHABET = [
    "a", "b", "the", "é", "\n", " ", "  ", "!", "\t", "1", "\r\n", "'s", "'ll", "ſ", "　", "\xa0", "漢",
    "🙂", "<|endoftext|>", "\x85", "\x1c", "\0", " ",
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN)


def texts():
    random.seed(1)
    made = ["".join(random.choices(ALPHABET, k=random.randint(0, 60))) for _ in range(800)]
    made += ["", "a" * 3000, "ab" * 1000, "aab" * 700, "!?" * 600, " " * 700, "é" * 500, "\n" * 500 + "x"]
    made += ["".join(random.choices("thein", k=2000)), "".join(random.choices("01", k=900))]
    return made


def test_against_library(codec):
    made = texts()
    lengths, ids = codec.encode(made)
    for text, part in zip(made, np.split(ids, np.cumsum(lengths)[:-1])):
        assert part.tolist() == LIBRARY.encode_ordinary(text), text[:60]
    assert codec.decode(lengths, ids) == [t.encode() for t in made]


def test_memory_begun_anew(codec, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    monkeypatch.setattr(bpe, "KEPT_MATCHES", 10)
    for text in texts()[:50]:
        assert codec.encode([text])[1].tolist() == LIBRARY.encode_ordinary(text)


def test_pieces_join_to_the_text():
    for text in texts():
        assert "".join(pieces.cut(text)) == text


def test_table(spark):
    found = bpe.encode(
        odd_table(spark), columns=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    ).collect()
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = LIBRARY.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append(
            (
                str(doc_id), len(ids), ids, hashlib.sha256(raw).hexdigest(), (text or "").encode(),
                hashlib.sha256((text or "").encode()).hexdigest(),
            )
        )
    got = [(str(r[0]), r[1], list(r[2]), r[3], bytes(r[4]), r[5]) for r in found]
    assert sorted(got) == sorted(want)


def test_queries_hold_little(monkeypatch):
    """Workers share an executor's memory with its JVM, so a query has few words at a time."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        codec = bpe.Codec(bpe.parse_ranks(file.read()), public_tokenizers.PATTERN)
    sizes, contract = [], codec._contract
    monkeypatch.setattr(codec, "_contract", lambda w: sizes.append(sum(map(len, w))) or contract(w))
    text = " ".join(f"w{i}x" for i in range(100_000))
    assert b"".join(codec.decode(*codec.encode([text]))) == text.encode()
    assert sum(sizes) > 400_000 and max(sizes) <= 300_000
