import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.common import SCHEMA, odd_rows
from tests.llm.test_bpe import texts
from worklens.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 9, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    made = token_files.to_planes(ids, planes)
    assert len(made) == {"byte": 4, "bit": 32}[planes]
    assert (token_files.from_planes(made, n) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_file_round_trip(planes, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 3)
    random.seed(9)
    lengths = [random.choice([1, 5, 63, 64, 65, 300]) for _ in range(20)]
    ids = np.random.default_rng(0).integers(0, 60000, sum(lengths)).astype("<u4")
    sink = Source()
    writer = token_files.PlaneWriter(sink, planes)
    names = [None, *range(10, 29)]
    at = 0
    for name, n in zip(names, lengths):
        writer.add([name], np.array([n]), ids[at : at + n])
        at += n
    writer.close()
    reader = token_files.PlaneReader(sink)
    got_names, got_lengths = reader.docs()
    assert got_names == names and got_lengths.tolist() == lengths
    assert (np.concatenate(list(reader.blocks())) == ids).all()
    for start, stop in ((0, 1), (60, 70), (63, 64), (64, 128), (500, 10**6), (5, 5)):
        assert (reader.read(start, stop) == ids[start:stop]).all()


def test_not_a_file():
    with pytest.raises(ValueError):
        token_files.PlaneReader(Source(b"x" * 40))


def test_pieces_as_whole_texts(library):
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.PieceTokenizer(f.read())
    made = texts()
    lengths, ids = encoder.encode(made)
    want = [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
    for text, got, ids_ in zip(made, np.split(ids, np.cumsum(lengths)[:-1]), want):
        assert got.tolist() == ids_, text[:60]


END = "<|endoftext|>"
WITH_ADDED = [
    f"a {END} b", END, f"{END}{END}", f"{END} at the start", f"at the end{END}", f" {END}\n{END} ",
    f"two  spaces {END}  and\n\n{END}more", f"it's{END}'s", "<|endoftext", f"<|endof{END}text|>",
    f"é{END}\u00a0{END}\t{END}3", f"long {'word ' * 300}{END}{' word' * 300}",
]


def test_added_tokens_in_texts(library):
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.PieceTokenizer(f.read())
    for texts_ in (WITH_ADDED, [*WITH_ADDED[::-1], *texts()]):
        lengths, ids = encoder.encode(texts_)
        want = [e.ids for e in library.encode_batch(texts_, add_special_tokens=False)]
        for text, got, ids_ in zip(texts_, np.split(ids, np.cumsum(lengths)[:-1]), want):
            assert got.tolist() == ids_, text[:60]
    assert library.encode(END, add_special_tokens=False).ids == [50256]


def test_tables(spark, library):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(50 + i, text, "en", "s", 1) for i, text in enumerate(WITH_ADDED)]
    rows += [(100 + i, f"text {i} " * (i % 9), "en", "s", 1) for i in range(400)]
    random.seed(10)
    shuffled = random.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, SCHEMA).repartition(7)
    found = token_files.written_and_read(docs).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in found) == want
