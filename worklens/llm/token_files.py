"""Token ids in files of byte planes.

A file holds blocks of a fixed number of ids. A block is transposed so that the first
bytes of all its ids stand together, then the second bytes, and so on; each plane is
compressed with zstandard. At the end stand the documents' ids and lengths, an index of
all chunks, and where the index begins, so a reader fetches only the blocks it needs.

    magic | planes of block 0 | planes of block 1 | ... | documents | index | length | magic
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worklens.llm.pieces import Numbering, Ragged, cut, sums
from worklens.llm.tables import kept, new_dir, own_to_worker, slices

MAGIC = b"IDPLANES"
BLOCK_IDS = 1 << 16
BLOCK_DOCS = 1 << 16
END_ID = 0
ROUND_CHARS = 4 << 20
#: Distinct pieces whose ids a worker keeps at most.
KEPT_PIECES = 2_000_000
#: Marks that end a piece; fixed values.
MARKS = ".,!?;:"
#: Pieces given to the library at a time.
BATCH_PIECES = 1000


def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """The planes of a block: its four bytes, or its thirty-two bits, least first."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        bits = np.unpackbits(by_byte, axis=1, bitorder="little")
        return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]
    return [by_byte[:, i].tobytes() for i in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes."""
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if len(rows) == 32:
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        rows = list(np.packbits(bits, axis=1, bitorder="little").T)
    return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes ids document by document; holds one block."""

    def __init__(self, sink, planes: str = "byte", level: int = 3) -> None:
        self.sink, self.planes = sink, planes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = self.ids = 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.doc_ids: list = []
        self.lengths: list[int] = []
        self.blocks: list = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        start = self.at
        sizes = [self._put(self.pack(p)) for p in to_planes(ids, self.planes)]
        self.blocks.append([start, len(ids), sizes])

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths += lengths.tolist()
        self.ids += len(ids)
        self.waiting.append(ids.astype("<u4"))
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            flat = np.concatenate(self.waiting)
            full = len(flat) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, full, BLOCK_IDS):
                self._block(flat[i : i + BLOCK_IDS])
            self.waiting, self.held = [flat[full:]], len(flat) - full

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        docs = []
        for i in range(0, len(self.doc_ids), BLOCK_DOCS):
            own = self.doc_ids[i : i + BLOCK_DOCS]
            known = np.array([x is not None for x in own], np.uint8)
            table = (
                known.tobytes()
                + np.array([x or 0 for x in own], "<i8").tobytes()
                + np.array(self.lengths[i : i + BLOCK_DOCS], "<i8").tobytes()
            )
            docs.append([self.at, len(own), self._put(self.pack(table))])
        index = self.pack(
            json.dumps({"planes": self.planes, "blocks": self.blocks, "docs": docs}).encode()
        )
        self._put(index)
        self._put(struct.pack("<q", len(index)) + MAGIC)


class PlaneReader:
    """Reads a file block by block through its index."""

    def __init__(self, source) -> None:
        self.source = source
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = source.size()
        tail = self._get(size - 16, 16)
        if tail[8:] != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a file of id planes")
        length = struct.unpack("<q", tail[:8])[0]
        self.index = json.loads(self.unpack(self._get(size - 16 - length, length)))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def docs(self) -> tuple[list, np.ndarray]:
        """The documents' ids and numbers of tokens, in the order of the file."""
        ids: list = []
        lengths = [np.empty(0, np.int64)]
        for at, n, size in self.index["docs"]:
            table = self.unpack(self._get(at, size))
            known = np.frombuffer(table, np.uint8, n)
            values = np.frombuffer(table, "<i8", n, n)
            ids += [v if k else None for v, k in zip(values.tolist(), known.tolist())]
            lengths.append(np.frombuffer(table, "<i8", n, 9 * n))
        return ids, np.concatenate(lengths)

    def block(self, number: int) -> np.ndarray:
        at, n, sizes = self.index["blocks"][number]
        raw, planes, done = self._get(at, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.unpack(raw[done : done + size]))
            done += size
        return from_planes(planes, n)

    def blocks(self) -> Iterator[np.ndarray]:
        for number in range(len(self.index["blocks"])):
            yield self.block(number)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only the blocks that hold them are read."""
        stop = min(stop, sum(b[1] for b in self.index["blocks"]))
        first, last = start // BLOCK_IDS, max(start, stop - 1) // BLOCK_IDS
        if start >= stop:
            return np.empty(0, "<u4")
        ids = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return ids[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


class PieceTokenizer:
    """Encodes by the library; each distinct piece of the texts once."""

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_str(vocabulary)
        # The library takes the strings of added tokens out of a text before anything else.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        longest = sorted(filter(None, added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pieces, self.piece_ids = Numbering(), Ragged(np.uint32)

    def _learn(self) -> None:
        """Encodes the pieces that are new. A mark after a letter at a piece's end is a match
        of its own, so such a piece is its stem's ids and the mark's."""
        marked = [
            p for p in self.pieces.new if len(p) > 1 and p[-1] in MARKS and p[-2].isalpha()
        ]
        stems = self.pieces.of(p[:-1] for p in marked)
        marks = self.pieces.of(p[-1] for p in marked)
        composed = set(marked)
        plain = [p for p in self.pieces.take_new() if p not in composed]
        numbers, flat = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for at in range(0, len(plain), BATCH_PIECES):
            some = plain[at : at + BATCH_PIECES]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            numbers.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
            flat.append(np.array(found.ids, np.uint32))
        self.piece_ids.put(self.pieces.of(plain), np.concatenate(numbers), np.concatenate(flat))
        if marked:
            both = np.stack((stems, marks), 1).ravel()
            lengths, ids = self.piece_ids.gather(both)
            self.piece_ids.put(self.pieces.of(marked), lengths.reshape(-1, 2).sum(axis=1), ids)

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text; an added token's string is a piece, and what stands between
        two of them is cut by itself."""
        if self.added is None or not self.added.search(text):
            return cut(text)
        pieces = []
        for place, part in enumerate(self.added.split(text)):
            pieces += [part] if place % 2 else cut(part) if part else []
        return pieces

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids per text, and the ids one after another."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces, self.piece_ids = Numbering(), Ragged(np.uint32)
        rows = [self.pieces.of(self._cut(t)) if t else np.empty(0, np.int64) for t in texts]
        self._learn()
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        lengths, flat = self.piece_ids.gather(np.concatenate([*rows, np.empty(0, np.int64)]))
        return sums(lengths, counts), flat


def with_ends(lengths: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each document."""
    return lengths + 1, np.insert(ids, np.cumsum(lengths), end_id)


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary_path: str | None = None,
    planes: str = "byte",
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encodes every whole text and writes the ids to files ``part-<number>.ids`` in ``path``, in
    ascending order of a whole-number id over all files (null first, equal ids by text).
    Returns a row per file: ``part, file, n_docs, n_ids, start`` (ids in earlier files).

    A null text counts as empty and is its end id only. Each task writes a file of its own
    under a temporary name and then renames it, so an attempt that is repeated replaces
    its file with the same one.
    """
    with open(vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary: bounded
    key = zlib.crc32(vocabulary.encode())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, sink = context.partitionId(), None
        for batch in slices(batches):
            if sink is None:
                files, folder = pyarrow.fs.FileSystem.from_uri(path)
                files.create_dir(folder, recursive=True)
                name = f"part-{part:08d}.ids"
                unfinished = f"{folder}/.{name}.{context.taskAttemptId()}"
                sink = files.open_output_stream(unfinished)
                writer = PlaneWriter(sink, planes)
                encoder = own_to_worker(("tokenizer", key), lambda: PieceTokenizer(shared.value))
            ids = batch.column("id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            begin = size = 0
            for i, text in enumerate(texts, 1):
                size += len(text)
                if size >= ROUND_CHARS or i == len(texts):
                    found = encoder.encode(texts[begin:i])
                    writer.add(ids[begin:i], *with_ends(*found, end_id))
                    begin, size = i, 0
        if sink is None:
            return
        writer.close()
        sink.close()
        files.move(unfinished, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.ids]},
            schema=pa.schema(
                [("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
            ),
        )

    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    written = kept(
        rows.repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(write, "part int, file string, n_docs long, n_ids long"),
        "files",
    )
    # One row per file.
    return written.selectExpr(
        "*", "coalesce(sum(n_ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start"
    )


def read_token_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """From the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens`` with the
    end id, and ``ids_crc32`` of the document's ids as little-endian 32-bit integers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base in zip(batch["file"], batch["start"]):
                source, folder = pyarrow.fs.FileSystem.from_uri(path)
                with source.open_input_file(f"{folder}/{name}") as file:
                    reader = PlaneReader(file)
                    ids, lengths = reader.docs()
                    crcs = np.zeros(len(ids), np.int64)
                    left, doc, crc = (int(lengths[0]) if len(ids) else 0), 0, 0
                    for block in reader.blocks():
                        raw, at = memoryview(block.tobytes()), 0
                        while at < len(block):
                            n = min(left, len(block) - at)
                            crc = zlib.crc32(raw[4 * at : 4 * (at + n)], crc)
                            at, left = at + n, left - n
                            if not left:
                                crcs[doc], crc, doc = crc, 0, doc + 1
                                left = int(lengths[doc]) if doc < len(ids) else 0
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(ids, "Int64"),
                        "start": base + np.cumsum(lengths) - lengths,
                        "n_tokens": lengths,
                        "ids_crc32": crcs,
                    }
                )

    spread = files.select("file", "start").repartition(max(files.count(), 1))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, **options) -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and reads them back."""
    path = new_dir(docs.sparkSession, "ids")
    files = kept(write_token_files(docs, path, **options), "manifest")
    return read_token_files(docs.sparkSession, path, files)
