"""Byte-level BPE by recursive queries, one database per task.

The texts of a partition are cut into pieces and these into matches of the pattern.
Each distinct match becomes rows of token and position, which a recursive query joins
with the merge table, contracting the leftmost pair of least rank of every word in each
round, until no pair of any word can merge. An ordered aggregation over rows of id and
position decodes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.pieces import Numbering, Ragged, cut, sums
from worklens.llm.tables import give_back, own_to_worker, slices

#: Bytes of a word from which it is contracted on its own, in bounded memory.
LONG_WORD = 256
#: Bytes of words per recursive query, bytes of text per round, tokens per decoding query.
QUERY_BYTES, ROUND_BYTES, DECODE_TOKENS = 1 << 18, 1 << 20, 1 << 18
#: Distinct pieces and matches kept at most before their memory is begun anew.
KEPT_PIECES, KEPT_MATCHES = 1 << 18, 1 << 20

CONTRACT = """
WITH RECURSIVE t(step, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM start
  UNION ALL
  SELECT step + 1, t.w, pos - (pos > bp)::INT, CASE WHEN pos = bp THEN br ELSE tok END
  FROM t JOIN (
    SELECT w, (min(k) & 1048575)::INT AS bp, (min(k) >> 20)::INT AS br
    FROM (
      SELECT l.w, r << 20 | l.pos AS k
      FROM t l JOIN t n ON n.w = l.w AND n.pos = l.pos + 1 JOIN merges ON l.tok = a AND n.tok = b
    ) GROUP BY w
  ) USING (w)
  WHERE pos <> bp + 1
)
SELECT w, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step)
ORDER BY w, pos
"""

#: One round over a single long word: all pairs of least rank at once, from the left,
#: as taking them one by one would, unless a pair with lower rank arises meanwhile.
ROUND = """
WITH p AS (
  SELECT pos, tok, lead(tok) OVER o AS nxt, lag(tok) OVER o AS before,
         lead(tok, 2) OVER o AS after
  FROM word WINDOW o AS (ORDER BY pos)
), m AS (
  SELECT p.*, r FROM p LEFT JOIN merges ON tok = a AND nxt = b
), q AS (
  SELECT *, min(r) OVER () AS least, r IS NOT DISTINCT FROM min(r) OVER () AS hit FROM m
), h AS (
  -- Hits next to each other overlap; of a run, every second one from the first counts.
  SELECT *, hit AND (row_number() OVER (PARTITION BY hit, pos_rank - hit_rank ORDER BY pos)) % 2 = 1
            AS taken
  FROM (SELECT *, row_number() OVER (ORDER BY pos) AS pos_rank,
               row_number() OVER (PARTITION BY hit ORDER BY pos) AS hit_rank FROM q)
), s AS (
  SELECT *, lag(taken) OVER o AS gone, lag(taken, 2) OVER o AS joined_before
  FROM h WINDOW o AS (ORDER BY pos)
)
SELECT pos, CASE WHEN taken THEN least ELSE tok END AS tok, least, taken, after,
       CASE WHEN joined_before THEN least ELSE before END AS left_tok
FROM s WHERE gone IS NOT TRUE
"""

DECODE = """
SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex
FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 of the token, a space, its rank."""
    pairs = (line.split() for line in lines.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Codec:
    """Encodes and decodes in a database of this task's own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        # White space by the Unicode property, as the pattern's own engine has it.
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaces)
        merges = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        pairs = pa.table(
            [pa.array(x, t) for x, t in zip(zip(*merges), (pa.int32(), pa.int32(), pa.int64()))]
            if merges
            else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64())],
            names=["a", "b", "r"],
        )
        words = pa.table(
            {
                "id": pa.array(list(ranks.values()), pa.int32()),
                "hex": pa.array([t.hex() for t in ranks]),
            }
        )
        for name, rows in (("merges", pairs), ("vocabulary", words)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pieces, self.piece_ids = Numbering(), Ragged()
        self.matches, self.match_ids = Numbering(), Ragged()

    def _bound(self) -> None:
        """Begins a memory anew that has become large."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces, self.piece_ids = Numbering(), Ragged()
        if len(self.matches) > KEPT_MATCHES:
            self.matches, self.match_ids = Numbering(), Ragged()

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids per word, and the ids, by one recursive query."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        total = int(lengths.sum())
        start = pa.table(
            {
                "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
                "pos": (np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(
                    np.int32
                ),
                "tok": self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)],
            }
        )
        self.db.register("start", start)
        found = self.db.execute(CONTRACT).fetchnumpy()
        self.db.unregister("start")
        return np.bincount(found["w"], minlength=len(words)).astype(np.int64), found["tok"]

    def _contract_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word, its rows replaced in each round."""
        tokens = self.byte[np.frombuffer(word, dtype=np.uint8)]
        while True:
            self.db.register("word", pa.table({"pos": np.arange(len(tokens)), "tok": tokens}))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE step AS {ROUND}")
            least, lower = self.db.execute(
                "SELECT any_value(least), count(*) FILTER (WHERE taken AND (l.r < least OR n.r < least))"
                " FROM step LEFT JOIN merges l ON l.a = left_tok AND l.b = least"
                " LEFT JOIN merges n ON n.a = least AND n.b = after"
            ).fetchall()[0]
            if least is None:
                return tokens
            if lower:  # one pair only: the leftmost
                pair = self.db.execute(
                    "SELECT min(pos) FROM step WHERE taken"
                ).fetchall()[0][0]
                tokens = np.concatenate((tokens[:pair], [least], tokens[pair + 2 :])).astype(np.int32)
            else:
                tokens = self.db.execute("SELECT tok FROM step ORDER BY pos").fetchnumpy()["tok"]
                tokens = tokens.astype(np.int32)

    def _learn(self) -> None:
        """Encodes the pieces that are new: their new matches first."""
        pieces = self.pieces.take_new()
        found = [self.pattern.findall(piece) for piece in pieces]
        rows = self.matches.of(match for of_piece in found for match in of_piece)
        words = [match.encode() for match in self.matches.take_new()]
        at = 0
        while at < len(words):
            if len(words[at]) >= LONG_WORD:
                ids = self._contract_long(words[at])
                self.match_ids.append(np.array([len(ids)]), ids)
                at += 1
                continue
            end, size = at, 0
            while end < len(words) and len(words[end]) < LONG_WORD and size < QUERY_BYTES:
                size += len(words[end])
                end += 1
            self.match_ids.append(*self._contract(words[at:end]))
            at = end
        counts = np.fromiter(map(len, found), np.int64, len(found))
        lengths, flat = self.match_ids.gather(rows)
        self.piece_ids.append(sums(lengths, counts), flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids per text, and the ids one after another."""
        self._bound()
        rows = [self.pieces.of(cut(text)) if text else np.empty(0, np.int64) for text in texts]
        self._learn()
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        lengths, flat = self.piece_ids.gather(np.concatenate([*rows, np.empty(0, np.int64)]))
        return sums(lengths, counts), flat

    def decode(self, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids."""
        out: list[bytes] = [b""] * len(lengths)
        upto, at = np.cumsum(lengths), 0
        while at < len(lengths):
            done = upto[at - 1] if at else 0
            end = max(int(np.searchsorted(upto, done + DECODE_TOKENS, "right")), at + 1)
            some = ids[done : upto[end - 1]]
            self.db.register(
                "tokens",
                pa.table(
                    {
                        "doc": np.repeat(np.arange(at, end), lengths[at:end]),
                        "pos": np.arange(len(some)),
                        "id": some,
                    }
                ),
            )
            found = self.db.execute(DECODE).fetchnumpy()
            for doc, text in zip(found["doc"].tolist(), found["hex"]):
                out[doc] = bytes.fromhex(text)
            at = end
        return out


def _rounds(texts: list[str]) -> Iterator[slice]:
    """Stretches of texts of bounded size."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > ROUND_BYTES:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def _encoded(
    docs: DataFrame, ranks: bytes, pattern: str, id_column: str, text_column: str,
    columns: tuple[str, ...], keep_words: bool,
) -> DataFrame:
    types = {
        "n_tokens": ("long", pa.int64()),
        "ids": ("array<int>", pa.list_(pa.int32())),
        "ids_sha256": ("string", pa.string()),
        "decoded": ("binary", pa.binary()),
        "decoded_sha256": ("string", pa.string()),
    }
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary: bounded
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        give_back()
        for batch in slices(batches, 2048):
            if codec is None:
                make = lambda: Codec(parse_ranks(shared.value), pattern)
                codec = own_to_worker(("bpe", key), make) if keep_words else make()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in _rounds(texts):
                lengths, ids = codec.encode(texts[part])
                ends = np.cumsum(lengths)
                made: dict[str, list] = {"n_tokens": lengths}
                if "ids" in columns:
                    made["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32())
                    )
                if "ids_sha256" in columns:
                    raw = ids.astype("<u4").tobytes()
                    made["ids_sha256"] = [
                        hashlib.sha256(raw[4 * (e - n) : 4 * e]).hexdigest()
                        for e, n in zip(ends.tolist(), lengths.tolist())
                    ]
                if {"decoded", "decoded_sha256"} & {*columns}:
                    made["decoded"] = codec.decode(lengths, ids)
                    made["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in made["decoded"]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[part.start : part.stop]]
                    + [
                        made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], types[c][1])
                        for c in columns
                    ],
                    names=["id", *columns],
                )
        if codec and not keep_words:
            codec.db.close()
        del codec
        give_back()

    source = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()
    fields = ", ".join([f"id {kind}", *(f"{c} {types[c][0]}" for c in columns)])
    return source.mapInArrow(run, fields).withColumnRenamed("id", id_column)


def encode(
    docs: DataFrame,
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    id_column: str = "doc_id",
    text_column: str = "text",
    columns: tuple[str, ...] = ("n_tokens", "ids"),
    keep_words: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its id and, of its whole text, the ``columns`` asked for
    out of ``n_tokens, ids, ids_sha256, decoded, decoded_sha256``.

    Digests are of the ids as little-endian unsigned 32-bit integers, and of the bytes
    that the ids decode to. A null or empty text has no ids. Nothing is shuffled. With
    ``keep_words`` a worker keeps the words of its tasks for the next one, which saves time
    where memory is not needed for other stages.
    """
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return _encoded(docs, ranks, pattern, id_column, text_column, columns, keep_words)
