"""Repeated passages by a logarithmic family of suffix arrays.

A passage of ``length`` bytes that an earlier document holds too is removed from the later
one. Suffixes start at anchors: the places whose next 24 bytes hash lowest among those of a
passage. Equal passages have their anchor at the same place, so a match of ``length`` bytes
always shows as two suffixes with the same first bytes, and one place in about 14 is enough.

Suffixes are dealt into buckets by the hash of the anchor, and the documents come in batches
of rising ids. In each bucket a batch gets a suffix array: its suffixes with the bytes before
them, sorted, equal ones once with their earliest document. It is scanned side by side with
every level of the index; where suffixes agree their passages are compared byte by byte, and
the earliest document of each passage goes back to the chunk that sent it. The batch then
becomes a level; levels of equal size are merged, so that there are never more than a
logarithm of the batches.

Anchors that one document alone has can't match: a first exchange of hashes finds the others
(``shared_anchors``), and only those are indexed. An anchor that very many passages share has
its passages dealt by their own hash, so that no task holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
import pyarrow as pa
from pyspark.sql import DataFrame

from worklens.llm.packing import pack, unpack
from worklens.llm.tables import give_back, kept

#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK = 2**20
#: Chunks whose anchors make one bucket, on average.
CHUNKS_PER_BUCKET = 16
#: Batches of a whole table.
BATCHES = 4
#: Chunks of one task, on average.
CHUNKS_PER_TASK = 6
#: Bits of an anchor's hash that the first exchange leaves out: it may take an anchor for
#: shared that isn't, which costs work but changes nothing.
SPARED = np.uint64(16)
#: Suffixes of one anchor beyond which its passages are dealt one by one.
CROWD = 20_000
#: The id that stands for a null one: after all others.
LAST = 2**63 - 1


@dataclass(frozen=True)
class Rule:
    """What is a repeat: ``length`` bytes; anchors are hashes of ``seed`` of them."""

    length: int = 50
    crowd: int = CROWD

    @property
    def seed(self) -> int:
        if self.length < 16:
            raise ValueError("passages have 16 bytes or more")
        return 8 * min(3, self.length // 16)

    @property
    def reach(self) -> int:
        """Places among which a passage's anchor is chosen."""
        return self.length - self.seed + 1

    @property
    def width(self) -> int:
        """Most bytes of a suffix with what stands before it."""
        return self.length + self.reach - 1

    @property
    def row(self) -> int:
        """Bytes of a row that holds a suffix: zeros follow, so that words can be read past it."""
        return -(-(self.width + 7) // 8) * 8

    def sizes(self, passages: np.ndarray) -> np.ndarray:
        """Bytes that hold so many passages."""
        return passages.astype(np.int64) + (self.length - 1)


#: Odd numbers that spread the words of a hash; fixed, as chunks compare their hashes.
SPREAD = np.random.default_rng(50).integers(2**63, 2**64, 64, np.uint64) | np.uint64(1)


def _words_at(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    flat = np.ascontiguousarray(flat)
    return np.ndarray((max(flat.size - 7, 0),), "<u8", flat.data, 0, (1,))


def _hash_of(words: Iterable[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.uint64(0)
        for k, word in enumerate(words):
            # Turned after each word, so that a word's place counts and not its value alone.
            out = (out ^ (out >> np.uint64(29))) + word * SPREAD[k % len(SPREAD)]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


def _seed_hashes(text: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``seed`` bytes from each place on."""
    n = len(text) - seed + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = _words_at(text)
    return _hash_of(words[at : at + n] for at in range(0, seed, 8))


def _least_places(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each place the first lowest hash among the next ``reach``: its place."""
    # The upper half of a key is the hash, the lower half the place.
    keys = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if span < reach:
        keys = np.minimum(keys[: len(keys) - (reach - span)], keys[reach - span :])
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Anchors:
    """The anchors of a chunk: place, hash, document, and the first passage that each serves
    and how many of them."""

    place: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    passages: np.ndarray


class Chunk:
    """Some documents as one stretch of bytes."""

    def __init__(self, data: bytes, rule: Rule):
        found = unpack(data)
        self.rule, self.id, self.size, self.text = rule, found["id"], found["size"], found["text"]
        self.start = np.cumsum(self.size) - self.size

    def anchors(self) -> Anchors:
        length, reach = self.rule.length, self.rule.reach
        none = np.zeros(0, np.int64)
        if len(self.text) < length:
            return Anchors(none, none.astype(np.uint64), none, none, none)
        hashes = _seed_hashes(self.text, self.rule.seed)
        place = _least_places(hashes, reach)  # of the anchor of the passage from each place on
        many = np.maximum(self.size - length + 1, 0)  # passages of each document
        doc = np.repeat(np.arange(len(self.id)), many)
        at = np.arange(len(doc)) + np.repeat(self.start - (np.cumsum(many) - many), many)
        place = place[at]
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        new = new if len(place) else none
        place, first = place[new], at[new]
        # Hashed again: those that were chosen are low, and buckets are ranges of hashes.
        own = _hash_of([hashes[place]])
        return Anchors(place, own, doc[new], first, np.diff(np.r_[new, len(at)]))

    def suffixes(self, flags: np.ndarray) -> Own:
        """The suffixes at shared anchors; ``flags`` are those of the distinct hashes."""
        rule, found = self.rule, self.anchors()
        flag = flags[np.unique(found.hash >> SPARED, return_inverse=True)[1]]
        single, crowded = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        many = found.passages[crowded]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        anchor = np.r_[single, np.repeat(crowded, many)]
        first = np.r_[found.first[single], found.first[np.repeat(crowded, many)] + within]
        passages = np.r_[found.passages[single], np.ones(len(within), np.int64)]
        text = np.r_[self.text, np.zeros(rule.width, np.uint8)]
        bytes_ = np.zeros((len(first), rule.row), np.uint8)
        bytes_[:, : rule.width] = sliding_window_view(text, rule.width)[first]
        bytes_[:, : rule.width] *= np.arange(rule.width) < rule.sizes(passages)[:, None]
        all_ = Suffixes(
            found.hash[anchor], (found.place[anchor] - first).astype(np.uint16),
            passages.astype(np.uint16), self.id[found.doc[anchor]], bytes_,
        )
        key = np.where(np.arange(len(anchor)) < len(single), all_.hash, all_.content())
        sent, back, at = all_.distinct()
        return Own(sent, key[at], back, first, found.doc[anchor])


@dataclass
class Suffixes:
    """Suffixes with the bytes before them: the anchor's hash and its offset in the bytes, how
    many passages the bytes hold, the earliest document, and the bytes, zeros after them."""

    hash: np.ndarray
    offset: np.ndarray
    passages: np.ndarray
    least: np.ndarray
    bytes: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def __getitem__(self, at) -> Suffixes:
        return Suffixes(*(getattr(self, f)[at] for f in self.__dataclass_fields__))

    def content(self) -> np.ndarray:
        """A hash of all that makes two suffixes equal."""
        own = self.offset.astype(np.uint64) << np.uint64(16) | self.passages
        return _hash_of([self.hash, own, *self.bytes.view("<u8").T])

    def words(self, at: np.ndarray, rows: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The words of the bytes from a place in each row on, as many as a row allows."""
        flat, row = _words_at(self.bytes.reshape(-1)), self.bytes.shape[1]
        rows = np.arange(len(self)) if rows is None else rows
        begin = rows * row + at.astype(np.int64)
        ends = rows * row + (row - 8)
        for word in range(0, row - 7, 8):
            # Past the end of a row come the zeros of its last word.
            yield flat[np.minimum(begin + word, ends)]

    def distinct(self) -> tuple[Suffixes, np.ndarray, np.ndarray]:
        """Equal suffixes once, with their earliest document; which one each is; and where
        each of them first stands."""
        content, at, back = np.unique(self.content(), return_index=True, return_inverse=True)
        twice = np.flatnonzero(at[back] != np.arange(len(back)))
        first = at[back[twice]]
        same = self.offset[twice] == self.offset[first]
        same &= self.passages[twice] == self.passages[first]
        for word in self.bytes.view("<u8").T:
            same &= word[twice] == word[first]
        if not same.all():  # two contents of one hash: all their bytes tell them apart
            whole = np.column_stack([self.bytes, self.offset, self.passages])
            _, at, back = np.unique(whole, axis=0, return_index=True, return_inverse=True)
            back = back.reshape(-1)
        out = self[at]
        # Of a suffix that stands once the document is known already.
        np.minimum.at(out.least, back[twice], self.least[twice])
        return out, back, at

    def order(self, rule: Rule) -> np.ndarray:
        """The order of the suffixes: first by the hash of their first bytes, which takes the
        place of those bytes, then by the bytes that follow."""
        order = np.argsort(self.hash, kind="stable")
        hashes = self.hash[order]
        tied = np.r_[False, hashes[1:] == hashes[:-1]]
        tied = np.flatnonzero(tied | np.r_[tied[1:], False])
        if len(tied):
            rows = order[tied]
            after = self.offset[rows].astype(np.int64) + rule.seed
            words = [w.byteswap() for w in self.words(after, rows)]
            order[tied] = rows[np.lexsort([*words[::-1], hashes[tied]])]
        return order

    def earliest(self, rule: Rule, group: np.ndarray) -> np.ndarray:
        """For each passage of each suffix, one after another, the earliest document among the
        suffixes of its group that hold it. Groups stand together; suffixes are distinct."""
        out = np.repeat(self.least, self.passages)
        if not len(self):
            return out
        group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
        # Alone in its group, a suffix shares no passage with another.
        met = np.flatnonzero(np.bincount(group)[group] > 1)
        ends = np.cumsum(self.passages.astype(np.int64))
        many = self.passages[met].astype(np.int64)
        upto = np.cumsum(many)
        begin = 0
        while begin < len(met):
            # Whole groups, about 200,000 passages at a time.
            end = int(np.searchsorted(upto, upto[begin] + 200_000, "right"))
            end = max(end, begin + 1)
            end = int(np.searchsorted(group[met], group[met[end - 1]], "right"))
            rows, n = met[begin:end], many[begin:end]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            least = np.repeat(self.least[rows], n)
            passage = _alike(self._passages(rule, np.repeat(rows, n), within))
            first = np.full(passage.max() + 1, LAST)
            np.minimum.at(first, passage, least)
            out[np.repeat(ends[rows] - n, n) + within] = first[passage]
            begin = end
        return out

    def _passages(self, rule: Rule, rows: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The words of one passage a row."""
        found = [w for w, _ in zip(self.words(at, rows), range(0, rule.length, 8))]
        if rule.length % 8:
            found[-1] &= (np.uint64(1) << np.uint64(8 * (rule.length % 8))) - np.uint64(1)
        return found

    def packed(self, rule: Rule) -> bytes:
        inside = np.arange(rule.row) < rule.sizes(self.passages)[:, None]
        arrays = {f: getattr(self, f) for f in self.__dataclass_fields__}
        return pack(arrays | {"bytes": self.bytes[inside]}, level=6)


def _unpacked(data: bytes, rule: Rule) -> Suffixes:
    found = unpack(data)
    inside = np.arange(rule.row) < rule.sizes(found["passages"])[:, None]
    bytes_ = np.zeros(inside.shape, np.uint8)
    bytes_[inside] = found["bytes"]
    return Suffixes(**(found | {"bytes": bytes_}))


def _joined(parts: list[Suffixes], rule: Rule) -> Suffixes:
    if not parts:
        none = np.zeros(0, np.int64)
        return Suffixes(none.astype(np.uint64), none.astype(np.uint16), none.astype(np.uint16),
                        none, np.zeros((0, rule.row), np.uint8))
    fields = Suffixes.__dataclass_fields__
    return Suffixes(*(np.concatenate([getattr(p, f) for p in parts]) for f in fields))


def _alike(words: list[np.ndarray]) -> np.ndarray:
    """Numbers rows so that those of equal words have the same: by a hash, checked word by word."""
    _, at, back = np.unique(_hash_of(words), return_index=True, return_inverse=True)
    if not all((w[at][back] == w).all() for w in words):  # two rows of one hash
        back = np.unique(np.column_stack(words), axis=0, return_inverse=True)[1].reshape(-1)
    return back


@dataclass
class Own:
    """A chunk's suffixes: the distinct ones and their keys, and of each anchor's suffix which
    distinct one it is, where its bytes begin, and its document."""

    sent: Suffixes
    key: np.ndarray
    back: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Which distinct suffixes each bucket gets, in the order in which it gets them."""
        bucket = _bucket(self.key, buckets)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                yield int(bucket[part[0]]), part


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], borders: list[int]) -> Iterator[pa.RecordBatch]:
    """Packs the documents of each batch of ids into chunks."""
    waiting: dict[int, list] = {}

    def flush(number: int) -> pa.RecordBatch:
        ids, sizes, texts = zip(*waiting.pop(number))
        arrays = zip(("id", "size", "text"), map(np.concatenate, (ids, sizes, texts)))
        data = pack(dict(arrays), level=6)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([data])], ["batch", "data"]
        )

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        texts = batch.column("text")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[
            texts.offset : texts.offset + len(texts) + 1
        ].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        numbers = np.searchsorted(borders, ids, "left")
        begin = 0
        while begin < len(ids):
            number = int(numbers[begin])
            alike = numbers[begin:] != number
            run = begin + int(alike.argmax()) if alike.any() else len(ids)
            # Not more than a chunk at once, one document at least.
            full = int(np.searchsorted(offsets, offsets[begin] + CHUNK, "right")) - 1
            end = min(run, max(full, begin + 1))
            waiting.setdefault(number, []).append(
                (
                    ids[begin:end], np.diff(offsets[begin : end + 1]),
                    raw[offsets[begin] : offsets[end]].copy(),
                )
            )
            if sum(len(t) for _, _, t in waiting[number]) >= CHUNK // 2:
                yield flush(number)
            begin = end
    for number in sorted(waiting):
        yield flush(number)
    give_back()


def _hashes(batches: Iterator[pa.RecordBatch], rule: Rule, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk and bucket the distinct hashes of anchors, how many anchors they have, and
    whether several documents have them."""
    for batch in batches:
        for number, data in zip(*(batch.column(c).to_pylist() for c in ("number", "data"))):
            chunk = Chunk(data, rule)
            found = chunk.anchors()
            value, back, n = np.unique(
                found.hash >> SPARED, return_inverse=True, return_counts=True
            )
            least, most = np.full(len(value), LAST), np.full(len(value), -LAST - 1)
            np.minimum.at(least, back, chunk.id[found.doc])
            np.maximum.at(most, back, chunk.id[found.doc])
            cuts = np.searchsorted(_bucket(value << SPARED, buckets), np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[bucket], cuts[bucket + 1])
                out = {
                    "step": np.diff(value[at], prepend=np.uint64(0)), "n": n[at].astype(np.uint32),
                    "several": (least[at] < most[at]).astype(np.uint8),
                }
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket)], pa.int32()), pa.array([number]),
                        pa.array([pack(out)]),
                    ],
                    ["bucket", "chunk", "data"],
                )
            del chunk, found, value, back, n, least, most
            give_back()


def _flagged(rows: pa.Table, rule: Rule) -> pa.Table:
    """For a bucket's hashes, in the order of each chunk: 0 if one document alone has the
    anchor, 1 if others do, 2 if very many passages go with it."""
    parts = [unpack(d) for d in rows.column("data").to_pylist()]
    hashes = np.concatenate([np.cumsum(p["step"], dtype=np.uint64) for p in parts])
    value, back = np.unique(hashes, return_inverse=True)
    chunks = np.bincount(back)
    several = np.bincount(back, np.concatenate([p["several"] for p in parts]))
    n = np.bincount(back, np.concatenate([p["n"] for p in parts]))
    flag = np.where((chunks > 1) | (several > 0), np.where(n > rule.crowd, 2, 1), 0)
    own = np.split(flag.astype(np.uint8)[back], np.cumsum([len(p["n"]) for p in parts])[:-1])
    give_back()
    return pa.table(
        {
            "bucket": rows.column("bucket"), "chunk": rows.column("chunk"),
            "data": pa.array([pack({"flag": f}) for f in own], pa.binary()),
        }
    )


def _taken(rows: pa.Table, rule: Rule) -> tuple[int, int, Chunk, Own, dict[int, np.ndarray]]:
    """A chunk with its suffixes, and the answers to them by bucket, if there are any."""
    chunk, flags, answers, number, batch = None, {}, {}, 0, 0
    for row in rows.to_pylist():
        if row["kind"] == "text":
            chunk, number, batch = Chunk(row["data"], rule), row["chunk"], row["bucket"]
        elif row["kind"] == "flags":
            flags[row["bucket"]] = unpack(row["data"])["flag"]
        else:
            found = unpack(row["data"])
            answers[row["bucket"]] = np.repeat(found["earliest"], found["runs"])
    # Buckets are ranges of hashes, so their flags one after another are the chunk's.
    flag = np.concatenate([flags[b] for b in sorted(flags)] or [np.zeros(0, np.uint8)])
    return number, batch, chunk, chunk.suffixes(flag), answers


def _sent(rows: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    number, batch, _, own, _ = _taken(rows, rule)
    out = [(batch, b, number, own.sent[at].packed(rule)) for b, at in own.by_bucket(buckets)]
    kinds = {"batch": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "data": pa.binary()}
    columns = list(zip(*out)) if out else [()] * 4
    del own
    give_back()
    return pa.table({c: pa.array(v, kind) for v, (c, kind) in zip(columns, kinds.items())})


class IndexFamily:
    """Levels of sorted suffixes; level ``k`` holds ``2 ** k`` batches."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.levels: dict[int, Suffixes] = {}

    def add(self, batch: Suffixes, last: bool = False) -> np.ndarray:
        """Scans a batch, sorted and distinct, against all levels and puts it into the index,
        merging levels of equal size; the ``last`` one is scanned only. Returns the earliest
        document, in the batch or the index, of each of its passages, one suffix after
        another."""
        earliest = batch.earliest(self.rule, batch.hash)
        for level in self.levels.values():
            np.minimum(earliest, self._scan(batch, level), out=earliest)
        size = 0
        while size in self.levels and not last:
            batch = _joined([self.levels.pop(size), batch], self.rule).distinct()[0]
            batch = batch[batch.order(self.rule)]
            size += 1
        if not last:
            self.levels[size] = batch
        return earliest

    def _scan(self, batch: Suffixes, level: Suffixes) -> np.ndarray:
        """The earliest documents of the batch's passages that a level holds."""
        out = np.full(int(batch.passages.sum(dtype=np.int64)), LAST)
        low = np.searchsorted(level.hash, batch.hash, "left")
        high = np.searchsorted(level.hash, batch.hash, "right")
        mine = np.flatnonzero(high > low)
        if not len(mine):
            return out
        # The stretches of the level that agree with some of the batch in their first bytes.
        starts, at = np.unique(low[mine], return_index=True)
        sizes = high[mine][at] - starts
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = np.repeat(starts, sizes) + within
        group = np.r_[low[mine], np.repeat(starts, sizes)]
        both, back, at = _joined([batch[mine], level[rows]], self.rule).distinct()
        order = np.argsort(group[at], kind="stable")
        both, group = both[order], group[at][order]
        found = both.earliest(self.rule, group)
        # Back from the joint order to the batch's.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begins = np.cumsum(both.passages.astype(np.int64)) - both.passages
        begins = begins[place[back[: len(mine)]]]
        n = batch.passages[mine].astype(np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.cumsum(batch.passages.astype(np.int64))
        out[np.repeat(ends[mine] - n, n) + within] = found[np.repeat(begins, n) + within]
        return out


def _scanned(rows: pa.Table, rule: Rule) -> pa.Table:
    """One bucket: its batches go through an index family one after another. Returns, for each
    chunk, the earliest documents of the passages that it sent."""
    batches: dict[int, list[tuple[int, bytes]]] = {}
    for row in rows.to_pylist():
        batches.setdefault(row["batch"], []).append((row["chunk"], row["data"]))
    family, out = IndexFamily(rule), []
    for number in sorted(batches):
        sent = [(chunk, _unpacked(data, rule)) for chunk, data in batches[number]]
        whole, back, _ = _joined([found for _, found in sent], rule).distinct()
        order = whole.order(rule)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        whole, back = whole[order], place[back]
        earliest = family.add(whole, last=number == max(batches))
        ends = np.cumsum(whole.passages.astype(np.int64))
        cuts = np.cumsum([0, *(len(found) for _, found in sent)])
        for (chunk, _), low, high in zip(sent, cuts, cuts[1:]):
            at = back[low:high]
            many = whole.passages[at].astype(np.int64)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            answer = earliest[np.repeat(ends[at] - many, many) + within]
            # Neighbouring passages mostly have one answer.
            new = np.flatnonzero(np.r_[True, answer[1:] != answer[:-1]])
            runs = np.diff(np.r_[new, len(answer)]).astype(np.int32)
            out.append((chunk, pack({"earliest": answer[new], "runs": runs})))
    give_back()
    chunk, data = zip(*out)
    bucket = rows.column("bucket")[0].as_py()
    return pa.table(
        {
            "bucket": pa.array([bucket] * len(out), pa.int32()),
            "chunk": pa.array(chunk, pa.int64()),
            "data": pa.array(data, pa.binary()),
        }
    )


def _cut(rows: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    """The documents of a chunk without their repeated passages."""
    _, _, chunk, own, answers = _taken(rows, rule)
    many = own.sent.passages.astype(np.int64)
    ends = np.cumsum(many)
    earliest = np.zeros(int(many.sum()), np.int64)
    for bucket, at in own.by_bucket(buckets):
        within = np.arange(many[at].sum()) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
        earliest[np.repeat(ends[at] - many[at], many[at]) + within] = answers[bucket]
    n = many[own.back]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = earliest[np.repeat(ends[own.back] - n, n) + within]
    gone = first < np.repeat(chunk.id[own.doc], n)
    start = (np.repeat(own.first, n) + within)[gone]
    size = len(chunk.text) + 1
    covered = np.bincount(start, minlength=size) - np.bincount(start + rule.length, minlength=size)
    mask = np.cumsum(covered)[:-1] > 0
    # Maximal runs of removed bytes, which end with their document.
    border = np.zeros(size, bool)
    border[chunk.start] = True
    opens = np.flatnonzero(mask & (border[:-1] | ~np.r_[False, mask[:-1]]))
    closes = np.flatnonzero(mask & (np.r_[border[1:-1], True] | ~np.r_[mask[1:], False])) + 1
    doc = np.searchsorted(chunk.start, opens, "right") - 1
    removed = np.r_[0, np.cumsum(mask)]
    end = chunk.start + chunk.size
    left = chunk.size - (removed[end] - removed[chunk.start])
    offsets = np.r_[0, np.cumsum(left)].astype(np.int32)
    kept_text = np.ascontiguousarray(chunk.text[~mask])
    spans = pa.StructArray.from_arrays(
        [pa.array(opens - chunk.start[doc]), pa.array(closes - chunk.start[doc])], ["start", "end"]
    )
    return pa.table(
        {
            "id": pa.array(chunk.id),
            "n_bytes": pa.array(chunk.size),
            "spans": pa.ListArray.from_arrays(
                np.searchsorted(doc, np.arange(len(chunk.id) + 1)).astype(np.int32), spans
            ),
            "kept": pa.Array.from_buffers(
                pa.binary(), len(chunk.id), [None, pa.py_buffer(offsets), pa.py_buffer(kept_text)]
            ),
        }
    )


def without_repeats(
    docs: DataFrame, length: int = 50, batches: int = BATCHES, crowd: int = CROWD,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``id, n_bytes, spans, kept`` for each row of ``docs``: the bytes of its text, the maximal
    stretches of them (``start, end``) that were removed, and what is left.

    A byte is removed if a string of ``length`` bytes covers it that also starts in a document
    of smaller id; strings are those of the input and lie within one document. Ids are whole
    numbers; a null id comes after all others and is returned as null. Rows of one id, equal or
    not, don't remove each other's bytes. A null text is empty. An empty table gives no rows;
    other columns are ignored. ``batches`` and ``crowd`` change the work, not the result.
    """
    rule = Rule(length, crowd)
    source = docs.selectExpr(
        f"coalesce(CAST(`{id_column}` AS LONG), {LAST}L) AS id",
        f"coalesce(CAST(`{text_column}` AS STRING), '') AS text",
    )
    parts = [i / batches for i in range(1, batches)]
    borders = [int(b) for b in source.approxQuantile("id", parts, 0.01)] if parts else []
    packed = source.mapInArrow(lambda rows: _chunks(rows, borders), "batch int, data binary")
    chunks = kept(packed.selectExpr("monotonically_increasing_id() AS number", "*"), "chunks")
    number = chunks.count()
    buckets = max(1, -(-number // CHUNKS_PER_BUCKET))
    tasks = max(1, -(-number // CHUNKS_PER_TASK))
    hashes = chunks.mapInArrow(
        lambda rows: _hashes(rows, rule, buckets), "bucket int, chunk long, data binary"
    )
    flags = kept(
        hashes.repartition(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(lambda t: _flagged(t, rule), "bucket int, chunk long, data binary"),
        "flags",
    )
    texts = chunks.selectExpr("'text' AS kind", "batch AS bucket", "number AS chunk", "data")
    texts = texts.union(flags.selectExpr("'flags' AS kind", "bucket", "chunk", "data"))
    sent = (
        texts.repartition(tasks, "chunk")
        .groupBy("chunk")
        .applyInArrow(
            lambda t: _sent(t, rule, buckets), "batch int, bucket int, chunk long, data binary"
        )
    )
    answers = kept(
        sent.repartition(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(lambda t: _scanned(t, rule), "bucket int, chunk long, data binary"),
        "answers",
    )
    texts = texts.union(answers.selectExpr("'answers' AS kind", "bucket", "chunk", "data"))
    cut = (
        texts.repartition(tasks, "chunk")
        .groupBy("chunk")
        .applyInArrow(
            lambda t: _cut(t, rule, buckets),
            "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
        )
    )
    return cut.selectExpr(f"nullif(id, {LAST}L) AS `{id_column}`", "n_bytes", "spans", "kept")
