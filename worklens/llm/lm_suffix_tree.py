"""Language-model scores by a probabilistic suffix tree over words.

A state is a context of up to two preceding words. A context is retained if it occurs
often enough and its next words, each left out of its own counts, are predicted better
than by the next shorter context: a divergence test that copies of chance fail. A word's
probability comes from the longest retained suffix of what precedes it, smoothed by the
shorter one's, down to the words' own frequencies.

Counts come from all training documents. Documents are kept in chunks, one file each. A
chunk asks for the counts of its distinct n-grams: requests are dealt by hash to
buckets, added up there, and answered in the order in which they were asked. Words are asked
for by their hashes, and get a place among the words of the same count; from then on a word is
its count, which buckets need in any case, and its place. Contexts grow
level by level, so longer n-grams are counted only after contexts frequent enough. What a
chunk or a bucket holds is bounded, whatever the corpus; contexts with over a
thousandth of all words, at most a thousand and some, are spread over all buckets and
their tests added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.packing import mixed_hash, pack, unpack
from worklens.llm.pieces import Numbering
from worklens.llm.tables import drop_shuffles, give_back, id_crc, kept, new_dir

FOLDS, HELD_OUT = 7, 2
CHUNK_TOKENS = 3 << 19
BUCKET_TOKENS = 1 << 21
HOT_SHARE = 1024
REQUEST = "level int, chunk long, bucket int, data binary"
ANSWER = "level int, chunk long, bucket int, data binary, tokens double, distinct double"


@dataclass(frozen=True)
class SuffixTree:
    """``least``: occurrences of a context worth testing, whatever the corpus's size.
    ``gain``: nats per word by which its predictions must beat the shorter context's.
    ``smooth``: weight of the shorter context."""

    least: int = 32
    gain: float = 0.02
    smooth: float = 4.0


class Chunk:
    """Documents as numbers of their words, in the order in which the words were asked for."""

    def __init__(self, table: pa.Table) -> None:
        row = {name: table.column(name).combine_chunks() for name in table.column_names}
        self.ids = row["id"].flatten()
        self.held = row["held"].flatten().to_numpy(zero_copy_only=False)
        self.n = row["n"].flatten().to_numpy().astype(np.int64)
        self.tokens = row["tokens"].flatten().to_numpy().astype(np.int32)
        at = np.arange(len(self.tokens), dtype=np.int32)
        self.place = at - np.repeat((np.cumsum(self.n) - self.n).astype(np.int32), self.n)
        self.learnt = np.repeat(~self.held, self.n)

    @staticmethod
    def read(path: str, number: int) -> Chunk:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        with files.open_input_file(f"{folder}/chunk-{number}.arrow") as source:
            table = pa.ipc.open_file(source).read_all()
        packed = unpack(table.column("tokens")[0].as_py())
        return Chunk(_with_tokens(table, [packed["words"][packed["tokens"]]], pa.list_(pa.int32())))


def _with_tokens(table: pa.Table, tokens: list, kind: pa.DataType) -> pa.Table:
    return table.set_column(table.schema.get_field_index("tokens"), "tokens", pa.array(tokens, kind))


def _packed(tokens: np.ndarray) -> bytes:
    """The tokens numbered from the most frequent word, which takes less room, and the words'
    numbers in that order."""
    words = np.argsort(-np.bincount(tokens), kind="stable").astype(np.int32)
    rank = np.empty(len(words), np.int32)
    rank[words] = np.arange(len(words), dtype=np.int32)
    return pack({"words": words, "tokens": rank[tokens]})


def _tokenised(path: str, id_type: pa.DataType, buckets_log: int):
    """Writes each chunk's file and asks for the counts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() << 32
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)

        def close(ids: list, held: list, n: list, tokens: list, words: list) -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            order = np.argsort(hashes, kind="stable")
            number_of = np.empty(len(order), np.int32)
            number_of[order] = np.arange(len(order), dtype=np.int32)
            hashes = hashes[order]
            lists = [
                pa.array([ids], pa.list_(id_type)),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([n], pa.list_(pa.int32())),
                pa.array([number_of[np.concatenate(tokens)]], pa.list_(pa.int32())),
            ]
            table = pa.table(lists, names=["id", "held", "n", "tokens"])
            chunk = Chunk(table)
            stored = _with_tokens(table, [_packed(chunk.tokens)], pa.binary())
            name = f"{folder}/chunk-{number}.arrow"
            unfinished = f"{name}.{context.taskAttemptId()}"
            with files.open_output_stream(unfinished) as sink:
                with pa.ipc.new_file(
                    sink, stored.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")
                ) as writer:
                    writer.write_table(stored)
            files.move(unfinished, name)
            counts = np.bincount(chunk.tokens[chunk.learnt], minlength=len(words))
            return _requests(
                1, number, _bucket(hashes, buckets_log),
                {"key": hashes, "count": counts.astype(np.int32)},
            )

        state, size = ([], [], [], []), 0
        numbering = Numbering()
        numbering.of([b""])
        for batch in batches:
            for id_, held, text in zip(
                batch.column("id").to_pylist(), batch.column("held").to_pylist(),
                batch.column("text").to_pylist(),
            ):
                words = (text or b"").lower().split()
                if size and size + len(words) >= CHUNK_TOKENS:
                    yield close(*state, list(numbering))
                    state, size, number = ([], [], [], []), 0, number + 1
                    numbering = Numbering()
                    numbering.of([b""])
                row = np.zeros(len(words) + 1, np.int32)
                row[:-1] = numbering.of(words)
                for part, value in zip(state, (id_, held, len(row), row)):
                    part.append(value)
                size += len(row)
        if size:
            yield close(*state, list(numbering))

    return run


def _bucket(keys: np.ndarray, buckets_log: int) -> np.ndarray:
    return (keys >> np.uint64(63 - buckets_log) >> np.uint64(1)).astype(np.int64)


def _requests(
    level: int, chunk: int, bucket: np.ndarray, arrays: dict[str, np.ndarray]
) -> pa.RecordBatch:
    """One row per bucket; ``bucket`` ascends over the arrays."""
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    end = np.append(begin[1:], len(bucket))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(begin), level), pa.int32()),
            pa.array(np.full(len(begin), chunk), pa.int64()),
            pa.array(bucket[begin], pa.int32()),
            pa.array([pack({k: v[s:e] for k, v in arrays.items()}) for s, e in zip(begin, end)], pa.binary()),
        ],
        names=["level", "chunk", "bucket", "data"],
    )


def _word(count: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of words by their count and place."""
    return mixed_hash(count.astype(np.uint64), place.astype(np.uint64))


def _added(settings: SuffixTree, known: float, buckets_log: int):
    """Adds up the requests of one bucket and answers each chunk in its own order.
    ``known``: what a word's count and one are divided by for its own probability."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        rows = rows.sort_values("chunk")
        asked = [unpack(x) for x in rows["data"]]
        sizes = np.array([len(x["count"]) for x in asked])
        count = np.concatenate([x["count"] for x in asked]).astype(np.float64)
        level = int(rows["level"].iloc[0])

        def every(name: str) -> np.ndarray:
            return np.concatenate([x[name] for x in asked])

        if level == 1:
            _, inverse = np.unique(every("key"), return_inverse=True)
            total = np.bincount(inverse, count)
            wanted = _wanted(total, inverse, count)
            order = np.argsort(total, kind="stable")
            among = np.arange(len(order)) - np.searchsorted(total[order], total[order])
            place = np.empty(len(order), np.int64)
            place[order] = (among << buckets_log) + int(rows["bucket"].iloc[0])
            ends = np.cumsum(sizes)[:-1]
            parts = (total[inverse].astype(np.int64), wanted, place[inverse])
            answers = [
                {"total": t, "wanted": w, "place": p}
                for t, w, p in zip(*(np.split(part, ends) for part in parts))
            ]
            stats = (total.sum(), float((total > 0).sum()))
        else:
            # Contexts stand once per run of keys, with their own counts.
            run = every("run")
            contexts = _word(every("last"), every("last_place"))
            if level == 3:
                contexts = mixed_hash(_word(every("first"), every("first_place")), contexts)
            context = np.repeat(contexts, run)
            word = _word(every("word"), every("word_place"))
            _, first, inverse = np.unique(
                mixed_hash(context, word), return_index=True, return_inverse=True
            )
            total = np.bincount(inverse, count)
            shorter = (every("word")[first].astype(np.float64) + 1) / known
            last = np.repeat(every("last"), run)[first].astype(np.float64)
            occurs = last
            if level == 3:
                occurs = np.repeat(every("occurs"), run)[first].astype(np.float64)
                after_last = (every("pair")[first] + settings.smooth * shorter) / (last + settings.smooth)
                shorter = np.where(np.repeat(every("kept"), run)[first], after_last, shorter)
            tested, which = np.unique(context[first], return_inverse=True)
            often = total >= 2
            left = (total - 1 + settings.smooth * shorter) / (occurs - 1 + settings.smooth)
            terms = np.zeros(len(total))
            terms[often] = total[often] * np.log(left[often] / shorter[often])
            gain = np.bincount(which, terms, len(tested))
            seen = np.bincount(which, np.where(often, total, 0), len(tested))
            of = np.zeros(len(tested))
            of[which] = occurs
            hot = np.zeros(len(tested), bool)
            hot[which] = np.repeat(every("hot"), run)[first].astype(bool)
            keep = ~hot & (_gain(gain, seen, of, settings) >= settings.gain)
            answers = []
            ends = np.cumsum(sizes)[:-1]
            totals = np.split(total[inverse].astype(np.int64), ends)
            wanted = np.split(_wanted(total, inverse, count), ends)
            runs = np.cumsum([len(x["run"]) for x in asked])[:-1]
            for c, t, w in zip(np.split(contexts, runs), totals, wanted):
                at = np.searchsorted(tested, c)
                answers.append({"total": t, "wanted": w, "keep": keep[at].astype(np.uint8)})
            if hot.any():
                # The parts of tests that other buckets have the rest of.
                answers[0] |= {
                    "hot": tested[hot], "gain": gain[hot], "seen": seen[hot], "of": of[hot]
                }
            stats = (0.0, 0.0)
        out = rows[["level", "chunk", "bucket"]].copy()
        out["data"] = [pack(_narrow(a)) for a in answers]
        out["tokens"], out["distinct"] = 0.0, 0.0
        out.iloc[0, 4], out.iloc[0, 5] = stats
        return out

    return run


def _wanted(total: np.ndarray, inverse: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each row, whether its n-gram occurs once in training and another chunk has it in
    held-out texts only: what longer n-grams have of that one occurrence must be told."""
    elsewhere = np.bincount(inverse, count == 0) > 0
    return ((total == 1) & elsewhere)[inverse].astype(np.uint8)


def _narrow(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Whole numbers in the smallest type that holds them."""
    return {
        k: v.astype(np.min_scalar_type(int(v.max(initial=0)))) if v.dtype.kind == "i" else v
        for k, v in arrays.items()
    }


def _gain(gain: np.ndarray, seen: np.ndarray, occurs: np.ndarray, settings: SuffixTree) -> np.ndarray:
    """Nats per word; words seen once after a context are predicted by smoothing alone."""
    alone = np.log(settings.smooth / (occurs - 1 + settings.smooth))
    return (gain + (occurs - seen) * alone) / np.maximum(occurs, 1)


def _known(model: dict) -> float:
    return model["tokens"] + model["distinct"] + 1


class Counted:
    """A chunk with the answers it has so far."""

    def __init__(
        self, number: int, chunk: Chunk, answers: pd.DataFrame, model: dict, settings: SuffixTree
    ) -> None:
        self.number, self.chunk, self.model, self.settings = number, chunk, model, settings
        answers = answers.sort_values("bucket")
        self.answers = {
            level: [unpack(x) for x in part["data"]] for level, part in answers.groupby("level")
        }
        # From here on words are numbered from the most frequent: requests pack better so.
        total = self._answer(1, "total").astype(np.int64)
        self.order = np.argsort(-total, kind="stable")
        self.count = total[self.order]
        self.wanted = self._answer(1, "wanted").astype(bool)[self.order]
        number_of = np.empty(len(total), np.int32)
        number_of[self.order] = np.arange(len(total), dtype=np.int32)
        chunk.tokens = number_of[chunk.tokens]
        self.share = (self.count + 1) / _known(model)  # a word's own probability

    def _answer(self, level: int, name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint8), *(x[name] for x in self.answers.get(level, []))])

    def level(self, number: int) -> dict[str, np.ndarray]:
        """The distinct n-grams of order ``number`` after frequent contexts, at each token.

        ``at``: for each token the n-gram that it ends, or -1. Of each n-gram: ``context``
        and ``word`` (numbers), ``own`` (its count in this chunk's training texts),
        ``total`` and ``wanted`` (once answered), ``some`` (a token that ends it), and ``ask``,
        whether it is asked for.
        """
        chunk, least = self.chunk, self.settings.least
        if number == 2:
            before = np.concatenate((np.zeros(1, np.int32), chunk.tokens[:-1]))
            occurs = self.count
            live = chunk.place >= 1
        else:
            lower = self._second()
            before = np.concatenate((np.full(1, -1, np.int32), lower["at"][:-1]))
            occurs = lower["total"]
            live = (chunk.place >= 2) & (before >= 0)
        live = live.copy()
        where = np.flatnonzero(live)
        where = where[occurs[before[where]] >= least]
        width = max(len(self.count), 1)
        code = before[where].astype(np.int64) * width + chunk.tokens[where]
        code, inverse = np.unique(code, return_inverse=True)
        own = np.bincount(inverse, chunk.learnt[where], len(code)).astype(np.int64)
        context, word = (code // width).astype(np.int32), (code % width).astype(np.int32)
        at = np.full(len(chunk.tokens), -1, np.int32)
        at[where] = inverse
        some = np.empty(len(code), np.int32)
        some[inverse] = where
        if number == 2:
            tell = (self.count[word] >= 2) | self.wanted[word]
        else:
            pair = lower["at"][some]
            tell = (pair < 0) | (lower["total"][pair] >= 2) | lower["wanted"][pair]
        # What occurs once at most without its first word is known here already, unless that
        # is in one chunk's training texts and in another's held-out ones; of every context
        # something is asked, to hear whether it is retained.
        ask = tell
        asks = np.bincount(context, ask, len(occurs)) > 0
        silent = np.flatnonzero(~asks[context])
        ask[silent[np.unique(context[silent], return_index=True)[1]]] = True
        made = {
            "at": at, "context": context, "word": word, "own": own, "some": some, "ask": ask,
            "occurs": occurs, "total": own.copy(), "wanted": np.zeros(len(code), bool),
            "kept": np.zeros(len(occurs), bool),
        }
        if number in self.answers:
            made |= self._asked(number, made)
            asked = made["asked"]
            made["total"][asked] = self._answer(number, "total").astype(np.int64)
            made["wanted"][asked] = self._answer(number, "wanted").astype(bool)
            begin = self._runs(made)
            keep = np.concatenate([x["keep"] for x in self.answers[number]]).astype(bool)
            made["kept"][context[asked[begin]]] = keep
            if len(self.model["hot"]):
                found = np.isin(made["context_hash"][begin], self.model["hot"])
                made["kept"][context[asked[begin[found]]]] = True
        return made

    def _asked(self, number: int, made: dict) -> dict[str, np.ndarray]:
        """The n-grams ``asked`` for, in that order, with their buckets and contexts' hashes."""
        hashes = words = _word(self.count, self._place())
        if number == 3:
            pairs = self._second()
            hashes = mixed_hash(words[pairs["context"]], words[pairs["word"]])
        # N-grams stand by context already, so that contexts stay together within buckets.
        asked = np.flatnonzero(made["ask"])
        context = hashes[made["context"][asked]]
        hot = made["occurs"][made["context"][asked]] * HOT_SHARE > self.model["tokens"]
        whole = mixed_hash(context, words[made["word"][asked]])
        bucket = _bucket(
            np.where(hot, whole, mixed_hash(context, context)), self.model["buckets_log"]
        )
        small = np.min_scalar_type((1 << self.model["buckets_log"]) - 1)
        order = np.argsort(bucket.astype(small), kind="stable")
        return {
            "asked": asked[order], "bucket": bucket[order], "context_hash": context[order],
            "hot": hot[order],
        }

    def _place(self) -> np.ndarray:
        return self._answer(1, "place").astype(np.int64)[self.order]

    @staticmethod
    def _runs(made: dict) -> np.ndarray:
        """Where a bucket or a context begins among what is asked."""
        if not len(made["asked"]):
            return np.empty(0, np.int64)
        step = (np.diff(made["bucket"]) != 0) | (np.diff(made["context_hash"]) != 0)
        return np.concatenate(([0], np.flatnonzero(step) + 1))

    def requests(self, number: int) -> pd.DataFrame:
        """What this chunk asks of each bucket about its n-grams of that order."""
        made = self.level(number) if number == 3 else self._second()
        made = made | self._asked(number, made)
        place = self._place()
        rows = []
        begin = np.flatnonzero(np.diff(made["bucket"], prepend=-1))
        runs = self._runs(made)
        ends = np.append(runs[1:], len(made["asked"]))
        for s, e in zip(begin, np.append(begin[1:], len(made["asked"]))):
            mine = made["asked"][s:e]
            a, b = np.searchsorted(runs, (s, e))
            context, word = made["context"][made["asked"][runs[a:b]]], made["word"][mine]
            last = context
            data = {}
            if number == 3:
                lower = self._second()
                begins, last = lower["context"][context], lower["word"][context]
                pair = lower["at"][made["some"][mine]]
                data = {
                    "first": self.count[begins],
                    "first_place": place[begins],
                    "occurs": made["occurs"][context],
                    # What the shorter context's prediction is made of.
                    "pair": np.where(pair >= 0, lower["total"][pair], 0),
                    "kept": lower["kept"][last].astype(np.uint8),
                }
            data |= {
                "last": self.count[last],
                "last_place": place[last],
                "run": (ends[a:b] - runs[a:b]).astype(np.int32),
                "hot": made["hot"][runs[a:b]].astype(np.uint8),
                "word": self.count[word],
                "word_place": place[word],
                "count": made["own"][mine].astype(np.int32),
            }
            rows.append((number, self.number, int(made["bucket"][s]), pack(_narrow(data))))
        return pd.DataFrame(rows, columns=["level", "chunk", "bucket", "data"])

    def after(self, deepest: int) -> np.ndarray:
        """Each token's probability after its longest retained context of that depth."""
        p = self.share[self.chunk.tokens]
        for number in range(2, deepest + 1):
            made = self.level(number) if number == 3 else self._second()
            occurs = self.count if number == 2 else self._second()["total"]
            has = np.flatnonzero(made["at"] >= 0)
            gram = made["at"][has]
            context = made["context"][gram]
            ok = made["kept"][context]
            has, gram, context = has[ok], gram[ok], context[ok]
            s = self.settings.smooth
            p[has] = (made["total"][gram] + s * p[has]) / (occurs[context] + s)
        return p

    def _second(self) -> dict:
        if not hasattr(self, "second"):
            self.second = self.level(2)
        return self.second


def suffix_tree_scores(
    docs: DataFrame,
    settings: SuffixTree = SuffixTree(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens`` (words and the end),
    ``n_known`` (tokens that training texts have), ``train_tokens``, ``base_score`` (log10 of the
    words' own probabilities) and ``score`` (log10 by the tree).

    Rows whose crc32 of the id leaves remainder 2 by 7 are not learnt from. A null text
    counts as empty, which is its end alone. Without training texts every word scores alike.
    """
    session = docs.sparkSession
    path = new_dir(session, "chunks")
    source = docs.selectExpr(
        f"`{id_column}` AS id",
        f"{id_crc(f'`{id_column}`')} % {FOLDS} = {HELD_OUT} AS held",
        f"CAST(CAST(`{text_column}` AS STRING) AS BINARY) AS text",
    )
    id_type = docs.select(F.col(f"`{id_column}`")).limit(0).toArrow().schema.field(0).type
    id_name = docs.schema[id_column].dataType.simpleString()
    words = source.select(F.sum(F.octet_length("text"))).first()[0] or 0
    # As many buckets as chunks of text and more: their contents stay bounded.
    buckets_log = max(5, int(np.ceil(np.log2(max(words / 6 / BUCKET_TOKENS, 1)))))
    asked = source.mapInArrow(_tokenised(path, id_type, buckets_log), REQUEST)

    def answered(requests: DataFrame, what: str, known: float = 0.0) -> DataFrame:
        adds = _added(settings, known, buckets_log)
        answers = kept(requests.groupBy("bucket").applyInPandas(adds, ANSWER), what)
        drop_shuffles(session)
        return answers

    first = answered(asked, "words")
    tokens, distinct = first.agg(F.sum("tokens"), F.sum("distinct")).first()
    # Answers are small for the work they bring: as many tasks as chunks, not by size.
    chunks = max(first.select("chunk").distinct().count(), 1)
    model = {
        "tokens": tokens or 0.0, "distinct": distinct or 0.0, "buckets_log": buckets_log,
        "hot": np.empty(0, np.uint64),
    }

    def counted(number: int, answers: pd.DataFrame, model: dict) -> Counted:
        return Counted(number, Chunk.read(path, number), answers, model, settings)

    def ask(answers: DataFrame, level: int, model: dict) -> DataFrame:
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            give_back()
            return counted(int(key[0]), rows, model).requests(level)

        return answers.repartition(chunks, "chunk").groupBy("chunk").applyInPandas(run, REQUEST)

    def hot_contexts(answers: DataFrame) -> np.ndarray:
        """Spread contexts that pass: their parts are at most one per context and bucket."""

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for data in batch["data"]:
                    x = unpack(data)
                    if "hot" in x:
                        yield pd.DataFrame(
                            {"c": x["hot"].view(np.int64), "g": x["gain"], "s": x["seen"], "o": x["of"]}
                        )

        found = (
            answers.select("data")
            .mapInPandas(parts, "c long, g double, s double, o double")
            .groupBy("c")
            .agg(F.sum("g").alias("g"), F.sum("s").alias("s"), F.max("o").alias("o"))
            .toPandas()  # at most HOT_SHARE contexts of either length
        )
        passed = _gain(
            found["g"].to_numpy(float), found["s"].to_numpy(float), found["o"].to_numpy(float), settings
        )
        return found["c"].to_numpy(np.int64).view(np.uint64)[passed >= settings.gain]

    second = answered(ask(first, 2, model), "pairs", _known(model))
    model = model | {"hot": hot_contexts(second)}
    both = first.union(second)
    third = answered(ask(both, 3, model), "triples", _known(model))
    model = model | {"hot": np.concatenate((model["hot"], hot_contexts(third)))}

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        made = counted(int(key[0]), rows, model)
        chunk = made.chunk
        starts = np.cumsum(chunk.n) - chunk.n

        def each(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, starts)

        return pd.DataFrame(
            {
                id_column: chunk.ids.to_pandas(types_mapper=pd.ArrowDtype),
                "held_out": chunk.held,
                "n_tokens": chunk.n,
                "n_known": each((made.count > 0)[chunk.tokens].astype(np.int64)),
                "train_tokens": int(model["tokens"]),
                "base_score": each(np.log10(made.share)[chunk.tokens]),
                "score": each(np.log10(made.after(3))),
            }
        )

    whole = both.union(third).repartition(chunks, "chunk")
    return whole.groupBy("chunk").applyInPandas(
        score,
        f"`{id_column}` {id_name}, held_out boolean, n_tokens long, n_known long,"
        " train_tokens long, base_score double, score double",
    )
