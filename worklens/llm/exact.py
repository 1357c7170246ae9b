"""Exact deduplication by sorting contents: equal texts end up next to each other.

Texts are equal when they are the same bytes after all white space is deleted.
Rows are dealt by sampled splitters over short keys (the first bytes, a hash, the
length, the id), so the driver never holds texts, and one group of copies may span
many partitions. Within a partition Spark's external sort places equals next to
each other, a pass over the sorted rows compares whole neighbours, and groups cut by
a partition's border are joined by one row per border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.tables import give_back, kept, slices

#: Bytes of the normalised text in the range key.
KEY_BYTES = 32


def sorted_contents(
    docs: DataFrame, id_column: str, text_column: str, whole_rows: bool = False
) -> DataFrame:
    """Rows ``id, norm`` in content order: within equal contents the longest original
    first, then the smallest id (null last). With ``whole_rows`` also ``row``, which then
    moves in place of the normalised text, made again where it arrives."""

    def normal(text: str) -> str:
        return (
            f"cast(regexp_replace(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+', '')"
            " AS BINARY) AS norm"
        )

    source = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    keyed = source.selectExpr(
        "id", normal("text"), "-char_length(coalesce(text, '')) AS shorter", "row"
    ).selectExpr(
        f"substring(norm, 1, {KEY_BYTES}) AS head",
        "xxhash64(norm) AS hash",
        "shorter",
        "id",
        "row" if whole_rows else "norm",
    )
    order = [F.col("head"), F.col("hash"), F.col("shorter"), F.col("id").asc_nulls_last()]
    dealt = keyed.repartitionByRange(*order)
    if whole_rows:
        dealt = dealt.selectExpr("*", normal(f"CAST(row.`{text_column}` AS STRING)"))
    return dealt.sortWithinPartitions(
        "head", "hash", "norm", "shorter", F.col("id").asc_nulls_last()
    )


def _runs(batches: Iterator[pa.RecordBatch], firsts_only: bool) -> Iterator[pa.RecordBatch]:
    """Compares each row with the one before; a run is a stretch of equal contents."""
    part = TaskContext.get().partitionId()
    schema, out, run, norm, sha, runs = None, [], [], None, "", 0

    def close(edge: bool) -> None:
        size = len(run)
        for i, (id_, row) in enumerate(run[:1] if firsts_only else run):
            out.append((id_, run[0][0], size, i == 0, edge, part, sha, row))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 8
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    for batch in slices(batches):
        rows = batch.column("row") if firsts_only else None
        if schema is None:
            id_type = batch.schema.field("id").type
            row_type = rows.type if firsts_only else pa.null()
            names = {
                "id": id_type,
                "keep_id": id_type,
                "size": pa.int64(),
                "first": pa.bool_(),
                "edge": pa.bool_(),
                "part": pa.int32(),
                "sha": pa.string(),
            }
            if firsts_only:
                names["row"] = row_type
            schema = pa.schema(list(names.items()))
        for i, (id_, content) in enumerate(
            zip(batch.column("id").to_pylist(), batch.column("norm").to_pylist())
        ):
            if content != norm:
                if run:
                    close(runs == 1)
                run, norm, sha = [], content, hashlib.sha256(content).hexdigest()
                runs += 1
            keeps = firsts_only and not run
            run.append((id_, rows[i].as_py() if keeps else None))
        if len(out) >= 4096:
            yield flush()
    if run:
        close(True)
    if out:
        yield flush()
    give_back()


def _resolved(runs: DataFrame) -> DataFrame:
    """Joins the runs that partition borders cut: fewer than there are partitions."""
    cut = (
        runs.where("edge AND first")
        .groupBy(F.col("sha").alias("cut_sha"))
        .agg(
            F.min_by("keep_id", "part").alias("whole_keep"),
            F.sum("size").alias("whole_size"),
            F.min("part").alias("whole_part"),
            F.count("*").alias("pieces"),
        )
        .where("pieces > 1")
    )
    # One short row per border at most: a proven bound, and no row need move for it.
    joined = runs.join(F.broadcast(cut), F.expr("edge AND sha = cut_sha"), "left")
    return joined.selectExpr(
        "*",
        "if(pieces IS NULL, keep_id, whole_keep) AS final_keep",
        "coalesce(whole_size, size) AS final_size",
        "first AND (pieces IS NULL OR part = whole_part) AS final_kept",
    )


def content_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``, the hash of the text without white space.

    A null text counts as empty; all empty texts form one group. Of equal texts the
    longest original stays, then the smallest id; a null id comes last. Of repeated
    rows exactly one is ``kept``. Other columns are ignored. An empty table gives none.
    """
    ordered = sorted_contents(docs, id_column, text_column).select("id", "norm")
    kind = ordered.schema["id"].dataType.simpleString()
    runs = ordered.mapInArrow(
        lambda batches: _runs(batches, False),
        f"id {kind}, keep_id {kind}, size long, first boolean, edge boolean, part int, sha string",
    )
    return _resolved(kept(runs, "runs")).selectExpr(
        f"id AS `{id_column}`",
        "final_keep AS keep_id",
        "final_size AS group_size",
        "final_kept AS kept",
        "sha AS text_sha256",
    )


def drop_equal_contents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that :func:`content_groups` keeps, with all their columns."""
    ordered = sorted_contents(docs, id_column, text_column, True).select("id", "norm", "row")
    kind, row = (ordered.schema[c].dataType.simpleString() for c in ("id", "row"))
    runs = ordered.mapInArrow(
        lambda batches: _runs(batches, True),
        f"id {kind}, keep_id {kind}, size long, first boolean, edge boolean, part int,"
        f" sha string, row {row}",
    )
    return _resolved(kept(runs, "firsts")).where("final_kept").select("row.*")
