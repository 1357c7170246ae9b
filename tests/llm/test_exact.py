import hashlib
import random
import re

from tests.llm.common import SCHEMA, odd_rows, odd_table
from worklens.llm import exact


def brute(rows):
    groups = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append(
            (-len(text or ""), doc_id is None, doc_id or 0, i)
        )
    out = []
    for norm, members in groups.items():
        members.sort()
        keep = members[0]
        for member in members:
            out.append(
                (
                    rows[member[3]][0], rows[keep[3]][0], len(members), member is keep,
                    hashlib.sha256(norm.encode()).hexdigest(),
                )
            )
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    assert found(exact.content_groups(odd_table(spark))) == brute(odd_rows())


def test_groups_across_partitions(spark):
    random.seed(3)
    texts = ["aaa b", "aa ab", " aaab ", "c", "", "d" * 50]
    rows = [
        (i, random.choice(texts) if random.random() < 0.9 else f"own {i}", "en", "s", 1)
        for i in range(900)
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(13)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(exact.content_groups(docs)) == brute(rows)
        stay = exact.drop_equal_contents(docs)
        assert sorted(r.doc_id for r in stay.collect()) == sorted(
            r[0] for r in brute(rows) if r[3]
        )
        assert stay.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_repeated_row_stays_once(spark):
    rows = [(1, "x", "en", "s", 1)] * 5
    assert exact.drop_equal_contents(spark.createDataFrame(rows, SCHEMA)).count() == 1
