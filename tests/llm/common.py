"""Odd tables and plain-Python versions that the operators are held against."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names the operators use inside.
CLASHING = (
    "id", "row", "kept", "norm", "hash", "head", "part", "edge", "size", "sha", "f", "node", "root",
    "least", "weight", "p", "tokens", "y", "meta", "held", "bucket", "data", "a", "b", "text_id", "m",
    "n", "gone_id", "t_lang", "level", "word_chars", "base_failed", "score", "s",
)

PROSE = "the quick brown fox jumps over the lazy dog while a small bird sings in the old tree"


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, PROSE, "en", "s1", len(PROSE)),
        (2, PROSE, "en", "s1", len(PROSE)),
        (2, PROSE, "en", "s1", len(PROSE)),
        (3, PROSE + "\n", "en", "s2", None),
        (4, "", "de", "s2", 0),
        (5, None, "de", None, None),
        (6, " \n\t ", None, "s1", 4),
        (None, PROSE, "en", "s1", 1),
        (None, None, None, None, None),
        (7, long, "en", "s1", len(long)),
        (8, "x" * 20_000, "fr", "s3", 20_000),
        (9, "\x1cä ß　漢 🙂\x85\x00", "fr", "s3", 9),
        (10, "One. Two! Three?\n" * 50, "en", "s3", -5),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_table(spark, rows=None):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHING])


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def roots(n, links):
    """The smallest member of each element's component."""
    to = list(range(n))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
