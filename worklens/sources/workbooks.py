"""Workbook uploads (xlsx): the rows of a sheet as the text that the other uploads show.

Spark reads the files, a workbook per row, and its tasks take the sheets apart: the zipped XML
is read as a stream, so that a task holds the file, its table of shared texts and a batch
of rows. Times and durations are numbers of days that only their style tells from others;
they become the texts that the log's typing reads.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.session import shared_dir

# What runs inside tasks travels with the job, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUFFIX = ".xlsx"
#: Rows of a record batch.
BATCH_ROWS = 4096
#: Rows of a file of cells, so that many tasks read those of a large workbook.
ROWS_PER_FILE = 100_000

# Built-in number formats that show days, and lengths of time.
DAY_FORMATS = frozenset({14, 15, 16, 17, 22})
TIME_FORMATS = frozenset({18, 19, 20, 21, 45, 46, 47})


def _kind_of(code: str) -> str:
    """What a number format shows: a ``day``, a length of ``time``, or a plain number."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.lower().split(";")[0])
    if re.search(r"\[(h+|m+|s+)\]", plain):
        return "time"
    plain = re.sub(r"\[[^\]]*\]", "", plain)
    if re.search("[yd]", plain) or re.fullmatch("m+", plain):
        return "day"
    return "time" if re.search("[hs]", plain) else "number"


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _children(element: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in element.iter() if _local(e) == name)


class Workbook:
    """One file: its sheets by name, shared texts, and what its styles show."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = self._tree("xl/workbook.xml")
        self.from_1904 = any(
            e.get("date1904") in ("1", "true") for e in _children(book, "workbookPr")
        )
        targets = {
            e.get("Id"): e.get("Target")
            for e in _children(self._tree("xl/_rels/workbook.xml.rels"), "Relationship")
        }
        self.sheets = {}
        for e in _children(book, "sheet"):
            link = next(v for k, v in e.attrib.items() if k.endswith("}id"))
            target = targets[link]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            self.sheets[e.get("name")] = path
        self.texts = list(self._shared_texts())
        self.kinds = self._style_kinds()

    def _tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _stream(self, name: str) -> Iterator[ElementTree.Element]:
        """Elements as they end; each is let go after its turn."""
        with self.zip.open(name) as part:
            for _, element in ElementTree.iterparse(part):
                yield element

    def _shared_texts(self) -> Iterator[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return
        for element in self._stream("xl/sharedStrings.xml"):
            if _local(element) == "si":
                yield _text_of(element)
                element.clear()

    def _style_kinds(self) -> list[str]:
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        styles = self._tree("xl/styles.xml")
        kinds = dict.fromkeys(DAY_FORMATS, "day") | dict.fromkeys(TIME_FORMATS, "time")
        kinds |= {
            int(e.get("numFmtId")): _kind_of(e.get("formatCode", ""))
            for e in _children(styles, "numFmt")
        }
        used = next(_children(styles, "cellXfs"), None)
        formats = [] if used is None else [x for x in used if _local(x) == "xf"]
        return [kinds.get(int(x.get("numFmtId", 0)), "number") for x in formats]

    def rows(self, sheet: str | None = None) -> Iterator[dict[int, str]]:
        """The cells of a sheet (the first one by default) by column, row after row; cells and
        rows without a value are left out."""
        path = self.sheets[sheet] if sheet else next(iter(self.sheets.values()))
        for element in self._stream(path):
            if _local(element) != "row":
                continue
            cells, column = {}, -1
            for cell in element:
                column = _column_of(cell.get("r")) if cell.get("r") else column + 1
                shown = self._shown(cell)
                if shown:
                    cells[column] = shown
            element.clear()
            if cells:
                yield cells

    def _shown(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _text_of(cell)
        value = next((e.text for e in cell if _local(e) == "v"), None)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(value)]
        if kind == "b":
            return "TRUE" if value == "1" else "FALSE"
        if kind in ("str", "d"):
            return value
        style = int(cell.get("s", 0))
        shows = self.kinds[style] if style < len(self.kinds) else "number"
        number = float(value)
        if shows == "day":
            return _day_text(number, self.from_1904)
        if shows == "time":
            return _time_text(number)
        return str(int(number)) if number.is_integer() and abs(number) < 2**53 else value


def _text_of(element: ElementTree.Element) -> str:
    """The text of a cell's runs, without the reading aids of some scripts."""
    aids = {t for aid in _children(element, "rPh") for t in aid.iter()}
    return "".join(t.text or "" for t in _children(element, "t") if t not in aids)


def _column_of(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = 26 * number + ord(letter) - 64
    return number - 1


def _day_text(days: float, from_1904: bool) -> str | None:
    """``dd/MM/yyyy HH:mm:ss`` of a number of days, to the nearest second."""
    begin = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
    if not from_1904 and days < 60:
        begin += dt.timedelta(1)  # the format knows a 29 February 1900
    try:
        return f"{begin + dt.timedelta(seconds=round(days * 86400)):%d/%m/%Y %H:%M:%S}"
    except OverflowError:
        return None


def _time_text(days: float) -> str | None:
    """``N days HH:MM:SS`` of a number of days, with milliseconds if it has some."""
    if days < 0:
        return None
    whole, millis = divmod(round(days * 86_400_000), 1000)
    clock = f"{whole % 86400 // 3600:02d}:{whole % 3600 // 60:02d}:{whole % 60:02d}"
    return f"{whole // 86400} days {clock}" + (f".{millis:03d}" if millis else "")


def _names(header: dict[int, str]) -> dict[int, str]:
    """Columns by place; of equal names the later ones get a number, as does one without."""
    names, seen = {}, {}
    for column in range(max(header) + 1):
        name = header.get(column, "").strip() or f"_c{column}"
        again = seen[name] = seen.get(name, -1) + 1
        names[column] = f"{name}.{again}" if again else name
    return names


def _cells(batches: Iterator[pa.RecordBatch], sheet: str | None) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("_up_time", pa.timestamp("us", "UTC")), ("_up_path", pa.string()),
            ("_up_place", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())),
        ]
    )
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("time", "path", "content"))
        for time, path, content in zip(*columns):
            rows = Workbook(content).rows(sheet)
            header = next(rows, None)
            if header is None:
                continue
            names, out = _names(header), []
            # Every row lists every column, so that a column without values is there too.
            for place, cells in enumerate(rows):
                listed = [(names[c], cells.get(c)) for c in names]
                out.append((time, path, place, listed))
                if len(out) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                    )
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                )


def placed_workbooks(
    spark: SparkSession, files: list[str], sheet: str | None = None
) -> DataFrame | None:
    """The rows of a sheet of each workbook (the first by default), all columns as text, with
    the columns that ``number_rows`` needs; none if no workbook has a row below its header.

    Workbooks may have different columns. A cell without a value, or with an error, is null;
    rows without any value are left out. Each workbook is taken apart once: its cells are
    written to the shared folder, for the passes that follow.
    """
    books = spark.read.format("binaryFile").load(files)
    cells = books.selectExpr(
        "modificationTime AS time", "_metadata.file_path AS path", "content"
    ).mapInArrow(
        lambda batches: _cells(batches, sheet),
        "_up_time timestamp, _up_path string, _up_place long, cells map<string,string>",
    )
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    cells.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    cells = spark.read.schema(cells.schema).parquet(path)
    # one row per column name
    keys = cells.select(F.explode(F.map_keys("cells")).alias("name")).distinct().collect()
    if not keys:
        return None
    return cells.select(
        *[F.element_at("cells", r.name).alias(r.name) for r in sorted(keys)],
        "_up_time", "_up_path", F.lit(0).cast("long").alias("_up_block"), "_up_place",
    )
