"""Writes workbooks, for the tests and queries that read them."""

from __future__ import annotations

import datetime as dt
import io
import sys
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts>'
    '<numFmt numFmtId="170" formatCode="dd/mm/yyyy\\ hh:mm:ss;@"/>'
    '<numFmt numFmtId="171" formatCode="[h]:mm:ss"/><numFmt numFmtId="172" formatCode="0.0&quot;d&quot;"/>'
    '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/>'
    '<xf numFmtId="172"/><xf numFmtId="14"/></cellXfs></styleSheet>'
)
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(column: int) -> str:
    column, out = column + 1, ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook(sheets: dict[str, Iterable[list]], from_1904: bool = False) -> bytes:
    """A file of sheets of rows: texts are shared, times and lengths of time are days with a
    style, None is left out, and a tuple is a cell's own attributes and content."""
    texts: dict[str, int] = {}
    begin = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)

    def cell(value, at: str) -> str:
        if isinstance(value, tuple):
            return f'<c r="{at}" {value[0]}>{value[1]}</c>'
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, dt.datetime):
            return f'<c r="{at}" s="1"><v>{(value - begin) / dt.timedelta(1)!r}</v></c>'
        if isinstance(value, dt.timedelta):
            return f'<c r="{at}" s="2"><v>{value / dt.timedelta(1)!r}</v></c>'
        if isinstance(value, str):
            return f'<c r="{at}" t="s"><v>{texts.setdefault(value, len(texts))}</v></c>'
        return f'<c r="{at}"><v>{value!r}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for number, rows in enumerate(sheets.values(), 1):
            with book.open(f"xl/worksheets/sheet{number}.xml", "w") as sheet:
                sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for i, row in enumerate(rows, 1):
                    cells = "".join(
                        cell(v, f"{letters(c)}{i}") for c, v in enumerate(row) if v is not None
                    )
                    sheet.write(f'<row r="{i}">{cells}</row>'.encode())
                sheet.write(b"</sheetData></worksheet>")
        listed = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)
        )
        links = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><workbookPr date1904="{int(from_1904)}"/>'
            f"<sheets>{listed}</sheets></workbook>",
        )
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        shared = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{shared}</sst>')
        book.writestr("xl/styles.xml", STYLES)
    return out.getvalue()
