"""Workbooks without libraries: reading sheets as text, writing sheets a row at a time."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MAX_CHARS, MAX_ROWS = 32_767, 1_048_575


class WorkbookError(ValueError):
    pass


def choose_sheet(sheets: list[str], wanted: str | None) -> str:
    if wanted is not None:
        if wanted not in sheets:
            raise WorkbookError(f"There is no sheet '{wanted}'. Sheets: {', '.join(sheets)}.")
        return wanted
    if len(sheets) != 1:
        raise WorkbookError(f"The workbook has several sheets; name one: {', '.join(sheets)}.")
    return sheets[0]


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


class Workbook:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise WorkbookError("The file is not a readable Excel workbook.") from e
        self.paths = {}
        for s in book.iter(f"{_MAIN}sheet"):
            target = links[s.get(f"{_REL}id")]
            self.paths[s.get("name")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
        properties = book.find(f"{_MAIN}workbookPr")
        self.epoch = dt.datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        self.strings = self._shared()
        self.dates = self._date_styles()

    @property
    def sheets(self) -> list[str]:
        return list(self.paths)

    def _shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        root = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))
        return ["".join(t.text or "" for r in [s] for t in r.iter(f"{_MAIN}t")) for s in root.iter(f"{_MAIN}si")]

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
        cells = root.find(f"{_MAIN}cellXfs")
        out = set()
        for i, x in enumerate(cells if cells is not None else ()):
            n = int(x.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, ""))
            if n in _DATE_FORMATS or n in own and re.search(r"[ymdhs]", code, re.IGNORECASE) and "general" not in code.lower():
                out.add(i)
        return out

    def _text(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.strings[int(value.text)]
        if kind == "b":
            return "TRUE" if value.text == "1" else "FALSE"
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            at = self.epoch + dt.timedelta(days=float(value.text))
            at = (at + dt.timedelta(milliseconds=500)).replace(microsecond=0)
            return at.strftime("%Y-%m-%d") if float(value.text).is_integer() else at.strftime("%Y-%m-%d %H:%M:%S")
        if kind == "n":
            v = float(value.text)
            return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
        return value.text

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        with self.zip.open(self.paths[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._text(c)
                yield cells
                row.clear()


#: Fill colours of cells, by what was found in them.
FILLS = {"error": "FFFFC7CE", "warning": "FFFFEB9C", "info": "FFDDEBF7", "corrected": "FFC6EFCE"}
_STYLES = ["", "head", *FILLS, *[f"head-{k}" for k in FILLS]]
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _style_sheet() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in FILLS.values())
    cells = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/><xf numFmtId="0" fontId="1" fillId="0" borderId="0" applyFont="1"/>'
    for font in (0, 1):
        cells += "".join(f'<xf numFmtId="0" fontId="{font}" fillId="{i + 2}" borderId="0" applyFill="1" applyFont="1"/>' for i in range(len(FILLS)))
    return (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts>'
        f'<fills count="{len(FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(_STYLES)}">{cells}</cellXfs></styleSheet>'
    )


def _cell(reference: str, value: object, style: str) -> str:
    s = f' s="{_STYLES.index(style)}"' if style else ""
    if value is None or value == "":
        return f'<c r="{reference}"{s}/>' if style else ""
    if isinstance(value, bool):
        return f'<c r="{reference}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) < 1e15:
        return f'<c r="{reference}"{s}><v>{value!r}</v></c>'
    text = _CONTROL.sub("", str(value))[:MAX_CHARS]
    return f'<c r="{reference}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


class Writer:
    """A workbook written sheet by sheet; rows are (value, style) pairs and go straight to the archive."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []

    def sheet(self, name: str, widths: list[float], rows: Iterable[list[tuple[object, str]]], header: bool = True) -> int:
        """Write a sheet; with a header it is frozen and can be filtered. Returns the number of rows."""
        self.names.append(name)
        count = 0
        with self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True) as f:
            pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if header else ""
            columns = "".join(f'<col min="{i}" max="{i}" width="{w:g}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            f.write(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{pane}{"<cols>" + columns + "</cols>" if columns else ""}<sheetData>'.encode())
            for row in rows:
                count += 1
                f.write((f'<row r="{count}">' + "".join(_cell(f"{column_letters(i)}{count}", v, s) for i, (v, s) in enumerate(row)) + "</row>").encode())
            f.write(b"</sheetData>")
            if header and widths and count:
                f.write(f'<autoFilter ref="A1:{column_letters(len(widths) - 1)}{count}"/>'.encode())
            f.write(b"</worksheet>")
        return count

    def close(self) -> None:
        n = len(self.names)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        self.zip.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        self.zip.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(self.names, 1)) + "</sheets></workbook>")
        self.zip.writestr("xl/styles.xml", _style_sheet())
        self.zip.close()
