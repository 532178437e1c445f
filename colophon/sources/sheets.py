"""Spreadsheets as .xlsx files: reading values, finding sheets and columns, writing.

The cells of a workbook are read once by one task from its bytes; columns and sheets are resolved on the
driver from the header alone. Standard library only.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass

# Namespaces of the parts of a workbook.
M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def header_key(header) -> str:
    """Form in which headers are compared: white space one space, trimmed, case folded."""
    return " ".join(str(header or "").split()).casefold()


def column_number(letters: str) -> int:
    """0-based number of a column by its letters."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    # phonetic guides are no text of the cell
    return ["".join(t.text or "" for part in item if part.tag != M + "rPh" for t in part.iter(M + "t")) for item in root.iter(M + "si")]


def sheet_parts(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in their order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter(P + "Relationship")}
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    part = lambda target: target.lstrip("/") if target.startswith("/") else "xl/" + target
    return [(s.get("name"), part(links[s.get(R + "id")])) for s in book.iter(M + "sheet")]


def _value(cell, strings: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(M + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(M + "t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind in ("str", "e", "d"):
        return value.text
    number = float(value.text)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, dict[int, str]]]:
    """(sheet, sheet number, row, {column: text}) of the rows that hold anything."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings = _strings(archive)
        for number, (name, part) in enumerate(sheet_parts(archive)):
            at = 0
            for _, row in ElementTree.iterparse(archive.open(part)):
                if row.tag != M + "row":
                    continue
                at = int(row.get("r") or at + 1)
                cells, column = {}, -1
                for cell in row.iter(M + "c"):
                    letters = re.match(r"[A-Za-z]+", cell.get("r") or "")
                    column = column_number(letters.group()) if letters else column + 1
                    text = _value(cell, strings)
                    if text is not None:
                        cells[column] = text
                if cells:
                    yield name, number, at, cells
                row.clear()


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, sheet_no, row_no, cells): rows of all workbooks under a path; ``cells`` maps the 0-based column to its text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("path", "content")

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            for name, number, row, cells in sheet_cells(r["content"]):
                yield r["path"], name, number, row, list(cells.items())

    return arrow_pass(files, rows, "path string, sheet string, sheet_no int, row_no int, cells map<int,string>")


def resolve_sheet(sheets: list[tuple[str, list]], wanted: str | int | None, required: list[list[str]] | None = None) -> str:
    """Name of a sheet among (name, header): by name, by 0-based number, or for 'auto' the first whose header has all ``required`` columns.

    ``required`` lists the accepted headers of each column.
    """
    names = [name for name, _ in sheets]
    if wanted in (None, "auto"):
        for name, header in sheets:
            keys = {header_key(h) for h in header}
            if all(any(header_key(a) in keys for a in accepted) for accepted in required or []):
                return name
        raise ValueError(f"no sheet has the required columns; sheets: {names}")
    if wanted in names:
        return str(wanted)
    if str(wanted).isdigit() and int(wanted) < len(names):
        return names[int(wanted)]
    raise ValueError(f"no sheet {wanted!r}; sheets: {names}")


def resolve_column(header: list, accepted: list[str], letters: bool = False) -> int:
    """Number of the column whose header is one of ``accepted``: an exact one first, then by comparable form.

    With ``letters`` a name that is no header may be a column's letters. Several columns that fit are an error.
    """
    for form in (lambda h: str(h or "").strip(), header_key):
        wanted = {form(a) for a in accepted}
        found = [i for i, h in enumerate(header) if h is not None and form(h) in wanted]
        if len(found) > 1:
            raise ValueError(f"several columns fit {accepted}: {[column_letters(i) for i in found]}")
        if found:
            return found[0]
    if letters:
        for a in accepted:
            if re.fullmatch(r"[A-Za-z]{1,3}", a) and column_number(a) < len(header):
                return column_number(a)
    raise ValueError(f"no column fits {accepted}; headers: {header}")


def read_sheet(spark: SparkSession, path: str, sheet: str | int | None = None, columns: dict[str, list[str]] | None = None, letters: bool = False) -> DataFrame:
    """Data rows of one sheet of a workbook, all values as text: row_no and the columns of the header, or those of ``columns`` (name, accepted headers).

    Blank rows are left out; ``row_no`` is the sheet's. The header rows of the sheets (few) are the only rows collected.
    """
    cells = workbook_cells(spark, path)
    heads: dict[str, list] = {}
    first = cells.groupBy("sheet_no", "sheet").agg(F.min_by("cells", "row_no").alias("cells")).orderBy("sheet_no")
    for r in first.collect():
        heads[r["sheet"]] = [r["cells"].get(i) for i in range(max(r["cells"]) + 1)]
    name = resolve_sheet(list(heads.items()), sheet, list((columns or {}).values()))
    header = heads[name]
    if columns is None:
        keys = [header_key(h) for h in header if h is not None]
        if len(set(keys)) < len(keys):
            raise ValueError(f"headers repeat: {header}")
        chosen = {str(h).strip(): i for i, h in enumerate(header) if h is not None}
    else:
        chosen = {c: resolve_column(header, accepted, letters) for c, accepted in columns.items()}
    rows = cells.where(F.col("sheet") == name)
    top = rows.agg(F.min("row_no")).head()[0]
    values = {c: F.try_element_at("cells", F.lit(i)) for c, i in chosen.items()}
    filled = F.exists(F.map_values("cells"), lambda v: v.rlike(r"\S"))
    return rows.where((F.col("row_no") > top) & filled).select("row_no", *[v.alias(c) for c, v in values.items()])


# The parts of the smallest workbook.
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{P[1:-1]}"><Relationship Id="rId1" Type="{R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{P[1:-1]}"><Relationship Id="rId1" Type="{R[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def workbook_bytes(header: list[str], rows: Iterator[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet. Numbers and truth values keep their kind; None leaves the cell out."""

    def cell(value, place: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{place}"><v>{value!r}</v></c>'
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in _PARTS.items():
            archive.writestr(name, text)
        archive.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{M[1:-1]}" xmlns:r="{R[1:-1]}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with archive.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{M[1:-1]}"><sheetData>'.encode())
            for n, row in enumerate(itertools.chain([header], rows), 1):
                part.write((f'<row r="{n}">' + "".join(cell(v, f"{column_letters(i)}{n}") for i, v in enumerate(row)) + "</row>").encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()
