"""Workbook (.xlsx) scan as a Spark job, one task per sheet, streamed.

``binaryFile`` lists the workbooks (paths only). One small step reads each file's zip directory and
workbook parts by range reads and gives one row per sheet; these rows are dealt one to a task.
A sheet's task opens the file again at that sheet's member and pulls its XML row by row, so
neither a file nor a sheet is ever held: it yields (path, sheet, sheet_pos, row_num, cells
ARRAY<STRING>) in batches of bounded size. Shared strings are held only while their part is
small (its size stands in the zip directory); beyond that a batch of rows is looked up by one
more pass over that part. Header rows (one per sheet, a bounded set) name the columns; the data rows become
columns by position, and text is typed by the same inference as CSV. Parsed rows are
checkpointed so the parse runs once even though the result is read twice.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.functions.names import c, header_names
from tablewash.operators.casts import infer_types, na_to_null
from tablewash.operators.union import union_by_name
from tablewash.session import ensure_checkpoint_dir, ship_package

MAIN_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NS = {"m": MAIN_NS}
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG_REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
SHARED_PART = "xl/sharedStrings.xml"

SHEET_SCHEMA = "path string, sheet string, sheet_pos int, target string"
ROW_SCHEMA = "path string, sheet string, sheet_pos int, row_num int, cells array<string>"
MAX_BROADCAST_SHEETS = 100_000
# tasks that sheets are dealt to (one each, up to this many)
MAX_SHEET_TASKS = 20_000
# shared strings are held in memory up to this size of their part (uncompressed bytes)
SHARED_BYTES = 32 << 20
# cells that wait for one look-up in shared strings that aren't held
WAITING_CELLS = 1 << 19
# rows, cells and characters of one batch
BATCH_ROWS, BATCH_CELLS, BATCH_CHARS = 4096, 1 << 16, 1 << 22


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{MAIN_NS}}}t"))


def _pulled(stream, tag: str, last: str) -> Iterator[ET.Element]:
    """Elements ``tag`` as they end, each forgotten afterwards; stops at the end of ``last``."""
    tag, last = f"{{{MAIN_NS}}}{tag}", f"{{{MAIN_NS}}}{last}"
    above: list[ET.Element] = []
    for event, el in ET.iterparse(stream, events=("start", "end")):
        if event == "start":
            above.append(el)
            continue
        above.pop()
        if el.tag == tag:
            yield el
            above[-1].remove(el)
        elif el.tag == last:
            return


class Shared:
    """A workbook's shared strings: held if small, else looked up by passes over their part."""

    def __init__(self, book: zipfile.ZipFile, limit: int | None = None):
        self.book = book
        self.there = SHARED_PART in book.namelist()
        self.held: list[str] | None = None
        if not self.there:
            self.held = []
        elif book.getinfo(SHARED_PART).file_size <= (SHARED_BYTES if limit is None else limit):
            self.held = list(self._strings())

    def _strings(self) -> Iterator[str]:
        with self.book.open(SHARED_PART) as f:
            for si in _pulled(f, "si", "sst"):
                yield _text(si)

    def look_up(self, wanted: set[int]) -> dict[int, str]:
        """The strings of these numbers."""
        if self.held is not None:
            return {i: self.held[i] for i in wanted}
        left, found = len(wanted), {}
        for i, text in enumerate(self._strings()):
            if i in wanted:
                found[i] = text
                left -= 1
                if not left:
                    break
        if left:
            raise ValueError(f"shared strings {sorted(wanted - set(found))[:5]} are missing")
        return found


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, int, str]]:
    """(sheet, sheet_pos, part) of every sheet, from the workbook's own parts."""
    names = set(book.namelist())
    if "xl/workbook.xml" not in names:
        raise ValueError("no workbook in this file")
    rels = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).findall(f"{{{PKG_REL_NS}}}Relationship"):
            target = r.get("Target")
            rels[r.get("Id")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
    root = ET.fromstring(book.read("xl/workbook.xml"))
    found = []
    for pos, sh in enumerate(root.findall("m:sheets/m:sheet", NS)):
        found.append((sh.get("name"), pos, rels.get(sh.get(f"{{{REL_NS}}}id"), f"xl/worksheets/sheet{pos + 1}.xml")))
    return found


def _cells(row: ET.Element) -> list:
    """Values of a row; a shared string is its number, as an int."""
    cells: list = []
    for i, cell in enumerate(row.findall("m:c", NS)):
        ref = cell.get("r")
        idx = _col_index(ref) if ref else i
        t = cell.get("t")
        v = cell.find("m:v", NS)
        if t == "s":
            val = int(v.text) if v is not None else None
        elif t == "inlineStr":
            is_ = cell.find("m:is", NS)
            val = _text(is_) if is_ is not None else None
        elif t == "b":
            val = None if v is None else ("True" if v.text == "1" else "False")
        else:
            val = None if v is None else v.text
            if val is not None and t in (None, "n") and re.fullmatch(r"-?\d+\.0+", val):
                val = val.split(".")[0]
        while len(cells) < idx:
            cells.append(None)
        cells.append(val)
    return cells


def sheet_rows(book: zipfile.ZipFile, target: str, shared: Shared, waiting_cells: int | None = None) -> Iterator[tuple[int, list]]:
    """(row_num, cells) of a sheet, pulled from its part; rows wait for their shared strings, at most
    ``waiting_cells`` cells at a time."""
    limit = (WAITING_CELLS if waiting_cells is None else waiting_cells) if shared.held is None else 0
    waiting: list[tuple[int, list]] = []
    cells_waiting = number = 0

    def done() -> Iterator[tuple[int, list]]:
        strings = shared.look_up({v for _, cells in waiting for v in cells if isinstance(v, int)})
        for n, cells in waiting:
            yield n, [strings[v] if isinstance(v, int) else v for v in cells]
        waiting.clear()

    with book.open(target) as part:
        for row in _pulled(part, "row", "sheetData"):
            number = int(row.get("r") or number + 1)
            cells = _cells(row)
            waiting.append((number, cells))
            cells_waiting += len(cells)
            if cells_waiting >= limit:
                yield from done()
                cells_waiting = 0
        yield from done()


def parse_workbook(data) -> Iterator[tuple[str, int, int, list]]:
    """Yield (sheet, sheet_pos, row_num, cells) for every row of every sheet of a file (bytes or an open file)."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as book:
        shared = Shared(book)
        for sheet, pos, target in sheets_of(book):
            for number, cells in sheet_rows(book, target, shared):
                yield sheet, pos, number, cells


def _opened(path: str):
    """The file, for range reads."""
    from pyarrow import fs

    from tablewash.sources.census import arrow_uri

    filesystem, inner = fs.FileSystem.from_uri(arrow_uri(path))
    return filesystem.open_input_file(inner)


def _directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path in b["path"]:
            with _opened(path) as f:
                if f.read(len(ZIP_MARK)) != ZIP_MARK:
                    if path.lower().endswith(BINARY_SUFFIX):
                        continue  # the binary format of that suffix isn't read
                    raise ValueError(f"not a workbook: {path}")
                f.seek(0)
                with zipfile.ZipFile(f) as book:
                    out += [(path, *s) for s in sheets_of(book)]
        yield pd.DataFrame(out, columns=["path", "sheet", "sheet_pos", "target"])


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet", "sheet_pos", "row_num", "cells"]
    for b in batches:
        for path, sheet, pos, target in b[["path", "sheet", "sheet_pos", "target"]].itertuples(index=False):
            with _opened(path) as f, zipfile.ZipFile(f) as book:
                out, cells_held, chars = [], 0, 0
                for number, cells in sheet_rows(book, target, Shared(book)):
                    out.append((path, sheet, pos, number, cells))
                    cells_held += len(cells)
                    chars += sum(len(x) for x in cells if x is not None)
                    if len(out) >= BATCH_ROWS or cells_held >= BATCH_CELLS or chars >= BATCH_CHARS:
                        yield pd.DataFrame(out, columns=names)
                        out, cells_held, chars = [], 0, 0
                yield pd.DataFrame(out, columns=names)


# file suffixes read as workbooks, the one that may also name a binary file, first bytes of a zip file (fixed values)
WORKBOOK_SUFFIXES = (".xlsx", ".xlsm", ".xls")
BINARY_SUFFIX = ".xls"
ZIP_MARK = b"PK\x03\x04"


def workbook_sheets(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, sheet, sheet_pos, target) of every sheet of every workbook under ``path``: .xlsx, .xlsm, and
    .xls files whose content is of that kind."""
    ship_package(spark)
    paths = [path] if isinstance(path, str) else list(path)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    is_book = None
    for suffix in WORKBOOK_SUFFIXES:
        cond = F.lower(F.col("path")).endswith(suffix)
        is_book = cond if is_book is None else (is_book | cond)
    return listing.where(is_book).select("path").mapInPandas(_directories, SHEET_SCHEMA)


def workbook_rows(spark: SparkSession, path: str | Sequence[str], sheets: str | Sequence[str] = "all") -> DataFrame:
    """Raw rows of the chosen sheets of every workbook under ``path``, one task per sheet."""
    ensure_checkpoint_dir(spark)
    directory = workbook_sheets(spark, path)
    if not (isinstance(sheets, str) and sheets.lower() == "all"):
        directory = directory.where(F.col("sheet").isin([s.strip() for s in (sheets.split(",") if isinstance(sheets, str) else sheets)]))
    directory = directory.checkpoint()  # a row per sheet
    tasks = max(1, min(directory.count(), MAX_SHEET_TASKS))
    return directory.repartition(tasks).mapInPandas(_parsed, ROW_SCHEMA)


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    rows = workbook_sheets(spark, path).select("sheet", "sheet_pos").distinct().orderBy("sheet_pos").collect()
    return [r["sheet"] for r in rows]


def read_workbook(
    spark: SparkSession,
    path: str | Sequence[str],
    sheets: str | Sequence[str] = "all",
    merge: bool = True,
    infer: bool = True,
    sheet_col: str | None = "sheet",
    row_col: str | None = None,
) -> DataFrame | dict[str, DataFrame]:
    """Sheets as tables; the first row of each sheet is its header.

    ``merge=True``: one DataFrame, union by column name (the reference's
    concat) with a ``sheet`` column. Sheets sharing a header are read by one
    select, so a thousand workbooks of one layout stay one plan branch.
    ``merge=False``: a dict of DataFrames by sheet name."""
    rows = workbook_rows(spark, path, sheets).checkpoint()
    first = rows.groupBy("path", "sheet", "sheet_pos").agg(F.min("row_num").alias("row_num"))
    # one header row per sheet: bounded by the number of sheets
    headers = rows.join(first, ["path", "sheet", "sheet_pos", "row_num"]).orderBy("path", "sheet_pos").collect()
    groups: dict[tuple, list] = {}
    for h in headers:
        key = (tuple(header_names(h["cells"])),) if merge else (h["sheet"],)
        groups.setdefault(key, []).append((h["path"], h["sheet"], h["row_num"], header_names(h["cells"])))
    frames: dict[str, DataFrame] = {}
    for key, members in groups.items():
        names = members[0][3]
        keys = spark.createDataFrame([(p, sh, rn) for p, sh, rn, _ in members], "path string, sheet string, header_row int")
        # one row per sheet: broadcast only while that count is small
        keys = F.broadcast(keys) if len(members) <= MAX_BROADCAST_SHEETS else keys
        body = rows.join(keys, ["path", "sheet"]).where(F.col("row_num") > F.col("header_row"))
        # try_element_at: a short row gives NULL, not an error, under ANSI mode
        cols = [F.try_element_at(F.col("cells"), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
        if merge and sheet_col:
            cols.append(F.col("sheet").alias(sheet_col))
        if row_col:
            cols += [F.col("path").alias(f"{row_col}_path"), F.col("row_num").alias(row_col)]
        df = na_to_null(body.select(*cols))
        if infer:
            df = infer_types(df, list(names))
        frames[members[0][1] if not merge else "|".join(names)] = df
    if not merge:
        return frames
    if not frames:
        raise ValueError("no sheet found")
    if len(frames) == 1:
        return next(iter(frames.values()))
    return union_by_name(list(frames.values()))


# ------------------------------------------------------------------ fixtures

def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal .xlsx (inline strings, numbers) for tests and examples."""
    from xml.sax.saxutils import escape

    def col_name(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            + "".join(
                f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" '
                'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                for i in range(len(sheets))
            )
            + "</Types>",
        )
        z.writestr(
            "_rels/.rels",
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PKG_REL_NS}">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
            "</Relationships>",
        )
        z.writestr(
            "xl/workbook.xml",
            f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS["m"]}" xmlns:r="{REL_NS}"><sheets>'
            + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
            + "</sheets></workbook>",
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PKG_REL_NS}">'
            + "".join(
                f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
                f'Target="worksheets/sheet{i + 1}.xml"/>'
                for i in range(len(sheets))
            )
            + "</Relationships>",
        )
        for i, rows in enumerate(sheets.values()):
            xml_rows = []
            for r, row in enumerate(rows):
                cells = []
                for j, v in enumerate(row):
                    ref = f"{col_name(j)}{r + 1}"
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                    elif isinstance(v, (int, float)):
                        cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                    else:
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                xml_rows.append(f'<row r="{r + 1}">' + "".join(cells) + "</row>")
            z.writestr(
                f"xl/worksheets/sheet{i + 1}.xml",
                f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS["m"]}"><sheetData>'
                + "".join(xml_rows)
                + "</sheetData></worksheet>",
            )
    return buf.getvalue()
