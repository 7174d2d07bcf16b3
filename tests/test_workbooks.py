"""Streamed workbook scan and per-sheet analysis."""

import io
import re
import tracemalloc
import zipfile

import pytest

from tablewash.plans.extract import analyze_file, rule_scorer
from tablewash.plans.sheets import sheet_notes, sheet_roles
from tablewash.sources import readers, workbook
from tablewash.sources.workbook import workbook_bytes


def with_shared_strings(data: bytes) -> bytes:
    """The same workbook with its inline strings moved to the shared part, rich text cut in runs."""
    strings: list[str] = []
    out = io.BytesIO()

    def share(m):
        strings.append(m[1])
        return f't="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            text = old.read(name).decode()
            if name.startswith("xl/worksheets/"):
                text = re.sub(r't="inlineStr"><is><t xml:space="preserve">(.*?)</t></is></c>', share, text, flags=re.S)
            new.writestr(name, text)
        items = "".join(f"<si><r><t>{x[:1]}</t></r><r><t>{x[1:]}</t></r></si>" for x in strings)
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbook.MAIN_NS}">{items}</sst>')
    return out.getvalue()


SHEETS = {"first": [["k", "v"], *[[f"key {i % 17}", i * 1.5] for i in range(300)]], "second": [["x"], [None], ["a&b"], [True]]}


@pytest.mark.parametrize("limit, waiting", [(1 << 20, 10), (0, 1), (0, 7), (0, 100_000)])
def test_shared_strings_held_or_looked_up(limit, waiting):
    plain = list(workbook.parse_workbook(workbook_bytes(SHEETS)))
    with zipfile.ZipFile(io.BytesIO(with_shared_strings(workbook_bytes(SHEETS)))) as book:
        shared = workbook.Shared(book, limit)
        assert (shared.held is None) == (limit == 0)
        got = [(s, p, n, cells) for s, p, t in workbook.sheets_of(book) for n, cells in workbook.sheet_rows(book, t, shared, waiting)]
    assert got == plain and len(got) == 305
    assert plain[1] == ("first", 0, 2, ["key 0", "0"]) and plain[-1] == ("second", 1, 4, ["True"])


def test_missing_shared_string_raises():
    data = with_shared_strings(workbook_bytes({"s": [["a"], ["b"]]}))
    with zipfile.ZipFile(io.BytesIO(data)) as book, pytest.raises(ValueError, match="missing"):
        workbook.Shared(book, 0).look_up({0, 9})


def test_memory_does_not_follow_the_sheet():
    """Rows are pulled: eight times the rows take about the same memory."""
    peaks = []
    for n in (6_000, 48_000):
        data = with_shared_strings(workbook_bytes({"s": [["k", "v"], *[[f"some text of row {i}", i] for i in range(n)]]}))
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            tracemalloc.start()
            rows = workbook.sheet_rows(book, "xl/worksheets/sheet1.xml", workbook.Shared(book, 0), 8_000)
            assert sum(1 for _ in rows) == n + 1
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[1] < 1.7 * peaks[0]


def test_rows_and_cells_without_references(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook_bytes({"s": [["a", "b"], [1, None], [2, "x"]]}))) as old, zipfile.ZipFile(data, "w") as new:
        for name in old.namelist():
            new.writestr(name, re.sub(rb' r="[A-Z]*\d+"', b"", old.read(name)))
    (tmp_path / "book.xlsx").write_bytes(data.getvalue())
    rows = workbook.workbook_rows(spark, str(tmp_path)).orderBy("row_num").collect()
    assert [(r.row_num, r.cells) for r in rows] == [(1, ["a", "b"]), (2, ["1"]), (3, ["2", "x"])]


def test_suffix_xls_is_read_by_content(spark, tmp_path):
    (tmp_path / "new.xls").write_bytes(workbook_bytes({"s": [["a"], [7]]}))
    assert [r.a for r in readers.read_any(spark, str(tmp_path / "new.xls")).collect()] == [7]
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0 binary")  # that format is left out
    assert workbook.workbook_sheets(spark, str(tmp_path)).count() == 1
    (tmp_path / "bad.xlsx").write_bytes(b"text")
    with pytest.raises(Exception, match="not a workbook"):
        workbook.workbook_sheets(spark, str(tmp_path)).collect()


def test_one_task_per_sheet(spark, tmp_path):
    for b in range(3):
        (tmp_path / f"b{b}.xlsx").write_bytes(workbook_bytes({f"s{i}": [["a"], *[[i]] * 50] for i in range(4)}))
    rows = workbook.workbook_rows(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 12
    held = [n for n in rows.rdd.mapPartitions(lambda x: [len({(r.path, r.sheet) for r in x})]).collect() if n]
    assert sum(held) == 12 and max(held) <= 2


def test_each_sheet_has_its_own_roles(spark, tmp_path):
    one = {"Anna": [["Seance", " Exercice "], ["S1", "lunge"], ["S1", "squat"], [None, "row"]],
           "Ben": [["Code_Patient", "x", "NOTES"], [None, 1, "press"], ["B7", 2, "None"], ["B8", 3, "dip"]]}
    two = {"Anna": [["texte", "day", "id"], ["plank", 3, 40], ["bridge", None, 41]], "Empty": [["notes"]], "": [["notes"], ["crawl"]]}
    (tmp_path / "one.xlsx").write_bytes(workbook_bytes(one))
    (tmp_path / "two.xlsx").write_bytes(workbook_bytes(two))
    rows = workbook.workbook_rows(spark, str(tmp_path)).checkpoint()
    places = {(r.path[-8:], r.sheet): (r.session_at, r.patient_at, r.text_at) for r in sheet_roles(rows).collect()}
    assert places == {("one.xlsx", "Anna"): (1, None, 2), ("one.xlsx", "Ben"): (None, 1, 3), ("two.xlsx", "Anna"): (2, 3, 1),
                      ("two.xlsx", "Empty"): (None, None, 1), ("two.xlsx", ""): (None, None, 1)}
    got = sorted((r.sheet[-10:], r.patient_id, r.session, r.row_ordinal, r.text) for r in sheet_notes(rows).collect())
    assert got == [
        ("one.xlsx#0", "Anna", "S1", 1, "lunge"), ("one.xlsx#0", "Anna", "S1", 2, "squat"), ("one.xlsx#0", "Anna", "nan", 3, "row"),
        ("one.xlsx#1", "B7", "session_1", 1, "press"), ("one.xlsx#1", "B7", "session_3", 3, "dip"),
        ("two.xlsx#0", "40", "3", 1, "plank"), ("two.xlsx#0", "40", "nan", 2, "bridge"),
        ("two.xlsx#2", "unknown", "session_1", 1, "crawl"),
    ]
    table = analyze_file(spark, str(tmp_path), rule_scorer).collect()
    assert sorted((r.patient_id, r.session, r.exercise_num) for r in table if r.session == "S1") == [("Anna", "S1", 1), ("Anna", "S1", 2)]
    assert {r.patient_id for r in analyze_file(spark, str(tmp_path), rule_scorer, sheets="Ben").collect()} == {"B7"}


def test_sheet_without_text_column_raises(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes({"good": [["notes"], ["a"]], "bad": [["id"], [1]]}))
    with pytest.raises(ValueError, match="'bad'"):
        analyze_file(spark, str(tmp_path / "b.xlsx"), rule_scorer)
    with pytest.raises(ValueError, match="scope"):
        analyze_file(spark, str(tmp_path / "b.xlsx"), rule_scorer, scope="x")
    assert analyze_file(spark, str(tmp_path / "b.xlsx"), rule_scorer, sheets="good").count() == 1


def test_written_workbooks_are_bounded(spark, tmp_path, monkeypatch):
    """Sheets grow over several files, each of few rows and characters; order and rows stay."""
    import os

    from tablewash.plans import catalog

    monkeypatch.setattr(catalog, "BOOK_ROWS", 7)
    monkeypatch.setattr(catalog, "BOOK_CHARS", 60)
    rows = [(i, "ab"[i % 2], "x" * (50 if i % 10 == 0 else 2) if i % 4 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, s string, t string").coalesce(1)
    base = catalog._write_workbooks(spark, df, str(tmp_path / "books"), ["i", "t"], sheet_col="s")
    files = sorted(f for f in os.listdir(base) if f.endswith(".xlsx"))
    assert len(files) >= 8
    order = []
    for f in files:
        with open(f"{base}/{f}", "rb") as book:
            own = [r for r in workbook.parse_workbook(book.read()) if r[2] > 1]
        assert len(own) <= 7 and sum(len(r[3][1] or "") for r in own if len(r[3]) > 1) <= 60
        order += sorted(int(r[3][0]) for r in own)
    assert order == list(range(50))
    got = workbook.read_workbook(spark, base).select("i", "sheet", "t")
    assert sorted(tuple(r) for r in got.collect()) == [tuple(r) for r in rows]
