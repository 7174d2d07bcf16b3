import json
import os

import pytest
from pyspark.sql import functions as F

from tablewash.sinks import writers
from tablewash.sources import census, readers, workbook


@pytest.fixture()
def files(tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "ships.csv").write_text("ship,tonnes,flag\nOrka,1200,NO\nPelikan,880,NL\nSirius,,DK\nVega,2310,NO\n", encoding="utf-8")
    (d / "calls.json").write_text(json.dumps([{"berth": 4, "hours": [6, 18]}, {"berth": 11, "hours": []}]), encoding="utf-8")
    (d / "hulls.json").write_text(json.dumps([
        {"id": i, "hull": {"size": {"length": 80 + i, "beam": 12.5}, "steel": i % 2 == 0}, "crew": {"officers": i}} for i in range(5)
    ]), encoding="utf-8")
    (d / "fake_csv.csv").write_text("[17, 4]", encoding="utf-8")
    (d / "notes.txt").write_text("x", encoding="utf-8")
    (d / "latin.csv").write_bytes("pilot,port\nBjørn,Ålesund\n".encode("iso-8859-1"))
    (d / "book.xlsx").write_bytes(workbook.workbook_bytes({
        "s1": [["id", "session", "exercise"], [1, "S1", "squat"], [2, "S1", "push-up"]],
        "s2": [["id", "session", "exercise", "extra"], [3, "S2", "squat", True]],
    }))
    return d


def test_census(spark, files):
    rows = {r["file_name"]: r for r in census.file_census(spark, str(files)).collect()}
    assert rows["ships.csv"]["status"] == "ok" and rows["ships.csv"]["ext_type"] == "csv"
    assert rows["calls.json"]["content_type"] == "json"
    assert rows["book.xlsx"]["content_type"] == "excel" and rows["book.xlsx"]["status"] == "ok"
    assert rows["fake_csv.csv"]["status"] == "mismatch"
    assert rows["notes.txt"]["status"] == "unsupported" and rows["notes.txt"]["ext_type"] == "format not supported yet"
    assert rows["latin.csv"]["encoding"] == "ISO-8859-1" and rows["ships.csv"]["encoding"] == "UTF-8"


def test_census_reads_every_byte(spark, tmp_path):
    """The only accent is the last byte, or cut by a chunk's edge."""
    (tmp_path / "last.csv").write_bytes(b"a,b\n" + b"x" * (3 << 20) + b"\xe9")
    (tmp_path / "edge.csv").write_bytes(b"x" * ((1 << 20) - 1) + "é".encode() + b"\n")
    (tmp_path / "cut.csv").write_bytes(b"x" * 10 + "é".encode()[:1])
    got = {r["file_name"]: (r["encoding"], r["ascii_only"]) for r in census.file_census(spark, str(tmp_path)).collect()}
    assert got == {"last.csv": ("ISO-8859-1", False), "edge.csv": ("UTF-8", False), "cut.csv": ("ISO-8859-1", False)}


def test_folder_with_an_ascii_part(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    (d / "a.csv").write_bytes(b"pilot,port\nOle,Bergen\n" * 50)
    (d / "b.csv").write_bytes("pilot,port\nBjørn,Ålesund\n".encode("iso-8859-1"))
    assert "Bjørn" in [r["pilot"] for r in readers.read_any(spark, str(d)).collect()]
    assert "Bjørn" in [r["pilot"] for r in readers.read_csv(spark, [str(d / "a.csv"), str(d / "b.csv")]).collect()]


def test_csv_rows_shorter_and_longer_than_the_header(spark, tmp_path):
    (tmp_path / "short.csv").write_text('buoy,,buoy\nA7,"x, y",3\nB2\nC9,"one\ntwo"\n', encoding="utf-8")
    got = readers.read_any(spark, str(tmp_path / "short.csv"))
    assert got.columns == ["buoy", "Unnamed: 1", "buoy.1"]
    assert sorted(tuple(r) for r in got.collect()) == [("A7", "x, y", 3), ("B2", None, None), ("C9", "one\ntwo", None)]
    (tmp_path / "long.csv").write_text("buoy,depth\nA7,3\nB2,4,5\n", encoding="utf-8")
    with pytest.raises(Exception, match="more than 2 fields"):
        readers.read_csv(spark, str(tmp_path / "long.csv"), encoding="UTF-8").collect()


def test_json_lines_keep_every_row(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n\n{"a": 3}\n')
    assert sorted(r["a"] for r in readers.read_any(spark, str(tmp_path / "l.json")).collect()) == [1, 2, 3]
    (tmp_path / "p.json").write_text('[\n {"a": 1},\n {"a": 2}\n]\n')
    assert readers.read_any(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "two.json").write_text('{\n"a": 1}\n{\n"a": 2}\n')
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "two.json"))


def test_census_missing_and_strict(spark, files):
    out = {r["file_name"]: r for r in census.census_of_files(spark, [str(files / "ships.csv"), str(files / "nope.csv")]).collect()}
    assert out["nope.csv"]["status"] == "missing"
    with pytest.raises(FileNotFoundError):
        census.require_type(out["nope.csv"])
    with pytest.raises(ValueError):
        readers.read_any(spark, str(files / "fake_csv.csv"))
    with pytest.raises(ValueError):
        readers.read_any(spark, str(files / "notes.txt"))


def test_read_csv_and_json(spark, files):
    df = readers.read_any(spark, str(files / "ships.csv"))
    assert dict(df.dtypes) == {"ship": "string", "tonnes": "bigint", "flag": "string"} and df.count() == 4
    j = readers.read_any(spark, str(files / "calls.json"))
    assert sorted(j.columns) == ["berth", "hours"] and j.count() == 2
    n = readers.read_any(spark, str(files / "hulls.json"))
    assert sorted(n.columns) == ["crew.officers", "hull.size.beam", "hull.size.length", "hull.steel", "id"]
    assert n.where(F.col("`hull.size.length`") == 83).count() == 1
    lat = readers.read_any(spark, str(files / "latin.csv")).first()
    assert lat["pilot"] == "Bjørn" and lat["port"] == "Ålesund"


def test_json_rejects(spark, tmp_path):
    p = tmp_path / "lines.json"
    p.write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n', encoding="utf-8")
    good, bad = readers.read_json_with_rejects(spark, str(p))
    assert sorted(r["a"] for r in good.collect()) == [1, 3]
    assert [r["record"] for r in bad.collect()] == ['{"a": 2']
    with pytest.raises(Exception):
        readers.read_json(spark, str(p), multiline=False).collect()


def test_key_detection(spark):
    assert readers.detect_key(spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")) == "k"
    assert readers.detect_key(spark.createDataFrame([(None, "a"), (None, "b")], "k int, v string")) is None
    assert readers.detect_key(spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")) == "k"


def test_workbook(spark, files):
    merged = readers.read_any(spark, str(files / "book.xlsx"))
    rows = sorted((r["id"], r["session"], r["extra"], r["sheet"]) for r in merged.collect())
    assert rows == [(1, "S1", None, "s1"), (2, "S1", None, "s1"), (3, "S2", True, "s2")]
    sheets = workbook.read_workbook(spark, str(files / "book.xlsx"), merge=False)
    assert set(sheets) == {"s1", "s2"} and sheets["s1"].count() == 2
    assert workbook.sheet_names(spark, str(files / "book.xlsx")) == ["s1", "s2"]


def test_union_widening(spark):
    from tablewash.operators.union import union_by_name

    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, 7)], "k double, t bigint")
    c = spark.createDataFrame([("z",)], "k string")
    out = union_by_name([a, b])
    assert dict(out.dtypes) == {"k": "double", "s": "string", "t": "bigint"}
    assert dict(union_by_name([a, c]).dtypes)["k"] == "string"


def test_csv_sink_keeps_whitespace_and_sorts(spark, tmp_path):
    df = spark.createDataFrame([(" p ", 2.0), ('a,"b"\nc', None), ("", 1.0)], "s string, v double")
    path = writers.write_csv(df, str(tmp_path / "new" / "dir" / "out.csv"), sort_col="v", ascending=True, single_file=True)
    assert os.path.isfile(path) and not os.path.exists(path + ".parts")
    back = readers.read_csv(spark, path, encoding="UTF-8").collect()
    assert [r["s"] for r in back] == [None, " p ", 'a,"b"\nc']  # '' is a missing token; NULL sorted last
    assert [r["v"] for r in back] == [1.0, 2.0, None]


def test_sort_desc_nulls_last(spark):
    from tablewash.operators.sort import sort_by

    df = spark.createDataFrame([(None,), (1,), (3,)], "v int")
    assert [r[0] for r in sort_by(df, "v", ascending=False).collect()] == [3, 1, None]
    assert sort_by(df, "nope") is df


def test_parquet_table_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, v string")
    p = writers.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(p).count() == 2
    assert writers.write_documents(df, path=str(tmp_path / "docs")) == 2
    assert writers.write_documents(df, path=str(tmp_path / "docs")) == 2  # appends
    assert spark.read.json(str(tmp_path / "docs")).count() == 4
    assert writers.write_documents(df, writer=lambda docs: sum(1 for _ in docs)) == 2
    assert [r["document"] for r in writers.to_documents(df).collect()] == ['{"k":1,"v":"a"}', '{"k":2,"v":null}']
    with pytest.raises(ValueError):
        writers.write_to(df, "carrier-pigeon")


def test_jdbc_url_and_modes():
    assert writers.jdbc_url("postgresql", "db", "h") == "jdbc:postgresql://h:5432/db"
    assert writers.jdbc_url("mysql", "db") == "jdbc:mysql://localhost:3306/db"
    assert writers.jdbc_url("sqlite", "/tmp/x.db") == "jdbc:sqlite:/tmp/x.db"
    assert writers.IF_EXISTS == {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    with pytest.raises(ValueError):
        writers.jdbc_url("oracle", "db")


def test_json_single_object_and_lists(spark, tmp_path):
    p = tmp_path / "one.json"
    p.write_text(json.dumps({"id": 1, "tags": ["a", "b"], "meta": {"k": {"deep": 2}}, "rows": [{"x": 1}]}), encoding="utf-8")
    df = readers.read_json(spark, str(p))
    assert df.count() == 1
    assert sorted(df.columns) == ["id", "meta.k.deep", "rows", "tags"]
    r = df.first()
    assert r["tags"] == ["a", "b"] and r["meta.k.deep"] == 2 and r["rows"][0]["x"] == 1


def test_census_uppercase_extension(spark, tmp_path):
    (tmp_path / "DATA.CSV").write_text("a\n1\n", encoding="utf-8")
    (tmp_path / "Book.XLSX").write_bytes(workbook.workbook_bytes({"s": [["a"], [1]]}))
    rows = {r["file_name"]: (r["ext_type"], r["content_type"], r["status"]) for r in census.file_census(spark, str(tmp_path)).collect()}
    assert rows == {"DATA.CSV": ("csv", "csv", "ok"), "Book.XLSX": ("excel", "excel", "ok")}
    assert readers.read_any(spark, str(tmp_path / "Book.XLSX")).first()["a"] == 1


def test_bom_encodings(spark, tmp_path):
    (tmp_path / "u16.csv").write_bytes("pilot,port\nBjørn,Ålesund\nZoë,Ærø\n".encode("utf-16"))
    (tmp_path / "u8bom.csv").write_bytes("pilot,port\nBjørn,Ålesund\n".encode("utf-8-sig"))
    enc = {r["file_name"]: r["encoding"] for r in census.file_census(spark, str(tmp_path)).collect()}
    assert enc == {"u16.csv": "UTF-16LE", "u8bom.csv": "UTF-8"}
    u16 = readers.read_any(spark, str(tmp_path / "u16.csv"))
    assert u16.columns == ["pilot", "port"] and sorted(tuple(r) for r in u16.collect()) == [("Bjørn", "Ålesund"), ("Zoë", "Ærø")]
    assert readers.read_any(spark, str(tmp_path / "u8bom.csv")).columns == ["pilot", "port"]


def test_read_any_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "k bigint, s string").repartition(3)
    writers.write_csv(df, str(tmp_path / "parts"))
    back = readers.read_any(spark, str(tmp_path / "parts"))
    assert sorted(tuple(r) for r in back.collect()) == [(i, f"n{i}") for i in range(20)]
    df.write.json(str(tmp_path / "mixed"))
    (tmp_path / "mixed" / "extra.csv").write_text("a\n1\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "mixed"))


def test_workbook_sheet_selection(spark, files):
    one = workbook.read_workbook(spark, str(files / "book.xlsx"), sheets="s2")
    assert [r["id"] for r in one.collect()] == [3]
    both = workbook.read_workbook(spark, str(files / "book.xlsx"), sheets=" s1 , s2 ")
    assert both.count() == 3
    with pytest.raises(ValueError):
        workbook.read_workbook(spark, str(files / "book.xlsx"), sheets="nope")


def test_table_replace_keeps_the_old_rows_until_the_new_are_whole(spark):
    name = "replace_me"
    spark.sql(f"DROP TABLE IF EXISTS {name}")

    def held():
        return sorted(r.v for r in spark.table(name).collect())

    writers.write_table(spark.range(3).selectExpr("id as v"), name)
    writers.write_table(spark.range(5).selectExpr("id as v"), name)
    assert held() == [0, 1, 2, 3, 4]
    broken = spark.range(9).selectExpr("id as v", "if(id = 8, raise_error('lost'), 1) as w")
    with pytest.raises(Exception, match="lost"):
        writers.write_table(broken, name)
    assert held() == [0, 1, 2, 3, 4]
    # a table may be replaced by what is read from it
    writers.write_table(spark.table(name).where("v > 2"), name)
    assert held() == [3, 4]
    writers.write_table(spark.range(1).selectExpr("id as v"), name, mode="append")
    assert held() == [0, 3, 4]
    # cut off between the renames
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}{writers.ASIDE}")
    assert writers.recover_table(spark, name) and held() == [0, 3, 4]
    spark.sql(f"CREATE TABLE {name}{writers.ASIDE} AS SELECT 1 AS v")
    assert not writers.recover_table(spark, name) and held() == [0, 3, 4]
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith(name)]
    assert left == [name]
    writers.write_table(spark.range(2).selectExpr("id as v"), "default.`replace_me`")
    assert held() == [0, 1]
    spark.sql(f"DROP TABLE {name}")
