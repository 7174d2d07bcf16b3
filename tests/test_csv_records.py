"""CSV files read in many tasks equal the one-task read, whatever stands in the quotes."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tablewash.sources import csv_records, readers
from tablewash.sources.csv_records import inside_after


@pytest.fixture()
def small_splits(spark):
    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("line, inside, after", [
    (b"", False, False), (b"", True, True), (b"a,b", False, False), (b"a,b", True, True), (b'"a', False, True), (b'a"', True, False),
    (b'"a,b",c', False, False), (b'"a""', False, True), (b'a,5" pipe', False, False), (b'a,"x', False, True), (b'x",y,"z', True, True),
    (b'x"",y', True, True), (b'"a" b,"c', False, True), (b' "a', False, False), (b'""', False, False), (b'"""', False, True), (b'"\r', True, False), (b'a","', True, True),
])
def test_state_at_line_ends(line, inside, after):
    assert inside_after(line, inside) is after


@pytest.mark.parametrize("seed, end, encoding", [(1, "\n", "utf-8"), (2, "\r\n", "utf-8"), (3, "\n", "utf-8-sig"), (4, "\n", "latin-1"), (5, "\r\n", "latin-1")])
def test_random_files(spark, tmp_path, small_splits, seed, end, encoding):
    rng = random.Random(seed)
    parts = ["a", "é", '"', ",", "\n", " ", "x y", "7", "1.5", "", 'said "hi"', f"line{end}break", "NA"]

    def table(n):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        w.writerow(["k", "text", 'odd "name"'])
        for i in range(n):
            w.writerow([i, "".join(rng.choices(parts, k=rng.randint(0, 12))), rng.choice(parts)])
            if rng.random() < 0.05:
                out.write(end)  # an empty line
        return out.getvalue()

    for f in range(3):
        (tmp_path / f"t{f}.csv").write_bytes(table(rng.randint(0, 60)).encode(encoding, "replace"))
    (tmp_path / "last.csv").write_bytes((table(40).rstrip(end) + f'{end}99,"no end').encode(encoding, "replace"))
    want = rows_of(readers.read_csv(spark, str(tmp_path), split=False))
    assert len(want) > 40
    for size in (200, 1 << 20):
        small_splits(size)
        got = readers.read_csv(spark, str(tmp_path))
        assert rows_of(got) == want
    small_splits(200)
    assert csv_records._lines(spark, [str(tmp_path)]).rdd.getNumPartitions() > 10


def test_long_value_over_many_splits(spark, tmp_path, small_splits):
    text = "\n".join(f'row {i}, with ""quotes""' for i in range(150))
    body = "\n\n" + f'id,note\n1,"{text}"\n2,5" pipe\n3,"{text}"\n\n4,"x\n"\n'
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "empty.csv").write_text("\n" * 300 + "id,note\n5,end")
    small_splits(250)
    got = readers.read_csv(spark, str(tmp_path), ordinal_col="at").orderBy("at").collect()
    plain = text.replace('""', '"')
    assert [(r.id, r.note) for r in got] == [(1, plain), (2, '5" pipe'), (3, plain), (4, "x\n"), (5, "end")]
    assert [r["at"] for r in got] == [1, 2, 3, 4, 5]


def test_short_long_and_clashing(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('_file,_n,f0,"a.b"\n1,2\n3,4,5,6\n')
    small_splits(8)
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["_file", "_n", "f0", "a.b"]
    assert rows_of(df) == [(1, 2, None, None), (3, 4, 5, 6)]
    (tmp_path / "b.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        readers.read_csv(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "c.csv")).count() == 0


def test_composition_of_maps(spark):
    """Every sequence of maps of six splits, against a walk along them."""
    kinds = [(False, True), (True, False), (False, False), (True, True)]  # keep, swap, out, in
    rng = random.Random(9)
    rows, want = [], set()
    for f in range(200):
        state = False
        for b in range(6):
            if state:
                want.add((f"f{f}", b))
            kind = rng.choice(kinds)
            rows.append((f"f{f}", b, *kind))
            state = kind[state]
    maps = spark.createDataFrame(rows, "file string, block long, from_out boolean, from_in boolean").repartition(7)
    assert {tuple(r) for r in csv_records.open_splits(maps).collect()} == want


def test_too_many_open_splits_raise(spark, tmp_path, small_splits, monkeypatch):
    (tmp_path / "a.csv").write_text('a\n"' + "x\n" * 300 + '"\n')
    small_splits(50)
    monkeypatch.setattr(csv_records, "MAX_OPEN_SPLITS", 3)
    with pytest.raises(ValueError, match="maxPartitionBytes"):
        readers.read_csv(spark, str(tmp_path / "a.csv"))


def test_other_encodings_take_one_task(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('a,b\n1,"é\nx"\n'.encode("utf-16"))
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), encoding="UTF-16")
    assert rows_of(df.select("a", F.length("b"))) == [(1, 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("body, plain", [
    ("a,b\n 1,x \n2,\n", True), ("a,b\n1,\"x\"\n", False), ("a,b\r\n1,x\r\n", False), ("a,b\n \n1,x\n", False), ("\n\na,b\n1,x\n", False), ("\ufeffa,b\n1,x\n", True),
])
def test_parsed_once(spark, tmp_path, small_splits, body, plain):
    """Fields are parsed once and stored, files without quotes by Spark's line reader; the same rows in any case."""
    (tmp_path / "a.csv").write_bytes(body.encode())
    want = rows_of(readers.read_csv(spark, str(tmp_path), split=False))
    lines = csv_records.plain_lines(spark, [str(tmp_path)])
    small_splits(4)
    got = readers.read_csv(spark, str(tmp_path))
    assert rows_of(got) == want
    assert "Scan parquet" in _plan(got) and "MapInArrow" not in _plan(got)
    text = _plan(readers.read_csv(spark, str(tmp_path), infer=False))
    assert ("MapInArrow" not in text) is lines
    assert lines is plain and "Union" not in text


@pytest.mark.parametrize("values, kind", [
    (["12", "+5", "-3"], "bigint"), (["\t12", " 7 ", "12\n"], "bigint"), (["9" * 19, "1"], "string"), (["9" * 18, "1" + "0" * 18], "bigint"), (["1.", "2", "1e5", ".5"], "double"),
    (["1\n", "1.5"], "double"), (["1\t", "1.5"], "string"), (["12\u2028"], "string"), (["True", "false"], "boolean"), (["True", "1"], "string"), (["", "1"], "string"), ([None], "string"),
])
def test_inferred_spellings(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = readers.infer_types(df)
    assert dict(got.dtypes) == {"v": kind}
    if kind == "bigint":
        assert [r.v for r in got.collect()] == [int(v) for v in values]


def test_texts_are_written_in_many_tasks(spark, tmp_path, monkeypatch):
    """scan_csv_split: no task gets the whole table, neither to write nor to read it."""
    from tablewash.plans import catalog

    rows = [(i, f'line {i}\n"quoted", {"x" * (i % 50)}', "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "_scratch", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a file per task
    try:
        got = catalog.scan_csv_split(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows_of(got) == sorted(rows, key=repr)
    assert len(list((tmp_path / "documents-csv").glob("part-*.csv"))) == 4
