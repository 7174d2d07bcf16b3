"""Whole-document JSON cut into records in many tasks, whatever the splits."""

import json
import random

import pytest

from tablewash.sources import json_records, readers


@pytest.fixture()
def small_splits(spark):
    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cut(spark, path):
    rows = json_records.json_records(spark, [str(path)]).orderBy("file", "block", "n").collect()
    return [r.record for r in rows if not r.bad], [r.record for r in rows if r.bad]


def value(rng, depth=0):
    texts = ["", "a", "}", "{", "]", '"', "\\", "\\\\", "}\\\"{", "é😀", "\n", ", ", "[{"]
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choices(texts, k=rng.randint(0, 6)))
    if kind == 3:
        return rng.choice([1, -2.5, True, None])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["k", "x}", 'q"{', "\\"]) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("seed, size", [(1, 300), (2, 1 << 20)])
def test_random_documents(spark, tmp_path, small_splits, seed, size):
    rng = random.Random(seed)
    want = {}
    for f in range(4):
        objects = [{"id": i, **{f"f{j}": value(rng) for j in range(3)}} for i in range(rng.randint(0, 12))]
        doc = objects if f else {"id": -1, "rows": objects}
        text = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"d{f}.json").write_bytes((b"\xef\xbb\xbf" if f == 2 else b"") + f"{rng.choice(['', '\n '])}{text}{rng.choice(['', '\n', '  \n'])}".encode())
        want[f] = objects if f else [doc]
    small_splits(size)
    rows = json_records.json_records(spark, [str(tmp_path)]).orderBy("file", "block", "n").collect()
    assert not [r.record for r in rows if r.bad]
    got = {f: [json.loads(r.record) for r in rows if r.file.endswith(f"d{f}.json")] for f in want}
    assert got == want


CASES = [
    ('[{"a": 1}, {"a": 2}]', 2, 0), ("[]", 0, 0), ("[ ]\n", 0, 0), ('{"a": 1}', 1, 0), ('{"a": 1}\n', 1, 0), (" \n", 0, 0),
    ('[{"a": 1} {"a": 2}]', 1, 2), ('[{"a": 1},, {"a": 2}]', 2, 1), ('[{"a": 1},]', 1, 1), ('[{"a": 1}', 1, 1), ('[{"a": 1}, ', 1, 1),
    ('[1, {"a": 1}, "x}", {"a": 2}, null]', 2, 3), ('[[{"a": 1}]]', 0, 3), ('{"a": 1} {"a": 2}', 1, 1), ('{"a": 1}]', 1, 1), ('[{"a": 1}}, {"a": 2}]', 2, 1),
]


def test_every_text_is_accounted_for(spark, tmp_path, small_splits):
    for i, (text, _, _) in enumerate(CASES):
        (tmp_path / f"d{i:02}.json").write_text(text)
    for size in (1 << 20, 9):
        small_splits(size)
        rows = json_records.json_records(spark, [str(tmp_path)]).collect()
        for i, (text, good, bad) in enumerate(CASES):
            own = [r for r in rows if r.file.endswith(f"d{i:02}.json")]
            assert sum(not r.bad for r in own) == good, (text, own)
            rejects = sum(r.bad for r in own)
            assert rejects == bad if size > 9 else bool(rejects) == bool(bad), (text, own)
    with pytest.raises(ValueError, match="broken JSON"):
        readers.read_json(spark, str(tmp_path / "d07.json"))
    assert readers.read_json(spark, str(tmp_path / "d00.json")).count() == 2


def test_rejects_of_a_document(spark, tmp_path, small_splits):
    (tmp_path / "d.json").write_text('[{"a": 1, "b": {"c": "x"}}, {"a": [1}, 7, {"a": 2, "b": {"c": "}"}},\n{"a" 3}, {"a": 4, "b": null}]')
    small_splits(20)
    good, bad = readers.read_json_with_rejects(spark, str(tmp_path / "d.json"), multiline=True)
    assert sorted((r.a, r["b.c"]) for r in good.collect()) == [(1, "x"), (2, "}"), (4, None)]
    assert sorted(r.record for r in bad.collect()) == ["7", '{"a" 3}', '{"a": [1}']


def test_one_line_in_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "d.json").write_text(json.dumps([{"id": i, "text": "}" * (i % 5)} for i in range(200)]))
    small_splits(400)
    assert json_records._texts(spark, [str(tmp_path / "d.json")]).rdd.getNumPartitions() > 8
    df = readers.read_any(spark, str(tmp_path / "d.json"))
    assert sorted((r.id, r.text) for r in df.collect()) == [(i, "}" * (i % 5)) for i in range(200)]


def test_walk():
    assert json_records.walk(b'{"a": "{', False) == (True, 1)
    assert json_records.walk(b'x\\" {" {{', True) == (False, 2)
    assert json_records.walk(b'x\\', True) == (True, 0)
    assert json_records.walk(b'"\\\\" {', False) == (False, 1)


def test_more_splits_than_fit_use_the_plain_reader(spark, tmp_path, monkeypatch):
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    monkeypatch.setattr(json_records, "MAX_SPLITS", 0)
    assert json_records.json_records(spark, [str(tmp_path)]) is None
    assert readers.read_json(spark, str(tmp_path / "d.json")).count() == 2
