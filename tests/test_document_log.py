"""Documents reach a store once, whatever dies on the way."""

import json

import pandas as pd
import pytest

from tablewash.sinks import document_log, writers


class Store:
    """Inserts by id, as document stores do."""

    def __init__(self):
        self.rows, self.calls = {}, []

    def insert(self, documents):
        documents = [json.loads(x) for x in documents]
        self.calls.append([d["_id"] for d in documents])
        self.rows |= {d["_id"]: d for d in documents}
        return len(documents)


def rows():
    texts = [(p, n // 3, n, json.dumps({"_id": f"{p}-{n}"})) for p in range(2) for n in range(8)]
    frame = pd.DataFrame(texts, columns=["part", "batch", "pos", "document"])
    return iter([frame[:5], frame[5:6], frame[6:]])


def test_task_killed_after_the_writer_ran(tmp_path, monkeypatch):
    store, log = Store(), str(tmp_path / "log")
    commit = document_log.commit_batch

    def die(log, part, batch, written):
        if (part, batch) == (1, 0):
            raise RuntimeError("killed")
        commit(log, part, batch, written)

    monkeypatch.setattr(document_log, "commit_batch", die)
    with pytest.raises(RuntimeError):
        list(document_log.hand_out(rows(), store.insert, log))
    assert len(store.rows) == 11 and len(store.calls) == 4  # the last batch is in the store, but not in the log
    monkeypatch.setattr(document_log, "commit_batch", commit)
    list(document_log.hand_out(rows(), store.insert, log))
    assert len(store.rows) == 16
    # that batch alone came twice, with the same ids
    again = [c for c in store.calls if store.calls.count(c) > 1]
    assert again == [["1-0", "1-1", "1-2"]] * 2 and len(store.calls) == 7
    list(document_log.hand_out(rows(), store.insert, log))
    assert len(store.calls) == 7


def test_run_is_repeated_under_its_id(spark, tmp_path):
    folder = tmp_path / "store"
    folder.mkdir()

    def insert(documents):
        import uuid

        documents = list(documents)
        (folder / uuid.uuid4().hex).write_text("\n".join(documents))
        return len(documents)

    df = spark.range(2500).selectExpr("id as k", "if(id % 2 = 0, null, 'x') as v", "'gone' as d").repartition(2)
    assert writers.write_documents(df, writer=insert, drop_columns=["d"], run_id="run-a") == 2500
    files = len(list(folder.iterdir()))
    # the same run again: nothing is handed out; another run writes anew
    assert writers.write_documents(df, writer=insert, drop_columns=["d"], run_id="run-a") == 2500
    assert len(list(folder.iterdir())) == files
    got = [json.loads(x) for f in folder.iterdir() for x in f.read_text().split("\n")]
    assert sorted(d["k"] for d in got) == list(range(2500)) and len({d["_id"] for d in got}) == 2500
    assert all(set(d) == {"_id", "k", "v"} for d in got)
    assert writers.write_documents(df.limit(3), writer=insert) == 3
    assert writers.write_documents(df.limit(0), writer=insert) == 0
