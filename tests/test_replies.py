"""The reply store: nothing committed is asked again."""

import json

import pandas as pd
import pytest

from tablewash.plans import extract, replies


def batches(*groups):
    return iter([pd.DataFrame({"digest": [f"d{i}" for i in g], "prompt": [f"p{i}" for i in g]}) for g in groups])


def test_retried_task_asks_only_what_is_not_committed(tmp_path):
    sent = []

    def scorer(prompts, attempt):
        if "p5" in prompts and len(sent) < 5:
            raise RuntimeError("the executor is lost")
        sent.extend(prompts)
        return [f"r{p}" for p in prompts]

    path = str(tmp_path)
    with pytest.raises(RuntimeError):
        list(replies.ask(batches([1, 2], [3, 1], [5, 6]), scorer, path, 1, "job-000", 1))
    assert sent == ["p1", "p2", "p3"]
    sent.append("-")
    sent.append("-")
    # the retry gets the same rows in another order
    assert list(replies.ask(batches([6, 3], [5, 2, 1]), scorer, path, 1, "job-000", 2))[0]["sent"].sum() == 2
    assert sorted(sent) == ["-", "-", "p1", "p2", "p3", "p5", "p6"]
    # another attempt, another partition: not these files
    assert replies.committed(path, 2, "job-000") == replies.committed(path, 1, "job-001") == {}
    assert replies.committed(path, 1, "job-000") == {f"d{i}": f"rp{i}" for i in (1, 2, 3, 5, 6)}


def test_wrong_number_of_replies_commits_nothing(tmp_path):
    with pytest.raises(ValueError, match="one reply per prompt"):
        list(replies.ask(batches([1, 2]), lambda p, a: ["x"], str(tmp_path), 1, "j-0"))
    assert replies.committed(str(tmp_path), 1, "j-0") == {}


def test_equal_notes_are_sent_once(spark, tmp_path):
    log = tmp_path / "sent"
    log.mkdir()

    def scorer(prompts, attempt):
        import uuid

        (log / uuid.uuid4().hex).write_text(json.dumps([[p, attempt] for p in prompts]))
        return ["broken" if "bad" in p and attempt < 3 else json.dumps([{"exercise_name": extract.note_of(p), "code": "X"}]) for p in prompts]

    rows = [(i, f"S{i % 3}", ["walk", "bad knee", "row"][i % 3]) for i in range(30)]
    notes = spark.createDataFrame(rows, "i int, session string, exercise string")
    store = str(tmp_path / "store")
    for _ in range(2):  # the second job finds all replies
        out = extract.extract_table(notes, scorer, ["i"], num_tasks=4, reply_store=store)
        assert sorted((r.session, r.exercise_num, r.exercise_name) for r in out.collect()) == sorted((f"S{i % 3}", i // 3 + 1, t) for i, _, t in rows)
    sent = [(extract.note_of(p), a) for f in log.iterdir() for p, a in json.loads(f.read_text())]
    assert sorted(sent) == [("bad knee", 1), ("bad knee", 2), ("bad knee", 3), ("row", 1), ("walk", 1)]
    plain = extract.extract_table(notes, scorer, ["i"], num_tasks=4)
    assert plain.exceptAll(out).isEmpty() and out.exceptAll(plain).isEmpty()


def test_calls_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(replies, "CALL_PROMPTS", 3)
    monkeypatch.setattr(replies, "CALL_BYTES", 10)
    cut = lambda *sizes, **k: list(replies.calls(pa.array([None if n is None else "x" * n for n in sizes], pa.string()), **k))
    assert cut(1, 1, 1, 1, 1, 1, 1) == [(0, 3), (3, 6), (6, 7)]
    assert cut(99, 4, 6, 1, None, 99, 99) == [(0, 1), (1, 3), (3, 5), (5, 6), (6, 7)]
    assert cut(1, 1, 1, batch_size=2) == [(0, 2), (2, 3)] and cut() == []


def test_scorer_is_never_handed_a_whole_arrow_batch(spark, tmp_path):
    """Calls are of bounded size without a batch size, with and without a store; replies stay with their notes."""
    from tablewash.plans import extract

    def score(prompts, attempt):
        if len(prompts) > replies.CALL_PROMPTS or sum(map(len, prompts)) > replies.CALL_BYTES:
            raise ValueError("too much at once")
        return ['[{"exercise_name": "%s"}]' % p[:9] for p in prompts]

    n = 5000
    rows = spark.range(n).selectExpr("id AS i", "concat('n', lpad(cast(id as string), 8, '0'), repeat('x', 5000)) AS prompt").coalesce(1)
    for store in (None, str(tmp_path / "store")):
        got = extract.score_and_parse(rows, score, ["i"], [], num_tasks=1, reply_store=store)
        assert got.selectExpr("count(distinct i)", "count_if(records[0].exercise_name = concat('n', lpad(cast(i as string), 8, '0')))").first()[:] == (n, n)
