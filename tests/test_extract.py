import json

import pytest
from pyspark.sql import functions as F

from tablewash.functions.replies import fallback_records, parse_reply
from tablewash.plans import extract
from tablewash.sources.vocabulary import CATEGORIES

VOCAB = ["Soleus", "Deltoideus", "Psoas major", "Trapezius"]
REC = {"exercise_name": "Wall slide", "code": "WaS", "code_base": "push", "muscles": ["Soleus"],
       "assistance": "a long strap", "repetitions": 10, "time": None}


def parse(spark, replies):
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    ok, recs = parse_reply(F.col("reply"), CATEGORIES, F.array(*[F.lit(v) for v in VOCAB]))
    return [(r["ok"], r["recs"]) for r in df.select(ok.alias("ok"), recs.alias("recs")).collect()]


def test_reply_shapes(spark):
    body = json.dumps([REC])
    cases = [body, "```json\n" + body + "\n```", "```\n" + body + "\n```", "Here is the result: " + body]
    for ok, recs in parse(spark, cases):
        assert ok and len(recs) == 1
        assert recs[0]["exercise_name"] == "Wall slide" and recs[0]["code_base"] == "Push"
        assert recs[0]["repetitions"] == "10" and recs[0]["time"] is None


@pytest.mark.parametrize("bad", ["not valid json", json.dumps([REC]) + " trailing", json.dumps([REC]) + "}",
                                 json.dumps([REC]) + "] x", json.dumps([REC]) + "," + json.dumps([REC]), '{"a": 1}', "5", ""])
def test_strict_failures(spark, bad):
    ((ok, recs),) = parse(spark, [bad])
    assert not ok and recs is None


def test_objects_only_and_empty(spark):
    (ok1, r1), (ok2, r2) = parse(spark, [json.dumps([REC, 5, "x"]), "[]"])
    assert ok1 and len(r1) == 1
    assert ok2 and r2 == []


def test_validation_and_vocabulary(spark):
    rec = dict(REC, code_base="  CARDIO ", muscles=["Deltoideus", "Unknown muscle", "Psoas major", "Deltoideus"],
               assistance="", repetitions=0, time=0)
    ((ok, recs),) = parse(spark, [json.dumps([rec, dict(REC, code_base="yoga"), dict(REC, code_base=5)])])
    assert ok
    assert recs[0]["code_base"] == "Cardio"
    assert recs[0]["muscles"] == ["Deltoideus", "Psoas major", "Deltoideus"]
    assert (recs[0]["assistance"], recs[0]["repetitions"], recs[0]["time"]) == (None, None, None)
    assert recs[1]["code_base"] == "unknown" and recs[2]["code_base"] == "unknown"
    ((_, r2),) = parse(spark, [json.dumps([dict(REC, repetitions="0", time=False, assistance=[])])])
    assert r2[0]["repetitions"] == "0" and r2[0]["time"] is None and r2[0]["assistance"] is None


def test_fallback(spark):
    f = spark.range(1).select(fallback_records().alias("f")).first()["f"][0]
    assert tuple(f) == ("unknown", "UNK", "unknown", [], None, None, None)


def test_roles():
    assert extract.detect_roles(["Seance", "Exercice", "ID"]) == extract.Roles("Seance", "ID", "Exercice")
    assert extract.detect_roles([" Day ", "notes"]).session == " Day "
    with pytest.raises(ValueError):
        extract.detect_roles(["a", "b"])
    assert extract.role_column(["a"], extract.SESSION_NAMES) is None


def _scorer(records_by_note, fail_first=()):
    def score(prompts, attempt):
        out = []
        for p in prompts:
            note = extract.note_of(p)
            if note in fail_first and attempt == 1:
                out.append("oops")
            else:
                out.append(json.dumps(records_by_note.get(note, [])))
        return out

    return score


def test_extract_numbering_and_skip(spark):
    df = spark.createDataFrame(
        [(0, "S1", "squat"), (1, "S1", "push-up"), (2, "S2", "squat"), (3, "S1", ""), (4, "S2", None)],
        "i int, session string, exercise string",
    )
    recs = {
        "squat": [dict(REC, exercise_name="Squat", muscles=["Deltoideus", "Psoas major"])],
        "push-up": [dict(REC, exercise_name="Push-up")],
    }
    muscles = spark.createDataFrame([(m,) for m in VOCAB], "name_latin string")
    out = extract.extract_table(df, _scorer(recs, fail_first=("push-up",)), ["i"], muscles=muscles)
    assert out.columns == list(extract.OUTPUT_COLUMNS)
    rows = sorted((r["session"], r["exercise_num"], r["exercise_name"], r["muscles"], r["patient_id"]) for r in out.collect())
    assert rows == [("S1", 1, "Squat", "Deltoideus, Psoas major", "unknown"), ("S1", 2, "Push-up", "Soleus", "unknown"),
                    ("S2", 1, "Squat", "Deltoideus, Psoas major", "unknown")]


def test_extract_fallback_after_three_attempts(spark):
    df = spark.createDataFrame([(0, "Block C", "Wall slide in a long strap", "P7")], "i int, seance string, exercise string, patient_id string")

    def never(prompts, attempt):
        return ["not valid json"] * len(prompts)

    r = extract.extract_table(df, never, ["i"]).first()
    assert (r["exercise_name"], r["code"], r["code_base"], r["muscles"]) == ("unknown", "UNK", "unknown", "")
    assert r["patient_id"] == "P7"
    notes = extract.with_prompt(extract.prepare_notes(df, ["i"]), extract.NO_REFERENCE, "")
    scored = extract.score_and_parse(notes, never, ["session", "row_ordinal"], [])
    assert [x["attempt"] for x in scored.collect()] == [3]


def test_session_fallback_and_patient_from_sheet(spark):
    df = spark.createDataFrame([(0, "a", "Alice"), (1, "b", "Alice"), (0, "c", "Bob")], "i int, notes string, sh string")
    notes = extract.prepare_notes(df, ["i"], sheet_col="sh")
    got = sorted((r["sheet"], r["patient_id"], r["session"]) for r in notes.collect())
    assert got == [("Alice", "Alice", "session_1"), ("Alice", "Alice", "session_2"), ("Bob", "Bob", "session_1")]


def test_prompt_contents(spark):
    notes = spark.createDataFrame([("", "p", "s", 1, "Wall slide")], "sheet string, patient_id string, session string, row_ordinal long, text string")
    ref = spark.createDataFrame([("Wall slide", "WaS", "Push")], "name string, code string, code_base string")
    muscles = spark.createDataFrame([(m,) for m in VOCAB], "name_latin string")
    rt, vt, names = extract.vocabulary_lines(ref, muscles)
    p = extract.with_prompt(notes, rt, vt).first()["prompt"]
    assert '"Wall slide"' in p and "- Wall slide | code: WaS | code_base: Push" in p
    assert "- Psoas major" in p and "Push, Pull, Transfer, Balance, Stretch, Cardio, Functional, unknown" in p
    assert extract.vocabulary_lines(None, None)[0] == extract.NO_REFERENCE


def test_analyze_csv_and_workbook(spark, tmp_path):
    from tablewash.sources.workbook import workbook_bytes

    recs = {"squat": [dict(REC, exercise_name="Squat")], "push-up": [dict(REC, exercise_name="Push-up")],
            "lunge": [dict(REC, exercise_name="Lunge"), dict(REC, exercise_name="Lunge 2")]}
    csv = tmp_path / "notes.csv"
    csv.write_text("patient_id,session,exercise\nP1,S1,squat\nP1,S1,push-up\nP2,S2,lunge\n", encoding="utf-8")
    out = extract.analyze_file(spark, str(csv), _scorer(recs))
    rows = sorted((r["patient_id"], r["session"], r["exercise_num"], r["exercise_name"]) for r in out.collect())
    assert rows == [("P1", "S1", 1, "Squat"), ("P1", "S1", 2, "Push-up"), ("P1", "S2", 1, "Lunge"), ("P1", "S2", 2, "Lunge 2")]
    book = tmp_path / "p.xlsx"
    book.write_bytes(workbook_bytes({"Anna": [["Seance", "Exercice"], ["S1", "lunge"], ["S1", "squat"]],
                                     "Ben": [["Seance", "Exercice"], ["S1", "push-up"]]}))
    out = extract.analyze_file(spark, str(book), _scorer(recs))
    rows = sorted((r["patient_id"], r["session"], r["exercise_num"], r["exercise_name"]) for r in out.collect())
    assert rows == [("Anna", "S1", 1, "Lunge"), ("Anna", "S1", 2, "Lunge 2"), ("Anna", "S1", 3, "Squat"), ("Ben", "S1", 1, "Push-up")]
    with pytest.raises(ValueError):
        bad = tmp_path / "x.json"
        bad.write_text("[]")
        extract.analyze_file(spark, str(bad), _scorer(recs))


def test_scorer_batch_size(spark):
    df = spark.createDataFrame([(i, "S", f"note {i}") for i in range(7)], "i int, session string, exercise string")

    def small_batches(prompts, attempt):
        assert len(prompts) <= 2
        return [json.dumps([dict(REC, exercise_name=extract.note_of(p))]) for p in prompts]

    out = extract.extract_table(df, small_batches, ["i"], batch_size=2, num_tasks=1)
    assert sorted(r["exercise_num"] for r in out.collect()) == list(range(1, 8))


def test_patient_fallbacks(spark):
    with_id = spark.createDataFrame([(0, None, "a"), (1, "P002", "b")], "i int, id string, notes string")
    assert {r["patient_id"] for r in extract.prepare_notes(with_id, ["i"]).collect()} == {"P002"}
    plain = spark.createDataFrame([(0, "a")], "i int, notes string")
    assert extract.prepare_notes(plain, ["i"], default_patient="P999").first()["patient_id"] == "P999"
    assert extract.prepare_notes(plain, ["i"]).first()["patient_id"] == "unknown"
    upper = spark.createDataFrame([(0, "S1", "a")], "i int, SESSION string, EXERCISE string")
    assert extract.detect_roles(upper.columns) == extract.Roles("SESSION", None, "EXERCISE")
