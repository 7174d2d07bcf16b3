"""Free text -> structured table, as one Spark job.

  notes table ──roles──> (sheet, patient_id, session, row_ordinal, text)
      └─ skip empty text
      └─ prompt  (note + vocabulary lists, built with column functions)
      └─ scorer  (caller's batch function via mapInArrow: Python calls of
                  bounded size)
      └─ strict parse / validate / vocabulary filter (JVM column functions);
         each round is checkpointed, so no later stage re-runs a finished
         round; a task lost mid-round re-sends only its own batch
      └─ retry only the unparseable replies, at most ``max_attempts`` rounds,
         then the fallback record
      └─ number per (sheet, session) in row order: a skew-safe running sum
         of record counts over notes, then posexplode (no shuffle)
      └─ fixed ten-column output

The scorer is ``scorer(prompts: list[str], attempt: int) -> list[str]``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewash.functions.names import c
from tablewash.functions.replies import fallback_records, parse_reply
from tablewash.operators.sequence import number_rows, running_total
from tablewash.plans.replies import calls, replies_of
from tablewash.session import ship_package
from tablewash.sources.vocabulary import CATEGORIES


Scorer = Callable[[list, int], list]

# Column names that identify each role, matched case-blind after trimming
# (fixed values).
SESSION_NAMES = ("session", "séance", "seance", "date", "jour", "day")
PATIENT_NAMES = ("patient_id", "id", "patient", "pseudonyme", "code_patient")
TEXT_NAMES = ("exercise", "exercice", "activite", "activité", "description", "texte", "notes")
# Text values that count as "no note", lower-cased (fixed values)
EMPTY_TEXT = ("", "nan", "none")

OUTPUT_COLUMNS = (
    "patient_id", "session", "exercise_num", "exercise_name", "code", "code_base",
    "muscles", "assistance", "repetitions", "time",
)

# Reference block of a prompt when no reference list is given (fixed value)
NO_REFERENCE = "No reference available yet."

DEFAULT_TEMPLATE = (
    "Read the note below and list every activity it describes.\n\n"
    "NOTE:\n\"{text}\"\n\n"
    "KNOWN ACTIVITIES (reuse their code when one matches):\n{reference}\n\n"
    "ALLOWED BODY PARTS (use no other):\n{vocabulary}\n\n"
    "ALLOWED CATEGORIES: {categories}, unknown\n\n"
    "Answer with a JSON array only. Each element has the fields exercise_name, code (3-4 characters), "
    "code_base (one allowed category or \"unknown\"), muscles (list of allowed body parts), "
    "assistance (text or null), repetitions (number or null) and time (seconds or null)."
)


def role_column(columns: Sequence[str], candidates: Sequence[str], override: str | None = None) -> str | None:
    """First column, in table order, whose trimmed lower-case name is a candidate."""
    if override is not None:
        return override if override in columns else None
    for name in columns:
        if name.strip().lower() in candidates:
            return name
    return None


@dataclass(frozen=True)
class Roles:
    session: str | None
    patient: str | None
    text: str


def detect_roles(columns: Sequence[str], session: str | None = None, patient: str | None = None, text: str | None = None) -> Roles:
    text_col = role_column(columns, TEXT_NAMES, text)
    if not text_col:
        raise ValueError("Exercise column not found.")
    return Roles(role_column(columns, SESSION_NAMES, session), role_column(columns, PATIENT_NAMES, patient), text_col)


def prepare_notes(
    df: DataFrame,
    order_cols: Sequence[str],
    roles: Roles | None = None,
    sheet_col: str | None = None,
    default_patient: str | None = None,
) -> DataFrame:
    """(sheet, patient_id, session, row_ordinal, text), empty notes dropped.

    row_ordinal: 1.. per sheet in ``order_cols`` order (distributed numbering).
    patient_id: first non-missing value of the patient column per sheet, as
    text; no column -> the sheet name (or ``default_patient``) -> 'unknown'.
    session: the session value as text ('nan' when missing), or
    ``session_<row_ordinal>`` when there is no session column."""
    roles = roles or detect_roles(df.columns)
    sheet = c(sheet_col).cast("string") if sheet_col else F.lit("")
    base = df.select(
        sheet.alias("sheet"),
        *[c(o).alias(f"_o{i}") for i, o in enumerate(order_cols)],
        (c(roles.patient).cast("string") if roles.patient else F.lit(None).cast("string")).alias("_patient"),
        (c(roles.session).cast("string") if roles.session else F.lit(None).cast("string")).alias("_session"),
        c(roles.text).cast("string").alias("text"),
    )
    ordered = number_rows(base, ["sheet"], [f"_o{i}" for i in range(len(order_cols))], out="row_ordinal")
    if roles.patient:
        # one row per sheet, straight from the notes; min_by is a partial aggregate
        first_order = F.struct(F.lit(0), *[F.col(f"_o{i}") for i in range(len(order_cols))])
        per_sheet = base.where(F.col("_patient").isNotNull()).groupBy("sheet").agg(
            F.min_by("_patient", first_order).alias("_first_patient")
        )
        ordered = ordered.join(per_sheet, "sheet", "left")
        patient = F.coalesce(F.col("_first_patient"), F.lit("unknown"))
    else:
        fallback = F.lit(default_patient) if default_patient else (F.col("sheet") if sheet_col else F.lit(None))
        patient = F.coalesce(F.nullif(fallback, F.lit("")), F.lit("unknown"))
    session = (
        F.coalesce(F.col("_session"), F.lit("nan"))
        if roles.session
        else F.concat(F.lit("session_"), F.col("row_ordinal").cast("string"))
    )
    notes = ordered.select("sheet", patient.alias("patient_id"), session.alias("session"), "row_ordinal", "text")
    return notes.where(~F.lower(F.coalesce(F.col("text"), F.lit("nan"))).isin(list(EMPTY_TEXT)))


# ------------------------------------------------------------------ prompt

def vocabulary_lines(reference: DataFrame | None, muscles: DataFrame | None) -> tuple[str, str, list[str]]:
    """Prompt blocks for the two vocabularies plus the body-part list. Every
    entry goes into every prompt, so the driver holds what one prompt holds."""
    ref_text = NO_REFERENCE
    names: list[str] = []
    if reference is not None:
        rows = reference.select(
            F.format_string("- %s | code: %s | code_base: %s", "name", "code", "code_base").alias("l")
        ).orderBy("l").collect()
        if rows:
            ref_text = "\n".join(r["l"] for r in rows)
    if muscles is not None:
        first = muscles.columns[0]
        rows = muscles.select(c(first).cast("string").alias("m")).distinct().orderBy("m").collect()
        names = [r["m"] for r in rows]
    return ref_text, "\n".join(f"- {m}" for m in names), names


def prompt_column(reference_text: str, vocabulary_text: str, template: str = DEFAULT_TEMPLATE,
                  categories: Sequence[str] = CATEGORIES) -> Column:
    """The prompt as an expression over the ``text`` column."""
    cats = ", ".join(x.capitalize() for x in categories)
    pre, post = template.split("{text}", 1)
    post = post.format(reference=reference_text, vocabulary=vocabulary_text, categories=cats)
    return F.concat(F.lit(pre), F.col("text"), F.lit(post))


def with_prompt(notes: DataFrame, reference_text: str, vocabulary_text: str, template: str = DEFAULT_TEMPLATE,
                categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Add ``prompt``: the template with the note and the vocabulary blocks."""
    return notes.withColumn("prompt", prompt_column(reference_text, vocabulary_text, template, categories))


# ------------------------------------------------------------------ scoring

def _score_batches(scorer: Scorer, attempt: int, key_cols: Sequence[str], batch_size: int | None = None,
                   carry: str = "prompt"):
    def run(batches):
        for batch in batches:
            prompts = batch.column("prompt")
            for a, b in calls(prompts, batch_size):
                replies = scorer(prompts.slice(a, b - a).to_pylist(), attempt)
                if len(replies) != b - a:
                    raise ValueError("scorer must return one reply per prompt")
                kept = [batch.column(x).slice(a, b - a) for x in (*key_cols, carry)]
                text = pa.array(["" if r is None else str(r) for r in replies], prompts.type)
                yield pa.record_batch([*kept, text, pa.array([attempt] * (b - a), pa.int32())], [*key_cols, carry, "reply", "attempt"])

    return run


def score_and_parse(
    prompts: DataFrame,
    scorer: Scorer,
    key_cols: Sequence[str],
    vocabulary: Sequence[str],
    categories: Sequence[str] = CATEGORIES,
    max_attempts: int = 3,
    checkpoint: bool = True,
    num_tasks: int | None = None,
    batch_size: int | None = None,
    prompt: Column | None = None,
    reply_store: str | None = None,
) -> DataFrame:
    """(key_cols..., attempt, records). Replies that do not parse are sent
    again, up to ``max_attempts`` rounds; the rest get the fallback record.

    Each round spreads its prompts round-robin over ``num_tasks`` tasks
    (default: the cluster's default parallelism): the number of concurrent
    scorer calls, independent of how the notes happened to be partitioned.
    A scorer call gets at most ``CALL_PROMPTS`` prompts of ``CALL_BYTES`` together (``plans.replies``), and never
    more than ``batch_size``: a task holds one call's prompts and replies, whatever an Arrow batch holds.

    ``prompts`` either holds a ``prompt`` column, or a ``text`` column and
    ``prompt`` is an expression over it: then the prompt (note plus the shared
    vocabulary block) is built after the repartition, so only the notes are
    shuffled, not one copy of the vocabulary per note.

    ``reply_store`` names a shared folder for replies (``plans.replies``): equal prompts are sent once, and
    no prompt whose reply was committed is sent again, by a retried task or by a later job."""
    spark = prompts.sparkSession
    vocab = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    key_cols = list(key_cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.select(*key_cols).schema.fields)
    carry = "prompt" if prompt is None else "text"
    schema += f", {carry} string, reply string, attempt int"
    ship_package(spark)
    tasks = int(num_tasks or spark.sparkContext.defaultParallelism)
    pending = prompts.select(*key_cols, carry)
    done: list[DataFrame] = []
    failed = pending
    for attempt in range(1, max_attempts + 1):
        if reply_store:
            asked = F.col("prompt") if prompt is None else prompt
            replies = replies_of(pending, asked, scorer, reply_store, attempt, tasks, batch_size).withColumn("attempt", F.lit(attempt))
        else:
            batch_in = pending.repartition(tasks)
            if prompt is not None:
                batch_in = batch_in.withColumn("prompt", prompt)
            replies = batch_in.mapInArrow(_score_batches(scorer, attempt, key_cols, batch_size, carry), schema)
        ok, recs = parse_reply(F.col("reply"), categories, vocab)
        parsed = replies.select(
            *key_cols, "attempt", ok.alias("_ok"), recs.alias("records"),
            # the prompt (or its text) is kept only where it will be sent again
            F.when(~ok, F.col(carry)).alias(carry),
        )
        if checkpoint:
            # the scorer and the parse run once per round; both branches below
            # and every later stage read this copy
            parsed = parsed.checkpoint()
        done.append(parsed.where("_ok").drop("_ok", carry))
        failed = parsed.where(~F.col("_ok")).select(*key_cols, carry)
        pending = failed
        if checkpoint and failed.isEmpty():  # reads the checkpoint; stops at the first failure
            break
    # whatever still fails after the last round gets the fallback record
    done.append(failed.select(*key_cols, F.lit(max_attempts).alias("attempt"), fallback_records().alias("records")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def explode_and_number(scored: DataFrame) -> DataFrame:
    """One row per record (no records -> no row), numbered 1.. per
    (sheet, session) in row order then record order.

    The numbering runs on notes, not records: a skew-safe running sum of the
    record counts per session gives each note its first number, and the
    explode that follows needs no shuffle."""
    per_note = scored.withColumn("_n", F.size("records").cast("bigint"))
    run = running_total(per_note, ["sheet", "session"], ["row_ordinal"], weight="_n", out="_cum")
    rows = run.select("*", F.posexplode("records").alias("pos", "rec")).drop("records")
    return rows.withColumn("exercise_num", F.col("_cum") - F.col("_n") + F.col("pos") + 1).drop("_cum", "_n")


def output_table(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "patient_id",
        "session",
        F.col("exercise_num").cast("int").alias("exercise_num"),
        F.col("rec.exercise_name").alias("exercise_name"),
        F.col("rec.code").alias("code"),
        F.col("rec.code_base").alias("code_base"),
        F.array_join("rec.muscles", ", ").alias("muscles"),
        F.col("rec.assistance").alias("assistance"),
        F.col("rec.repetitions").alias("repetitions"),
        F.col("rec.time").alias("time"),
    )


def extract_table(
    df: DataFrame,
    scorer: Scorer,
    order_cols: Sequence[str],
    reference: DataFrame | None = None,
    muscles: DataFrame | None = None,
    sheet_col: str | None = None,
    roles: Roles | None = None,
    template: str = DEFAULT_TEMPLATE,
    max_attempts: int = 3,
    num_tasks: int | None = None,
    batch_size: int | None = None,
    reply_store: str | None = None,
) -> DataFrame:
    """The whole extraction: notes -> ten-column table."""
    notes = prepare_notes(df, order_cols, roles, sheet_col)
    return extract_notes(notes, scorer, reference, muscles, template, max_attempts, num_tasks, batch_size, reply_store)


def extract_notes(
    notes: DataFrame,
    scorer: Scorer,
    reference: DataFrame | None = None,
    muscles: DataFrame | None = None,
    template: str = DEFAULT_TEMPLATE,
    max_attempts: int = 3,
    num_tasks: int | None = None,
    batch_size: int | None = None,
    reply_store: str | None = None,
) -> DataFrame:
    """Prepared notes (sheet, patient_id, session, row_ordinal, text) -> ten-column table."""
    ref_text, vocab_text, vocab = vocabulary_lines(reference, muscles)
    keys = ["sheet", "patient_id", "session", "row_ordinal"]
    scored = score_and_parse(notes, scorer, keys, vocab, max_attempts=max_attempts, num_tasks=num_tasks,
                             batch_size=batch_size, prompt=prompt_column(ref_text, vocab_text, template), reply_store=reply_store)
    return output_table(explode_and_number(scored))


def analyze_file(
    spark,
    path: str,
    scorer: Scorer,
    reference: DataFrame | None = None,
    muscles: DataFrame | None = None,
    sheets: str | Sequence[str] = "all",
    max_attempts: int = 3,
    scope: str = "file",
    reply_store: str | None = None,
) -> DataFrame:
    """Whole-file analysis: a CSV file (or folder of CSV part files) or every
    chosen sheet of a workbook (or folder of workbooks), in file / sheet row order, as one plan
    (sheets are data, not a loop). Other formats raise.

    ``scope='file'``: each (file, sheet) has columns, a patient and numbers of its own.
    ``scope='sheet'``: the workbooks are parts of one; sheets of equal name are one table, with
    the columns of all sheets together."""
    from tablewash.plans.sheets import sheet_notes
    from tablewash.sources.readers import detect_kind, read_csv
    from tablewash.sources.workbook import read_workbook, workbook_rows

    if scope not in ("file", "sheet"):
        raise ValueError("scope must be 'file' or 'sheet'")

    kind, encoding = detect_kind(spark, path)
    if kind == "csv":
        df = read_csv(spark, path, encoding=encoding, ordinal_col="_file_row")
        return extract_table(df, scorer, ["_file_row"], reference, muscles, None, None, max_attempts=max_attempts, reply_store=reply_store)
    if kind == "excel" and scope == "file":
        notes = sheet_notes(workbook_rows(spark, path, sheets).checkpoint())
        return extract_notes(notes, scorer, reference, muscles, max_attempts=max_attempts, reply_store=reply_store)
    if kind == "excel":
        df = read_workbook(spark, path, sheets=sheets, merge=True, sheet_col="_sheet", row_col="_sheet_row")
        return extract_table(df, scorer, ["_sheet_row_path", "_sheet_row"], reference, muscles, "_sheet", None,
                             max_attempts=max_attempts, reply_store=reply_store)
    raise ValueError(f"Format not supported by analyzer: {path}")


# ------------------------------------------------------------------ test scorer

def note_of(prompt: str) -> str:
    """The note text inside a prompt built from DEFAULT_TEMPLATE."""
    start = prompt.index('NOTE:\n"') + len('NOTE:\n"')
    end = prompt.index('"\n\nKNOWN ACTIVITIES')
    return prompt[start:end]


def allowed_of(prompt: str) -> list[str]:
    block = prompt.split("ALLOWED BODY PARTS (use no other):\n", 1)[1].split("\n\nALLOWED CATEGORIES", 1)[0]
    return [line[2:] for line in block.split("\n") if line.startswith("- ")]


# reply categories the rule scorer cycles through (valid, padded, odd case, invalid)
RULE_CATEGORIES = ("push", " Pull ", "TRANSFER", "balance", "stretch", "cardio", "functional", "yoga", "")


def rule_records(note: str, allowed: list[str]) -> list[dict]:
    recs = []
    for j, line in enumerate(note.split("\n")):
        name = line.strip()
        if not name:
            continue
        n = len(line)
        muscles = ([allowed[n % len(allowed)], allowed[(n * 7 + 3) % len(allowed)]] if allowed else []) + ["Nope"]
        recs.append({
            "exercise_name": name,
            "code": name[:3],
            "code_base": RULE_CATEGORIES[n % len(RULE_CATEGORIES)],
            "muscles": muscles,
            "assistance": None if j % 3 == 0 else ("" if j % 3 == 1 else "parallel bars"),
            "repetitions": n % 5,
            "time": j * 15,
        })
    return recs


def rule_scorer(prompts: list, attempt: int) -> list:
    """Deterministic stand-in for a model: one record per non-blank line of
    the note; the reply shape depends on the note length (plain, fenced,
    fenced without tag, text before, trailing text on the first attempt only,
    never valid)."""
    out = []
    for p in prompts:
        note = note_of(p)
        body = json.dumps(rule_records(note, allowed_of(p)), ensure_ascii=False)
        v = len(note) % 6
        if v == 0:
            out.append(body[:-1] + (", 5, \"x\"]" if body != "[]" else "5, \"x\"]"))
        elif v == 1:
            out.append("```json\n" + body + "\n```")
        elif v == 2:
            out.append("```\n" + body + "\n```")
        elif v == 3:
            out.append("Here is the result: " + body)
        elif v == 4:
            out.append(body + (" trailing words" if attempt == 1 else ""))
        else:
            out.append("not valid json")
    return out
