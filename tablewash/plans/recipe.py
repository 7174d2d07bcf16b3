"""The cleaning recipe: an ordered list of steps that can be saved as JSON and
replayed on new data. Applying a recipe folds the steps into one DataFrame
transformation; statistics (mean, median, mode) are recomputed on the data the
recipe is applied to, never stored.

JSON layout: {"created_at": ISO time, "steps": [{"step": name, "params": {...}}]}
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from tablewash.operators import casts, clean

# The fixed cleaning order (step names as stored in recipe files).
STEP_ORDER = (
    "replace_zeros",
    "handle_missing",
    "remove_duplicates",
    "fix_types",
    "trim_whitespace",
    "standardize_case",
)


@dataclass(frozen=True)
class Step:
    step: str
    params: dict[str, Any] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"step": self.step, "params": dict(self.params)}


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...] = ()
    created_at: str = field(default_factory=lambda: datetime.now().isoformat())

    # -- record / query -------------------------------------------------
    def record(self, step: str, params: dict | None = None) -> "Recipe":
        """New recipe with the step appended (recipes are immutable)."""
        return Recipe(self.steps + (Step(step, dict(params or {})),), self.created_at)

    def get(self, step: str) -> dict | None:
        """Params of the first step of that name, or None."""
        return self._first().get(step)

    def has(self, step: str) -> bool:
        return step in self._first()

    def _first(self) -> dict[str, dict]:
        return {s.step: s.params for s in reversed(self.steps)}

    # -- JSON -------------------------------------------------------------
    def to_dict(self) -> dict:
        return {"created_at": self.created_at, "steps": [s.to_json() for s in self.steps]}

    def dumps(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    @staticmethod
    def loads(text: str) -> "Recipe":
        data = json.loads(text)
        return Recipe(tuple(Step(s["step"], dict(s.get("params") or {})) for s in data["steps"]), data["created_at"])

    def save(self, path: str) -> None:
        import os

        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.dumps())

    @staticmethod
    def load(path: str) -> "Recipe":
        with open(path, encoding="utf-8") as f:
            return Recipe.loads(f.read())

    # -- apply ------------------------------------------------------------
    def apply(self, df: DataFrame, key_columns=(), fixed_order: bool = True, trim: bool = True) -> DataFrame:
        """Run the recipe. ``fixed_order`` runs steps in STEP_ORDER (the
        reference's order; first occurrence of each); otherwise in recorded
        order. Steps absent from the recipe are skipped, but for the trim: in the
        fixed order it always runs, on all text columns (unless ``trim=False``)."""
        steps = list(self.steps)
        if fixed_order:
            own = {n: Step(n, self.get(n)) for n in STEP_ORDER if self.has(n)}
            own.pop("trim_whitespace", None)
            if trim:
                own["trim_whitespace"] = Step("trim_whitespace", {})
            steps = [own[n] for n in STEP_ORDER if n in own]
        out = df
        for s in steps:
            out = apply_step(out, s.step, s.params, key_columns)
        return out


def apply_step(df: DataFrame, step: str, params: dict, key_columns=()) -> DataFrame:
    p = params or {}
    if step == "read_file":  # the source, used by run_recipe; not a transformation
        return df
    if step == "replace_zeros":
        return clean.replace_zeros(df, p.get("columns", "all"), key_columns=key_columns)
    if step == "handle_missing":
        return clean.handle_missing(df, p["method"], p.get("fill_value"), key_columns=key_columns)
    if step == "remove_duplicates":
        remove = p.get("remove", "yes")
        if remove is True or str(remove).lower() in ("yes", "true"):
            return clean.remove_duplicates(df, key_columns=key_columns)
        return df
    if step == "fix_types":
        return casts.fix_types(
            df, p.get("conversions", {}), mode=p.get("mode", "guard"),
            datetime_format=p.get("datetime_format"), epoch_unit=p.get("epoch_unit", "ns"),
        )
    if step == "trim_whitespace":
        return clean.trim_text(df, p.get("columns"), key_columns=key_columns) if p.get("columns") is not None \
            else clean.trim_text(df, key_columns=key_columns)
    if step == "standardize_case":
        return clean.standardize_case(df, p.get("case", "none"), key_columns=key_columns)
    raise ValueError(f"unknown recipe step: {step}")


def clean_table(
    df: DataFrame,
    zeros="none",
    missing: tuple[str, Any] | None = None,
    remove_duplicates: bool = False,
    conversions: dict | None = None,
    case: str = "none",
    key_columns=(),
    trim: bool = True,
) -> tuple[DataFrame, Recipe]:
    """The reference's fixed six-step cleaning with parameters instead of
    prompts. Returns the cleaned DataFrame and the recipe that replays it.
    Declined steps are not recorded."""
    r = Recipe()
    if zeros is not None and not (isinstance(zeros, str) and zeros.lower() == "none"):
        r = r.record("replace_zeros", {"columns": zeros})
    if missing is not None:
        method, value = missing
        r = r.record("handle_missing", {"method": method, "fill_value": value})
    if remove_duplicates:
        r = r.record("remove_duplicates", {"remove": "yes"})
    if conversions:
        r = r.record("fix_types", {"conversions": dict(conversions)})
    if trim:
        r = r.record("trim_whitespace", {})
    if case and case.lower() != "none":
        r = r.record("standardize_case", {"case": case.lower()})
    return r.apply(df, key_columns=key_columns, trim=trim), r


def run_recipe(
    spark,
    recipe: Recipe,
    source: str | None = None,
    sink: dict | None = None,
    report_path: str | None = None,
    report_format: str = "text",
    key_columns=(),
    generated_at: str | None = None,
):
    """Replay end to end: read the source (``source`` or the recipe's recorded
    ``read_file`` path), apply the recipe, write to ``sink`` ({"kind": ...,
    **options}) and optionally save the before/after report. The recipe is
    never changed. Returns (cleaned DataFrame, report DataFrame)."""
    from tablewash.plans.report import build_report, save_report
    from tablewash.sinks.writers import write_to
    from tablewash.sources.readers import read_any

    path = source or (recipe.get("read_file") or {}).get("file_path")
    if not path:
        raise ValueError("no source given and the recipe records no read_file step")
    before = read_any(spark, path)
    after = recipe.apply(before, key_columns=key_columns)
    if sink:
        opts = dict(sink)
        write_to(after, opts.pop("kind"), **opts)
    report = build_report(before, after, recipe, generated_at or datetime.now().isoformat())
    if report_path:
        save_report(report, report_path, report_format)
    return after, report


def run_clean(
    spark,
    source: str,
    sink: dict | None = None,
    recipe_path: str | None = None,
    report_path: str | None = None,
    report_format: str = "text",
    generated_at: str | None = None,
    **clean_params,
):
    """Full run: read the source, clean it with ``clean_table`` parameters,
    write to ``sink``, save the recipe (with its ``read_file`` step, so it can
    be replayed as is) and the before/after report.
    Returns (cleaned DataFrame, recipe, report DataFrame)."""
    from tablewash.plans.report import build_report, save_report
    from tablewash.sinks.writers import write_to
    from tablewash.sources.readers import read_any

    before = read_any(spark, source)
    after, recipe = clean_table(before, **clean_params)
    recipe = Recipe((Step("read_file", {"file_path": source}),) + recipe.steps, recipe.created_at)
    if sink:
        opts = dict(sink)
        write_to(after, opts.pop("kind"), **opts)
    if recipe_path:
        recipe.save(recipe_path)
    report = build_report(before, after, recipe, generated_at or datetime.now().isoformat())
    if report_path:
        save_report(report, report_path, report_format)
    return after, recipe, report
