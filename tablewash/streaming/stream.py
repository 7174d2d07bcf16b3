"""The recipe on a streaming DataFrame.

Row-wise steps are plain column expressions, so they run unchanged on a
``readStream`` source: zero replacement, dropping rows with missing values,
typed literal fill, coerce-mode casts, trim and case. Steps that need
statistics of the whole table (column drop, mean / median / mode fill, the
all-or-nothing cast guard) have no meaning on an unbounded stream and raise.
Duplicate removal needs state: it is allowed with an event-time watermark
(``dropDuplicatesWithinWatermark``), which bounds that state.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewash.operators import casts, clean
from tablewash.plans.recipe import STEP_ORDER, Recipe
from tablewash.session import ensure_checkpoint_dir


class NotStreamable(ValueError):
    pass


def apply_recipe_stream(
    df: DataFrame,
    recipe: Recipe,
    key_columns=(),
    event_time: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Apply a recipe to a streaming DataFrame (fixed step order)."""
    out = df
    if event_time and watermark:
        out = out.withWatermark(event_time, watermark)
    for name in STEP_ORDER:
        if not recipe.has(name):
            continue
        p = recipe.get(name) or {}
        if name == "replace_zeros":
            out = clean.replace_zeros(out, p.get("columns", "all"), key_columns=key_columns)
        elif name == "handle_missing":
            method = p["method"].lower()
            value = p.get("fill_value")
            if method == "drop_rows":
                out = clean.drop_rows_any(out, key_columns)
            elif method == "fill" and not (isinstance(value, str) and value.lower() in clean.FILL_METHODS):
                out = clean.fill_literal(out, value, key_columns=key_columns, on_mismatch="skip")
            else:
                raise NotStreamable(f"handle_missing {method}/{value} needs the whole table")
        elif name == "remove_duplicates":
            if str(p.get("remove", "yes")).lower() not in ("yes", "true"):
                continue
            if not (event_time and watermark):
                raise NotStreamable("duplicate removal on a stream needs event_time and watermark")
            cols = [c for c in out.columns if c not in set(key_columns)]
            out = out.dropDuplicatesWithinWatermark(cols)
        elif name == "fix_types":
            if p.get("mode", "guard") != "coerce":
                raise NotStreamable("fix_types on a stream runs in coerce mode only")
            out = casts.fix_types(out, p.get("conversions", {}), mode="coerce",
                                  datetime_format=p.get("datetime_format"), epoch_unit=p.get("epoch_unit", "ns"))
        elif name == "trim_whitespace":
            out = clean.trim_text(out, p.get("columns"), key_columns=key_columns)
        elif name == "standardize_case":
            out = clean.standardize_case(out, p.get("case", "none"), key_columns=key_columns)
    return out


def start_parquet_sink(df: DataFrame, path: str, checkpoint_location: str | None = None,
                       trigger_available_now: bool = True) -> StreamingQuery:
    """Append the cleaned stream to Parquet files. The checkpoint location
    defaults to a folder under ``spark.checkpoint.dir`` (shared storage) that is named
    after ``path``, so a restarted query of the same output resumes exactly once."""
    named = hashlib.sha256(path.encode()).hexdigest()[:24]
    loc = checkpoint_location or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tablewash/stream-{named}"
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", loc).outputMode("append")
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
