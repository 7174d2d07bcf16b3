"""Strict parsing of model replies into records, as column expressions.

A reply is: optional text, optionally a Markdown code fence, and a JSON array
of objects. The chain (all JVM-side, no UDF):

  unfence   first ``` fence (optional ``json`` tag), content stripped
  cut       when not starting with '[', cut at the first '['
  strict    the whole remaining text must be one JSON value (trailing text is
            an error), and it must be an array
  objects   non-object elements are dropped; an empty array gives no record
  fields    category validated, empty-like values -> NULL, body-part lists
            filtered by the vocabulary (order and repeats kept)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tablewash.functions.text import unicode_trim

# Markdown code fence around a reply, optional json tag (fixed value). Java
# regex: (?U) makes \s Unicode-aware like Python's re.
FENCE = r"(?U)```(?:json)?\s*([\s\S]*?)```"

RECORD_TYPE = (
    "struct<exercise_name:string,code:string,code_base:string,muscles:array<string>,"
    "assistance:string,repetitions:string,time:string>"
)


def unfence(raw: Column) -> Column:
    r = unicode_trim(raw)
    return F.when(r.contains("```") & r.rlike(FENCE), unicode_trim(F.regexp_extract(r, FENCE, 1))).otherwise(r)


def cut_to_array(body: Column) -> Column:
    at = F.instr(body, "[")
    return F.when(~body.startswith("[") & (at > 0), F.substr(body, at)).otherwise(body)


def strict_json_array(body: Column) -> tuple[Column, Column]:
    """(ok, variant): ok when ``body`` is exactly one JSON value and an array.
    ``try_parse_json`` alone accepts trailing text; wrapping the text in an
    array and requiring exactly one element rejects anything after the value."""
    v = F.try_parse_json(body)
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"r":'), body, F.lit("}")))
    ok = (
        v.isNotNull()
        & in_object.isNotNull()
        & (F.size(wrapped) == 1)
        & F.schema_of_variant(v).startswith("ARRAY")
    )
    return F.coalesce(ok, F.lit(False)), v


def object_elements(v: Column) -> Column:
    arr = F.try_variant_get(v, "$", "array<variant>")
    return F.filter(arr, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _field(x: Column, key: str) -> Column:
    return F.try_variant_get(x, f"$.{key}", "variant")


def empty_like_to_null(f: Column) -> Column:
    """Missing, null, '', false, 0, [] and {} -> NULL; anything else as text."""
    t = F.schema_of_variant(f)
    text = F.try_variant_get(f, "$", "string")
    return (
        F.when(f.isNull() | (t == "VOID"), F.lit(None).cast("string"))
        .when(t == "STRING", F.nullif(text, F.lit("")))
        .when(t == "BOOLEAN", F.when(text == "true", F.lit("true")))
        .when(t.startswith("ARRAY"), F.when(F.size(F.try_variant_get(f, "$", "array<variant>")) > 0, F.to_json(f)))
        .when(t.startswith("OBJECT"), F.when(t != "OBJECT<>", F.to_json(f)))
        .when(F.try_variant_get(f, "$", "double") == 0, F.lit(None).cast("string"))
        .otherwise(text)
    )


def validate_category(f: Column, categories: Sequence[str]) -> Column:
    """Trimmed lower-case value in the list -> capitalized; else 'unknown'."""
    is_text = F.schema_of_variant(f) == "STRING"
    low = F.lower(unicode_trim(F.try_variant_get(f, "$", "string")))
    return F.when(is_text & low.isin(list(categories)), F.initcap(low)).otherwise(F.lit("unknown"))


def vocabulary_filter(items: Column, vocabulary: Column) -> Column:
    """Keep list items found in the vocabulary array (exact match)."""
    return F.filter(items, lambda m: F.array_contains(vocabulary, m))


def record(x: Column, categories: Sequence[str], vocabulary: Column) -> Column:
    els = F.try_variant_get(x, "$.muscles", "array<variant>")
    names = F.transform(
        F.filter(F.coalesce(els, F.array().cast("array<variant>")), lambda e: F.schema_of_variant(e) == "STRING"),
        lambda e: F.try_variant_get(e, "$", "string"),
    )
    return F.struct(
        F.try_variant_get(x, "$.exercise_name", "string").alias("exercise_name"),
        F.try_variant_get(x, "$.code", "string").alias("code"),
        validate_category(_field(x, "code_base"), categories).alias("code_base"),
        vocabulary_filter(names, vocabulary).alias("muscles"),
        empty_like_to_null(_field(x, "assistance")).alias("assistance"),
        empty_like_to_null(_field(x, "repetitions")).alias("repetitions"),
        empty_like_to_null(_field(x, "time")).alias("time"),
    )


# The record used when no valid reply came back (fixed values):
# name "unknown", code "UNK", category "unknown", no body parts, three missing.
FALLBACK_NAME, FALLBACK_CODE, FALLBACK_CATEGORY = "unknown", "UNK", "unknown"


def fallback_records() -> Column:
    """The single record used when no valid reply came back."""
    return F.array(
        F.struct(
            F.lit(FALLBACK_NAME).alias("exercise_name"),
            F.lit(FALLBACK_CODE).alias("code"),
            F.lit(FALLBACK_CATEGORY).alias("code_base"),
            F.array().cast("array<string>").alias("muscles"),
            F.lit(None).cast("string").alias("assistance"),
            F.lit(None).cast("string").alias("repetitions"),
            F.lit(None).cast("string").alias("time"),
        )
    )


def parse_reply(raw: Column, categories: Sequence[str], vocabulary: Column) -> tuple[Column, Column]:
    """(ok, records ARRAY<record>) for one raw reply."""
    body = cut_to_array(unfence(raw))
    ok, v = strict_json_array(body)
    recs = F.transform(object_elements(v), lambda x: record(x, categories, vocabulary))
    return ok, F.when(ok, recs)
