"""Fields whose type changes from record to record (``success``, ``extra_info``), read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pyudfs import question_text
from .text import strip


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def field(record: Column, name: str) -> Column:
    """Variant field of a variant record; SQL NULL if the key is absent, variant null if it holds null."""
    return F.try_variant_get(record, f"$.{name}", "variant")


def as_string(v: Column) -> Column:
    """The value if it is a string, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def truthy(v: Column) -> Column:
    """Python truth of a JSON value; an absent key counts as false."""
    kind = _kind(v)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY"), F.to_json(v) != "[]")
        .when(kind.startswith("OBJECT"), F.to_json(v) != "{}")
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def not_false(v: Column) -> Column:
    """Present and not the boolean false: null, 0 and '' count, an absent key does not."""
    return v.isNotNull() & ~F.coalesce(
        (_kind(v) == "BOOLEAN") & ~F.try_variant_get(v, "$", "boolean"), F.lit(False)
    )


def true_or_valid(v: Column) -> Column:
    """Exactly true, or the string "valid"."""
    kind = _kind(v)
    return F.coalesce(
        ((kind == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"))
        | ((kind == "STRING") & (F.try_variant_get(v, "$", "string") == "valid")),
        F.lit(False),
    )


def answer_contains_truth(answer: Column, truth: Column) -> Column:
    """Case-blind containment; an empty or missing truth never succeeds."""
    return F.coalesce((truth != "") & F.contains(F.lower(answer), F.lower(truth)), F.lit(False))


def question_of_struct(extra_info: Column) -> Column:
    return F.coalesce(strip(extra_info["question"]), F.lit(""))


def question_of_json(extra_info: Column) -> Column:
    """Trimmed question of a JSON text; '' when the JSON is broken or the question is no string."""
    return F.coalesce(strip(as_string(field(F.try_parse_json(extra_info), "question"))), F.lit(""))


def question_cast(extra_info: Column) -> Column:
    """Question of a Python-literal or JSON text, cast with str().

    Where both readings agree, JSON is read natively: a text question without escapes, or no question. Python is
    asked for the other rows only.
    """
    value = field(F.try_parse_json(extra_info), "question")
    plain = (_kind(value) == "STRING") & ~extra_info.contains("\\")
    asked = question_text(F.when(~F.coalesce(plain, F.lit(False)), extra_info))
    return F.coalesce(strip(F.when(plain, F.try_variant_get(value, "$", "string")).otherwise(asked)), F.lit(""))


def listed_question(item: Column) -> Column:
    """Entry of an exclusion list: a text, or an object with ``question`` or else ``Objective``."""
    return strip(
        F.coalesce(
            as_string(item),
            as_string(field(item, "question")),
            as_string(field(item, "Objective")),
        )
    )
