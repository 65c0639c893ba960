"""What went wrong in a step or a trajectory, as expressions over the reply and the observation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import actions as A
from .observation import element_type
from .text import after_last, let, strip, words

# Element types that accept typing, and types that take no click or hover.
INPUT_TYPES = ("textbox", "searchbox", "textarea", "combobox", "input")
STATIC_TYPES = ("statictext", "heading", "rootwebarea", "row", "cell", "table", "group", "paragraph", "text")

CAUSES = {
    1: "format_error", 2: "bad_element", 3: "action_loop", 4: "wrong_stop", 5: "lost",
}
DEFECTS = ("hallucinated_id", "element_mismatch", "action_loop", "format_error", "wrong_stop")
LOOP_LIMIT = 5


def format_error(reply: Column, match: Column, action: Column, valid: Column) -> Column:
    """Kind of format error of a reply, null if it is well formed."""
    tail = strip(after_last(reply, "</think>"))
    low = F.lower(tail)
    word = F.trim(F.lower(F.coalesce(F.try_element_at(words(tail), F.lit(1)), F.lit(""))), F.lit(":"))
    return (
        F.when(match != "", F.when(~valid, F.concat(F.lit("bad_syntax:"), bad_verb(action))))
        .when(~reply.contains("</think>"), F.lit("think_not_closed"))
        .when(tail == "", F.lit("nothing_after_think"))
        .when(low.contains("<action>") | low.contains("</action>"), F.lit("action_tag"))
        .when(tail.contains("`"), F.lit("backticks"))
        .when(word.isin(*A.VERBS), F.lit("bare_action"))
        .when(word.contains("action") | word.contains("step"), F.lit("lead_in_word"))
        .otherwise(F.lit("other_text"))
    )


def format_subtype(reply: Column, kind: Column) -> Column:
    """Finer kind for the tag and backtick errors, null for the rest."""
    tail = strip(after_last(reply, "</think>"))
    low = F.lower(tail)
    opened, closed = low.contains("<action>"), low.contains("</action>")
    tag = (
        F.when(opened & ~closed, F.lit("1_tag_not_closed"))
        .when(closed & ~opened, F.lit("2_tag_not_opened"))
        .when(F.instr(low, "<action>") > 1, F.lit("3_text_before_tag"))
        .otherwise(F.lit("4_tag_garbled"))
    )
    ticks = F.when(tail.startswith("`") & ~tail.startswith(A.FENCE), F.lit("1_too_few_backticks")).otherwise(
        F.lit("2_fence_garbled"))
    return F.when(kind == "action_tag", tag).when(kind == "backticks", ticks)


def bad_verb(action: Column) -> Column:
    return F.when(action == "", F.lit("EMPTY")).otherwise(F.substring_index(action, " ", 1))


def bad_action_sample(action: Column) -> Column:
    """``[verb] text`` with the whole action on one line."""
    return F.concat(F.lit("["), bad_verb(action), F.lit("] "), F.replace(action, F.lit("\n"), F.lit(" ")))


def mismatched(verb: Column, kind: Column) -> Column:
    """Whether a verb does not apply to an element type."""
    return F.coalesce(
        ((verb == "type") & ~kind.isin(*INPUT_TYPES)) | (verb.isin("click", "hover") & kind.isin(*STATIC_TYPES)),
        F.lit(False))


def loop_action(action: Column, stored: Column) -> Column:
    """Text counted for loops: the extracted action, else the stored one; null if neither exists."""
    stored = strip(F.coalesce(stored, F.lit("")))
    return F.when(action != "", action).when(stored != "", stored)


def step_diagnosis(reply: Column, observation: Column, stored: Column, dialect: str = "checker") -> Column:
    """All step findings as one struct, for use inside ``transform`` over a step array."""

    def with_match(m: Column) -> Column:
        return let(A.anchored_body(m), lambda act: with_action(m, act))

    def with_action(m: Column, act: Column) -> Column:
        valid = (m != "") & A.has_syntax(act, dialect)
        verb = F.when(valid, A.target_verb(act, dialect)).otherwise(F.lit(""))
        kind = F.when(verb != "", element_type(observation, A.target_id(act, dialect), dialect))
        return let(F.struct(verb.alias("verb"), kind.alias("kind"), valid.alias("valid")), lambda t: F.struct(
            (~t["valid"]).alias("format_error"),
            ((t["verb"] != "") & t["kind"].isNull()).alias("hallucinated_id"),
            mismatched(t["verb"], t["kind"]).alias("element_mismatch"),
            act.startswith("stop").alias("wrong_stop"),
            loop_action(act, stored).alias("loop_action"),
        ))

    reply = F.coalesce(reply, F.lit(""))
    return let(A.anchored_match(reply), with_match)


def has_loop(texts: Column, limit: int = LOOP_LIMIT) -> Column:
    """Whether any text occurs more than ``limit`` times: after sorting, equal texts sit side by side."""
    known = F.filter(texts, lambda t: t.isNotNull())
    return let(F.array_sort(known), lambda s: F.exists(
        F.when(F.size(s) > limit, F.sequence(F.lit(1), F.size(s) - limit)).otherwise(
            F.array().cast("array<int>")),
        lambda i: F.element_at(s, i) == F.element_at(s, i + limit)))


def primary_cause(format_err: Column, hallucinated: Column, mismatch: Column, loop: Column, stop: Column) -> Column:
    """Exclusive cause 1..5, the gravest first."""
    return (
        F.when(format_err, F.lit(1)).when(hallucinated | mismatch, F.lit(2))
        .when(loop, F.lit(3)).when(stop, F.lit(4)).otherwise(F.lit(5))
    )


def cause_name(cause: Column) -> Column:
    out = F
    for number, name in CAUSES.items():
        out = out.when(cause == number, F.lit(name))
    return out


def steps_diagnosis(steps: Column, dialect: str = "checker") -> Column:
    """Flags and cause of a whole step array, with no shuffle.

    Steps are structs with ``model_response``, ``observation`` and ``action``.
    """
    found = F.transform(
        steps, lambda s: step_diagnosis(s["model_response"], s["observation"], s["action"], dialect))

    def any_of(f: Column, name: str) -> Column:
        return F.coalesce(F.exists(f, lambda x: x[name]), F.lit(False))

    return let(found, lambda f: F.struct(
        any_of(f, "format_error").alias("format_error"),
        any_of(f, "hallucinated_id").alias("hallucinated_id"),
        any_of(f, "element_mismatch").alias("element_mismatch"),
        F.coalesce(has_loop(F.transform(f, lambda x: x["loop_action"])), F.lit(False)).alias("action_loop"),
        any_of(f, "wrong_stop").alias("wrong_stop"),
    ))


def cause_of(flags: Column) -> Column:
    return primary_cause(flags["format_error"], flags["hallucinated_id"], flags["element_mismatch"],
                         flags["action_loop"], flags["wrong_stop"])
