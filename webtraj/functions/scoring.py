"""Answer and format scores, step rewards, reward mixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .actions import FENCE, answer_tag, has_syntax
from .pyudfs import match_ratio
from .text import after_first, before_first, first_match, let, strip

STEP_COST = -0.01
SUCCESS_SIMILARITY = 0.7
INVALID_PENALTY = -1.0


def format_score(reply: Column) -> Column:
    """0.3 for think tags, then 0.1 nothing before them, 0.2 an action, 0.2 nothing else, 0.2 valid syntax.

    Only triple-backtick actions count; without both think tags the score is 0.
    """
    def points(tail: Column) -> Column:
        return let(strip(first_match(tail, r"(?sd)```(.*?)```")), lambda action: (
            F.lit(3)
            + F.when(strip(before_first(reply, "<think>")) == "", 1).otherwise(0)
            + F.when(action.isNotNull(), 2).otherwise(0)
            + F.when(tail == F.concat(F.lit(FENCE), action, F.lit(FENCE)), 2).otherwise(0)
            + F.when(has_syntax(action, "reward"), 2).otherwise(0)
        ))

    has_tags = reply.contains("<think>") & reply.contains("</think>")
    return F.when(has_tags, F.round(let(strip(after_first(reply, "</think>")), points) / 10.0, 3)).otherwise(F.lit(0.0))


def clean_text(c: Column) -> Column:
    """Trimmed lower-case text without one layer of matching quotes."""
    t = F.lower(strip(c))
    quoted = (t.startswith("'") & t.endswith("'")) | (t.startswith('"') & t.endswith('"'))
    return F.when(quoted, F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)


def char_match_ratio(ref: Column, pred: Column) -> Column:
    """Matching-block characters over the longer length.

    Blocks are found greedily, longest first, as difflib defines them; Spark has no such built-in.
    """
    return match_ratio(ref, pred)


def tokens(c: Column) -> Column:
    """Distinct words and punctuation marks."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1)))


def token_f1(ref: Column, pred: Column) -> Column:
    """F1 over token sets."""
    r, p = tokens(ref), tokens(pred)
    shared = F.size(F.array_intersect(r, p))
    total = F.size(r) + F.size(p)
    return F.when((F.size(r) == 0) | (F.size(p) == 0), F.lit(0.0)).otherwise(shared * 2.0 / total)


def edit_ratio(ref: Column, pred: Column) -> Column:
    return F.levenshtein(ref, pred) / F.greatest(F.length(ref), F.length(pred), F.lit(1))


def fuzzy_score(ref: Column, pred: Column, alpha: float = 0.7, beta: float = 0.3, gamma: float = 0.1) -> Column:
    """alpha * matching characters + beta * token F1 - gamma * edit ratio, within [0, 1]."""
    r, p = clean_text(ref), clean_text(pred)
    score = char_match_ratio(r, p) * alpha + token_f1(r, p) * beta - edit_ratio(r, p) * gamma
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


def exact_match(refs: Column, pred: Column) -> Column:
    """1 if the trimmed lower-case prediction equals any reference, else 0."""
    normal = F.transform(refs, lambda r: F.lower(strip(r)))
    return F.coalesce(F.array_contains(normal, F.lower(strip(pred))), F.lit(False)).cast("int")


def step_reward(format_points: Column, similarity: Column, is_stop: Column) -> Column:
    """Cost of a step plus its format score, plus the answer similarity on a stop."""
    return F.lit(STEP_COST) + format_points + F.when(is_stop, similarity).otherwise(F.lit(0.0))


def episode_success(answered: Column, similarity: Column) -> Column:
    return F.coalesce(answered & (similarity >= SUCCESS_SIMILARITY), F.lit(False))


def tracked_reward(reward: Column, is_valid: Column) -> Column:
    """Reward with the penalty for an invalid action."""
    return reward + F.when(is_valid, F.lit(0.0)).otherwise(F.lit(INVALID_PENALTY))


def predicted_action(prediction: Column, invalid: str = "0") -> Column:
    """Action inside the <answer> tag and whether there is a valid one."""
    action = F.coalesce(answer_tag(prediction), F.lit(invalid))
    return F.struct(action.alias("action"), (action != invalid).alias("is_valid"))


def mixed_reward(answer: Column, format_points: Column, action_ok: Column | None = None,
                 hallucinated: Column | None = None, tool_invalid: Column | None = None, *,
                 enabled: bool = True, answer_weight: float = 0.9, format_weight: float = 0.1,
                 action_weight: float = 0.0, hallucinated_weight: float = 0.0,
                 tool_invalid_weight: float = 0.0) -> Column:
    """Weighted sum of the reward parts; all zero when disabled."""
    if not enabled:
        return F.lit(0.0)
    zero = F.lit(0.0)
    part = lambda c, w: (c.cast("double") if c is not None else zero) * w
    return (answer * answer_weight + format_points * format_weight + part(action_ok, action_weight)
            - part(hallucinated, hallucinated_weight) - part(tool_invalid, tool_invalid_weight))
