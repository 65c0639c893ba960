"""Training-run texts: metric lines, number formats, experiment tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_numeric_text

STEP_KEY = "training/global_step"


def metric_text(line: Column, key: str) -> Column:
    """Text after the first ``key:`` up to the next blank, free of number wrappers; null without the key."""
    rest = F.substr(line, F.instr(line, f"{key}:") + len(key) + 1)
    # Leading blanks do not count, as in awk's field splitting.
    value = F.regexp_extract(rest, r"\A[ \t]*([^ \t]*)", 1)
    return F.when(line.contains(f"{key}:"), F.regexp_replace(value, r"np.float64\(|np.int32\(|\)", ""))


def metric_value(line: Column, key: str) -> Column:
    """The metric as a number, null if it is absent or no number."""
    text = metric_text(line, key)
    return F.when(is_numeric_text(text), text.try_cast("double"))


def step_of(line: Column) -> Column:
    return F.regexp_extract(line, rf"{STEP_KEY}:(\d+)", 1).try_cast("bigint")


def is_metric_line(line: Column, key: str) -> Column:
    return line.contains(f"{STEP_KEY}:") & line.contains(f"{key}:")


def format_fixed(text: Column, digits: int = 4) -> Column:
    """A numeric text with a fixed number of decimals, any other text unchanged."""
    return F.when(is_numeric_text(text), F.format_string(f"%.{digits}f", text.try_cast("double"))).otherwise(text)


def format_scientific(text: Column) -> Column:
    return F.when(is_numeric_text(text), F.format_string("%.2e", text.try_cast("double"))).otherwise(text)


# Tag prefixes in matching order, and the setting each one holds.
TAG_PREFIXES = (
    ("warmup", "lr_warmup_steps"), ("maxturns", "max_turns"), ("turns", "max_turns"), ("mt", "max_turns"),
    ("kl", "kl_loss_coef"), ("lr", "lr"), ("n", "n"), ("b", "batch"), ("t", "temp"), ("e", "epoch"),
)
REQUIRED = (("n", "n"), ("b", "batch"), ("lr", "lr"), ("t", "temp"), ("kl", "kl_loss_coef"), ("warmup", "lr_warmup_steps"))


def parse_experiment(tag: Column, default_epoch: str = "8") -> Column:
    """Settings written in an experiment tag such as ``n6_b64_lr4e-7``; ``error`` tells what is wrong."""
    def name_value(token: Column) -> Column:
        out = None
        for prefix, setting in TAG_PREFIXES:
            hit = F.struct(F.lit(setting).alias("name"), F.substr(token, F.lit(len(prefix) + 1)).alias("value"))
            cond = token.startswith(prefix)
            out = F.when(cond, hit) if out is None else out.when(cond, hit)
        return out

    tokens = F.split(tag, "_", -1)
    pairs = F.transform(tokens, name_value)

    def setting(name: str) -> Column:
        own = F.filter(pairs, lambda p: p["name"] == name)
        return F.coalesce(F.try_element_at(own, F.lit(-1))["value"], F.lit(""))

    values = {name: setting(name) for _, name in TAG_PREFIXES}
    values["epoch"] = F.when(values["epoch"] == "", F.lit(default_epoch)).otherwise(values["epoch"])
    unknown = F.try_element_at(F.filter(tokens, lambda t: name_value(t).isNull()), F.lit(1))
    missing = F.array_compact(F.array(*[F.when(values[name] == "", F.lit(short)) for short, name in REQUIRED]))
    error = (
        F.when(unknown.isNotNull(), F.concat(F.lit("unknown token "), unknown))
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields "), F.array_join(missing, " ")))
    )
    order = ("n", "batch", "lr", "temp", "epoch", "kl_loss_coef", "lr_warmup_steps", "max_turns")
    return F.struct(*[values[n].alias(n) for n in order], error.alias("error"))
