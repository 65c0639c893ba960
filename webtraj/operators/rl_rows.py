"""Question rows in the shape a trainer reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.observation import infer_data_source
from ..functions.templates import message
from ..functions.text import strip
from .ordered import ranked

DEFAULT_URL = "http://localhost:22015/wikipedia_en_all_maxi_2022-05/A/User:The_other_Kiwix_guy/Landing/"


def _has(df: DataFrame, struct: str, name: str) -> bool:
    t = df.schema[struct].dataType if struct in df.columns else None
    return isinstance(t, T.StructType) and name in t.names


def _text(c: Column) -> Column:
    """null for a missing or empty text."""
    return F.nullif(c.cast("string"), F.lit(""))


def adapt_rows(df: DataFrame, system_prompt: str, data_source: str | None = None, url: str = DEFAULT_URL,
               paths: tuple[str, ...] = ()) -> DataFrame:
    """Seed rows with source, answers, ids, reward model and a two-message prompt filled in.

    A given or path-inferred source wins over the stored one. ``gt`` falls back to the selected answer,
    then to the first golden answer, then to ''. ``id`` falls back to ``index``, then to 0.
    """
    has = lambda name: _has(df, "extra_info", name)
    info = lambda name: F.col("extra_info")[name] if has(name) else F.lit(None).cast("string")

    inferred = infer_data_source(*[F.lit(p) for p in paths]) if paths else F.lit(None).cast("string")
    stored = F.col("data_source") if "data_source" in df.columns else F.lit(None).cast("string")
    source = F.coalesce(F.lit(data_source).cast("string"), inferred, _text(stored), info("data_source"), F.lit("unknown"))

    golden = F.array().cast("array<string>")
    if has("golden_answers"):
        raw = F.col("extra_info.golden_answers")
        if isinstance(df.schema["extra_info"].dataType["golden_answers"].dataType, T.ArrayType):
            golden = F.coalesce(raw.cast("array<string>"), golden)
        else:
            golden = F.when(_text(raw).isNull(), golden).otherwise(F.array(raw.cast("string")))

    question = F.coalesce(strip(info("question")), F.lit("None") if has("question") else F.lit(""))
    gt = F.coalesce(_text(info("gt")), _text(info("selected_answer")), F.try_element_at(golden, F.lit(1)), F.lit(""))
    ident = info("id") if has("id") else (F.col("extra_info.index") if has("index") else F.lit(0))

    truth = golden
    if _has(df, "reward_model", "ground_truth"):
        own = F.col("reward_model.ground_truth")
        if not isinstance(df.schema["reward_model"].dataType["ground_truth"].dataType, T.ArrayType):
            own = F.when(_text(own).isNotNull(), F.array(own.cast("string")))
        truth = F.coalesce(own, golden)
    style = F.col("reward_model.style") if _has(df, "reward_model", "style") else F.lit("rule")

    first_turn = F.concat(F.lit("Objective: "), question, F.lit(f"\nURL: {url}\nObservation: None\nParsed Previous Action: None"))
    known = df.schema["extra_info"].dataType.names if "extra_info" in df.columns else []
    filled = {"data_source": source, "url": F.lit(url), "gt": gt, "id": ident}
    extra = F.struct(*[F.col("extra_info")[n].alias(n) for n in known if n not in filled],
                     *[c.alias(n) for n, c in filled.items()])
    return df.withColumns({
        "data_source": source,
        "prompt": F.array(message("system", F.lit(system_prompt)), message("user", first_turn)),
        "reward_model": F.struct(style.alias("style"), truth.alias("ground_truth")),
        "extra_info": extra,
    })


_USER_TEMPLATE = "OBJECTIVE: {question}\n\nURL: {url}\nOBSERVATION:\n{observation}\n"


def build_rows(df: DataFrame, split: str, order: list, bucket: Column, system_prompt: str, compat: bool = True) -> DataFrame:
    """Trainer rows from (question, golden_answers).

    ``compat`` numbers rows 0, 2, 4, … as the customary builder does; without it 0, 1, 2, …. The user
    text stays an unfilled template.
    """
    at = ranked(df, [], order, bucket, "__rn")
    index = F.col("__rn") * (2 if compat else 1)
    answer = F.coalesce(F.try_element_at("golden_answers", F.lit(1)), F.lit("N/A"))
    return at.select(
        F.lit("wiki_qa").alias("data_source"),
        F.array(message("system", F.lit(system_prompt)), message("user", F.lit(_USER_TEMPLATE))).alias("prompt"),
        F.lit("wiki").alias("ability"), F.struct(F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("seed"), index.alias("index"), F.col("question"),
                 F.col("golden_answers"), answer.alias("selected_answer")).alias("extra_info"))
