"""Steps and tasks: segmentation, histories, nesting, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import templates as T
from ..functions.layout import image_name
from ..functions.observation import parse_prompt
from .ordered import runs


def role_text(messages: Column, role: str) -> Column:
    """Content of the first message with this role, '' without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"], F.lit(""))


def parsed_steps(samples: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """Chat samples as step rows: system text, parsed user prompt, assistant text."""
    system = F.lit(system_prompt) if system_prompt is not None else role_text(F.col("messages"), "system")
    return (
        samples.withColumn("system", system)
        .withColumn("prompt", parse_prompt(role_text(F.col("messages"), "user")))
        .withColumn("assistant", role_text(F.col("messages"), "assistant"))
    )


def segment_tasks(steps: DataFrame, key: Column, order: list, bucket: Column, file: list[str] | None = None,
                  name: str = "task_no") -> DataFrame:
    """Number tasks: a new one starts whenever the key differs from the previous row's, per file."""
    return runs(steps, file or [], order, bucket, key, name)


STEPS_PER_BLOCK = 256


def step_history(steps: DataFrame, key: str, order: str, action: str = "action", conclusion: str = "conclusion",
                 keep_blanks: bool = False, block: Column | None = None) -> DataFrame:
    """``history_action`` and ``history_info``: everything before the step, one entry per line.

    Each starts with a line break. Blank entries are skipped, or kept as blanks with ``keep_blanks``. A trajectory is
    cut into blocks of steps (``block`` must never decrease along ``order``; ``STEPS_PER_BLOCK`` by default): the text of
    a block is put together once, the texts of all blocks before it are its prefix, and a step adds the tail of its own
    block. So no task sorts a whole trajectory; what remains long is the history text itself. A null key is a
    trajectory like others.
    """
    columns, names = steps.columns, {"history_action": action, "history_info": conclusion}
    cut = block if block is not None else F.floor(F.col(order) / STEPS_PER_BLOCK)

    def entry(c: str) -> Column:
        line = F.concat(F.col(c), F.lit("\n"))
        return line if keep_blanks else F.when(F.col(c) != "", line)

    marked = steps.withColumn("__part", F.struct(F.col(key).alias("k"), cut.alias("b"))).withColumns({f"__{n}": entry(c) for n, c in names.items()})
    before = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = marked.withColumns({f"__{n}": F.array_join(F.collect_list(f"__{n}").over(before), "") for n in names})
    blocks = marked.groupBy("__part").agg(*[
        F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(f"__{n}").alias("t")))).getField("t"), "").alias(f"__all_{n}") for n in names])
    earlier = Window.partitionBy("__part.k").orderBy("__part.b").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = blocks.select("__part", *[F.array_join(F.collect_list(f"__all_{n}").over(earlier), "").alias(f"__before_{n}") for n in names])
    return rows.join(prefixes, "__part").select(
        *[f"`{c}`" for c in columns], *[F.concat(F.lit("\n"), f"__before_{n}", f"__{n}").alias(n) for n in names])


def nested_history(steps: Column, field: str, keep_blanks: bool = False) -> Column:
    """The same history for a nested step array: one text per step, without a shuffle."""
    entries = F.transform(steps, lambda s: F.coalesce(s[field], F.lit("")))

    def line(e: Column) -> Column:
        full = F.concat(e, F.lit("\n"))
        return full if keep_blanks else F.when(e != "", full).otherwise(F.lit(""))

    return F.transform(entries, lambda _, i: F.concat(
        F.lit("\n"), F.array_join(F.transform(F.slice(entries, F.lit(1), i), line), "")))


def step_samples(steps: DataFrame, style: str = "opensource") -> DataFrame:
    """Step-level vision samples from ``parsed_steps`` rows."""
    image = F.concat(F.lit("images/"), image_name(F.col("prompt.observation")))
    text = T.vision_user_text(F.col("prompt"), style)
    if style == "openai":
        content = T.content_parts(text, image)
        as_parts = T.parts_of_text
    else:
        content, as_parts = text, lambda c: c
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    out = steps.withColumn("messages", F.array(
        msg("system", as_parts(F.col("system"))), msg("user", content), msg("assistant", as_parts(F.col("assistant")))))
    out = out.withColumn("subset", F.concat(F.coalesce("subset", F.lit("vision_dataset")), F.lit("_vision")))
    out = out.withColumn("stage", F.coalesce("stage", F.lit("sft")))
    return out.withColumn("images", F.array(image)) if style == "opensource" else out


def task_samples(steps: DataFrame, task: list[str], order: str, position: str, steps_per_row: int | None = None) -> DataFrame:
    """Task-level samples: one system message, then the user and assistant message of every step in order.

    A task is one sample however long it is. Only on request do tasks of more than ``steps_per_row`` steps
    continue in further rows (``chunk`` 1, 2, …; ``position`` is the 0-based step within the task).
    """
    image = F.concat(F.lit("images/"), image_name(F.col("prompt.observation")))
    step = F.struct(
        F.col(order).alias("o"), T.vision_user_text(F.col("prompt")).alias("user"), F.col("assistant"),
        image.alias("image"), F.col("system"), F.col("subset"), F.col("stage"))
    chunk = F.lit(0) if steps_per_row is None else F.floor(F.col(position) / steps_per_row).cast("int")
    chunked = steps.withColumn("chunk", chunk)
    nested = chunked.groupBy(*task, "chunk").agg(F.array_sort(F.collect_list(step)).alias("s"))
    turns = F.flatten(F.transform("s", lambda x: F.array(T.message("user", x["user"]), T.message("assistant", x["assistant"]))))
    first = F.col("s")[0]
    return nested.select(
        *task, "chunk", F.concat(F.array(T.message("system", first["system"])), turns).alias("messages"),
        F.col("s.image").alias("images"),
        F.concat(F.coalesce(first["subset"], F.lit("vision_dataset")), F.lit("_vision")).alias("subset"),
        F.coalesce(first["stage"], F.lit("sft")).alias("stage"))


def sample_steps(mode: str, has_images: bool = True) -> Column:
    """Steps of a sample: 1 per row, or in task mode its images, else its user turns (at least 1)."""
    if mode == "step":
        return F.lit(1)
    users = F.greatest(F.size(F.filter("messages", lambda m: m["role"] == "user")), F.lit(1))
    return F.coalesce(F.when(F.col("images").isNotNull(), F.size("images")), users) if has_images else users


def dataset_profile(samples: DataFrame, mode: str) -> DataFrame:
    """Tasks, steps and image references of a sample file; rows that continue a task are no tasks of their own."""
    first = F.count_if(F.col("chunk") == 0) if "chunk" in samples.columns else F.count(F.lit(1))
    has_images = "images" in samples.columns
    refs = F.coalesce(F.when(F.col("images").isNotNull(), F.size("images")), F.lit(0)) if has_images else F.lit(0)
    return samples.agg(first.alias("tasks"), F.coalesce(F.sum(sample_steps(mode, has_images)), F.lit(0)).alias("steps"),
                       F.coalesce(F.sum(refs), F.lit(0)).alias("image_refs"))


def steps_per_task(steps: DataFrame, task: list[str]) -> DataFrame:
    """Total steps and mean, largest and smallest task; zeros for an empty input."""
    sizes = steps.groupBy(*task).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    return sizes.agg(
        F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("n"), zero).alias("steps"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_steps"), F.coalesce(F.max("n"), zero).alias("max_steps"),
        F.coalesce(F.min("n"), zero).alias("min_steps"))


def unique_observations(df: DataFrame, text: str) -> DataFrame:
    """Each observation once, with its image name: the input of a costly render step."""
    named = df.withColumn("image", image_name(F.col(text)))
    return named.groupBy("image").agg(F.first(text).alias(text), F.count(F.lit(1)).alias("uses"))


def image_manifest(samples: DataFrame, files: DataFrame) -> DataFrame:
    """References per image path and whether the file exists; ``files`` has one ``path`` per file."""
    refs = samples.select(F.explode("images").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("refs"))
    return refs.join(files.select("path").distinct().withColumn("__f", F.lit(True)), "path", "left").select(
        "path", "refs", F.coalesce("__f", F.lit(False)).alias("found"))
