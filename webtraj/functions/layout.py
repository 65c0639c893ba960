"""What an observation costs as an image: compaction, lines, canvas, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pyudfs import wrap_lines
from .text import is_blank, strip

# Fixed values of the canvas: paddings, title bar, smallest image side, patch side.
PAD_X, PAD_Y, TITLE_HEIGHT, MIN_SIDE, PATCH = 20, 15, 35, 28, 14


def compact(text: Column) -> Column:
    """Line breaks and tabs, real or escaped, as blanks; runs of blanks squeezed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\\n|\\t|\n|\t", " "), " +", " "))


def compact_no_urls(text: Column) -> Column:
    """``compact`` that also drops ``url: http…`` properties."""
    flat = F.regexp_replace(text, r"\\n|\\t|\n|\t", " ")
    flat = F.regexp_replace(flat, r"(?U)url:\s*https?://\S+", "")
    return strip(F.regexp_replace(flat, " +", " "))


def chars_per_line(width: int, font_size: int) -> int:
    return max(10, int((width - 2 * PAD_X) / (font_size * 0.6)))


def estimated_lines(text: Column, per_line: int) -> Column:
    """Lines if every paragraph were filled to the last column; a blank paragraph takes one line."""
    sizes = F.transform(F.split(text, "\n", -1),
                        lambda p: F.when(is_blank(p), F.lit(1)).otherwise(F.ceil(F.length(p) / per_line).cast("int")))
    return F.when(text == "", F.lit(0)).otherwise(F.aggregate(sizes, F.lit(0), lambda a, x: a + x))


def wrapped_lines(text: Column, per_line: int) -> Column:
    """Exact word-wrapped lines; the wrap rules need Python's textwrap."""
    return wrap_lines(text, F.lit(per_line))


def drawn_text(text: Column, compacted: bool = True, max_chars: int | None = None) -> Column:
    """The text to draw: all of it unless the caller sets ``max_chars``."""
    head = text if max_chars is None else F.left(text, F.lit(max_chars))
    return compact(head) if compacted else head


def canvas(line_count: Column, line_height: int, max_height: int = 2048) -> Column:
    """Canvas height, whether it is cut, how many lines are drawn on it, and how many canvases hold all lines."""
    needed = line_count * line_height + (2 * PAD_Y + TITLE_HEIGHT)
    cut = needed > max_height
    # A line is drawn while two more would still fit above the bottom.
    fitting = F.greatest(F.floor((F.lit(max_height) - (PAD_Y + TITLE_HEIGHT)) / line_height) - 1, F.lit(0))
    return F.struct(
        F.when(cut, F.ceil(line_count / F.greatest(fitting, F.lit(1)))).otherwise(F.lit(1)).cast("int").alias("canvases"),
        F.least(needed, F.lit(max_height)).cast("int").alias("height"),
        cut.alias("truncated"),
        F.when(cut, F.least(fitting, line_count)).otherwise(line_count).cast("int").alias("lines_drawn"),
    )


def chars_drawn(lines: Column, lines_drawn: Column) -> Column:
    """Characters on the drawn lines."""
    return F.aggregate(F.slice(lines, F.lit(1), lines_drawn), F.lit(0), lambda a, x: a + F.length(x))


def simple_canvas_height(width: int, aspect_ratio: str = "4:3") -> int:
    if aspect_ratio not in ("1:1", "4:3"):
        raise ValueError("aspect_ratio must be '1:1' or '4:3'")
    return width if aspect_ratio == "1:1" else int(width * 3 / 4)


def compressed_side(side: Column, factor: float) -> Column:
    """Side after shrinking the area by ``factor``, never below the smallest side."""
    if factor <= 1.0:
        return side.cast("int")
    return F.greatest(F.lit(MIN_SIDE), F.floor(side * (1.0 / factor ** 0.5)).cast("int"))


def image_tokens(width: Column, height: Column, patch: int = PATCH) -> Column:
    """Patches that cover the image; 0 without an image."""
    return F.coalesce((F.ceil(width / patch) * F.ceil(height / patch)).cast("bigint"), F.lit(0).cast("bigint"))


def token_costs(text_tokens: Column, original: Column, final: Column | None = None) -> Column:
    """Image tokens against text tokens, as numbers and as the usual report strings."""
    final = F.coalesce(final, original) if final is not None else original
    ratio = F.when(text_tokens > 0, final / text_tokens).otherwise(F.lit(float("inf")))
    factor = F.when(final > 0, text_tokens / final).otherwise(F.lit(0.0))
    return F.struct(
        text_tokens.alias("text_tokens"), original.alias("original_image_tokens"), final.alias("final_image_tokens"),
        ratio.alias("cost_ratio"), factor.alias("compression"),
        F.when(text_tokens > 0, F.format_string("%.2f%%", ratio * 100)).otherwise(F.lit("inf%")).alias("token_cost_ratio"),
        F.format_string("%.2fx", factor).alias("compression_factor"),
    )


def token_count(text: Column, tokenizer=None) -> Column:
    """Text tokens: words and punctuation marks, or whatever ``tokenizer(text) -> Column`` counts."""
    if tokenizer is not None:
        return tokenizer(text)
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def image_name(text: Column) -> Column:
    """File name by content, so equal observations share one image."""
    return F.concat(F.lit("obs_"), F.md5(text), F.lit(".png"))
