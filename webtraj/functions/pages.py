"""HTML texts and their attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, words


def clean_html(html: Column) -> Column:
    """Without comments, styles and scripts, whitespace collapsed."""
    for pattern in (r"(?s)<!--.*?-->", r"(?s)<style.*?>.*?</style>", r"(?s)<script.*?>.*?</script>"):
        html = F.regexp_replace(html, pattern, "")
    return strip(F.regexp_replace(html, r"(?U)\s+", " "))


def node_text(text: Column, width: int | None = None) -> Column:
    """Stripped text; a ``width`` shortens it."""
    whole = strip(F.coalesce(text, F.lit("")))
    return whole if width is None else F.left(whole, F.lit(width))


def _carries_meaning(key: Column, value: Column) -> Column:
    """Not a role or type that says nothing to a reader."""
    return ~(((key == "role") & value.isin("presentation", "none", "link")) | ((key == "type") & (value == "hidden")))


def shown_attributes(attrs: Column, wanted: list[str] | None = None, hidden: tuple[str, ...] = (),
                     width: int | None = None) -> Column:
    """Attributes to print, as (key, val) in order.

    All of them when no list is given, blanks included; else the wanted ones in list order, without blanks.
    """
    if wanted:
        entries = F.transform(F.array(*[F.lit(w) for w in wanted]), lambda k: F.struct(
            k.alias("key"), F.try_element_at(attrs, k).alias("val")))
        entries = F.filter(entries, lambda e: e["val"].isNotNull() & (node_text(e["val"]) != ""))
    else:
        entries = F.transform(F.map_entries(attrs), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("val")))
    kept = F.filter(entries, lambda e: _carries_meaning(e["key"], e["val"]) & ~e["key"].isin(*hidden) if hidden
                    else _carries_meaning(e["key"], e["val"]))
    return F.transform(kept, lambda e: F.struct(e["key"].alias("key"), node_text(e["val"], width).alias("val")))


def meaningful_attributes(attrs: Column) -> Column:
    """The same rule as a map filter."""
    return F.map_filter(attrs, lambda k, v: _carries_meaning(k, v) & (strip(v) != ""))


def clean_attribute(value: Column) -> Column:
    """Without opacity blocks and injected marker words, whitespace collapsed."""
    plain = F.regexp_replace(value, r"(?Ud)\{\s*opacity:\s*.*;*\s*\}", " ")
    return F.array_join(F.filter(words(plain), lambda w: ~w.contains("vimium")), " ")
