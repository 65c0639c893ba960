"""Element boxes against the viewport."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

COMPAT_THRESHOLD = 0.6
VISIBLE_THRESHOLD = 0.3


def _overlap(start: Column, length: Column, size) -> Column:
    size = size if isinstance(size, Column) else F.lit(float(size))
    return F.greatest(F.lit(0.0), F.least(start + length, size) - F.greatest(start, F.lit(0.0)))


def viewport_ratio(x: Column, y: Column, w: Column, h: Column, win_w, win_h, compat: bool = True) -> Column:
    """Share of a box inside the window.

    ``compat`` keeps the customary formula overlap / w * h, which multiplies by the height; without it
    the overlap is divided by the area.
    """
    area = _overlap(x, w, win_w) * _overlap(y, h, win_h)
    return F.try_divide(area, w) * h if compat else F.try_divide(area, w * h)


def is_in_viewport(x: Column, y: Column, w: Column, h: Column, win_w, win_h,
                   threshold: float = VISIBLE_THRESHOLD) -> Column:
    return F.coalesce(viewport_ratio(x, y, w, h, win_w, win_h, compat=False) > threshold, F.lit(False))


def survives_viewport(x: Column, y: Column, w: Column, h: Column, win_w, win_h) -> Column:
    """Whether a node stays in a pruned tree: it has a box, the box has an area, and enough of it shows."""
    ratio = viewport_ratio(x, y, w, h, win_w, win_h, compat=True)
    return F.coalesce((w != 0) & (h != 0) & (ratio >= COMPAT_THRESHOLD), F.lit(False))


def meets_window(x: Column, y: Column, w: Column, h: Column, win: tuple[float, float, float, float]) -> Column:
    """Whether a box touches the window rectangle (x, y, width, height)."""
    wx, wy, ww, wh = (float(v) for v in win)
    return F.coalesce(~((x + w < wx) | (x > wx + ww) | (y + h < wy) | (y > wy + wh)), F.lit(False))


def centre(x: Column, y: Column, w: Column, h: Column, win_w: float, win_h: float) -> Column:
    """Centre of a box in units of the viewport."""
    return F.struct(((x + w / 2) / win_w).alias("x"), ((y + h / 2) / win_h).alias("y"))


def parse_rect(text: Column) -> Column:
    """``"x,y,w,h"`` as four doubles, null unless there are exactly three commas and four numbers."""
    parts = F.transform(F.split(strip(text), ",", -1), lambda p: strip(p).try_cast("double"))
    good = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(good, F.struct(*[parts[i].alias(n) for i, n in enumerate("xywh")]))


def _letter(n: Column) -> Column:
    """The character n places behind A, whatever its code; surrogates are no characters and an error."""
    code = (n + 65).cast("int")
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")  # char() takes its argument modulo 256
    return F.when(code < 256, F.char(code)).when(code.between(0xD800, 0xDFFF), F.raise_error(F.lit("label beyond the characters"))).otherwise(wide)


def ordered_label(i: Column) -> Column:
    """Label of position i: A..Z, then AA..ZZ, then AAA..ZZZ; the first letter goes on past Z: [AA, …, ճAA, …"""
    letter = lambda n: F.char((n + 65).cast("int"))
    past = i - 26
    pair = F.concat(letter(F.floor(past / 26) % 26), letter(past % 26))
    lead = F.floor(past / 676)
    return F.when(i < 26, letter(i)).when(lead == 0, pair).otherwise(F.concat(_letter(lead - 1), pair))


def label_place(label: Column) -> Column:
    """Place of an ordered label, null for any other text."""
    code = lambda n: F.ascii(F.substring(label, n, 1)) - 65
    return (F.when(label.rlike(r"\A[A-Z]\z"), code(1)).when(label.rlike(r"\A[A-Z]{2}\z"), 26 + code(1) * 26 + code(2))
            .when(label.rlike(r"\A[A-\x{10FFFF}][A-Z]{2}\z"), 26 + (code(1) + 1) * 676 + code(2) * 26 + code(3)))


def hashed_label(key: Column, letters: int = 3) -> Column:
    """Label that looks random yet is the same on every run: letters drawn from the hex digits of a hash of the key."""
    digit = lambda n: F.ascii(F.substring(F.md5(key.cast("string")), n + 1, 1))
    return F.concat(*[F.char((digit(2 * n) * 31 + digit(2 * n + 1)) % 26 + 65) for n in range(letters)])
