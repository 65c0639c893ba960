"""Text helpers with the matching rules of Python's ``re`` and ``str``, written as Spark expressions.

Pattern flags used throughout: ``(?d)`` keeps ``.``, ``^`` and ``$`` bound to ``\\n`` only, ``(?s)`` lets
``.`` cross lines, ``(?U)`` makes ``\\s``, ``\\d`` and ``\\w`` cover Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    For expressions nested in higher-order functions, where no column can be staged.
    """
    return F.transform(F.array(value), body)[0]


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without a match (an empty group stays '')."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the last match, null without a match."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def after_last(c: Column, mark: str) -> Column:
    """Text after the last ``mark``; the whole text if it never occurs."""
    return F.substring_index(c, mark, -1)


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def after_first(c: Column, mark: str) -> Column:
    """Text after the first ``mark``; '' if it never occurs."""
    return F.substr(c, F.length(before_first(c, mark)) + F.lit(len(mark) + 1))


def squeeze(c: Column) -> Column:
    """str.split() joined by single blanks."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """str.split(): no empty pieces."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def is_numeric_text(c: Column) -> Column:
    """Plain decimal or scientific notation; nan, inf and NA are not numbers."""
    return c.rlike(r"\A[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?\z")


UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"  # controls, formats, surrogates, private and unassigned signs, separators but the blank


def _escaped(char: Column) -> Column:
    """One character, as an escape if it is not printable."""
    code = F.ascii(char)
    digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
    return F.when(~char.rlike(UNPRINTABLE), char).when(code < 256, F.concat(F.lit("\\x"), digits(2))).when(
        code < 65536, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))


def py_repr(c: Column) -> Column:
    """Quoting as repr() does: single quotes unless the text holds ' and no ", unprintable characters escaped."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    body = F.when(body.rlike(UNPRINTABLE), F.array_join(F.transform(F.split(body, ""), _escaped), "")).otherwise(body)
    double_quoted = c.contains("'") & ~c.contains('"')
    return F.when(double_quoted, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 with the divisor raised to at least 1."""
    return part / F.greatest(whole, F.lit(1)) * F.lit(100.0)
