"""Places of regular-expression matches as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def none_of(kind: str) -> Column:
    """An empty array with elements of a SQL type."""
    return F.expr(f"cast(array() as array<{kind}>)")


def matches(text: Column, pattern: str, group: int | None = None, context: int = 0) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, match, value, before), in code points, end exclusive.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches; lengths add up to places,
    in chunks, so that thousands of matches in one text stay cheap. ``value`` is the given group, ``before`` up to
    ``context`` characters in front of the match (not beyond the match before). The pattern must not match
    the empty text; a null text has no matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), values.alias("value")),
                       lambda r: F.struct(F.length(r["gap"]).alias("gap"), r["match"].alias("match"), r["value"].alias("value"),
                                          (F.expr("''") if not context else F.right(r["gap"], F.lit(context))).alias("before")))
    rows = F.filter(rows, lambda r: r["match"].isNotNull())

    def place(rows):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")),
                             lambda i: F.slice(rows, i * CHUNK + 1, CHUNK))
        return let(chunks, lambda cs: let(
            F.aggregate(cs, F.array(F.lit(0)), lambda done, c: F.concat(done, F.array(
                F.element_at(done, -1) + F.aggregate(c, F.lit(0), lambda n, r: n + r["gap"] + F.length(r["match"]))))),
            lambda firsts: F.flatten(F.transform(cs, lambda c, i: F.aggregate(
                c, none_of("struct<start:int,end:int,match:string,value:string,before:string>"),
                lambda done, r: let(
                    F.when(F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(F.get(firsts, i)) + r["gap"],
                    lambda at: F.concat(done, F.array(F.struct(
                        at.alias("start"), (at + F.length(r["match"])).alias("end"), r["match"].alias("match"),
                        r["value"].alias("value"), r["before"].alias("before"))))))))))

    return let(rows, lambda rs: F.when(F.size(rs) > 0, place(rs)).otherwise(
        none_of("struct<start:int,end:int,match:string,value:string,before:string>")))


def spans_of(found: Column, rank: int, kind: str) -> Column:
    """Matches as (rank, kind, start, end)."""
    return F.transform(found, lambda m: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def printed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
