"""Look-ups in ascending arrays, and scans that carry a state from element to element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def lower_bound(values: Column, x: Column) -> Column:
    """Place of the first element of an ascending array that isn't below ``x`` (its size if there is none)."""
    return _bound(values, lambda v: v < x)


def upper_bound(values: Column, x: Column) -> Column:
    """Place of the first element of an ascending array above ``x`` (its size if there is none)."""
    return _bound(values, lambda v: v <= x)


def _bound(values: Column, before) -> Column:
    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(before(F.get(values, mid)), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 2)).cast("int") + 1)
    return F.aggregate(rounds, start, halve, lambda s: s["lo"])


def place(ids: Column, x: Column) -> Column:
    """0-based place of ``x`` in ascending ``ids``, -1 where it is missing."""
    return let(lower_bound(ids, x), lambda i: F.when(F.get(ids, i) == x, i).otherwise(F.lit(-1)))


CHUNK = 128


def scan(items: Column, start: Column, step, out, out_type: str) -> Column:
    """``out(state)`` after each item, the state being carried from item to item by ``step(state, item)``.

    An aggregate copies its state for every item, so results never grow inside one for long: of more than ``CHUNK``
    items the states at the start of each chunk come first, then the chunks are scanned apart.
    """
    none = F.array().cast(f"array<{out_type}>")
    inside = lambda some, state: F.aggregate(some, F.struct(state.alias("s"), none.alias("out")), lambda acc, x: let(step(acc["s"], x), lambda now: F.struct(
        now.alias("s"), F.concat(acc["out"], F.array(out(now).cast(out_type))).alias("out"))), lambda acc: acc["out"])

    def in_chunks(items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))
        first = F.struct(F.slice(F.array(F.struct(start.alias("s"))), 1, 0).alias("done"), start.alias("s"))
        states = lambda cs: F.aggregate(cs, first, lambda acc, c: F.struct(
            F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s")))).alias("done"), F.aggregate(c, acc["s"], step).alias("s")), lambda acc: acc["done"])
        return let(chunks, lambda cs: F.flatten(F.zip_with(cs, states(cs), lambda c, at: inside(c, at["s"]))))

    return let(items, lambda xs: F.when(F.size(xs) > CHUNK, in_chunks(xs)).otherwise(inside(xs, start)))
