"""Secrets in texts: fixed forms, and strings whose sliding windows look random. DataFrame operations only.

Runs of base64 and of hexadecimal characters are candidates. A window slides over each; the counts of its
characters change by the one that enters and the one that leaves, and the entropy follows from the sum of c log c,
so a step costs the same however long the window is. Each character class has its own threshold. What is known to
be harmless (identifiers, numbers, words, file paths, alphabets, checksums announced as such) is suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, matches, none_of, printed, spans_of

# The forms of the contract. The second group of the first one is the value.
ASSIGN = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}+"  # a failing match lies in a run that holds no other
HEX = r"[0-9a-f]{32,}+"

WINDOW = 20
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
CLASSES = {  # candidate runs with a digit, characters, bits per character that look random
    "hex": (r"(?<![0-9a-fA-F])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{20,}+", "0123456789abcdefABCDEF", 3.0),
    "base64": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+", BASE64, 3.7),
}
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # identifiers
    r"^[0-9+/_-]+$",  # numbers and dates
    r"^[A-Za-z]+(?:[-_/+][A-Za-z]+)*[-_/+]?[0-9]{0,6}$",  # words, paths and names with a number
    r"(?i)abcdefgh|01234567|98765432|xxxxxx|example",  # alphabets and placeholders
    r"^/?(?:[A-Za-z0-9_-]{1,15}/)+[A-Za-z0-9_-]{0,15}$",  # paths of short parts
)
ANNOUNCED = r"(?i)(?:commit|sha-?1|sha-?256|sha-?512|md5|integrity|checksum|uuid)[\s:=\"'-]*$"
CONTEXT = 24


def random_range(value: Column, alphabet: str, threshold: float, window: int = WINDOW) -> Column:
    """(first, last): from the start of the first to the end of the last window whose entropy reaches ``threshold``; null for none."""
    g = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(value, "", -1), lambda c: F.instr(F.lit(alphabet), c) - 1)
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(codes):
        def move(state, i):
            enter = F.get(codes, i)
            leave = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))

            def counted(s):
                inc, dec = F.get(state["counts"], enter), F.coalesce(F.get(state["counts"], F.when(leave >= 0, leave)), F.lit(0))
                s = F.when(enter == leave, s).otherwise(
                    s + F.get(g, inc + 1) - F.get(g, inc) + F.when(leave >= 0, F.get(g, dec - 1) - F.get(g, dec)).otherwise(F.lit(0.0)))
                return s

            return let(counted(state["s"]), lambda s: let(
                (i >= window - 1) & (F.lit(math.log2(window)) - s / window >= threshold - 1e-9), lambda hit: F.struct(
                    F.transform(state["counts"], lambda c, j: c + F.when(j == enter, 1).otherwise(0) - F.when(j == leave, 1).otherwise(0)).alias("counts"),
                    s.alias("s"),
                    F.when(hit & (state["first"] < 0), i - window + 1).otherwise(state["first"]).alias("first"),
                    F.when(hit, i + 1).otherwise(state["last"]).alias("last"))))
        return move

    scanned = let(codes, lambda cs: F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), start, step(cs)))
    return F.when(F.length(value) >= window, let(scanned, lambda r: F.when(r["first"] >= 0, F.struct(r["first"].alias("first"), r["last"].alias("last")))))


def _random_spans(text: Column, kind: str, allow: tuple[str, ...], window: int) -> Column:
    pattern, alphabet, threshold = CLASSES[kind]
    harmless = "|".join(f"(?:{a})" for a in allow)
    found = F.filter(matches(text, pattern, context=CONTEXT), lambda m: ~F.rlike(m["before"], F.lit(ANNOUNCED)) & (~F.rlike(m["match"], F.lit(harmless)) if harmless else F.lit(True)))
    ranges = F.transform(found, lambda m: F.struct(m["start"].alias("at"), random_range(m["match"], alphabet, threshold, window).alias("r")))
    return F.transform(F.filter(ranges, lambda x: x["r"].isNotNull()), lambda x: F.struct(
        F.lit(3).alias("rank"), F.lit("entropy").alias("kind"), (x["at"] + x["r"]["first"]).alias("start"), (x["at"] + x["r"]["last"]).alias("end")))


SPAN = "struct<rank:int,kind:string,start:int,end:int>"


def find_secrets(df: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> DataFrame:
    """Add ``base`` and ``added``: arrays of (rank, kind, start, end) in code points, sorted by start, then rank.

    Base kinds are assign, access and hex; a match that fails its length is dropped. Added spans have the kind
    ``entropy``; those inside a base span are left out, and of overlapping ones the union remains. A null or empty
    text has no span. Work is row by row: no shuffle; texts without a hit of a pattern pay for the search alone.
    Columns called ``base`` or ``added`` are replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = none_of(SPAN)
    assign = F.when(t.rlike(ASSIGN), spans_of(F.filter(matches(t, ASSIGN, 2), lambda m: F.length(m["value"]) >= 8), 0, "assign")).otherwise(none)
    access = F.when(t.contains("AKIA"), spans_of(matches(t, ACCESS), 1, "access")).otherwise(none)
    hexes = F.when(t.rlike(HEX), spans_of(matches(t, HEX), 2, "hex")).otherwise(none)
    random = F.when(t.rlike(CLASSES["base64"][0]), F.concat(*[_random_spans(t, k, allow, window) for k in CLASSES])).otherwise(none)
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
                                  lambda s: F.struct(s["rank"].alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def merged(spans):
        grow = lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                s["rank"].alias("rank"), s["kind"].alias("kind"), F.element_at(done, -1)["start"].alias("start"),
                F.greatest(s["end"], F.element_at(done, -1)["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s)))
        return F.aggregate(spans, none, grow)

    raw = df.withColumn("base", order(F.concat(assign, access, hexes))).withColumn("added", random)
    free = F.filter("added", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return raw.withColumn("added", F.when(F.size("added") > 0, merged(order(free))).otherwise(none))


def all_spans(base: Column, added: Column) -> Column:
    """Base and added spans by start, then kind as listed."""
    both = F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.when(F.size(added) == 0, base).otherwise(F.transform(F.array_sort(both), lambda s: F.struct(
        s["rank"].alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
