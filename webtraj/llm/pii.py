"""Personal data: fixed forms, and boosted trees over the candidates of high-recall generators. DataFrame operations only.

Generators propose overlapping spans. Each candidate is described by its format and context in small whole numbers;
whether a validator (the fixed forms with their checks) confirms it is the label. One aggregate counts confirmed and
other candidates per combination of features over all documents, so the trees are fitted on everything while the
driver sees no more rows than there are combinations (at most ``MAX_CELLS``). Scores are an expression of nested conditions.
Per generator, the threshold is the least score that reaches ``precision`` on the half of the counts kept for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, matches, none_of, printed, spans_of

# The forms of the contract, written so that long runs are searched in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

GENERATORS = (  # overlapping, of high recall
    ("number", r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
    ("address", r"(?<![^\s<>\"',;])[^\s@<>\"',;]++@[^\s@<>\"',;]++"),
    ("dotted", r"(?<![0-9.])[0-9]{1,3}(?:[.,\x20]{1,2}[0-9]{1,3}){3}(?![0-9])"),
)
FEATURES = {"gen": len(GENERATORS), "digits": 20, "groups": 6, "sep": 4, "lead": 3, "ctx": 5, "tail": 4}  # name: values
MAX_CELLS = 2 * int(np.prod(list(FEATURES.values())))
CONTEXT = 24
CONTEXTS = (r"(?i)\b(?:tel|phone|call|mobile|fax)\w*\W*$", r"(?i)\b(?:card|account|iban|visa|ssn|passport)\w*\W*$",
            r"(?i)\b(?:ip|host|server|addr|login)\w*\W*$", r"(?i)\b(?:mail|contact|write|from|to)\w*\W*$")
SPAN = "struct<rank:int,kind:string,start:int,end:int>"
CELL = "struct<" + ",".join(f"{f}:int" for f in FEATURES) + ",start:int,end:int>"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _base(t: Column) -> Column:
    """Confirmed spans of the fixed forms, by kind, then start."""
    none = none_of(SPAN)
    long_enough = lambda d, low, high: (F.length(d) >= low) & (F.length(d) <= high)
    octet = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"
    email = F.when(t.contains("@"), matches(t, EMAIL))
    ip = F.when(t.rlike(IP), F.filter(matches(t, IP), lambda m: F.forall(F.split(m["match"], r"\."), lambda p: p.rlike(octet))))
    card = F.when(t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(matches(t, CARD), lambda m: let(digits_of(m["match"]), lambda d: F.when(long_enough(d, 16, 19), luhn(d)).otherwise(False))))
    phone = F.when(t.rlike(r"\+[0-9]"), F.filter(matches(t, PHONE), lambda m: let(digits_of(m["match"]), lambda d: long_enough(d, 8, 15))))
    return F.concat(*[F.coalesce(spans_of(f, i, k), none) for i, (k, f) in enumerate(zip(KINDS, (email, ip, card, phone)))])


def _candidates(t: Column) -> Column:
    """All proposals with their features."""
    def described(gen):
        def one(m):
            text, before = m["match"], m["before"]
            groups = F.least(F.size(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))), F.lit(5))
            sep = F.when(text.rlike(r"[()]"), 3).when(text.contains("."), 2).when(text.rlike(r"[0-9][\x20-]+[0-9]"), 1).otherwise(0)
            ctx = F.lit(0)
            for i, words in reversed(list(enumerate(CONTEXTS, 1))):
                ctx = F.when(before.rlike(words), i).otherwise(ctx)
            values = (F.lit(gen), F.least(F.length(digits_of(text)), F.lit(19)), groups, sep,
                      F.when(text.startswith("+"), 1).when(text.startswith("("), 2).otherwise(0), ctx,
                      F.least(F.length(F.regexp_extract(text, r"\.([A-Za-z]+)$", 1)), F.lit(3)))
            return F.struct(*[v.cast("int").alias(f) for v, f in zip(values, FEATURES)], m["start"].alias("start"), m["end"].alias("end"))
        return one

    return F.concat(*[F.when(t.rlike(p), F.transform(matches(t, p, context=CONTEXT), described(i))).otherwise(none_of(CELL))
                      for i, (_, p) in enumerate(GENERATORS)])


def _proposed(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumn("base", _base(t)).withColumn("proposed", F.when(t.rlike("[0-9@]"), _candidates(t)).otherwise(none_of(CELL)))


def _overlap(s, spans) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))


class Trees:
    """Boosted trees of depth two on weighted cells of small whole numbers, by Newton steps on the log loss."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, n: np.ndarray, rounds: int = 24, rate: float = 0.4, ridge: float = 2.0):
        prior = (pos.sum() + 1) / (n.sum() + 2)
        self.start = float(np.log(prior / (1 - prior)))
        self.trees = []
        score = np.full(len(n), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = pos - n * p, n * p * (1 - p)

            def leaf(rows):
                return float(rate * g[rows].sum() / (h[rows].sum() + ridge))

            def cut(rows):
                best = (1e-6, None, None)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                for f in range(x.shape[1]):
                    for at in np.unique(x[rows, f])[:-1]:
                        low = rows & (x[:, f] <= at)
                        high = rows & ~low
                        gain = sum(g[r].sum() ** 2 / (h[r].sum() + ridge) for r in (low, high)) - whole
                        if gain > best[0]:
                            best = (gain, f, int(at))
                return best[1:]

            def grow(rows, depth):
                f, at = cut(rows) if depth else (None, None)
                if f is None:
                    return leaf(rows)
                low = rows & (x[:, f] <= at)
                return f, at, grow(low, depth - 1), grow(rows & ~low, depth - 1)

            tree = grow(np.ones(len(n), dtype=bool), 2)
            self.trees.append(tree)
            score += np.array([self._leaf(tree, row) for row in x])

    def _leaf(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return self.start + sum(self._leaf(t, row) for t in self.trees)

    def column(self, cell: Column) -> Column:
        names = list(FEATURES)

        def branch(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(cell[names[tree[0]]] <= tree[1], branch(tree[2])).otherwise(branch(tree[3]))
        out = F.lit(self.start)
        for t in self.trees:
            out = out + branch(t)
        return out


def fit(df: DataFrame, text: str = "text", precision: float = 0.95, least: int = 20):
    """Trees and one threshold per generator from all texts of ``df``; no candidates give no model.

    ``least``: confirmed candidates that a threshold must rest on. A generator that never reaches ``precision``
    selects nothing.
    """
    cells = (_proposed(df.select(text), text).where("size(proposed) > 0")
             .select(F.col(f"`{text}`").alias("__text"), F.explode(F.transform("proposed", lambda c: F.struct(c.alias("c"), _overlap(c, F.col("base")).cast("int").alias("y")))).alias("x"))
             .select(*[F.col(f"x.c.{f}").alias(f) for f in FEATURES], "x.y", F.pmod(F.xxhash64("__text", "x.c.start"), F.lit(2)).alias("fold"))
             .groupBy(*FEATURES, "fold").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect())
    if not cells:
        return None
    x = np.array([[r[f] for f in FEATURES] for r in cells])
    pos, n, fold = (np.array([float(r[k]) for r in cells]) for k in ("pos", "n", "fold"))
    learn = np.where(fold == 0, 1.0, 0.0)
    model = Trees(x, pos * learn, n * learn) if learn.any() else Trees(x, pos, n)
    scores = np.array([model.score(row) for row in x])
    check = fold == 1 if (fold == 1).any() and learn.any() else np.ones(len(n), dtype=bool)
    thresholds = []
    for gen in range(len(GENERATORS)):
        rows = check & (x[:, 0] == gen)
        fitting = [s for s in np.unique(scores[rows]) if (p := pos[rows & (scores >= s)].sum()) >= least and p >= precision * n[rows & (scores >= s)].sum()]
        thresholds.append(float(min(fitting)) - 1e-9 if fitting else float("inf"))  # sums differ in their last bits
    return model, thresholds


def find_pii(df: DataFrame, text: str = "text", model=None) -> DataFrame:
    """Add ``base`` and ``added``: arrays of (rank, kind, start, end) in code points, by kind as listed, then start.

    Base kinds are email, ip, card and phone. Added spans carry the name of their generator: candidates whose score
    reaches the calibrated threshold and that overlap no base span. ``model`` comes from ``fit`` (default: fitted on
    ``df``). A null or empty text has no span. Row by row, but for the one aggregate of ``fit``. Columns called
    ``base`` or ``added`` are replaced.
    """
    model = model or fit(df, text)
    raw = _proposed(df, text)
    if model is None or all(np.isinf(t) for t in model[1]):
        return raw.drop("proposed").withColumn("added", none_of(SPAN))
    trees, thresholds = model

    def chosen(c):
        limit = F.lit(1e9)
        for gen, t in enumerate(thresholds):
            limit = F.when(c["gen"] == gen, F.lit(min(t, 1e9))).otherwise(limit)
        return trees.column(c) >= limit

    free = F.filter("proposed", lambda c: ~_overlap(c, F.col("base")))
    kept = F.filter(free, chosen)
    kind = lambda c: F.element_at(F.array(*[F.lit(g) for g, _ in GENERATORS]), c["gen"] + 1)
    spans = F.transform(kept, lambda c: F.struct((c["gen"] + len(KINDS)).alias("rank"), kind(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return raw.withColumn("added", F.when(F.size("proposed") > 0, F.array_sort(spans)).otherwise(none_of(SPAN))).drop("proposed")


def redact(df: DataFrame, text: str = "text", model=None, mark: str = "[{}]") -> DataFrame:
    """Replace every span of ``text`` by its kind in capitals; overlapping spans count as one with the kind that starts first."""
    found = find_pii(df, text, model)
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first, last = mark.split("{}")

    def step(state, s):
        apart = s["start"] >= state["at"]
        piece = F.concat(F.substring(F.col(f"`{text}`"), state["at"] + 1, s["start"] - state["at"]), F.lit(first), F.upper(s["kind"]), F.lit(last))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"),
                        F.when(apart, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    state = F.aggregate(both, F.struct(F.lit(0).alias("at"), none_of("string").alias("out")), step)
    clean = let(state, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(f"`{text}`"), s["at"] + 1, F.length(F.col(f"`{text}`")))))
    return found.withColumn(text, F.when(F.size("base") + F.size("added") > 0, clean).otherwise(F.col(f"`{text}`"))).drop("base", "added")


def all_spans(base: Column, added: Column) -> Column:
    """Base spans and added ones printed by start, then rank of the kind; empty where a text has none, null for none given."""
    return printed(F.concat(base, added))


