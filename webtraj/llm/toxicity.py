"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps letters of other alphabets that look like Latin ones, and reads digits and signs inside
words as letters; it keeps the length. The lexicon holds words and word beginnings. It is learned: a term's weight
is the log of its rate in toxic over its rate in clean documents, and only well supported terms enter. Phrases that
hold a term but occur in clean documents alone are exceptions. A document's evidence is the weight of its hits, as
such and per hundred words; a logistic curve turns it into a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraj.session import cut_lineage

from .shared import bound_batches, ship, worker_state

MAX_TRAIN = 20_000  # labelled documents that the lexicon and the curve are fitted on, chosen by a hash of doc_id
LEXICON_BYTES = 64 << 20  # a lexicon larger than this isn't sent to the workers: an error
COUNT_CAP = 5  # occurrences of a term in one document that count as evidence while learning
THRESHOLD = 0.7
SUPPORT = 25.0  # least likelihood ratio of a term
# Letters that look like Latin ones, and digits and signs read as letters.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтɡαερονικυτⅼ", "aeopcyxijshdqwbkmhtgaepovikutl"))
DIGITS = dict(zip("01345789@$", "oieastbgas"))


def _fold_word(m: re.Match) -> str:
    word = m.group()
    return "".join(DIGITS.get(c, c) for c in word) if any(c.isalpha() for c in word) else word


class Folder:
    def __init__(self):
        self.table = str.maketrans(LOOKALIKES)
        self.odd = re.compile(f"[{''.join(LOOKALIKES)}]").search
        sign = f"[{re.escape(''.join(DIGITS))}]"
        self.mixed = re.compile(rf"[^\W\d_][\d_]*{sign}|{sign}[\d_]*[^\W\d_]").search  # a word that _fold_word may change
        self.word = re.compile(r"(?<![\w@$])[\w@$]*[^\W\d_][\w@$]*")
        self.words = re.compile(r"[^\W_]+").findall

    def fold(self, text: str) -> str:
        low = text.lower()
        if not low.isascii() and self.odd(low):
            low = low.translate(self.table)
        return self.word.sub(_fold_word, low) if self.mixed(low) else low


def terms_of(word: str) -> list[str]:
    """Beginnings of a word, and the word with an end mark."""
    return [word[:k] for k in range(4, min(len(word), 9))] + [word + "$"]


class Lexicon:
    """Terms with weights (a word ends with ``$``, others are beginnings), exception phrases, and the curve."""

    def __init__(self, weights: dict[str, float], phrases=(), curve=(0.0, 0.0, 0.0, 0.0)):
        self.weights, self.phrases, self.curve = weights, frozenset(phrases), tuple(curve)
        self.key = zlib.crc32(repr((sorted(weights.items()), sorted(self.phrases), self.curve)).encode())

    def matcher(self) -> Matcher:
        return worker_state(f"state:lexicon:{self.key}", lambda: Matcher(self))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.folder, self.phrases, self.curve = Folder(), lexicon.phrases, lexicon.curve
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(term.removesuffix("$"), (len(term.removesuffix("$")), weight, False)) if not term.endswith("$") else None
        for term, weight in lexicon.weights.items():
            if term.endswith("$"):
                word = term[:-1]
                start = self.automaton.get(word, None) if len(self.automaton) else None
                self.automaton.add_word(word, (len(word), weight, True) if start is None else (len(word), start[1], False, weight))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()
        self.word = re.compile(r"[^\W_]+")
        self.after = re.compile(r"[\W_]+([^\W_]+)")
        self.rest = re.compile(r"[^\W_]*")

    def hits(self, text: str) -> dict[int, float]:
        """Best weight at each start of a word."""
        found: dict[int, float] = {}
        if not self.some:
            return found
        n = len(text)
        for end, entry in self.automaton.iter(text):
            start = end - entry[0] + 1
            if start and text[start - 1].isalnum():
                continue
            whole = end + 1 == n or not text[end + 1].isalnum()
            if entry[2] and not whole:
                continue
            weight = max(entry[1], entry[3]) if len(entry) > 3 and whole else entry[1]
            if weight > found.get(start, 0.0):
                found[start] = weight
        return found

    def phrases_at(self, text: str, start: int) -> list[str]:
        """The word at ``start`` with its neighbour on either side."""
        word = self.rest.match(text, start).group()
        end = start
        while end and not text[end - 1].isalnum():
            end -= 1
        low = end
        while low and text[low - 1].isalnum():
            low -= 1
        right = self.after.match(text, start + len(word))
        return ([f"{text[low:end]} {word}"] if end else []) + ([f"{word} {right.group(1)}"] if right else [])

    def evidence(self, text: str | None) -> tuple[float, float, float, int]:
        """Total weight (logarithmic), weight per hundred words (logarithmic), kinds of hits (logarithmic), words.

        Words are runs of letters and digits, so blanks, line breaks and signs around them change nothing.
        """
        text = self.folder.fold(text or "")
        words = len(self.word.findall(text))
        total, kinds = 0.0, set()
        for start, weight in self.hits(text).items():
            if self.phrases and not self.phrases.isdisjoint(self.phrases_at(text, start)):
                continue
            total += weight
            kinds.add(self.rest.match(text, start).group())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(words, 20))), float(np.log1p(len(kinds))), words

    def score(self, evidence) -> float:
        b, *w = self.curve
        z = b + sum(a * x for a, x in zip(w, evidence))
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def _train_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_train: int) -> DataFrame:
    """Rows (doc_id, text, toxic) outside the held-out third; copies of one text with one label once."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    share = min(1.0, max_train / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(picked, "doc_id")
    return (rows.groupBy(F.sha2("text", 256).alias("copy"), (F.col("toxic") > 0).alias("bad"))
            .agg(F.min(F.struct("doc_id", "text", "toxic")).alias("r")).select("r.*"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folder = Folder()
    counts = [[Counter(), Counter()], [Counter(), Counter()]]  # by label: occurrences, documents

    def flush():
        names = list({t for pair in counts for c in pair for t in c})
        cols = [[c[t] for t in names] for pair in counts for c in pair]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["term", "c0", "d0", "c1", "d1"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            here = Counter()
            for word, n in Counter(folder.words(folder.fold(text.as_py() or ""))).items():
                if len(word) >= 3:
                    for t in terms_of(word):
                        here[t] += n
            occurrences, documents = counts[1 if toxic else 0]
            for t, n in here.items():
                occurrences[t] += min(n, COUNT_CAP)
            documents.update(here.keys())
            if len(counts[0][0]) + len(counts[1][0]) > 100_000:
                yield flush()
                for pair in counts:
                    for c in pair:
                        c.clear()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN,
        exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon, exception phrases and curve from at most about ``max_train`` labelled documents.

    Without labelled documents of both kinds the lexicon is empty and every score is 0.
    """
    bound_batches(docs.sparkSession)
    rows = cut_lineage(_train_rows(docs, labels, doc_id, text, max_train), "train")
    sizes = {bool(r["toxic"]): r["n"] for r in rows.groupBy(F.col("toxic") > 0).agg(F.count(F.lit(1)).alias("n")).toDF("toxic", "n").collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return Lexicon({}, exceptions, (-30.0, 0.0, 0.0, 0.0))
    counted = rows.select("text", "toxic").mapInArrow(_count_terms, "term string, c0 long, d0 long, c1 long, d1 long")
    totals = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c0", "d0", "c1", "d1")])
    weight = F.log((F.col("c1") + 0.5) / bad) - F.log((F.col("c0") + 0.5) / good)
    part = lambda n, whole: F.when(n > 0, n * F.log(n * (bad + good) / ((F.col("d1") + F.col("d0")) * whole))).otherwise(0.0)
    scored = totals.where(F.col("d1") >= max(4, bad // 400)).withColumn("weight", weight).withColumn(
        "support", 2 * (part(F.col("d1"), bad) + part(F.col("d0"), good)))  # likelihood ratio of the document counts
    top = scored.where(F.col("weight") >= 1).where(F.col("support") >= SUPPORT).select("term", "weight")
    weights = {r["term"]: round(r["weight"], 6) for r in _collected(top, "term")}
    draft = Lexicon(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = draft.matcher()
        for batch in batches:
            names, kinds = [], []
            for t, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                folded = matcher.folder.fold(t.as_py() or "")
                seen = {p for start in matcher.hits(folded) for p in matcher.phrases_at(folded, start)}
                names += seen
                kinds += [1 if toxic else 0] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.int32())], names=["phrase", "toxic"])

    harmless = (rows.select("text", "toxic").mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase")
                .agg(F.sum("toxic").alias("d1"), F.count(F.lit(1)).alias("n")).where("d1 = 0 and n >= 5").select("phrase"))
    lexicon = Lexicon(weights, {*exceptions, *[r["phrase"] for r in _collected(harmless, "phrase")]})
    seen = add_evidence(rows, lexicon, "text").select("e.total", "e.density", "e.kinds", "toxic").collect()
    data = np.array([[1.0, r[0], r[1], r[2], r[3] > 0] for r in seen])
    return Lexicon(weights, lexicon.phrases, _logistic(data[:, :4], data[:, 4]))


def _collected(entries: DataFrame, text: str) -> list:
    """All rows, in order of ``text``; an error where they take more than ``LEXICON_BYTES``."""
    entries = cut_lineage(entries, "lexicon")
    size = entries.agg(F.sum(F.octet_length(text) + 100).alias("n")).first()["n"] or 0
    if size > LEXICON_BYTES:
        raise ValueError(f"a lexicon of {size} bytes is larger than {LEXICON_BYTES}")
    return sorted(entries.collect(), key=lambda r: r[text])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return [float(v) for v in w]


def add_evidence(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "e") -> DataFrame:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = lexicon.matcher()
        for texts in batches:
            rows = [matcher.evidence(t.as_py()) for t in texts]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            score = [matcher.score(r) for r in rows]
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), *[pa.array(c, pa.float64()) for c in cols[:3]], pa.array(cols[3], pa.int64())],
                                             names=["score", "total", "density", "kinds", "words"])

    return df.withColumn(out, F.arrow_udf(run, "struct<score:double,total:double,density:double,kinds:double,words:long>")(F.col(f"`{text}`")))


def score_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``n_words``; columns of those names are replaced.

    Nothing but the text enters the score. Null and empty texts have no evidence and get the score of a text without
    hits. Row by row, no shuffle; the lexicon takes at most ``LEXICON_BYTES``.
    """
    bound_batches(df.sparkSession)
    name = "__evidence"
    return (add_evidence(df, lexicon, text, name).withColumn("score", F.col(f"{name}.score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("n_words", F.col(f"{name}.words")).drop(name))


ship(__name__)
