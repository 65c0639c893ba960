"""Benchmark decontamination: every training passage queries a BM25 index of test items.

The index holds the impact of each term in each item, divided by the item's whole impact, so a score says which part
of the item's weight a passage covers. Items lie in blocks; the largest impact of a term in a block bounds what a
passage can score there. A passage (overlapping windows of twice the longest item, so that every item fits into one)
enters a block only if its bound reaches the threshold; inside, lists are walked by WAND: cursors sorted by item, a
pivot where the bounds add up, skips below it. All items above the threshold come out. They count as leaked if the
passage also holds the n-grams of the question and the words of the answer.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, ship, worker_state

BLOCKS = 64  # blocks of an index, of at least MIN_BLOCK items each
MIN_BLOCK = 4
SHARD_ITEMS = 4_000  # items of one index, which is broadcast; more items make more indexes, searched one after the other
SHARD_BYTES = 64 << 20
NGRAM = 5
OVERLAP = 0.8
THRESHOLD = 0.6
K1, B = 1.2, 0.75
SENTENCE = re.compile(r"(?<=[.?!])\s+")
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence gives its last fifth as the answer."""
    parts = [w for w in (words_of(s) for s in SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 5)
    return (words[:cut], words[cut:]) if cut > 0 else (words, words)


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


class ItemIndex:
    """Block-max index of test items; items without words are left out."""

    def __init__(self, items: list[tuple], key: str, df: dict[str, int] | None = None, total: int | None = None, average: float | None = None):
        self.key = key
        rows = sorted(((i, words_of(t), t) for i, t in items if words_of(t)), key=lambda r: (sorted(set(r[1]), key=len)[-1], r[0]))
        self.ids = [r[0] for r in rows]
        self.parts = [question_and_answer(r[2]) for r in rows]
        self.longest = max((len(r[1]) for r in rows), default=0)
        df = df or Counter(w for r in rows for w in set(r[1]))
        total, average = total or len(rows), average or sum(len(r[1]) for r in rows) / max(1, len(rows))
        self.vocabulary: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for n, (_, words, _) in enumerate(rows):
            weight = {}
            for w, tf in Counter(words).items():
                idf = np.log1p((total - df[w] + 0.5) / (df[w] + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
            whole = sum(weight.values())
            for w, x in weight.items():
                t = self.vocabulary.setdefault(w, len(self.vocabulary))
                if t == len(lists):
                    lists.append([])
                lists[t].append((n, float(x / whole)))
        self.lists = [([n for n, _ in p], [x for _, x in p]) for p in lists]
        self.block = max(MIN_BLOCK, -(-len(rows) // BLOCKS))
        self.bounds = np.zeros((len(lists) + 1, -(-max(1, len(rows)) // self.block)), dtype=np.float32)  # the last row: words of no item
        for t, (ns, xs) in enumerate(self.lists):
            np.maximum.at(self.bounds[t], np.array(ns) // self.block, np.array(xs, dtype=np.float32))
        self.tables: dict[int, tuple] = {}

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All items of a block whose score reaches ``threshold``."""
        low, high = block * self.block, (block + 1) * self.block
        cursors = []
        for t in terms:
            ns, xs = self.lists[t]
            at = int(np.searchsorted(ns, low)) if len(ns) > 8 else next((k for k, n in enumerate(ns) if n >= low), len(ns))
            if at < len(ns) and ns[at] < high:
                cursors.append([ns[at], at, float(self.bounds[t, block]), ns, xs])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= threshold - 1e-6:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            score = 0.0
            for c in cursors:
                if c[0] > pivot:
                    break
                ns, at = c[3], c[1]
                while at < len(ns) and ns[at] < pivot:
                    at += 1
                if at < len(ns) and ns[at] == pivot:
                    score += c[4][at]
                    at += 1
                c[1] = at
                c[0] = ns[at] if at < len(ns) and ns[at] < high else high
            if score >= threshold - 1e-6:
                out.append((pivot, score))
            cursors = [c for c in cursors if c[0] < high]
        return out

    def search(self, words: list[str], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(window start, window end, item, score) of all windows of a document."""
        if not self.longest or not words:
            return
        outside = len(self.vocabulary)
        get = self.vocabulary.get
        codes = np.fromiter(map(get, words, repeat(outside)), dtype=np.int32, count=len(words))
        where = np.flatnonzero(codes != outside)
        if not len(where):
            return
        codes = codes[where]
        order = np.argsort(codes, kind="stable")
        before = np.full(len(codes), -1, dtype=np.int64)  # the place of the same word before
        same = codes[order][1:] == codes[order][:-1]
        before[order[1:][same]] = where[order[:-1][same]]
        stride, span = self.longest, 2 * self.longest
        starts = np.arange(0, max(1, len(words) - stride), stride)
        first, last = np.searchsorted(where, starts), np.searchsorted(where, starts + span)
        for group in range(0, len(starts), 256):  # long documents in groups of windows
            a, b = first[group:group + 256], last[group:group + 256]
            sizes = b - a
            if not sizes.any():
                continue
            row = np.repeat(np.arange(len(a)), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(a, sizes)
            fresh = before[at] < starts[group:group + 256][row]  # a word counts once in a window
            row, at = row[fresh], at[fresh]
            bounds = np.zeros((len(a), self.bounds.shape[1]), dtype=np.float32)
            edge = np.flatnonzero(np.diff(row, prepend=-1))
            bounds[row[edge]] = np.add.reduceat(self.bounds[codes[at]], edge, axis=0)
            for r, block in zip(*np.nonzero(bounds >= threshold - 1e-4)):
                terms = codes[at[row == r]].tolist()
                start = int(starts[group + r])
                for item, score in self.wand(terms, int(block), threshold):
                    yield start, min(len(words), start + span), item, score

    def overlaps(self, item: int, words: list[str], n: int) -> tuple[float, float]:
        """Shares of the question's n-grams and of the answer's words in a passage."""
        if item not in self.tables:
            q, a = self.parts[item]
            self.tables[item] = (grams(q, n), min(n, len(q)), Counter(a))
        wanted, size, answer = self.tables[item]
        here = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
        seen = Counter(words)
        return len(wanted & here) / len(wanted), sum(min(c, seen[w]) for w, c in answer.items()) / sum(answer.values())


def _indexes(items: DataFrame, item_id: str, text: str) -> list[ItemIndex]:
    """One index for at most ``SHARD_ITEMS`` items or ``SHARD_BYTES``, each with the statistics of all items."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    shards = max(1, -(-size["n"] // SHARD_ITEMS), -(-size["b"] // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    out = []
    stats = {}
    if shards > 1:
        words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
        counted = rows.select(words.alias("w"), shard.alias("shard"))
        whole = counted.agg(F.sum((F.size("w") > 0).cast("int")).alias("n"), F.avg(F.when(F.size("w") > 0, F.size("w"))).alias("mean")).first()
        pairs = counted.select("shard", F.explode(F.array_distinct("w")).alias("word"))
        df = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        stats = {"total": whole["n"], "average": whole["mean"]}
    for k in range(shards):
        part = [(r["item_id"], r["text"]) for r in rows.where(shard == k).collect()]
        own = None
        if shards > 1:
            known = pairs.where(F.col("shard") == k).select("word").distinct().join(df, "word").collect()
            counts = {r["word"]: r["df"] for r in known}
            own = {w: counts.get(w, 1) for _, t in part for w in words_of(t)}
        out.append(ItemIndex(part, f"{k}", own, **stats))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               threshold: float = THRESHOLD, overlap: float = OVERLAP, n: int = NGRAM) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap, start, end) of leaked items, places in words.

    One row per row of ``docs`` and item: the passage with the most overlap, then the first. All windows of all texts
    are queried. Null or empty texts and items without words leak nothing; repeated items count once; an empty table
    on either side gives no row. Documents stay where they are: no shuffle, and no state beyond one document. Each
    index is broadcast and bounded by ``SHARD_ITEMS`` and ``SHARD_BYTES``; further indexes are further passes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def leaks(index: ItemIndex) -> DataFrame:
        find = _finder(spark, index, threshold, overlap, n)
        names = spark.createDataFrame(list(enumerate(index.ids)), f"item int, item_id {kind}")
        hits = rows.select("doc_id", F.explode(find("text")).alias("x")).select("doc_id", "x.*")
        return hits.join(F.broadcast(names), "item").select(
            "doc_id", "item_id", F.round("score", 6).alias("score"), F.col("q").alias("question_overlap"), F.col("a").alias("answer_overlap"), "start", "end")

    return reduce(DataFrame.unionByName, map(leaks, _indexes(items, item_id, item_text)))


def _finder(spark, index: ItemIndex, threshold: float, overlap: float, n: int):
    """The leaks of each text as a column function, one for each item."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = sent.value
        index = worker_state(f"state:items:{zlib.crc32(raw)}", lambda: cloudpickle.loads(raw))
        for texts in batches:
            found = []
            for t in texts:
                words = words_of(t.as_py() or "")
                best: dict[int, tuple] = {}
                for start, end, item, score in index.search(words, threshold):
                    q, a = index.overlaps(item, words[start:end], n)
                    if q >= overlap - 1e-9 and a >= overlap - 1e-9 and (item not in best or (q + a) > best[item][1] + best[item][2]):
                        best[item] = (score, q, a, start, end)
                found.append([{"item": i, "score": s, "q": q, "a": a, "start": b, "end": e} for i, (s, q, a, b, e) in sorted(best.items())])
            yield pa.array(found, pa.list_(pa.struct([("item", pa.int32()), ("score", pa.float64()), ("q", pa.float64()), ("a", pa.float64()),
                                                      ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(run, "array<struct<item:int,score:double,q:double,a:double,start:int,end:int>>")


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                threshold: float = THRESHOLD, overlap: float = OVERLAP, n: int = NGRAM) -> DataFrame:
    """Documents that hold no test item. Every row is judged by its own text, whatever its id; null texts hold none."""
    bound_batches(docs.sparkSession)
    for index in _indexes(items, item_id, item_text):
        docs = docs.where(F.size(_finder(docs.sparkSession, index, threshold, overlap, n)(F.col(f"`{text}`"))) == 0)
    return docs


ship(__name__)
