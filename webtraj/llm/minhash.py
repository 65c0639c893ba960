"""Near copies by n-gram Jaccard similarity: MinHash LSH forest, then exact counts.

Every text gets ``trees`` label sequences of MinHash values. Two texts are candidates if they share a prefix in one
tree. The prefix is shortened from ``depth`` labels until a pair that just reaches the threshold meets in some tree
with at least the probability ``recall``. Texts that meet, directly or by others, form a group; inside a group every
pair is counted exactly on its shingle sets, as products of 0/1 matrices, in blocks that are tasks of their own. Only
counts and spanning edges leave a block, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraj.session import cut_lineage

from .graph import components
from .shared import bound_batches, ship, worker_state

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9999
BLOCK = 256  # texts of one side of a block
BUCKET = 1_000  # texts of small groups that share a task's group


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Labels that must agree: shortened from ``depth`` until the expected recall at the threshold is reached."""
    length = depth
    while length > 1 and 1 - (1 - threshold ** length) ** trees < recall:
        length -= 1
    return length


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the word n-grams (lower case, split at blanks); a shorter text is one gram, no word none."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(out)]
    out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


class Forest:
    """Hash functions of all trees, for prefixes of one length."""

    def __init__(self, trees: int, length: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.length = trees, length
        self.a = rng.integers(1, 1 << 63, size=trees * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size=trees * length, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, size=(1, length), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prefixes(self, grams: np.ndarray) -> np.ndarray:
        """One number per tree for the prefix of its labels; equal numbers mean equal prefixes of the same tree."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 256):
            np.minimum(least, (grams[at:at + 256, None] * self.a + self.b).min(axis=0), out=least)
        labels = (least >> np.uint64(16)).reshape(self.trees, self.length)
        key = (labels * self.mix).sum(axis=1, dtype=np.uint64) + np.arange(self.trees, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
        return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists."""
    owners = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    values, column = np.unique(np.concatenate(left + right), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owners, column = owners[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    step = 4096
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        m = np.zeros((len(left) + len(right), step), dtype=np.float32)
        m[owners[a:b], column[a:b] - low] = 1
        out += m[:len(left)] @ m[len(left):].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold."""
    a, b = np.array([len(x) for x in left], dtype=np.float64), np.array([len(x) for x in right], dtype=np.float64)
    both = common(left, right)
    return (both > 0) & (both * (1 + threshold) >= threshold * (a[:, None] + b[None, :]) - 1e-9)


def spanning(ids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Least id of each one's component in a symmetric matrix of links."""
    head = ids.copy()
    closed = links | np.eye(len(ids), dtype=bool)
    while True:
        low = np.where(closed, head[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (low == head).all():
            return head
        head = low


def _unit(threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch] | pa.Table) -> pa.Table:
        rows = batches.to_pydict()
        groups: dict[int, list[int]] = {}
        for k, g in enumerate(rows["grp"]):
            groups.setdefault(g, []).append(k)
        ids, links, heads, open_ = [], [], [], []
        for members in groups.values():
            sets = [shingles(rows["text"][k], n) for k in members]
            own = np.array([rows["id"][k] for k in members], dtype=np.int64)
            copies = np.array([rows["copies"][k] for k in members], dtype=np.float64)
            block = np.array([rows["block"][k] for k in members])
            i, j = rows["i"][members[0]], rows["j"][members[0]]
            if i == j:
                match = linked(sets, sets, threshold)
                np.fill_diagonal(match, False)
            else:
                match = np.zeros((len(own), len(own)), dtype=bool)
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                if len(left) and len(right):
                    cross = linked([sets[k] for k in left], [sets[k] for k in right], threshold)
                    match[np.ix_(left, right)] = cross
                    match[np.ix_(right, left)] = cross.T
            ids += own.tolist()
            links += (match @ copies).astype(np.int64).tolist()
            heads += spanning(own, match).tolist()
            open_ += [rows["blocks"][members[0]] > 1] * len(own)
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "head": pa.array(heads, pa.int64()), "open": pa.array(open_, pa.bool_())})
    return run


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n: int = SHINGLE,
                trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one per row of ``docs``.

    ``class_id`` is the least doc_id among all texts connected by links, ``n_links`` the number of other rows whose
    text is equal or reaches the threshold. Equal texts are compared once. Texts without words equal each other and
    link to nothing else. Rows of one doc_id with different texts are one document. A null doc_id takes no part: its
    class is null and it has no links. Other columns are not read; an empty table gives an empty result.

    Shuffled: one row of ``trees`` numbers per text, the texts of candidate groups once (once per block in groups
    of more than ``BLOCK`` texts), and edges. Pairs of a group of m different texts cost m * m / 2 products spread over
    m * m / (2 * BLOCK * BLOCK) tasks.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    length = prefix_length(threshold, trees, depth, recall)

    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forest = worker_state(f"state:forest:{trees}:{length}", lambda: Forest(trees, length))
        for texts in batches:
            rows = []
            for t in texts:
                grams = shingles(t.as_py(), n)
                rows.append(forest.prefixes(grams) if len(grams) else np.empty(0, dtype=np.int64))
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, dtype=np.int64)])))

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    prefixes = F.arrow_udf(signed, "array<long>")
    signs = cut_lineage(rows.select("id", F.md5("text").alias("key"), prefixes("text").alias("prefixes")), "signatures")
    known = signs.where("id is not null")
    texts = known.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("prefixes").alias("prefixes"))
    texts = cut_lineage(texts, "texts")

    met = texts.select("id", F.explode("prefixes").alias("prefix"))
    nodes = met.groupBy("prefix").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")
    edges = met.join(nodes, "prefix").where("id > head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct()
    heads = components(edges, "candidates")
    member = cut_lineage(heads.unionByName(heads.select(F.col("head").alias("id"), "head").distinct()), "members")
    sizes = member.groupBy("head").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    buckets = max(1, member.count() // BUCKET)

    grouped = (member.join(sizes, "head").join(texts.select("id", "key", "copies"), "id")
               .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = grouped.select("id", "key", "copies", F.col("head").alias("grp"), "blocks", "block", other.alias("o")).select(
        "*", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"),
        F.when(F.col("blocks") > 1, F.col("grp")).otherwise(-1 - F.pmod(F.xxhash64("grp"), F.lit(buckets))).alias("unit")).drop("o")
    whole = rows.select("id", F.md5("text").alias("key"), "text").join(grouped.select("id", "key").distinct(), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    units = placed.join(whole, ["id", "key"]).drop("key")
    counted = cut_lineage(units.groupBy("unit", "i", "j").applyInArrow(_unit(threshold, n), "id long, links long, head long, open boolean"), "links")

    spread = counted.where("open and id > head").select(F.col("id").alias("u"), F.col("head").alias("v"))
    closed = counted.where("not open").select("id", "head")
    wide = closed if spread.isEmpty() else closed.unionByName(components(spread, "classes"))
    linked_ = counted.groupBy("id").agg(F.sum("links").alias("links"))
    classes = linked_.join(wide.groupBy("id").agg(F.min("head").alias("head")), "id", "left")
    judged = texts.select("key", "id", "copies").join(classes, "id", "left").select(
        "key", F.coalesce("head", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return known.select("key", F.col("id").alias("doc_id")).join(judged, "key").select("doc_id", "class_id", "n_links").unionByName(
        signs.where("id is null").select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


ship(__name__)
