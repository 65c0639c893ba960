"""Near copies among embeddings by an inverted index of nearest reference points.

Every vector is described by its nearest reference points (pivots), nearest first. Vectors at the threshold
still share most of them, so partners are looked up in inverted lists of pivots: a pair is a candidate when it
shares at least ``least`` of ``near`` pivots, and every candidate is verified by its cosine.

A pair that shares ``least`` of ``near`` pivots meets in the list of one of the ``near - least + 1`` rarest pivots
of both, so only those are listed; the pair is handled in the list of its rarest shared pivot alone. Lists of any
length are cut into blocks, and a task multiplies two blocks. It returns the number of links of each vector and a
spanning forest of the links, never the links themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraj.session import cut_lineage

from .graph import components
from .shared import bound_batches, ship

THRESHOLD = 0.98
NEAR = 8  # pivots that describe a vector, nearest first; more only where the recall asks for it
RECALL = 0.999  # wanted for pairs exactly at the threshold, measured on planted pairs
PLANTED = 8192  # pairs at least that measure it
SAMPLE = 8  # vectors drawn for each pivot when the pivots are chosen
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
BLOCK, MOST_BLOCK = 256, 4096  # rows of a block; longer lists take larger blocks, so that copies stay few


class Index(NamedTuple):
    """What describes vectors of one number of entries: unit pivots, places listed, and shares asked for."""

    pivots: np.ndarray
    near: int
    least: int


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of usable vectors by their number of entries, with the vectors and their unit vectors.

    Null and empty vectors, zero vectors and those with null or non-finite entries are left out.
    """
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    out = []
    for size in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == size)
        rows = values[offsets[places][:, None] + np.arange(size)]
        largest = np.abs(rows).max(1)
        good = np.isfinite(largest) & (largest > 0)
        places, rows = places[good], rows[good]
        scaled = rows / largest[good][:, None]
        out.append((places, rows + 0.0, scaled / np.sqrt((scaled * scaled).sum(1))[:, None]))
    return out


def nearest(units: np.ndarray, index: Index) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first; equally near ones by number."""
    near = min(index.near, len(index.pivots))
    out = np.empty((len(units), near), dtype=np.int16)
    for at in range(0, len(units), 1024):
        far = -(units[at:at + 1024] @ index.pivots.T)
        cut = np.partition(far, near - 1, axis=1)[:, near - 1:near]
        order = np.argsort(np.where(far <= cut, far, np.inf), axis=1, kind="stable")
        out[at:at + 1024] = order[:, :near]
    return out


def spread_out(units: np.ndarray, wanted: int, threshold: float) -> np.ndarray:
    """At most ``wanted`` pivots: each drawn vector in turn that is farthest from those taken.

    None that would link with one taken: several pivots inside a group of near copies would order its members by noise.
    """
    taken = [0] if len(units) else []
    if taken:
        closest = units @ units[0]
        while len(taken) < min(wanted, len(units)):
            far = int(np.argmin(closest))
            if closest[far] >= threshold:
                break
            taken.append(far)
            closest = np.maximum(closest, units @ units[far])
    return units[taken]


def build_index(units: np.ndarray, size: int, wanted: int, threshold: float = THRESHOLD, near: int = NEAR, recall: float = RECALL) -> Index:
    """Pivots from drawn unit vectors of ``size`` entries, and how many shared pivots a linked pair keeps.

    Measured on pairs planted at exactly the threshold around the drawn vectors and on the links among the first of
    these; ``least`` is the largest number that all but ``1 - recall`` of either kind share. Where even one shared
    pivot is too much to ask, vectors list more pivots.
    """
    draw = np.random.default_rng(42)
    fresh = draw.standard_normal((wanted, size))
    fresh /= np.sqrt((fresh * fresh).sum(1))[:, None]
    pivots = spread_out(units.reshape(-1, size), wanted, threshold)
    pivots = np.concatenate([pivots, fresh[:wanted - len(pivots)]])
    drawn = units.reshape(-1, size)[:2048]
    base = np.concatenate([drawn, fresh])
    base = np.tile(base, (-(-PLANTED // len(base)), 1))
    linked_pairs = np.argwhere(np.triu(drawn @ drawn.T >= threshold, 1))
    linked_pairs = linked_pairs[::max(1, len(linked_pairs) // PLANTED)]
    side = draw.standard_normal(base.shape)
    side -= (side * base).sum(1)[:, None] * base
    length = np.sqrt((side * side).sum(1))[:, None]
    moved = base * threshold + side / np.where(length > 1e-12, length, 1) * np.sqrt(max(0.0, 1 - threshold * threshold))
    while True:
        probe = Index(pivots, min(near, wanted), 1)
        both = lambda x, y: np.sort((x[:, :, None] == y[:, None, :]).sum((1, 2)))
        places = nearest(drawn, probe)
        measured = [both(nearest(base, probe), nearest(moved, probe)), both(places[linked_pairs[:, 0]], places[linked_pairs[:, 1]])]
        least = min(int(shared[int((1 - recall) * len(shared))]) for shared in measured if len(shared))
        if least >= 1 or near >= wanted:
            return Index(pivots, probe.near, max(least, 1) if near < wanted else 1)
        near *= 2


def linked(left: np.ndarray, right: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], place: int, least: int, threshold: float) -> np.ndarray:
    """Which pairs of two blocks share enough pivots, ``place`` being their rarest shared one, and pass the threshold."""
    used = np.unique(np.concatenate([r.ravel() for r in ranks]))
    first = int(np.searchsorted(used, place))

    def marks(r: np.ndarray) -> np.ndarray:
        out = np.zeros((len(r), len(used)), dtype=np.float32)
        out[np.arange(len(r))[:, None], np.searchsorted(used, r)] = 1
        return out

    out = np.empty((len(left), len(right)), dtype=bool)
    of_right = marks(ranks[1])
    for at in range(0, len(left), 1024):
        of_left = marks(ranks[0][at:at + 1024])
        close = of_left @ of_right.T >= least
        if first:
            close &= of_left[:, :first] @ of_right[:, :first].T == 0
        some = np.flatnonzero(close.any(1))
        close[some] &= left[at:at + 1024][some] @ right.T >= threshold
        out[at:at + 1024] = close
    return out


def forest(adjacent: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix, the number of the least vertex that links lead to.

    Rows are numbered before columns; with ``same`` rows and columns are the same vertices.
    """
    n, m = adjacent.shape
    head = np.arange(n if same else n + m)
    rows, columns = head[:n], head if same else head[n:]
    while True:
        before = head.copy()
        rows[:] = np.minimum(rows, np.where(adjacent, columns[None, :], n + m).min(1, initial=n + m))
        columns[:] = np.minimum(columns, np.where(adjacent, rows[:, None], n + m).min(0, initial=n + m))
        head[:] = head[head]
        if (before == head).all():
            return rows, columns


def _described(df: DataFrame, columns: tuple[str, str, str], indexes: dict[int, Index] | None, wanted: int) -> DataFrame:
    """Usable rows as (id, key, size, unit, nearest): ``key`` names the vector within its label.

    Without indexes the nearest pivots are left out.
    """
    ident, vector, label = columns
    shared = None if indexes is None else df.sparkSession.sparkContext.broadcast({s: tuple(i) for s, i in indexes.items()})  # pivots times entries numbers
    source = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                       F.col(f"`{vector}`").cast("array<double>").alias("vector")).where("label is not null and vector is not null")
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Index] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for places, rows, units in unit_rows(batch.column("vector")):
                size = rows.shape[1]
                keys = [hashlib.blake2b(r.tobytes(), digest_size=16, key=hashlib.blake2b(labels[p].encode()).digest()).hexdigest()
                        for p, r in zip(places, rows)]
                near = None
                if shared is not None:
                    if size not in made:
                        made[size] = Index(*shared.value[size]) if size in shared.value else build_index(np.empty((0, size)), size, wanted)
                    near = nearest(units, made[size])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(places)), pa.array(keys, pa.string()), pa.array(np.full(len(places), size, dtype=np.int32)),
                    pa.array([u.tobytes() for u in units], pa.binary()),
                    pa.array([labels[p] for p in places], pa.string()),
                    pa.nulls(len(places), pa.list_(pa.int16())) if near is None else pa.array(list(near), pa.list_(pa.int16()))],
                    names=["id", "key", "size", "unit", "label", "nearest"])

    bound_batches(df.sparkSession)
    return source.mapInArrow(run, f"id {kind}, key string, size int, unit binary, label string, nearest array<smallint>")


def _pair_blocks(classes: DataFrame, listed: dict[int, int], least: dict[int, int], order: dict[int, list[int]], threshold: float) -> DataFrame:
    """(key, links, other) of all pairs that meet in a list: the links of a vector in one task, and edges of a forest."""
    sizes = [s for s in sorted(order)]
    table = F.element_at(F.create_map(*[x for s in sizes for x in (F.lit(s), F.array(*[F.lit(int(r)) for r in order[s]]))]), F.col("size"))
    postings = F.element_at(F.create_map(*[x for s in sizes for x in (F.lit(s), F.lit(listed[s]))]), F.col("size"))
    ranked = classes.withColumn("__order", table).withColumn("ranks", F.array_sort(F.transform("nearest", lambda p: F.get(F.col("__order"), p.cast("int"))))).drop("__order", "nearest")
    in_lists = ranked.withColumn("place", F.explode(F.slice("ranks", F.lit(1), postings)))
    lists = in_lists.groupBy("label", "size", "place").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumn(
        "blocks", F.ceil(F.col("__n") / F.least(F.greatest(F.col("__n") / 64, F.lit(BLOCK)), F.lit(MOST_BLOCK))).cast("int")).drop("__n").hint("rebalance")  # in no order, so that the join may split a long list
    own = F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")
    dealt = in_lists.join(lists, ["label", "size", "place"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, place = group.column("size")[0].as_py(), group.column("place")[0].as_py()
        own, low, high = (group.column(c).to_numpy() for c in ("own", "low", "high"))
        units = np.frombuffer(b"".join(group.column("unit").to_pylist()), dtype=np.float64).reshape(-1, size)
        ranks = np.array(group.column("ranks").to_pylist(), dtype=np.int32)
        copies, keys = group.column("n").to_numpy(), np.array(group.column("key").to_pylist(), dtype=object)
        a = np.flatnonzero(own == low)
        same = bool(low[0] == high[0])
        b = a if same else np.flatnonzero(own == high)
        found = linked(units[a], units[b], (ranks[a], ranks[b]), place, least[size], threshold)
        if same:
            np.fill_diagonal(found, False)
        some, others = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
        if not len(some):
            return pa.table({"key": pa.array([], pa.string()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.string())})
        if same:
            others = some
        found = found[np.ix_(some, others)]
        a, b = a[some], b[others]
        number = (found.astype(np.float64) @ copies[b]).astype(np.int64)
        vertex, links = [a], [number]
        if not same:
            vertex, links = [a, b], [number, (copies[a] @ found.astype(np.float64)).astype(np.int64)]
        vertex, links = np.concatenate(vertex), np.concatenate(links)
        rows, columns = forest(found, same)
        head = rows if same else np.concatenate([rows, columns])
        edge = np.flatnonzero(head != np.arange(len(head)))
        return pa.table({
            "key": pa.array([*keys[vertex], *keys[vertex[edge]]], pa.string()), "links": pa.array(np.concatenate([links, np.zeros(len(edge), dtype=np.int64)])),
            "other": pa.array([*[None] * len(vertex), *keys[vertex[head[edge]]]], pa.string())})

    # dealt anew: grouped as the join leaves them, all blocks of a long list would meet in one task
    pair = ["label", "size", "place", "low", "high"]
    return dealt.repartition(*pair).groupBy(*pair).applyInArrow(run, "key string, links bigint, other string")


def near_vectors(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                 pivots: int | None = None, near: int = NEAR, recall: float = RECALL) -> DataFrame:
    """(``ident``, n_links, component_id, kept) for every row: links to rows of the same label with a cosine of at least ``threshold``.

    ``component_id`` is the least id that links lead to, ``kept`` whether it is the row's own. Equal vectors of a
    label are one class that is compared once; its rows link with each other. Links below the threshold never occur.
    Rows whose label is null, whose vector is null, empty, zero or holds null or non-finite entries link with nothing,
    and vectors of different length don't link. Repeated rows count as rows; a row of null id has the least other id
    of its component, null if there is none, and isn't kept. Ties between equally near pivots go to the smaller
    number. An empty table gives an empty result; other columns are ignored, whatever their names.

    ``pivots`` defaults to the square root of the number of rows, as a power of two from 64 to 4,096; they are chosen
    from ``SAMPLE`` vectors each, drawn by the hash of the vector. All vectors are indexed. A group of m different
    near copies costs m²/2 products, cut into blocks.
    """
    spark, columns = df.sparkSession, (ident, vector, label)
    bare = _described(df, columns, None, 0)
    rows = bare.count()
    wanted = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(max(rows, 1)) / 2))))
    drawn = bare.select("key", "size", "unit").orderBy("key").limit(SAMPLE * wanted).collect()  # bounded by the number of pivots
    by_size: dict[int, dict[str, bytes]] = {}
    for r in drawn:
        by_size.setdefault(r["size"], {})[r["key"]] = bytes(r["unit"])
    indexes = {s: build_index(np.frombuffer(b"".join(u.values())).reshape(-1, s), s, wanted, threshold, near, recall) for s, u in by_size.items()}

    described = _described(df, columns, indexes, wanted)
    classes = cut_lineage(described.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("label", "size", "unit", "nearest")]), "vectors")
    used = classes.select("size", F.explode("nearest").alias("p")).groupBy("size", "p").agg(F.count(F.lit(1)).alias("n")).collect()  # pivots times sizes rows
    order: dict[int, list[int]] = {}
    for s in {r["size"] for r in used}:
        indexes.setdefault(s, build_index(np.empty((0, s)), s, wanted))
        counts = {r["p"]: r["n"] for r in used if r["size"] == s}
        by_number = sorted(range(len(indexes[s].pivots)), key=lambda p: (counts.get(p, 0), p))
        order[s] = [0] * len(by_number)
        for rank, p in enumerate(by_number):
            order[s][p] = rank
    source = df.select(F.col(f"`{ident}`").alias("id"))
    if not order:
        return source.select(F.col("id").alias(ident), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                             F.col("id").isNotNull().alias("kept"))
    least = {s: i.least for s, i in indexes.items()}
    listed = {s: i.near - i.least + 1 for s, i in indexes.items()}
    found = cut_lineage(_pair_blocks(classes, listed, least, order, threshold), "links")
    links = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    heads = components(found.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v")), "linked")
    known = classes.select("key", "n", "id").join(links, "key", "left").join(heads.withColumnRenamed("id", "key"), "key", "left").withColumn(
        "head", F.coalesce("head", "key"))
    least_ids = known.groupBy("head").agg(F.min("id").alias("component_id")).hint("rebalance")  # a large component is split by the join
    known = known.join(least_ids, "head").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")

    # every row again: usable ones by their key, the others alone
    keyed = bare.select("id", "key").join(known, "key", "left").select("id", "n_links", "component_id")
    alone = _unusable(df, columns)
    out = keyed.unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(ident), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _unusable(df: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    """Ids of the rows that ``unit_rows`` leaves out, by the same rules."""
    ident, vector, label = columns
    v = F.col(f"`{vector}`").cast("array<double>")
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    zero = ~F.exists(v, lambda x: x != 0)
    bad = F.col(f"`{label}`").isNull() | v.isNull() | F.coalesce(F.exists(v, infinite) | zero, F.lit(True))
    return df.where(bad).select(F.col(f"`{ident}`").alias("id"))


ship(__name__)
