"""Alignment of the tokens that two tokenizers make of the same bytes.

Tokens and bytes form an incidence matrix for each tokenizer, stored as hand-built compressed sparse rows. The product
A·Bᵀ of the two, row by row after Gustavson, holds an entry for every pair of tokens that share bytes: the overlap
links, with the number of shared bytes. Offsets at which tokens of both end cut a text into groups, and the product of
the incidences of tokens and groups holds the pairs within a group.

How many documents hold a pair of ids linked is counted over the whole corpus. A task encodes its documents in batches
and writes for each batch its different pairs once, with the number of documents; only these rows are shuffled, summed,
ranked per id of the first tokenizer, and sent back to their batch, where the links of each document look them up.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webtraj.session import cut_lineage

from .bpe import SPLIT, byte_characters
from .shared import MAX_VOCABULARY_BYTES, TOKENIZERS, bound_batches, ship, vocabulary, worker_state

BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
TEXT_BYTES = 1 << 20  # bytes of texts that are aligned in one go; a longer text is aligned alone
BATCH_LINKS = 1 << 21  # links of a batch, after which its pairs are written
PRODUCT = 1 << 22  # terms of a product that are expanded at a time
BLANKS = re.compile(r"\s{5000}")  # runs this long overflow the stack of one library; the other takes such texts


# ---- sparse rows ------------------------------------------------------------------------------

class Rows(NamedTuple):
    """Compressed sparse rows: row i has the columns ``columns[starts[i]:starts[i + 1]]`` with ``values`` (None: ones)."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None


def row_terms(a: Rows, b: Rows) -> np.ndarray:
    """Symbolic step: the number of terms that each row of a·b adds up."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])
    return terms[a.starts[1:]] - terms[a.starts[:-1]]


def product(a: Rows, b: Rows) -> Rows:
    """a·b: every row of a picks rows of b, whose entries are added up. Rows are expanded ``PRODUCT`` terms at a time."""
    terms = np.cumsum(row_terms(a, b))
    starts, columns, values, at, size = [np.zeros(1, dtype=np.int64)], [], [], 0, len(a.starts) - 1
    while at < size:
        done = int(terms[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(terms, done + PRODUCT, side="right")))
        picked = a.columns[a.starts[at]:a.starts[end]]
        each = np.diff(b.starts)[picked]
        ends = np.cumsum(each)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b.starts[picked] - (ends - each), each)
        row = np.repeat(np.repeat(np.arange(end - at), np.diff(a.starts[at:end + 1])), each)
        key = row * np.int64(b.width) + b.columns[place]
        value = np.ones(len(key), dtype=np.int64)
        if a.values is not None:
            value = value * np.repeat(a.values[a.starts[at]:a.starts[end]], each)
        if b.values is not None:
            value = value * b.values[place]
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        values.append(np.add.reduceat(value, first) if len(first) else value)
        columns.append(key[first] % b.width if b.width else key[first])
        counts = np.bincount(key[first] // b.width if b.width else key[first], minlength=end - at)
        starts.append(starts[-1][-1] + np.cumsum(counts))
        at = end
    return Rows(np.concatenate(starts), np.concatenate(columns) if columns else np.zeros(0, dtype=np.int64), b.width,
                np.concatenate(values) if values else np.zeros(0, dtype=np.int64))


class Aligned(NamedTuple):
    """Texts laid out behind each other. ``ends`` are byte offsets of token ends; ``bounds`` those that both share."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    bounds: np.ndarray
    links: Rows  # tokens of A by tokens of B, values: shared bytes
    group_a: Rows  # tokens of A by groups
    group_b: Rows  # groups by tokens of B


def align_sizes(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Links and groups from the byte lengths of two token sequences over the same bytes."""
    ends_a, ends_b = np.cumsum(sizes_a, dtype=np.int64), np.cumsum(sizes_b, dtype=np.int64)
    total, zero = int(ends_a[-1]) if len(ends_a) else 0, np.zeros(1, dtype=np.int64)
    by_token = Rows(np.concatenate([zero, ends_a]), np.arange(total), total)
    by_byte = Rows(np.arange(total + 1), np.repeat(np.arange(len(sizes_b)), sizes_b), len(sizes_b))
    bounds = np.intersect1d(ends_a, ends_b, assume_unique=True)
    in_group = lambda ends: np.searchsorted(bounds, ends)
    group_a = Rows(np.arange(len(ends_a) + 1), in_group(ends_a), len(bounds))
    group_b = Rows(np.concatenate([zero, np.cumsum(np.bincount(in_group(ends_b), minlength=len(bounds)))]).astype(np.int64), np.arange(len(ends_b)), len(ends_b))
    return Aligned(ends_a, ends_b, bounds, product(by_token, by_byte), group_a, group_b)


def shared_groups(aligned: Aligned) -> Rows:
    """Tokens of A by tokens of B in the same group."""
    return product(aligned.group_a, aligned.group_b)


# ---- tokenizers -------------------------------------------------------------------------------

class Pair:
    """Both tokenizers, the bytes of their tokens, and the printed forms of their ids."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        spec = json.loads(byte_bpe)
        vocab, marks = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(back[c] for c in name): i for name, i in vocab.items() if name not in marks}
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        self.whole = Tokenizer.from_str(byte_bpe)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()
        # where the ids follow the order of the merges, ranks alone give the same ids
        ranked = all(vocab.get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges))
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        self.piece = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = [b""] * (max([*vocab.values(), *marks.values()]) + 1)
        for raw, i in ranks.items():
            self.bytes_a[i] = raw
        for name, i in marks.items():
            self.bytes_a[i] = name.encode()
        p = self.piece
        self.bytes_b = [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(p.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        names = [[str(i).encode() for i in range(len(t))] for t in (self.bytes_a, self.bytes_b)]
        self.printed = [x + end for x in names[0] for end in (b",", b"|")] + [x + end for x in names[1] for end in (b",", b";", b"")]
        self.of_b = 2 * len(names[0])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for a space and each text; none where the tokens' bytes aren't these bytes."""
        out = []
        for text, b in zip(texts, self.piece.encode(texts, num_threads=1) if texts else []):
            spaced = " " + text
            if self.fast is None or len(text) >= 5000 and BLANKS.search(text):
                a = self.whole.encode(spaced, add_special_tokens=False).ids
            else:
                a = self.fast.encode_ordinary(spaced)
            raw = spaced.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((np.array(a if same else [], dtype=np.int64), np.array(b if same else [], dtype=np.int64)))
        return out


class Shares(NamedTuple):
    """Of some texts, per text: counts of tokens, groups, links and pairs in a group, and the digest of the groups;
    and per text and different linked pair of ids: the text, the pair, and how often it occurs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_group_links: np.ndarray
    digests: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def align_texts(texts: list[str], both: Pair) -> Shares:
    """The alignment of non-empty texts, all in one product."""
    encoded = both.encode(texts)
    n_a, n_b = (np.array([len(e[k]) for e in encoded], dtype=np.int64) for k in (0, 1))
    join = lambda k: np.concatenate([e[k] for e in encoded]) if encoded else np.zeros(0, dtype=np.int64)
    a, b = join(0), join(1)
    al = align_sizes(both.sizes_a[a], both.sizes_b[b])
    number = np.arange(len(texts))
    text_a, text_b = np.repeat(number, n_a), np.repeat(number, n_b)
    token = np.repeat(np.arange(len(a)), np.diff(al.links.starts))  # token of A of each link
    text = text_a[token]
    count = lambda of, weights=None: np.bincount(of, weights, len(texts)).astype(np.int64)
    in_a, in_b = np.bincount(al.group_a.columns, minlength=len(al.bounds)), np.diff(al.group_b.starts)
    last_a = np.cumsum(in_a) - 1  # every group has tokens of both
    group_text = text_a[last_a]

    # ids in print order: the tokens of A of a group, then those of B
    group_of_b = np.repeat(np.arange(len(al.bounds)), in_b)
    place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[al.group_a.columns]
    place_b = np.arange(len(b)) + np.cumsum(in_a)[group_of_b]
    order = np.empty(len(a) + len(b), dtype=np.int64)
    ends_group_a = np.zeros(len(a), dtype=np.int64)
    ends_group_a[last_a] = 1
    end_b = np.zeros(len(b), dtype=np.int64)
    end_b[np.cumsum(in_b) - 1] = 1
    end_b[(np.cumsum(n_b) - 1)[n_b > 0]] = 2
    order[place_a] = 2 * a + ends_group_a
    order[place_b] = both.of_b + 3 * b + end_b
    digests, at = [], 0
    for n in (n_a + n_b).tolist():
        digests.append(hashlib.sha256(b"".join(map(both.printed.__getitem__, order[at:at + n].tolist()))).hexdigest() if n else "")
        at += n

    pairs, code = np.unique((a[token] << 32) | b[al.links.columns], return_inverse=True)
    in_text, times = np.unique(text * len(pairs) + code, return_counts=True)
    width = max(len(pairs), 1)
    return Shares(n_a, n_b, count(group_text), count(text), count(text_a, row_terms(al.group_a, al.group_b)), digests,
                  in_text // width, pairs[in_text % width] if len(pairs) else pairs, times)


# ---- over a table ------------------------------------------------------------------------------

_PARTS = "batch long, pair long, docs int, id {0}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, codes binary, times binary"


def _written(rows: list, kind: pa.DataType, number: int) -> Iterator[pa.RecordBatch]:
    """The rows of one batch: its different pairs with their number of documents, and its documents.

    Pairs ascend, so a document names them by gaps between their places.
    """
    pair = np.concatenate([s.pair for _, s in rows])
    pairs, code = np.unique(pair, return_inverse=True)
    docs = np.bincount(code, minlength=len(pairs))
    n, none = len(pairs), pa.nulls
    names = [c.split()[0] for c in _PARTS.split(", ")]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(n, number, dtype=np.int64)), pa.array(pairs), pa.array(docs.astype(np.int32)), none(n, kind),
        *[none(n, pa.int64())] * 5, none(n, pa.string()), none(n, pa.binary()), none(n, pa.binary())], names=names)
    at = 0
    for ids, s in rows:
        m = len(s.n_a)
        ends = np.searchsorted(s.text, np.arange(m + 1)) + at
        codes, times = [], []
        for low, high in zip(ends[:-1], ends[1:]):
            codes.append(np.diff(code[low:high], prepend=0).astype(np.int32).tobytes())
            t = s.times[low - at:high - at]
            times.append(t.astype(np.uint8 if t.max(initial=0) < 256 else np.int32).tobytes())
        at += len(s.pair)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(m, number, dtype=np.int64)), none(m, pa.int64()), none(m, pa.int32()), ids,
            *[pa.array(x) for x in s[:5]], pa.array(s.digests, pa.string()), pa.array(codes, pa.binary()), pa.array(times, pa.binary())], names=names)


def _encoded(df: DataFrame, ident: str, text: str, paths: tuple[str, str]) -> DataFrame:
    spark = df.sparkSession
    byte_bpe, pieces = vocabulary(spark, paths[0]), _model(spark, paths[1])
    source = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"state:alignment:{zlib.crc32(byte_bpe.value.encode())}:{zlib.crc32(pieces.value)}"
        both = worker_state(key, lambda: Pair(byte_bpe.value, pieces.value))
        number, rows, links, kind = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            kind = batch.schema.field("id").type
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= TEXT_BYTES):
                    size += len(texts[end])
                    end += 1
                shares = align_texts(texts[at:end], both)
                rows.append((batch.column("id").slice(at, end - at), shares))
                links += len(shares.pair)
                if links >= BATCH_LINKS:
                    yield from _written(rows, kind, number)
                    number, rows, links = number + 1, [], 0
                at = end
        if rows:
            yield from _written(rows, kind, number)

    bound_batches(spark)
    return source.mapInArrow(run, _PARTS.format(dict(source.dtypes)["id"]))


def _model(spark, path: str):
    """A binary vocabulary file as a broadcast value, refused beyond ``MAX_VOCABULARY_BYTES``."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair of ids linked, and whether no pair of its first id has more."""
    counts = parts.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(df: DataFrame, ident: str = "doc_id", text: str = "text", paths: tuple[str, str] = (BYTE_BPE, PIECES)) -> DataFrame:
    """Per document (``ident``, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256).

    ``paths`` name a byte-level vocabulary (A, which encodes a space and the text) and a sentencepiece model (B, which
    adds the space itself). Control strings in texts are plain text. A text that is null, empty, or not given back by
    the bytes of either's tokens has no tokens: zeros, and '' as digest. ``n_best`` counts links whose pair no other
    pair of the same A id exceeds, equal ones included; ``count_sum`` adds up the counts of all links.

    Every row is a document, whatever its id: null and repeated ids are rows of their own. Texts are aligned whole. An
    empty table gives an empty result; other columns are ignored, whatever their names. The encoded batches are written
    to the shared folder once; a pair that all batches hold has one row for each batch.
    """
    parts = cut_lineage(_encoded(df, ident, text, paths), "alignment")
    asked = parts.where("pair is not null").select("batch", "pair", "docs")
    answers = asked.join(pair_counts(asked), "pair").select(F.col("batch").alias("of_batch"), "pair", "n", "best")
    documents = parts.where("pair is null").drop("pair", "docs")
    kept = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        n_best, total = [], []
        for gaps, times in zip(left.column("codes").to_pylist(), left.column("times").to_pylist()):
            code = np.cumsum(np.frombuffer(gaps, dtype=np.int32), dtype=np.int64)
            often = np.frombuffer(times, dtype=np.uint8 if len(times) * 4 == len(gaps) else np.int32).astype(np.int64)
            n_best.append(int((best[code] * often).sum()) if len(code) else 0)
            total.append(int((n[code] * often).sum()) if len(code) else 0)
        return pa.table([left.column("id"), *[left.column(c) for c in kept], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left.column("groups_sha256")],
                        names=["id", *kept, "n_best", "count_sum", "groups_sha256"])

    schema = f"id {dict(parts.dtypes)['id']}, {', '.join(c + ' long' for c in [*kept, 'n_best', 'count_sum'])}, groups_sha256 string"
    return documents.groupBy("batch").cogroup(answers.groupBy("of_batch")).applyInArrow(run, schema).withColumnRenamed("id", ident)


ship(__name__)
