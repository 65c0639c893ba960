"""Token ids of a corpus as wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents as bit planes, the highest bit first; each plane is stably split
into zeros and ones before the next. Counts of ones per block give rank in constant time and select by search, so
a reader gets any token, the count of a token in a range, or its k-th place without unpacking the shard. Files are
written by Spark's committer into a shared folder: a task that is run again replaces its own output only.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters
from .shared import TOKENIZERS, bound_batches, ship, vocabulary, worker_state

VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"
SHARD_TOKENS = 1 << 22
BLOCK = 512  # bits between two rank counts
WORD_CACHE = 1_000_000  # words a worker remembers; the table is emptied when it is full
RUN_CACHE = 300_000  # the same for runs between blanks
SEPARATORS = "\x1c\x1d\x1e\x1f"  # str.split() takes these for blanks, the vocabulary's pattern doesn't
SHARD_SCHEMA = ("part int, seq int, before long, n_tokens long, doc_ids array<long>, ends array<int>, bits int, "
                "zeros array<int>, planes binary, ranks binary")
SHARD_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("bits", pa.int32()),
    ("zeros", pa.list_(pa.int32())), ("planes", pa.binary()), ("ranks", pa.binary())])


class WaveletMatrix:
    """Bit planes of ``n`` numbers of ``bits`` bits, with rank counts every ``BLOCK`` bits."""

    def __init__(self, n: int, zeros: list[int], planes: bytes, ranks: bytes):
        self.n, self.zeros, self.bits = n, list(zeros), len(zeros)
        self.planes = np.frombuffer(planes, dtype=np.uint8).reshape(self.bits, -(-n // 8))
        self.ranks = np.frombuffer(ranks, dtype=np.uint32).reshape(self.bits, n // BLOCK + 1)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, zeros, planes, ranks = len(ids), [], [], []
        for level in range(bits):
            ones = (ids & ids.dtype.type(1 << (bits - 1 - level))) != 0
            plane = np.packbits(ones)
            padded = np.zeros((n // BLOCK + 1) * (BLOCK // 8), dtype=np.uint8)
            padded[:len(plane)] = plane
            counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32).tobytes())
            planes.append(plane.tobytes())
            low = ids[~ones]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[ones]])
        return cls(n, zeros, b"".join(planes), b"".join(ranks))

    def rank(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        start = i // BLOCK
        part = self.planes[level, start * (BLOCK // 8):i // 8]
        count = int(self.ranks[level, start]) + int(np.bitwise_count(part).sum())
        return count + (int(self.planes[level, i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else count

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a kind in a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level, i // 8]) >> (7 - i % 8) & 1
            ones = self.rank(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank(level, low), self.rank(level, high)
            low, high = (zeros + a, zeros + b) if value >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of ``value`` in [low, high)."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, low, self.n if high is None else high)
        return b - a

    def occurrence(self, value: int, k: int) -> int | None:
        """Position of the k-th (from 0) occurrence, None where there are fewer."""
        if k < 0 or k >= self.count(value):
            return None
        at = self._range(value, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All numbers in order: the planes are merged back from the lowest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            merged, zeros = np.empty_like(values), self.zeros[level]
            merged[~ones] = values[:zeros]
            merged[ones] = values[zeros:] | kind(1 << (self.bits - 1 - level))
            values = merged
        return values


class WordEncoder:
    """The library's ids of whole texts, looked up by word.

    The vocabulary lower-cases, drops white space and ends every word. Texts of Latin-1 characters are split by the
    file's own pattern, spelled out for that range; the library's model gives the ids of words not met before, many
    in one call, and they are remembered, as are those of whole runs between blanks. Any other text goes through the
    library as a whole.
    """

    def __init__(self, text: str):
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.model = Tokenizer.from_str(json.dumps({  # the same merges for words that are split and byte-mapped here
            **json.loads(text), "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.escape = dict(enumerate(byte_characters()))
        self.bits = max(vocab.values()).bit_length()
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.ends = np.zeros(1 << self.bits, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        letters, digits, blanks = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blanks}{letters}{digits}]+").findall
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> dict[str, bytes]:
        mapped = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.escape) for w in new]
        ids = np.array(self.model.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)[0].ids, dtype=self.kind)
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(new):
            raise ValueError("a word of the vocabulary has no end mark")
        raw, last, out = ids.tobytes(), 0, {}
        for w, end in zip(new, (at * ids.itemsize).tolist()):
            out[w] = raw[last:end]
            last = end
        if len(self.words) + len(out) > WORD_CACHE:
            self.words.clear()
        self.words.update(out)
        return out

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of words that the pattern has split."""
        codes = list(map(self.words.get, parts))
        if None in codes:
            fresh = self.learn(list({p for p, c in zip(parts, codes) if c is None}))
            codes = [fresh[p] if c is None else c for p, c in zip(parts, codes)]
        return codes

    def runs(self, new: list[str]) -> dict[str, bytes]:
        """Ids of runs between blanks that were not met before, all split and looked up in one go."""
        pieces = [self.split(r) for r in new]
        codes, at, out = self.parts([p for ps in pieces for p in ps]), 0, {}
        for r, ps in zip(new, pieces):
            out[r] = b"".join(codes[at:at + len(ps)])
            at += len(ps)
        if len(self.known) + len(out) > RUN_CACHE:
            self.known.clear()
        self.known.update((r, c) for r, c in out.items() if len(r) <= 64)
        return out

    def latin(self, text: str) -> bytes:
        """No word of the pattern crosses a blank, so the runs between blanks are split alone and remembered."""
        if any(c in text for c in SEPARATORS):
            return b"".join(self.parts(self.split(text.lower())))
        runs = text.lower().split()
        codes = list(map(self.known.get, runs))
        if None in codes:
            fresh = self.runs(list({r for r, c in zip(runs, codes) if c is None}))
            codes = [fresh[r] if c is None else c for r, c in zip(runs, codes)]
        return b"".join(codes)

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return self.latin(text)
            except UnicodeEncodeError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()


def _shards(batches: Iterator[pa.RecordBatch], encoder: WordEncoder, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    part, seq, before = TaskContext.get().partitionId(), 0, 0
    end, size = np.array([end_id], dtype=encoder.kind).tobytes(), np.dtype(encoder.kind).itemsize
    ids, codes, ends, total = [], [], [], 0

    def shard():
        m = WaveletMatrix.build(np.frombuffer(b"".join(codes), dtype=encoder.kind), encoder.bits)
        row = {"part": part, "seq": seq, "before": before, "n_tokens": total, "doc_ids": ids, "ends": ends, "bits": encoder.bits,
               "zeros": m.zeros, "planes": m.planes.tobytes(), "ranks": m.ranks.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=SHARD_ARROW)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            code = encoder.encode(text.as_py() or "")
            n = len(code) // size + 1
            if total and total + n > shard_tokens:
                yield shard()
                seq, before = seq + 1, before + total
                ids, codes, ends, total = [], [], [], 0
            total += n
            ids.append(doc)
            codes += (code, end)
            ends.append(total)
    if total:
        yield shard()


def write_tokens(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, end_id: int = 2,
                 shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Encode ``df`` in ascending ``doc_id`` order and write one wavelet file per shard to ``folder``.

    One range shuffle by id, then every partition streams through shards of at most ``shard_tokens`` ids (a longer
    document is a shard of its own). Null ids come first; rows of equal id follow the order of their texts; a null or
    empty text is the end mark alone; an empty table writes no shard. Other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    vocab = vocabulary(spark, path)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocab.value
        yield from _shards(batches, worker_state(f"state:words:{zlib.crc32(raw.encode())}", lambda: WordEncoder(raw)), end_id, shard_tokens)

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    shards = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``start``, the ids in all shards before; only one total per partition meets in one task."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("first"))
    return shards.join(F.broadcast(starts), "part").withColumn("start", F.col("first") + F.col("before")).drop("first")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) read back from the files; ``ids`` are little-endian unsigned 32-bit numbers."""
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]).decode()
                ends = np.array([0, *row["ends"]], dtype=np.int64)
                for at in range(0, len(ends) - 1, 1000):
                    cut = ends[at:at + 1001]
                    raw = values[cut[0]:cut[-1]].astype("<u4").tobytes()
                    ids = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [
                        None, pa.py_buffer(((cut - cut[0]) * 4).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["doc_ids"][at:at + 1000], pa.int64()), pa.array(cut[:-1] + row["start"]),
                        pa.array(np.diff(cut)), ids], names=["doc_id", "start", "n_tokens", "ids"])

    return read_shards(spark, folder).select("start", "n_tokens", "doc_ids", "ends", "zeros", "planes", "ranks").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


ship(__name__)
