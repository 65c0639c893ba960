"""Byte-level BPE by backtracking over longest matches; decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at every position of a word. The encoder
takes it, falls back to shorter prefixes where the pair with the token before is not one that the merges would
leave standing, and steps back where no prefix fits. The compatibility of a pair follows from undoing the merges
on both sides of the seam; verdicts are kept in a table. Every position is entered once, so the work is linear.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TOKENIZERS, bound_batches, ship, vocabulary, worker_state

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
REMEMBERED = 80 << 20  # bytes of words and their ids that a worker remembers; the tables are emptied when they are full
ENTRY = 220  # bytes of an entry besides word and ids
PAIR_CACHE = 250_000  # verdicts on pairs, about 100 bytes each
# Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return out


class Decoder:
    """The bytes of all tokens behind each other, with the offset of each id."""

    def __init__(self, text: str):
        spec = json.loads(text)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = spec["model"]["vocab"]
        marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = [b""] * (max([*vocab.values(), *marks.values()]) + 1)
        for n, i in vocab.items():
            raw[i] = bytes(back[c] for c in n) if all(c in back for c in n) else n.encode()
        for n, i in marks.items():
            raw[i] = n.encode()
        self.sizes = np.array([len(x) for x in raw], dtype=np.int32)
        self.offsets = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), 1 << 16):  # long texts in pieces, so that the index stays small
            some = ids[at:at + (1 << 16)]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes, dtype=np.int32)
            index = np.repeat(self.offsets[some] - (ends - sizes), sizes)
            index += np.arange(ends[-1], dtype=np.int32)
            out.append(self.bytes[index].tobytes())
        return b"".join(out).decode("utf-8", "replace")


class Codec:
    """Tables of one vocabulary for encoding. Ranks number the byte tokens first and then the merges in their order."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        self.split = regex.compile(SPLIT)
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mark = regex.compile("|".join(regex.escape(m) for m in sorted(self.marks, key=len, reverse=True))) if self.marks else None
        chars = byte_characters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = chars + ["".join(m) for m in merges]
        if len(set(names)) != len(names):
            raise ValueError("two merges make the same token")
        rank = {n: r for r, n in enumerate(names)}
        self.parts = [(r, r) for r in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.merged = {(a << 20) | b: r for r, (a, b) in enumerate(self.parts) if r > 255}
        self.ids = [vocab[n] for n in names]
        self.length = [len(n) for n in names]
        self.pairs: dict[int, bool] = {}
        usable = [True] * 256
        for r in range(256, len(names)):
            a, b = self.parts[r]
            usable.append(usable[a] and usable[b] and self.stands(a, b, r))
        self.shorter = [-1] * len(names)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, r in rank.items():
            if usable[r]:
                if r > 255:
                    self.automaton.add_word(n, r)
                self.shorter[r] = next((rank[n[:k]] for k in range(len(n) - 1, 0, -1) if usable[rank.get(n[:k], -1)] and n[:k] in rank), -1)
        self.automaton.make_automaton()
        self.escape = dict(enumerate(chars))
        self.single = {c: b for b, c in enumerate(chars)}
        self.blank = chars[32]
        self.code = [np.uint32(i).tobytes() for i in self.ids]
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.remembered = 0

    def remember(self, store: dict[str, bytes], piece: str, code: bytes) -> None:
        """Keep the ids of a word that isn't long, within ``REMEMBERED`` bytes for all tables together."""
        if len(piece) > 256:
            return
        self.remembered += ENTRY + len(piece) + len(code)
        if self.remembered > REMEMBERED:
            for old in (self.words, self.first, self.inner):
                old.clear()
            self.remembered = 0
        store[piece] = code

    def stands(self, a: int, b: int, limit: int = 1 << 30) -> bool:
        """Whether the seam between two tokens outlives all merges of a rank below ``limit``."""
        merged, parts = self.merged, self.parts
        while True:
            if merged.get((a << 20) | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        return True

    def word(self, piece: str) -> bytes:
        """Ids of one pre-split word, as 32-bit numbers."""
        known = self.words.get(piece)
        if known is not None:
            return known
        if piece.isascii() and piece.isprintable():
            s = piece.replace(" ", self.blank)
        else:
            s = piece.encode().decode("latin-1").translate(self.escape)
        longest = list(map(self.single.__getitem__, s))
        length, shorter, pairs = self.length, self.shorter, self.pairs
        for end, r in self.automaton.iter(s):
            longest[end - length[r] + 1] = r  # later ends are longer
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        pos, n, token = 0, len(s), longest[0] if s else -1
        if token >= 0 and length[token] == n:
            out, token = [token], -1
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = pos + length[token]
                if not dead[end]:
                    if last < 0:
                        fits = True
                    else:
                        key = (last << 20) | token
                        fits = pairs.get(key)
                        if fits is None:
                            if len(pairs) >= PAIR_CACHE:
                                pairs.clear()
                            fits = pairs[key] = self.stands(last, token)
                    if fits:
                        out.append(token)
                        pos = end
                        token = longest[pos] if pos < n else -1
                        break
                token = shorter[token]
                if token < 0:  # no prefix fits: the token before gives way
                    dead[pos] = 1
                    token = out.pop()
                    pos -= length[token]
                    break
        code = b"".join(map(self.code.__getitem__, out))
        self.remember(self.words, piece, code)
        return code

    def pieces(self, text: str) -> bytes:
        word = self.word
        return b"".join([word(p) for p in self.split.findall(text)])

    def learn(self, piece: str, inner: bool) -> bytes | None:
        """Ids of a run between blanks; None where its edges are no seams of the pattern."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        code = self.pieces(" " + piece if inner else piece)
        self.remember(self.inner if inner else self.first, piece, code)
        return code

    def plain(self, text: str) -> bytes:
        """Text without control tokens. Runs between single blanks and line breaks split alone and are looked up."""
        if not text:
            return b""
        first, inner, learn = self.first, self.inner, self.learn
        newline = self.word("\n")
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(newline)
            runs = line.split(" ")
            codes = list(map(inner.get, runs))
            codes[0] = first.get(runs[0])
            if None in codes:
                for j, code in enumerate(codes):
                    if code is None:
                        codes[j] = learn(runs[j], j > 0)
                        if codes[j] is None:
                            return self.pieces(text)
            out += codes
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.mark is None or not any(m in text for m in self.marks):
            return self.plain(text)
        out, at = [], 0
        for m in self.mark.finditer(text):
            out += [self.plain(text[at:m.start()]), np.uint32(self.marks[m.group()]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


def encode_texts(texts: pa.Array, codec: Codec) -> pa.Array:
    codes = [codec.encode(t.as_py() or "") for t in texts]
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), dtype=np.int32)))


def decode_ids(ids: pa.Array, decoder: Decoder) -> pa.Array:
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    valid = ids.is_valid().to_pylist()
    return pa.array([decoder.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)], pa.string())


def _state(vocab, kind: type):
    return worker_state(f"state:{kind.__name__}:{zlib.crc32(vocab.value.encode())}", lambda: kind(vocab.value))


def bpe_encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """Add the ids of ``text`` as ``array<int>``; a column that is already called ``out`` is replaced.

    A null or empty text has no ids; control strings of the vocabulary become their ids. Rows are independent:
    no shuffle, any number of repeated rows, texts of any length.
    """
    bound_batches(df.sparkSession)
    vocab = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _state(vocab, Codec)
        for texts in batches:
            yield encode_texts(texts, codec)

    return df.withColumn(out, F.arrow_udf(run, T.ArrayType(T.IntegerType()))(F.col(f"`{text}`")))


def bpe_decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """Add the text of ``ids``; null ids give null, no ids an empty text."""
    bound_batches(df.sparkSession)
    vocab = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _state(vocab, Decoder)
        for codes in batches:
            yield decode_ids(codes, decoder)

    return df.withColumn(out, F.arrow_udf(run, T.StringType())(F.col(f"`{ids}`")))


def bpe_round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """Both of the above in one pass of one Python worker: the ids of ``text``, and the text decoded from them.

    The decoder sees nothing but the ids. A null or empty text has no ids and decodes to an empty text.
    """
    bound_batches(df.sparkSession)
    vocab = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, decoder = _state(vocab, Codec), _state(vocab, Decoder)
        for texts in batches:
            codes = encode_texts(texts, codec)
            yield pa.StructArray.from_arrays([codes, decode_ids(codes, decoder)], names=["ids", "decoded"])

    both = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    # generated, as a plain projection of both fields would run the function for each of them
    staged = df.select("*", F.arrow_udf(run, both)(F.col(f"`{text}`")).alias("__both"))
    return staged.withColumns({ids: F.col("__both.ids"), decoded: F.col("__both.decoded")}).drop("__both")


ship(__name__)
