import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import CLASH, HARD, clash_rows
from webtraj.llm import bpe, wavelet

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "'", "É", "ß", "日本", "𝒳", "1", "23", "!!", " \n", "the", " Tion", "<|endoftext|>", "<|startoftext|>",
          "　", "\xa0", "é", "́", "\x00", "\x1c", "\x85", "İ", "ΑΣ", "ª", "_", "×", "²", "½", "''m"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [t or "" for t in HARD]


def test_ids_and_texts_equal_the_library():
    with open(bpe.VOCABULARY, encoding="utf-8") as f:
        raw = f.read()
    codec, decoder, library = bpe.Codec(raw), bpe.Decoder(raw), Tokenizer.from_file(bpe.VOCABULARY)
    for t in texts(1500, 1):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(t), dtype=np.uint32).tolist() == want
        assert decoder.decode(np.array(want, dtype=np.int64)) == library.decode(want, skip_special_tokens=False)


def test_every_token_is_found_and_seams_are_exact():
    with open(bpe.VOCABULARY, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    library = Tokenizer.from_file(bpe.VOCABULARY)
    rng = random.Random(2)
    for _ in range(1500):
        word = "".join(rng.choice("abeinorstu") for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(codec.word(word), dtype=np.uint32).tolist() == library.encode(word, add_special_tokens=False).ids


def test_columns_nulls_and_clashes(spark):
    df = spark.createDataFrame(clash_rows(HARD), CLASH)
    out = bpe.bpe_decode(bpe.bpe_encode(df))
    assert set(df.columns) | {"decoded"} == set(out.columns)
    for r in out.collect():
        assert r["decoded"] == (r["text"] or "") and r["odd name.x"] == "kept" and (r["text"] or r["ids"] == [])
    assert bpe.bpe_encode(df.limit(0)).count() == 0
    assert bpe.bpe_decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).select("decoded").collect() == [(None,), ("",)]


def test_words_equal_the_library():
    with open(wavelet.VOCABULARY, encoding="utf-8") as f:
        raw = f.read()
    encoder, library = wavelet.WordEncoder(raw), Tokenizer.from_str(raw)
    for t in texts(2500, 3):
        assert np.frombuffer(encoder.encode(t), dtype=encoder.kind).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 3000])
def test_wavelet_matrix_answers(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 999).astype(np.uint16)
    m = wavelet.WaveletMatrix.build(ids, 10)
    assert (m.decode() == ids).all()
    rng = random.Random(n)
    for _ in range(60 if n else 0):
        i = rng.randrange(n)
        value = int(ids[i])
        low, high = sorted(rng.choices(range(n + 1), k=2))
        places = np.flatnonzero(ids == value)
        k = rng.randrange(len(places))
        assert m.access(i) == value and m.count(value, low, high) == int((ids[low:high] == value).sum()) and m.occurrence(value, k) == places[k]
        assert m.occurrence(value, len(places)) is None
    assert m.count(1023) == 0 and m.count(5000) == 0


def test_shards_read_back(spark, tmp_path):
    library = Tokenizer.from_file(wavelet.VOCABULARY)
    rows = [*clash_rows(HARD), *clash_rows(["tie b", "tie a"], 3), *[(None, "no id", *["kept"] * 9)]]
    df = spark.createDataFrame(rows, CLASH)
    folder = f"file://{tmp_path}/tokens"
    wavelet.write_tokens(df, folder, shard_tokens=300, partitions=3)
    got = {(r["start"]): r for r in wavelet.read_tokens(spark, folder).collect()}
    at = 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[at]
        assert (r["doc_id"], r["n_tokens"]) == (doc, len(want)) and np.frombuffer(r["ids"], dtype="<u4").tolist() == want
        at += len(want)
    assert wavelet.read_shards(spark, folder).count() > 3
    assert wavelet.read_tokens(spark, folder).select(F.crc32("ids").alias("c")).where(F.col("c") == zlib.crc32(np.array([2], "<u4").tobytes())).count() == 4
    wavelet.write_tokens(df.limit(0), f"{folder}-none")
    assert wavelet.read_tokens(spark, f"{folder}-none").count() == 0
