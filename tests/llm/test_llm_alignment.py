"""Links and groups of two tokenizers' tokens against a plain walk over the bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from helpers import CLASH, HARD, clash_rows
from webtraj.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["the", "Alignment", "naïve", "日本語", "𝒳𝒴", "1,234.5", "don't", "\n", "\t", "  ", "<|endoftext|>", "</s>", "<s>", "[INST]", "<0x0A>", "é", "\x00", "🙂🙃", "ﬁ", " "]


@pytest.fixture(scope="module")
def both():
    return alignment.Pair(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())


def walked(texts, both):
    """The result of ``align_tokens`` by plain loops and the libraries' own encoders."""
    whole, piece = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    whole.encode_special_tokens = True
    found, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        if not text or b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
            a, b, raw = [], [], b""
        owner_a = [k for k, i in enumerate(a) for _ in both.bytes_a[i]]
        owner_b = [k for k, i in enumerate(b) for _ in both.bytes_b[i]]
        links = [(a[x], b[y]) for x, y in sorted(set(zip(owner_a, owner_b)))]
        cuts = [at for at in range(1, len(raw) + 1) if at == len(raw) or owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]]
        groups, in_group, low = [], 0, 0
        for at in cuts:
            ga, gb = (list(dict.fromkeys(o[low:at])) for o in (owner_a, owner_b))
            groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
            in_group, low = in_group + len(ga) * len(gb), at
        found.append((len(a), len(b), links, in_group, groups))
        counts.update(set(links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(groups), len(links), in_group, sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for na, nb, links, in_group, groups in found]


def aligned(spark, texts):
    return sorted(alignment.align_tokens(spark.createDataFrame(clash_rows(texts), CLASH), paths=PATHS).collect())


def test_equal_to_a_walk_over_the_bytes(spark, both, monkeypatch):
    rng = np.random.default_rng(0)
    texts = [str(rng.choice(["", " "])).join(rng.choice(WORDS, rng.integers(1, 60))) for _ in range(300)]
    texts += ["the same text"] * 50 + HARD + ["▁ is a piece's blank", "�￾"]
    out = aligned(spark, texts)
    want = walked(texts, both)
    assert [tuple(r)[1:] for r in out] == want
    assert sum(w[0] == 0 for w in want) >= 4 and sum(w[2] < w[0] for w in want) > 100


def test_small_batches_and_products_change_nothing(both, monkeypatch):
    texts = ["one two three 日本語", "", "x" * 500, "don't  stop\n\n"]
    before = alignment.align_texts(texts, both)
    monkeypatch.setattr(alignment, "PRODUCT", 7)
    after = alignment.align_texts(texts, both)
    for x, y in zip(before, after):
        assert list(x) == list(y)


def test_long_blanks_take_the_other_library(both):
    text = "a" + " " * 400_000 + "b"
    (a, b), = both.encode([text])
    assert both.whole.encode(" " + text, add_special_tokens=False).ids == a.tolist() and len(b)


def test_products_of_sparse_rows():
    rng = np.random.default_rng(3)

    def sparse(dense):
        starts = np.concatenate([[0], np.cumsum((dense > 0).sum(1))])
        rows, columns = np.nonzero(dense)
        return alignment.Rows(starts, columns, dense.shape[1], dense[rows, columns])
    for shape in ((5, 7, 4), (1, 1, 1), (6, 3, 0), (0, 3, 2)):
        a, b = rng.integers(0, 3, shape[:2]), rng.integers(0, 3, shape[1:])
        out = alignment.product(sparse(a), sparse(b))
        dense = np.zeros((shape[0], shape[2]), dtype=int)
        dense[np.repeat(np.arange(shape[0]), np.diff(out.starts)), out.columns] = out.values
        assert (dense == a @ b).all()
        assert alignment.row_terms(sparse(a), sparse(b)).tolist() == [int(((b > 0).sum(1) * (r > 0)).sum()) for r in a]


def test_pairs_in_a_group():
    al = alignment.align_sizes(np.array([2, 2, 3]), np.array([1, 3, 3]))
    assert al.bounds.tolist() == [4, 7]
    shared = alignment.shared_groups(al)
    assert shared.starts.tolist() == [0, 2, 4, 5] and shared.columns.tolist() == [0, 1, 0, 1, 2]
    assert al.links.columns.tolist() == [0, 1, 1, 2] and al.links.values.tolist() == [1, 1, 2, 3]


def test_no_documents(spark):
    assert aligned(spark, []) == []
    rows = spark.createDataFrame([(None, "one text"), (None, "one text"), (1, None)], "doc_id int, text string")
    out = alignment.align_tokens(rows, paths=PATHS).collect()
    assert sorted(r["n_links"] for r in out) == [0, 2, 2] and [r["count_sum"] for r in out if r["n_links"]] == [4, 4]
