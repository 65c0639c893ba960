import random
import zlib

from helpers import CLASH, HARD, clash_rows
from webtraj.llm import toxicity
from webtraj.llm.toxicity import Folder, Lexicon

BAD = ["vilespeak", "nastyword", "grumblor"]


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(rng.randint(3, 6)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        elif i % 3 == 0:
            words[5:7] = ["harmless", "grumblor"]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_folding():
    f = Folder()
    assert f.fold("VІLE5PEAK n4sty $tupid 1d10t") == "vilespeak nasty stupid idiot"
    assert f.fold("24 hours, 1000, $$$ word***") == "24 hours, 1000, $$$ word***"
    assert len(f.fold("Ѕсum İx 0k")) == len("Ѕсum İx 0k".lower())


def test_folding_looks_at_each_word_alone():
    f = Folder()
    for word, folded in [("a55", "ass"), ("a$$", "ass"), ("pi$$", "piss"), ("455hole", "asshole"), ("a_5", "a_s"), ("x" * 30 + "5", "x" * 30 + "s"), ("2024", "2024")]:
        assert f.fold(word) == folded and f.fold(f"n4sty {word}") == f"nasty {folded}"


def test_matches_at_word_starts_only():
    m = Lexicon({"idiot$": 2.0, "idio": 1.0, "bad": 3.0, "a$": 5.0}, ["not idiot"], (0, 1, 0, 0)).matcher()
    assert m.hits("idiot idiots xidiot abad bad badly a ab") == {0: 2.0, 6: 1.0, 25: 3.0, 29: 3.0, 35: 5.0}
    assert m.evidence("so not idiot")[0] == 0.0 and m.evidence("so idiot")[0] > 0


def test_held_out_quality_and_exceptions(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert any(t.startswith("vile") for t in lexicon.weights) and "harmless grumblor" in lexicon.phrases
    held = {r[0]: r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, lexicon).collect()}
    assert sum(scored[i]["predicted"] == y for i, y in held.items()) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored.values())
    swapped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(docs, swapped).weights == lexicon.weights  # held-out labels change nothing


def test_copies_count_once_while_learning(spark):
    rows = corpus(600, 2) + [(10_000 + i, "unique flavour of a copied toxic text with many plain words", 1) for i in range(300)]
    lexicon = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert not any(t.startswith("flav") for t in lexicon.weights)


def test_shared_passages_are_no_copies(spark):
    passage = "one passage of many words that a lot of texts share " * 3
    rows = [(i, f"{passage}own{i} word{i}", i % 2) for i in range(60)] + [(100, "same text", 0), (101, "same text", 0), (102, "same text", 1), (103, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    kept = toxicity._train_rows(docs, labels, "doc_id", "text", 1000).collect()
    assert {(r["text"], r["toxic"]) for r in kept} == {r[1:] for r in known} and len(kept) == len({r[1:] for r in known})


def test_hard_rows_and_empty_tables(spark):
    df = spark.createDataFrame(clash_rows(HARD), CLASH)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, none)
    out = toxicity.score_toxicity(df, lexicon).collect()
    assert len(out) == len(HARD) and all(r["score"] < 1e-6 and r["predicted"] == 0 and r["base"] == "kept" for r in out)
    nulls = spark.createDataFrame([(None, 1), (0, None), (3, 1)], "doc_id long, toxic int")
    assert toxicity.fit(df, nulls).weights == {}
    assert toxicity.score_toxicity(df.limit(0), lexicon).count() == 0


def plain_evidence(lexicon, text):
    """Weights of hits, kinds of hits and words, by a scan over the words of the folded text."""
    import re
    folded = Folder().fold(text or "")
    words = list(re.finditer(r"[^\W_]+", folded))
    total, kinds = 0.0, set()
    for k, w in enumerate(words):
        best = 0.0
        for term, weight in lexicon.weights.items():
            if w.group() == term[:-1] if term.endswith("$") else folded.startswith(term, w.start()):
                best = max(best, weight)
        around = {f"{words[k - 1].group()} {w.group()}" if k else None, f"{w.group()} {words[k + 1].group()}" if k + 1 < len(words) else None}
        if best > 0 and not around & set(lexicon.phrases):
            total += best
            kinds.add(w.group())
    return total, len(kinds), len(words)


def test_evidence_equals_a_plain_count(spark):
    import math
    rows = corpus(400, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    matcher = lexicon.matcher()
    gaps = " " * 60
    texts = [t for _, t, _ in rows] + [f"harmless{gaps}grumblor", f"harmless,\n{gaps}grumblor nastyword", "N4STYWORD-vilespeak", "", "   ", None]
    for t in texts:
        total, kinds, words = plain_evidence(lexicon, t)
        want = (math.log1p(total), math.log1p(100 * total / max(words, 20)), math.log1p(kinds), words)
        assert all(abs(a - b) < 1e-9 for a, b in zip(matcher.evidence(t), want)), t
    assert any(plain_evidence(lexicon, t)[0] for t in texts)


def test_padding_changes_no_score(spark):
    rows = corpus(400, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    matcher = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")).matcher()
    for _, t, _ in rows[:50]:
        padded = "\n" * 5000 + t.replace(" ", "  \t") + " \n . " * 3000
        assert matcher.evidence(padded) == matcher.evidence(t)
    assert matcher.evidence("a  b\tc   d")[3] == 4
