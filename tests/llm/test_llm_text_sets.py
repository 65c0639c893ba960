"""Near copies, test items and search against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from helpers import CLASH, HARD, clash_rows
from webtraj.llm import decontaminate, graph, minhash, search


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def near(rng, text, changes):
    out = text.split()
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def family_texts(seed, families=25, group=6, big=0):
    rng = random.Random(seed)
    texts = []
    for f in range(families):
        text = " ".join(words(rng, rng.randint(60, 200)))
        texts += [text] + [near(rng, text, rng.randint(0, 3)) for _ in range(rng.randint(0, group))]
    if big:
        text = " ".join(words(rng, 150))
        texts += [near(rng, text, rng.randint(0, 2)) for _ in range(big)]
    rng.shuffle(texts)
    return texts


def brute_links(docs, threshold=0.8):
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in docs}
    text = dict(docs)
    ids = sorted(sets)
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i
    links = Counter()
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if (text[a] or "") == (text[b] or "") or both and both / len(sets[a] | sets[b]) >= threshold - 1e-9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                head[high] = low
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("big, block", [(0, 256), (90, 16)])
def test_near_copies_against_brute_force(spark, monkeypatch, big, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = list(enumerate(family_texts(1, big=big) + HARD, 5))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_links(docs)


def test_near_copies_defined_cases(spark):
    rows = [*clash_rows([*HARD, "a b c d e f", "a b c d e f"]), (None, "a b c d e f", *["kept"] * 9), (11, "other text for the same id", *["kept"] * 9)]
    df = spark.createDataFrame(rows, CLASH)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"], r["n_links"]) for r in minhash.near_copies(df).collect())
    assert len(got) == len(rows) and got[0] == (-1, None, 0)
    assert minhash.near_copies(df.limit(0)).count() == 0


def test_prefix_is_shortened_to_the_recall():
    assert minhash.prefix_length(0.8, 24, 8, 0.9999) == 5
    assert minhash.prefix_length(0.8, 24, 8, 0.5) == 8
    for length in (4, 5):
        assert 1 - (1 - 0.8 ** length) ** 24 >= 0.9999


def test_forest_and_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash.common(sets, sets).tolist() == want
    forest = minhash.Forest(6, 3)
    assert (forest.prefixes(sets[0]) == forest.prefixes(sets[0].copy())).all() and len(set(forest.prefixes(sets[0]).tolist())) == 6


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in (300, 301, 9, 8)] + [(5, 5), (1, 2), (2, 1)]
    got = {r["id"]: r["head"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 300: 7, 301: 7, 9: 7, 8: 7, 2: 1}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def items(rng, n):
    return [(100 + i, " ".join(words(rng, rng.randint(8, 30), 900)) + ". " + " ".join(words(rng, rng.randint(1, 12), 900)) + ".") for i in range(n)]


def brute_leaks(docs, tests, threshold=0.8):
    out = set()
    for i, t in tests:
        q, a = decontaminate.question_and_answer(t)
        size = min(5, len(q))
        wanted = decontaminate.grams(q, 5)
        for d, text in docs:
            have = decontaminate.words_of(text)
            span = max(len(decontaminate.words_of(x)) for _, x in tests) * 2
            for s in range(0, max(1, len(have) - span // 2), span // 2):
                part = have[s:s + span]
                seen = Counter(part)
                grams = {tuple(part[k:k + size]) for k in range(len(part) - size + 1)}
                if len(wanted & grams) >= threshold * len(wanted) and sum(min(c, seen[w]) for w, c in Counter(a).items()) >= threshold * len(a):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [4_000, 9])
def test_leaks_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", limit)
    rng = random.Random(3)
    tests = items(rng, 30)
    docs = []
    for i in range(120):
        parts = words(rng, rng.randint(0, 300), 900)
        for _ in range(rng.choice([0, 0, 1, 2])):
            text = rng.choice(tests)[1]
            text = near(rng, text, 1) if rng.random() < 0.3 else text.upper() if rng.random() < 0.3 else text
            at = rng.randint(0, len(parts))
            parts[at:at] = [text]
        docs.append((i, " ".join(parts)))
    docs += list(enumerate(HARD, 500))
    extra = [(900, None), (901, ""), (100, tests[0][1])]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests + extra, "item_id long, text string")).collect()}
    want = brute_leaks(docs, tests)
    assert got == want and len(want) > 20


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(4)
    index = decontaminate.ItemIndex(items(rng, 60), "t")
    for _ in range(200):
        part = words(rng, 40, 900) + decontaminate.words_of(items(rng, 1)[0][1])[:rng.randint(0, 15)] + index.parts[rng.randrange(60)][0][:rng.randint(0, 30)]
        terms = sorted({index.vocabulary[w] for w in part if w in index.vocabulary})
        scores = Counter()
        for t in terms:
            for n, x in zip(*index.lists[t]):
                scores[n] += x
        for threshold in (0.2, 0.6):
            got = {n: s for b in range(index.bounds.shape[1]) for n, s in index.wand(terms, b, threshold)}
            assert set(got) == {n for n, s in scores.items() if s >= threshold - 1e-6}


def test_leaks_defined_cases(spark):
    df = spark.createDataFrame(clash_rows(HARD), CLASH)
    tests = spark.createDataFrame([(1, "one two three four five six. seven.")], "item_id long, text string")
    assert decontaminate.find_leaks(df, tests).count() == 0 and decontaminate.find_leaks(df, tests.limit(0)).count() == 0
    assert decontaminate.drop_leaked(df, tests).count() == len(HARD) and decontaminate.find_leaks(df.limit(0), tests).count() == 0
    leaked = spark.createDataFrame([(1, "so ONE two, three four five six seven"), (None, "one two three four five six seven"), (2, "fine")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.drop_leaked(leaked, tests).collect()] == [2]


def brute_search(docs, k, query_terms):
    counts = {i: Counter(search.tokens(t)) for i, t in docs}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    n, mean = len(counts), sum(sum(c.values()) for c in counts.values()) / len(counts)
    code = {w: int(np.array([xxhash.xxh3_64_intdigest(w)], dtype=np.uint64).view(np.int64)[0]) for w in df}

    def impact(w, i):
        tf = counts[i][w]
        return math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * sum(counts[i].values()) / mean))
    out = {}
    for q in counts:
        if q % 20:
            continue
        terms = sorted(counts[q], key=lambda w: (df[w], -counts[q][w], code[w]))[:query_terms]
        scores = defaultdict(float)
        for w in sorted(terms, key=code.get):
            for i in counts:
                if w in counts[i]:
                    scores[i] += impact(w, i)
        out[q] = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
    return {q: v for q, v in out.items() if v}


def test_search_is_exact(spark):
    docs = [(i, t) for i, t in enumerate(family_texts(7, families=60))] + list(enumerate(HARD, 1000))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = defaultdict(list)
    for r in search.top_k(df, df.where("doc_id % 20 = 0"), k=5, query_terms=8, shard_docs=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["doc_id"]))
    want = brute_search(docs, 5, 8)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=2e-6)


def test_search_asks_for_the_whole_text(spark):
    docs = [(i, t) for i, t in enumerate(family_texts(11, families=30, group=3))] + list(enumerate(HARD, 1000))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = defaultdict(list)
    for r in search.top_k(df, df.where("doc_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["doc_id"]))
    want = brute_search(docs, 10, None)
    assert set(got) == set(want) and want != brute_search(docs, 10, 12)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=2e-6)


def test_terms_of_one_document_count(spark):
    docs = spark.createDataFrame([(0, "alpha beta gamma"), (20, "delta shared"), (21, "epsilon shared shared"), (40, "zeta")], "doc_id long, text string")
    got = {}
    for r in search.top_k(docs, docs.where("doc_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {0: [0], 20: [20, 21], 40: [40]}


def test_block_max_wand_equals_sums():
    rng = np.random.default_rng(9)
    term, doc = np.divmod(rng.choice(12 * 3000, 9000, replace=False), 3000)
    impact = np.round(rng.gamma(1.0, 1.0, len(term)), 4)
    shard = search.Shard(term.astype(np.int64), doc.astype(np.int64), impact)
    for terms in ([0], [0, 1, 2], list(range(12)), [3, 3, 5], [99]):
        scores = Counter()
        for t in sorted(set(terms)):
            for d, x in zip(doc[term == t].tolist(), impact[term == t].tolist()):
                scores[d] += x * (1 + t / 7)
        want = sorted(((-s, d) for d, s in scores.items()))[:10]
        got = shard.top({t: 1 + t / 7 for t in terms}, 10)
        assert [d for d, _ in got] == [d for _, d in want]
        if len(want) > 4:
            assert [d for d, _ in shard.top({t: 1 + t / 7 for t in terms}, 10, -want[4][0])] == [d for s, d in want if s <= want[4][0]]


def test_search_defined_cases(spark):
    df = spark.createDataFrame([*clash_rows(HARD), (None, "two words", *["kept"] * 9)], CLASH)
    found = search.top_k(df, df).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} >= {(4, 4), (4, 5), (5, 4)} and all(r["doc_id"] is not None for r in found)
    twice = spark.createDataFrame([(1, "red red fish"), (1, "blue fish"), (2, "red cat"), (3, "blue cat")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.top_k(twice, twice.where("doc_id = 1")).orderBy("rank").collect()] == [1, 1, 2, 3]
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0 and search.top_k(df, df.limit(0)).count() == 0


def test_search_over_many_small_partitions(spark):
    """Small partitions meet in few blocks: the tasks are not the product of the partitions of both sides."""
    docs = [(i, t) for i, t in enumerate(family_texts(13, families=40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(tuple(r) for r in search.top_k(df, df.where("doc_id % 20 = 0")).collect())
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    sc = spark.sparkContext
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        many = df.repartition(40).localCheckpoint()
        sc.setJobGroup("many partitions", "search")
        assert sorted(tuple(r) for r in search.top_k(many, many.where("doc_id % 20 = 0")).collect()) == want
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("many partitions") for s in status.getJobInfo(j).stageIds}
    assert 0 < max(i.numTasks for i in map(status.getStageInfo, stages) if i) <= 40


def test_rows_of_rounds_follow_the_queries():
    """A round of g times the blocks before it brings back about g k rows a query: few in all, however many blocks."""
    for blocks in (0, 1, 2, 12, 64, 4000):
        rounds = search._rounds(blocks)
        assert rounds[0][0] == 0 and rounds[-1][1] == 1 and all(a[1] == b[0] for a, b in zip(rounds, rounds[1:]))
        rows = blocks * rounds[0][1] + sum((high - low) / low for low, high in rounds[1:])
        assert rows <= 3 + 2.5 * math.log2(blocks + 1)


def test_block_scores_equal_double_sums():
    """Scores through the single-precision product are those of double sums; copies tie and come by document."""
    rng = np.random.default_rng(5)
    size, n, terms = 900, 30, 400
    share = 0.9 / (1 + np.arange(terms)) ** 0.6
    impact = np.where(rng.random((size, terms)) < share, rng.uniform(0.2, 2.2, (size, terms)), 0.0)
    impact[size // 2:] = impact[:size // 2]
    asked = rng.random((n, terms)) < share
    weight = rng.uniform(0.1, 9.0, terms)
    doc, term = np.nonzero(impact)
    shard = search.Shard(term.astype(np.int64), doc, impact[doc, term])
    shard.weigh(weight[shard.terms])
    query, at = np.nonzero(asked[:, shard.terms])
    want = np.round((asked * weight) @ impact.T, 6)
    for floor in (np.full(n, -1.0), np.sort(want, axis=1)[:, -4]):
        got = list(zip(*(x.tolist() for x in shard.best(query, at, floor, 10))))
        first = [(q, d, want[q, d]) for q in range(n) for d in np.lexsort((np.arange(size), -want[q]))[:10] if want[q, d] >= floor[q]]
        assert [x[:2] for x in got] == [x[:2] for x in first] and np.allclose([x[2] for x in got], [x[2] for x in first], atol=2e-6)


def test_words_are_those_of_the_pattern():
    for text in ["".join(chr(c) + " x"[c % 2] for c in range(256)), "ÀÉ naïve_x 3½ a\u00a0b\x1cc", "İstanbul ſ K 日本語 x", "a\u2028b c", "", None]:
        assert search.tokens(text) == search.WORDS.findall((text or "").lower())
