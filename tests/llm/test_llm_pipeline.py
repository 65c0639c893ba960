import corpus_pipeline
from webtraj.llm import minhash, pii, toxicity
from webtraj.llm.queries import ORACLE, QUERIES
from webtraj.session import cut_lineage

from helpers import CLASH, HARD, clash_rows

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark):
    df = spark.createDataFrame([*clash_rows(HARD), (None, "no id mail a@b.example", *["kept"] * 9), (3, "another text", *["kept"] * 9)], CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF_DIR)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        rows = out.collect()
        if name in ("toxicity", "decontamination", "pii"):
            assert len(rows) == len(HARD) + 2
        if name == "near_copies":  # 0 and 1 (empty, null), 2 and 6 (blank) and 4 and 5 are copies or wordless
            ids = [r["doc_id"] for r in rows]
            assert {None, 0, 3, 4} <= set(ids) and 5 not in ids and ids.count(3) == 2
        if name == "pii":
            assert {r["text"] for r in rows} >= {"no id mail [EMAIL]", None, ""}
        assert stage(spark, df.limit(0), SF_DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF_DIR).where("not round_trip").count() == 0


def plain_stages(rows, items, score):
    """What the stages keep of (doc_id, text) rows, by loops over all rows and pairs."""
    kept = [(i, t) for i, t in rows if score[t] < toxicity.THRESHOLD]
    sets = [set(minhash.shingles(t).tolist()) for _, t in kept]
    head = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (kept[a][1] or "") == (kept[b][1] or "") or not sets[a] and not sets[b] or both and both / len(sets[a] | sets[b]) >= 0.8 - 1e-9:
                old, new = head[a], head[b]
                head = [new if h == old else h for h in head]
    best = {}
    for k, h in enumerate(head):
        key = (kept[k][0] is None, kept[k][0] or 0, k)
        best[h] = min(best.get(h, key), key)
    kept = [kept[k] for *_, k in sorted(best.values(), key=lambda x: x[2])]
    return [(i, t) for i, t in kept if not any(item in (t or "") for item in items)]


def test_stages_against_plain_loops(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    extra = [(None, given[3][1]), (None, "clean words of their own without an id"), (5, "another text that shares its id with a clean one"),
             (None, "an item without an id: " + items[0]), (7, None), (None, "")]
    rows = [r for r in given + extra if not any(item in (r[1] or "") and item != items[0] for item in items)]  # leaks that no change blurs
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            lexicon = toxicity.fit(df, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            score = {r["text"]: r["score"] for r in toxicity.score_toxicity(df, lexicon).collect()}
        df = cut_lineage(stage(spark, df, sf_dir), "stage")
        if name == "decontamination":
            left = sorted(((i is None, i or 0, t or "") for i, t in plain_stages(rows, items[:1], score)))
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()) == left
    out = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
    assert out.count() == len(left) and out.where("not round_trip").count() == 0
    assert pii.find_pii(df).where("size(base) > 0").count() == 0


def test_whole_pipeline(spark):
    sf_dir = "/root/testdata/sf0.01"  # labels enough to learn from
    out = corpus_pipeline.run(spark, sf_dir)
    ids = [r["doc_id"] for r in out.collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count() and len(toxic & set(ids)) <= len(toxic) // 2


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} >= {f"op{k}" for k in range(1, 14)} and set(ORACLE) <= set(QUERIES)
