"""The operators of this package as queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from webtraj.session import scratch_path

from . import alignment, bpe, chat, decontaminate, minhash, pii, pivots, search, secret_scan, toxicity, urls, wavelet, whitening
from .shared import table
from .spans import printed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op8_bpe_codec")
def op8_bpe_codec(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_round_trip(docs, path=public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_token_shards")
def op4_token_shards(spark, sf_dir):
    """Places and checksums of all documents' ids, read back from the wavelet files in the shared folder."""
    folder = scratch_path(spark, "tokens")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), folder, path=public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_url_rules", """
WITH rules(action, rhost, rpath) AS (VALUES
    ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parts AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
    SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts),
fits AS (
    SELECT page_id, max({'n': length(rhost) + length(rpath), 'rule': rhost || rpath, 'action': action}) AS best
    FROM urls JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id
""")
def op10_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


@query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    """Secrets of every document: base counts and digest, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
                        printed(secret_scan.all_spans(F.col("base"), F.col("added"))).alias("spans"))


@query("op7_pii_spans")
def op7_pii_spans(spark, sf_dir):
    """Personal data of every document: base counts and digest, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
                        pii.all_spans(F.col("base"), F.col("added")).alias("spans"))


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Toxicity of every document by the lexicon learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.score_toxicity(docs, lexicon).select("doc_id", held.alias("held_out"), "score", "predicted", "n_words")


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    """Benchmark items leaked into documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark, sf_dir):
    """Class and number of links of every document."""
    return minhash.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_chat_format", r"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) + CASE role
        WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7
        ELSE 19 + length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) END AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op5_chat_format(spark, sf_dir):
    """Every conversation and one full of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                   "conv_id long, turn long, role string, text string")
    read = chat.read_chats(chat.format_chats(rows.unionByName(tricky)))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op9_bm25_search")
def op9_bm25_search(spark, sf_dir):
    """The ten best documents for every document whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 20 = 0"))


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    """Links and groups between the tokens of two vocabularies in every document."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), paths=paths).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("op12_whitened_vectors")
def op12_whitened_vectors(spark, sf_dir):
    """Every vector on the first 32 components of all vectors, with unit covariance."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=32)
    shares = F.lit(model.explained).cast("array<double>")
    return whitening.whiten(vectors, model).select(
        "vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


@query("op13_near_vectors")
def op13_near_vectors(spark, sf_dir):
    """Number of links, component and representative of every vector."""
    return pivots.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.98)
