"""From raw documents to token ids: toxic texts, near copies and leaked test items go, personal data is masked.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns they were given.
Every row is judged by its own text: null and repeated values of doc_id are rows like others, and an empty table stays
empty. A null text is judged as an empty one and stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtraj.llm import bpe, decontaminate, minhash, pii, toxicity
from webtraj.llm.shared import table
from webtraj.session import cut_lineage


def _quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels outside the held-out third, doesn't call toxic.

    A score of exactly the threshold goes; a null or empty text has the score of no evidence."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.add_evidence(docs, lexicon, "text", "__evidence")
    return judged.where(F.col("__evidence.score") < toxicity.THRESHOLD).select(*_quoted(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the least doc_id, a null one last; of equal ones any one.

    Rows get numbers of their own, fixed by writing them, so that rows which share an id or have none are told apart.
    """
    numbered = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    classes = minhash.near_copies(numbered, "__row").select(F.col("doc_id").alias("__row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("__r")
    kept = numbered.select("__row", "doc_id").join(classes, "__row").groupBy("class_id").agg(first).select("__r.__row")
    return numbered.join(kept, "__row", "left_semi").select(*_quoted(docs))


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows. A null text stays null; where spans of several
    kinds overlap, their union is replaced once."""
    names = [c for c in ("base", "added", "proposed") if c in docs.columns]  # columns that the search for spans would replace
    clean = pii.redact(docs.withColumnsRenamed({c: f"__{c}" for c in names}), "text").withColumnsRenamed({f"__{c}": c for c in names})
    return (clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean).select(*_quoted(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text back. A null text has no ids."""
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return bpe.bpe_round_trip(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", clean_language), ("near_copies", one_of_near_copies), ("decontamination", no_test_items), ("pii", masked), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
