"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Language ID (rejected documents go), near-duplicates (one document of each
group stays), benchmark decontamination (hit spans go; so do documents that are
mostly test items), personal data (spans become their kind), SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklode.llm import decontaminate, language_id, near_dedup, pii, sentencepiece
from worklode.llm.common import free_name, materialize, table

#: Documents whose language is undetermined, or more doubtful than this, are rejected.
MIN_LANGUAGE_SCORE = 0.5
#: Word-shingle similarity from which two documents are near copies (op8's own contract has 85).
NEAR_PERCENT = 80


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out()))
    lang, score = free_name("_lang_pred", docs.columns), free_name("_lang_score", docs.columns)
    judged = language_id.identify(docs, model, lang_out=lang, score_out=score)
    return judged.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null doc_id stay; repeated rows of a kept document leave one; texts that share a doc_id are judged each by itself."""
    text = free_name("_text_hash", docs.columns)
    gone = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT, text_hash=text).where("not kept").select("doc_id", text).distinct()
    named = docs.where("doc_id is not null").withColumn(text, F.xxhash64("text")).join(gone, ["doc_id", text], "left_anti").dropDuplicates(["doc_id", text])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(pii.redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("pii", personal_data),
    ("sentencepiece", tokens),
]

#: Trained models and merge agendas are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
