"""A corpus pipeline: language, repeated lines, near copies, secrets, packing.

Each stage takes what the one before kept, as written and read back, and all but the
last return the columns of ``documents``; ``n_chars`` follows where a text changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reqsift.llm import language, lines, near, packing, secrets
from reqsift.llm.queries import WORD_TOKENIZER
from reqsift.workspace import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The documents with another text, and its length where they state one."""
    changed = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        same = F.col("text").isNull()
        changed = changed.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go, and only those
    where no document names a language."""
    model = language.fit(docs)
    if not model.languages:
        return docs.filter(language.with_letter(F.col("text")))
    known = language.predicted(F.col("text"), model)["lang_pred"] != language.UNKNOWN
    return docs.filter(known)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the three-line windows of earlier documents; texts that lose all lines go."""
    done = lines.remove_repeats(docs)
    left = F.col("lines_before") > lines.removed_count(F.col("lines_removed"))
    return _with_text(done.filter(left).select(*docs.columns), F.col("text"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of equal rows one (five words, 0.8)."""
    kept = near.components(docs, words=5, percent=80).filter("kept")
    ids = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    chosen = docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return chosen
    return chosen.dropDuplicates(["doc_id", "text"])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    model = secrets.fit(docs)
    text = F.col("text")
    return _with_text(docs, secrets.redacted(text, secrets.spans(text, model)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the documents that are left."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("repeated lines", without_repeats),
    ("near copies", without_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tagger; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def all_oracles() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
