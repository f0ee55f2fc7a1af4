"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reqsift.llm import (
    graph, language, licences, lines, mixing, near, negatives, oracles, packing, pieces, quality, secrets, suffixes,
    whitening,
)
from reqsift.llm.common import fold, table, whole_text

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in folders by source, language and thousands of their ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000"), "doc_id")
    return licences.scan(docs.select("doc_id", path.alias("path"), "text"), file=0.2)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, decoded=True)
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def _listed(spans: Column) -> Column:
    named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(named, ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.fit(docs)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), secrets.spans(F.col("text"), model).alias("all")
    )

    def number(kind: str) -> Column:
        of_kind = F.filter("all", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    base = F.filter("all", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *map(number, secrets.KINDS[:3]),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
    )


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.components(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.remove_repeats(table(spark, sf_dir, "documents"))
    runs = F.transform("lines_removed", lambda r: F.concat(r["first"], F.lit("-"), r["last"]))
    return done.select(
        "doc_id",
        F.col("lines_before").alias("n_lines"),
        lines.removed_count(F.col("lines_removed")).alias("n_removed"),
        F.array_join(runs, ",").alias("removed"),
        F.sha2(whole_text(F.col("text")).cast("binary"), 256).alias("text_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold(F.col("doc_id"), 5) != 0))
    guess = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        language.predicted(F.col("text"), model).alias("guess"),
    )
    return guess.select("doc_id", "held_out", "guess.lang_pred", "guess.score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return graph.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=4)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id bears the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = rows.select("vec_id", moved.alias("label"), "embedding")
    return negatives.mined(rows, rows.filter(F.col("vec_id") % 50 == 0))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_licences,
        op2_pieces, op3_secrets, op4_near, op5_lines, op6_packing, op7_mixing, op8_language, op9_neighbours,
        op10_quality, op11_whitening, op12_suffixes, op13_negatives,
    ]
    return {f.__name__: f for f in named}


def all_oracles() -> dict[str, str]:
    return {
        "op1_licences": oracles.OP1_LICENCES,
        "op4_near": oracles.OP4_NEAR,
        "op5_lines": oracles.OP5_LINES,
        "op10_quality": oracles.OP10_QUALITY,
        "op12_suffixes": oracles.OP12_SUFFIXES,
        "op13_negatives": oracles.OP13_NEGATIVES,
    }
