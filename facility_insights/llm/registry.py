"""Queries over the given tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from facility_insights.llm import bpe, chat, decontaminate, language, lexical, lines, packing, quality, simhash, sql, substring, toxicity, whitening, wrapper

#: The contract's extra conversation.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, most=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), path=public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return packing.digest(pieces)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_turns(given.unionByName(spark.createDataFrame(EXTRA, given.schema))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13, share=20))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "pages"), language.fit(_read(spark, sf_dir, "documents")))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), every_end=True)


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(_read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=50)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings")
    return whitening.whiten(table, whitening.fit(table, components=4))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(_read(spark, sf_dir, "documents"), path=path, pattern=public_tokenizers.PATTERN), path=path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_packing,
        op3_chat,
        op4_toxicity,
        op5_decontamination,
        op6_language,
        op7_substring,
        op8_wrapper,
        op9_quality,
        op10_lines,
        op11_lexical,
        op12_whitening,
        op13_bpe,
    )
}
ORACLE: dict[str, str] = sql.ORACLE
