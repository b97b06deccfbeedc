"""Queries p3, p6, p8, p9 and p10 over whole tables, with their SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import decode_ids, encode_corpus
from gridloom.llm.langid import fit_profiles, identify, relabelled, segments
from gridloom.llm.leaks import find_leaks
from gridloom.llm.nearest import nearest_within
from gridloom.llm.topn import top_n

TOKENIZERS = os.environ.get("GRIDLOOM_TOKENIZERS", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best symbols of each t_obs with score and rank."""
    return top_n(_read(spark, sf_dir, "oof_book_inputs"), "t_obs", "symbol", "score", 5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_ranked(spark, sf_dir).select("t_obs", "symbol")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _read(spark, sf_dir, "perp_klines").filter("close is not null and not isnan(close)")
    return nearest_within(_read(spark, sf_dir, "decision_grid_8h"), "symbol", "t_obs", bars, "symbol", "close_time", 300_000)


def p8_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return encode_corpus(_read(spark, sf_dir, "documents"), "doc_id", "text", f"{tokenizers}/byte_bpe_50k.tiktoken")


def p8_round_trip(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents with a text whose ids decode to the text again, and their tokens, by language label."""
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode_ids(encode_corpus(docs, "doc_id", "text", path), "ids", path, "back")
    same = docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"), F.size("ids").alias("tokens"))
    return same.groupBy("same").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "heldout_items"), "item_id", "text").select("doc_id", "item_id")


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every document with words, with confidence."""
    out = identify(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang", fit_profiles(_read(spark, sf_dir, "lang_samples"), "lang", "text"))
    return out.withColumn("confidence", F.round("confidence", 6))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabelled(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang", fit_profiles(_read(spark, sf_dir, "lang_samples"), "lang", "text")).select("doc_id", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every document with words: place, language, confidence and sentences."""
    out = segments(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang", fit_profiles(_read(spark, sf_dir, "lang_samples"), "lang", "text"))
    return out.withColumn("confidence", F.round("confidence", 6))


QUERIES = {"p3_found": p3_found, "p3_ranked": p3_ranked, "p6_found": p6_found, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p10_found": p10_found, "p10_languages": p10_languages, "p10_segments": p10_segments}

_P3 = """
with b as (select t_obs, symbol, max(0.0 + score) as score from oof_book_inputs where t_obs is not null and symbol is not null and score is not null and not isnan(score) group by all),
r as (select *, row_number() over (partition by t_obs order by score desc, symbol) as rank from b)
"""

ORACLE = {
    "p3_found": _P3 + "select t_obs, symbol from r where rank <= 5",
    "p3_ranked": _P3 + "select t_obs, symbol, score, cast(rank as int) as rank from r where rank <= 5",
    "p6_found": """
with l as (select distinct symbol, t_obs from decision_grid_8h where symbol is not null and t_obs is not null),
r as (select distinct symbol, close_time from perp_klines where close is not null and not isnan(close) and close_time is not null),
j as (select l.symbol, l.t_obs, r.close_time, row_number() over (partition by l.symbol, l.t_obs order by abs(r.close_time - l.t_obs), r.close_time) as rn
  from l join r on r.symbol = l.symbol and r.close_time between l.t_obs - 300000 and l.t_obs + 300000)
select symbol, t_obs, close_time from j where rn = 1
""",
}
