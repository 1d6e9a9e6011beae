"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.llm.mixing import mix_sources
from grafloom.llm.quality import text_statistics
from grafloom.llm.tokenizer import encode_corpus
from grafloom.llm.topn import top_items
from grafloom.plans.runtime import table

#: Best distinct targets per search.
TOP = 5


def p1_best(spark: SparkSession, sf: str) -> DataFrame:
    return top_items(table(spark, sf, "graphrag_result"), "search_id", "target_node_id", "score", "depth", TOP)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_best(spark, sf).select("search_id", "target_node_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = encode_corpus(table(spark, sf, "documents").select("doc_id", "source", "text").where("source is not null"), "text", ids=None, count="size")
    targets = table(spark, sf, "mix_target").selectExpr("source", "target_share as share", "repeat_cap as cap")
    return mix_sources(docs.select(F.col("doc_id").alias("id"), "source", "size"), targets)


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def _quality(spark: SparkSession, sf: str, failing: bool) -> DataFrame:
    # common_word is a fixed table of 96 rows
    common = [r["word"] for r in table(spark, sf, "common_word").where("word is not null").select("word").distinct().orderBy("word").collect()]
    return text_statistics(table(spark, sf, "documents"), "doc_id", "text", common, failing)


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, False)


def p8_words(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that SQL can express."""
    df = p8_statistics(spark, sf).select("doc_id", "words", "mean_word_length", "common_share")
    return df.withColumns({c: F.round(c, 6) for c in ("mean_word_length", "common_share")})


def p8_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that break published rules and prove to be no prose, with the reasons."""
    return _quality(spark, sf, True).where(F.size("no_prose") > 0).select("doc_id", "published", "no_prose")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_reasons(spark, sf).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_best, p6_ids, p7_mixture, p7_shares, p8_found, p8_reasons, p8_words, p8_statistics)}

_BEST = """
with best as (
  select search_id, target_node_id, score + 0.0 as score, depth, row_number() over (partition by search_id, target_node_id order by score + 0.0 desc, depth asc nulls last) n
  from graphrag_result where search_id is not null and target_node_id is not null and score is not null and not isnan(score)),
ranked as (select *, row_number() over (partition by search_id order by score desc, depth asc nulls last, encode(target_node_id)) :: int as "rank" from best where n = 1)
"""

_WORDS = """
with w as (select doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}\\x{00ad}]', '', 'g')), '[\\p{L}\\p{M}]+') ws from documents)
select doc_id, len(ws) :: int words, case when len(ws) = 0 then 0 else round(length(array_to_string(ws, '')) / len(ws), 6) end :: double mean_word_length,
  case when len(ws) = 0 then 0 else round(len(list_filter(ws, lambda x: list_contains(l, regexp_replace(x, '\u03c3$', '\u03c2')))) / len(ws), 6) end :: double common_share from w, (select list(distinct word) l from common_word where word is not null)
"""

SQL = {
    "p8_words": _WORDS,
    "p1_found": _BEST + f'select search_id, target_node_id from ranked where "rank" <= {TOP}',
    "p1_best": _BEST + f'select search_id, target_node_id, score, depth, "rank" from ranked where "rank" <= {TOP}',
}
