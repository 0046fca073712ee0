"""Stages of the pipeline: each applies one operator to the documents that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.decontaminate import contaminated
from plumbline.llm.language_id import UNKNOWN, fit, held_out, predict
from plumbline.llm.mixing import mix
from plumbline.llm.simhash import simhash_components
from plumbline.llm.token_files import token_files
from plumbline.session import read_table


def row_key() -> Column:
    """Names a row by its id and text, so rows that repeat an id with another text, and rows without an id, are told apart.

    64 bits: of ten billion rows a pair or two may share a name.
    """
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def named(docs: DataFrame) -> DataFrame:
    """Ids and texts for an operator, with the rows' names as ids."""
    return docs.select(row_key().alias("doc_id"), "text")


def listed_rows(docs: DataFrame, keys: DataFrame, purpose: str, how: str) -> DataFrame:
    """Documents whose name is (left_semi) or is not (left_anti) listed. The list grows with them, so they are joined one way at every size."""
    listed = written(keys.select(F.col("doc_id").alias("listed_key")).distinct(), purpose)
    return docs.join(listed.hint("merge"), row_key() == F.col("listed_key"), how)


def one_row_per_key(docs: DataFrame) -> DataFrame:
    """Rows that are equal in id and text fold to the greatest of them; all others pass untouched."""
    repeated = written(docs.groupBy(row_key().alias("repeated_key")).count().where("count > 1").select("repeated_key"), "repeated")
    matches = row_key() == F.col("repeated_key")
    row = F.max(F.struct(*[F.col(c) for c in docs.columns])).alias("row")
    folded = docs.join(repeated, matches, "left_semi").groupBy(row_key().alias("folded_key")).agg(row).select("row.*")
    return docs.join(repeated, matches, "left_anti").unionByName(folded)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: that with the smallest id, rows without an id last, then by name.

    Unlike texts stay even where they share an id; rows equal in id and text are one document.
    """
    ids = docs.groupBy(row_key().alias("row_key")).agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    found = simhash_components(named(docs)).groupBy(F.col("doc_id").alias("row_key")).agg(F.min("component_id").alias("component"))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row_key"))["row_key"].alias("doc_id")
    return one_row_per_key(listed_rows(docs, ids.join(found, "row_key").groupBy("component").agg(first), "kept", "left_semi"))


#: Least share of a text's n-grams that its language must explain.
EXPLAINED = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised: not ``und``, and with enough of the n-grams explained."""
    learn = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("doc_id").isNotNull())
    found = predict(docs, fit(learn))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= EXPLAINED)).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with or without an id."""
    return listed_rows(docs, contaminated(named(docs), read_table(spark, sf_dir, "benchmark")), "contaminated", "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: a document of a small source may come several times or, of a large one, not."""
    return mix(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files of the mixture and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    return token_files(docs)
