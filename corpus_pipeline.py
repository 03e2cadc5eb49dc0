"""Corpus pipeline: from raw documents to the tokens of those that are worth keeping.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept,
and returns a DataFrame; between stages the rows are written as Parquet in the
shared folder and read again. All but the last return the columns of documents; other
columns, whatever their names, are left out. In every stage texts of any length
count whole, a null or empty text or a null in any other column is no reason to go,
except that the classifier judges empty texts too, and an empty table gives an empty
table. Repeated rows of an id are judged alike: where one stays, all stay, but for
lines that a row before them has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, ngram_join, quality, queries, sentencepiece_codec
from tidemark.llm.common import Cuts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose quality score is under 0.5; the rest pass unchanged.

    A null text is scored as an empty one. Repeated rows have one score."""
    scored = quality.score(docs.select(*COLUMNS), queries.quality_model(spark, sf_dir), name="__score")
    return scored.filter(F.col("__score") >= 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document or line has, or has but for one edit.

    n_chars follows the text. A document that had a line with other than blanks and
    keeps none is a copy of what stays elsewhere and goes, a repeated row of long lines among
    them. Null and empty texts have no lines and stay; lines of under 20 characters stay."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    empty = F.regexp_replace("text", r"\s", "") == ""
    out = out.filter(~((F.col("n_dropped") > 0) & empty))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their 5-word shingles the one with the smallest id stays, with
    all rows of that id. Texts without words and rows with a null id link with nothing and stay."""
    groups = ngram_join.ngram_components(docs.select("doc_id", "text"), n=5, percent=75)
    copies = groups.filter("doc_id != component_id").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(copies, F.col("doc_id") == F.col("__copy"), "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more stands in the benchmark. Texts without
    words stay; each row is judged by itself, so repeated rows and null ids need no care."""
    found = decontaminate.find_overlap(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"), queries.WINDOW)
    return found.filter(~decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of tokens and the digests of its ids and of the decoded text; null is
    encoded as empty: no tokens, digests of the empty string. Rows neither merge nor go."""
    coded = sentencepiece_codec.encode_frame(docs.select(*COLUMNS), queries.PIECE_MODEL, keep_text=False)
    return coded.select(
        "doc_id", "lang", "source", "n_chars",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    cuts, docs = Cuts(spark), queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cuts.cut(stage(spark, docs, sf_dir))
        if k:
            cuts.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
