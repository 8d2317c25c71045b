"""A corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again.

Language ID drops documents without a language; line dedup cuts repeated lines and drops documents of which nothing
is left; the Jaccard join keeps the row of the smallest id of each group; mixing repeats or drops documents to
meet source weights; byte-level BPE turns texts into ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom.llm import bpe, jaccard, langid, linedup, mixing
from policyloom.llm.queries import ranks_path
from policyloom.runtime import stored

#: A document is rejected below this score; texts of a learned language reach several times as much.
LEAST_LANGUAGE_SCORE = 0.05


def _apart(docs: DataFrame) -> DataFrame:
    """The columns under names of their own, so that an operator's outputs replace none of them."""
    return docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})


def _back(made: DataFrame, columns: list[str]) -> DataFrame:
    return made.select(*[F.col(f"`in_{c}`").alias(c) for c in columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; texts that are null, without letters, or unlike every language, go. Rows are judged one by one."""
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    named = langid.identify(_apart(docs), model, "in_text")
    return _back(named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which only blank lines are left go, those without lines to remove stay as they are. n_chars counts what is left."""
    kept = linedup.dedupe_lines(_apart(docs), "in_doc_id", "in_text").where((F.col("n_removed") == 0) | F.col("in_text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("in_n_chars", F.length("in_text").cast("long"))
    return _back(kept, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked shingle sets: that of the smallest id, null ids last.

    Rows are judged one by one, so rows without an id or with a repeated id are copies only if their texts are.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "near-copy-rows")
    groups = jaccard.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    placed = groups.join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    first = placed.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row"))
    gone = stored(groups.select("__row").join(first, "__row", "left_anti"), "near-copies")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources have their target shares, in a random order; a null source is one of its own."""
    return _back(mixing.mix(_apart(docs), "in_doc_id", "in_source"), docs.columns)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document; a null text has none."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks_path()).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_text),
]

#: SQL cannot express the classifier; the tests compare run() with the stages called one by one, not with a second implementation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
