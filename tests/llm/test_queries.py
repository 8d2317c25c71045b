"""The registered queries on the small tables, and the pipeline against its stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from policyloom.llm import queries
from tests.test_catalog import TABLES, plain

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(con.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op11_binpack_compaction"}))
def test_query_covers_its_table(spark, name):
    made = queries.QUERIES[name](spark, DATA)
    base = "embeddings" if name.startswith("op1_") else "documents"
    assert made.count() == spark.read.parquet(f"{DATA}/{base}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.keep_languages(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    lines = corpus_pipeline.drop_repeated_lines(spark, kept, DATA).cache()
    assert lines.columns == docs.columns and lines.where("length(text) <> n_chars").count() == 0
    single = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    groups = queries.QUERIES["op8_jaccard_join"](spark, DATA)
    assert {r.doc_id for r in single.select("doc_id").collect()} == {r.component_id for r in groups.collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert mixed.columns == docs.columns and mixed.join(docs, docs.columns, "left_anti").count() == 0
    final = corpus_pipeline.run(spark, DATA)
    assert final.count() > 0 and final.where("n_tokens is null or token_ids is null").count() == 0


def test_near_copies_are_dropped_by_row(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["a"]), (4, text["b"]), (5, text["b"]), (5, text["c"]), (7, text["d"]), (7, text["d"]), (None, text["d"]), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()
    expected = [(None, text["a"]), (4, text["b"]), (5, text["c"]), (7, text["d"]), (9, None), (9, None)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
    rows = lambda df: sorted((r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.token_ids)) for r in df.collect())
    expected = rows(docs)
    assert expected and rows(corpus_pipeline.run(spark, DATA)) == expected


def test_stages_keep_columns_nulls_and_repeats(spark):
    text = "Ein Satz aus vielen Worten steht hier allein und wird nicht wiederholt."
    rows = [(1, text, "de", "a", 9, "mine", "x"), (1, text + " Noch einer.", "de", None, 9, None, "x"), (None, text + " Und noch ein ganz anderer Satz.", "de", "a", 9, "mine", "y"), (3, None, "de", "a", 0, "m", "z"), (4, "", None, "b", 0, "m", "z"), (5, "77 !", "de", "b", 0, "m", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed string, copy_no string")
    kept = corpus_pipeline.keep_languages(spark, spark.read.parquet(f"{DATA}/documents.parquet").select(*docs.columns[:5]), DATA)
    assert kept.count() > 0
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, DATA)
    assert lines.columns == docs.columns and sorted((r.doc_id or 0, r.n_removed or "", r.copy_no) for r in lines.collect()) == sorted((r[0] or 0, r[5] or "", r[6]) for r in rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    assert mixed and {(r.doc_id, r.source, r.n_removed, r.copy_no) for r in mixed} <= {(r[0], r[3], r[5], r[6]) for r in rows}
    ids = corpus_pipeline.encode_text(spark, docs, DATA).collect()
    assert len(ids) == len(rows) and sorted(r.n_tokens == 0 for r in ids) == [False] * 4 + [True] * 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
