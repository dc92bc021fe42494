"""The pipeline's stages keep their contracts, and queries with SQL match it."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == columns and [f.dataType for f in seen.schema] == [f.dataType for f in docs.schema], name
        seen = seen.cache()
        counts.append(seen.count())
    assert counts[1] <= counts[0] and counts[3] <= counts[2] <= counts[1]
    assert corpus_pipeline.run(spark, SF).count() == counts[4]


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    gone = docs.join(kept.select("doc_id"), "doc_id", "left_anti").filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}{3,}.*\p{L}{3,}"))
    assert gone.count() <= 0.02 * docs.count()


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 1), (2, "the and of\n" * 5, "en", "a", 50, 1), (2, "the and of\n" * 5, "en", "a", 50, 1), (3, "der die das und ist\nzu\nden", "de", None, 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    seen = docs
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, SF)
    seen.collect()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    rows = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    names = sorted(rows.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows.select(*names).collect())
