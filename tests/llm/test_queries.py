"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import brute
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from odflow.llm import queries, toxicity
from odflow.llm.oracle import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(SQL[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()))
    assert rows == sorted(want.select(*columns).fetchall())


def test_pipeline(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert docs.count() <= before.count()
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in packed} == set(kept)
    brute.check_packing((r.sequence_id, r.offset, r.length) for r in packed)
    groups = brute.near_duplicates(list(kept.items()), 5, 80, 100)
    assert all(alone for _, _, alone in groups.values())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(bad for *_, bad in brute.decontaminate(list(kept.items()), items).values())


CLASHING = ["_line_id", "_Line_Places", "_kept_id", "_cleaned", "_toxicity", "_benchmark_hits", "_row", "_scores", "key", "text_"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})
    rows = stage(spark, more, SF).collect()
    own = docs.columns
    assert sorted(r[:len(own)] for r in rows) == sorted(map(tuple, stage(spark, docs, SF).collect()))
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)


def test_words_joined_beside_columns_of_any_name(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.withColumns({c: F.lit(c) for c in CLASHING})
    model = toxicity.fit(docs, labels)
    want = {r.doc_id for r in toxicity.without_toxic(docs, model).select("doc_id").collect()}
    monkeypatch.setattr(toxicity, "MAX_UNITS", 0)
    joined = toxicity.fit(docs, labels)
    assert not isinstance(joined.units, dict) and joined.weights == pytest.approx(model.weights)
    got = toxicity.without_toxic(more, joined)
    assert got.columns == more.columns
    assert {r.doc_id for r in got.select("doc_id").collect()} == want


def test_pipeline_of_no_documents(spark, tmp_path):
    for table in ("documents", "benchmark", "labels"):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        (rows.limit(0) if table == "documents" else rows).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
