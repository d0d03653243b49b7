import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle import compare, connect
from texts import DOCS

from barwright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    verdict, rows, _, _ = compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name])
    assert verdict.startswith("equal") and rows


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries().keys()
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} and {*queries.QUERIES, "pipeline"} <= names


def test_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert rows.columns == docs.columns
        now = {r.doc_id: r.text for r in rows.collect()}
        assert len(now) == rows.count() and now.keys() <= kept.keys()
        if name == "quality_classifier":
            assert all(now[i] == kept[i] for i in now) and len(now) > 0.5 * len(kept)
            bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
            assert len(bad & now.keys()) <= 0.3 * len(bad)
        elif name == "near_dedup":
            texts = [" ".join(now[i].lower().split()) for i in now if now[i].split()]
            assert len(set(texts)) == len(texts) and all(now[i] == kept[i] for i in now)
        else:
            assert now.keys() == kept.keys()
        docs, kept = rows, now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == kept.keys()
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    digest = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(whole) == digest(pieces)


def test_stages_on_an_empty_table_and_on_edge_rows(spark, tmp_path, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, None, None, None, None), (1, None, None, None, None), (1, "", None, None, None), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5),
            (3, 'token = "' + hashlib.sha1(b"x").hexdigest() + '"', None, None, None)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, DOCS)
        assert docs.schema.names == schema.names
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() >= 0
