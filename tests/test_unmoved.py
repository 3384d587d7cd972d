"""What is large stays where it lies: texts do not move to meet paths, nor postings to meet the places of phrases."""

import pytest
from pyspark.sql import functions as F

from passagework.operators import bm25, index
from passagework.plans.corpus import from_directory

D = "/root/testdata/sf0.001"


@pytest.fixture()
def unhinted(spark):
    """Nothing is sent to all tasks unless the code says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list:
    return sorted(map(repr, df.collect()))


def test_texts_do_not_move_to_meet_few_paths(spark, unhinted, tmp_path, monkeypatch):
    c = from_directory(spark, D)
    c.chunks.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "chunks"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        spread = c.with_(chunks=spark.read.parquet(str(tmp_path / "chunks")))
        near = index.of_corpus(spread)
        monkeypatch.setattr(index, "FILES_SENT", 0)
        far = index.of_corpus(spread)
        assert "Exchange hashpartitioning" not in plan(near.postings) and "Exchange hashpartitioning" in plan(far.postings)
        assert rows(near.postings) == rows(far.postings) == rows(index.of_corpus(c).postings)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_texts_are_cut_once_for_an_index(spark, monkeypatch):
    """The statistics that are stored are those of the texts, which are not read for them again."""
    made, write = {}, index.materialize
    monkeypatch.setattr(index, "materialize", lambda df, label: write(made.setdefault(label, df), label))
    c = from_directory(spark, D)
    ix = index.of_corpus(c)
    assert ix.stored().stats.head() == ix.stats.head() and ix.stats.head().n == c.chunks.count()
    assert "heading_path" in plan(made["postings"]) and "heading_path" not in plan(made["stats"])


@pytest.mark.parametrize("docs", [[], [(1, "", ""), (2, None, None)], [(1, "a head", "one two two"), (1, "a head", "three"), (2, "", None), (3, "x", "")]])
def test_stored_statistics_are_those_of_the_texts(spark, docs):
    """Chunks without terms and keys that come twice count as before; without chunks there is no mean."""
    ix = index.build(spark.createDataFrame(docs, "id bigint, head string, body string"), "id", F.col("head"), F.col("body"))
    assert ix.stored().stats.collect() == ix.stats.collect() and ix.stored().stats.dtypes == ix.stats.dtypes


def test_postings_do_not_move_to_meet_few_places(spark, unhinted, monkeypatch):
    docs = [(i, "map config", f"the map config w{i % 3} config map " * (i % 4)) for i in range(60)]
    ix = index.build(spark.createDataFrame(docs, "id bigint, head string, body string"), "id", F.col("head"), F.col("body")).stored()
    phrases = bm25.query_phrases(spark.createDataFrame([(1, "map_config config_w1_config config_map_the")], "query_id bigint, text string")).select("phrase", "terms")
    weight = lambda head, body: 2.0 * head + body
    few = bm25._long_hits(ix, phrases, weight, 3)
    monkeypatch.setattr(bm25, "PLACES_SENT", 0)
    many = bm25._long_hits(ix, phrases, weight, 3)
    assert "SortMergeJoin" not in plan(few) and "SortMergeJoin" in plan(many)
    assert rows(few) == rows(many) and len({r.phrase for r in few.collect()}) == 3
