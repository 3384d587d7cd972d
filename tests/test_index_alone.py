import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.operators import bm25, index
from passagework.plans import queries


@pytest.fixture()
def undrawn(monkeypatch, tmp_path):
    """A directory that no map was prepared of, and none can be."""

    def refused(*a, **more):
        raise AssertionError("links or categories are made for a query that reads none")

    monkeypatch.setattr(queries.links, "all_links", refused)
    monkeypatch.setattr(queries.facts, "categorize", refused)
    os.symlink("/root/testdata/sf0.001", tmp_path / "data")
    return str(tmp_path / "data")


@pytest.mark.parametrize("name", ["x03_shown_similar", "e13_slot_swap", "e19_gate"])
def test_a_query_that_reads_the_index_draws_no_links(spark, undrawn, name):
    assert queries.QUERIES[name](spark, undrawn).count() > 0


def test_packed_rows_give_every_bit_of_the_rows_one_by_one(spark):
    """Chunks by name, one of them indexed twice, weights with fractions, a share without rows."""
    docs = [(f"c{i % 45}", f"head w{i % 3}", f"same w{i % 7} w{i % 5} w{i % 5}") for i in range(50)]
    ix = index.build(spark.createDataFrame(docs, "id string, head string, body string"), "id", F.col("head"), F.col("body")).stored()
    asked = spark.createDataFrame([(q, f"same w{q} w{q + 1}") for q in range(6)], "query_id bigint, text string")
    told = bm25.query_phrases(asked)
    known = bm25.weights(ix, told)
    hits = bm25._hits_by_number(ix, known, 2.3, bm25._numbers(known)).cache()
    packed = bm25._packed(hits, 3).toArrow()
    assert len(packed) < hits.count() / 5
    pids = told.join(known.select("phrase", "pid"), "phrase").groupBy("query_id").agg(F.array_sort(F.collect_list("pid")).alias("pids"))
    pids = pids.withColumn("k", F.lit(9)).toArrow()
    worth = hits.select(bm25._share(F.lit(3)), "pid", "chunk_id", bm25._worth(F.col("f")).alias("worth"))
    for share in range(4):
        got = bm25._best_of_packed(packed.filter(pa.compute.equal(packed["share"], share)), pids)
        want = bm25._best_of_share(worth.where(F.col("share") == share).toArrow(), pids)
        assert got.to_pylist() == want.to_pylist() and (share == 3) == (not len(got))


def test_phrases_are_sent_to_the_postings(spark):
    """Postings aren't moved to meet few phrases; many phrases find the same."""
    docs = [(i, "map config", f"the map config w{i % 3} config map " * (i % 4)) for i in range(60)]
    ix = index.build(spark.createDataFrame(docs, "id bigint, head string, body string"), "id", F.col("head"), F.col("body")).stored()
    asked = spark.createDataFrame([(1, "map_config"), (2, "config_w1_config"), (3, "map_none"), (4, "config_map_the")], "query_id bigint, text string")
    phrases = bm25.query_phrases(asked).select("phrase", "terms")
    weight = lambda head, body: 2.0 * head + body
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (bm25._long_hits(ix, phrases, weight, several) for several in (4, bm25.PHRASES_SENT + 1))
        sent = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
        assert sent(few) >= 3 and not sent(many)
        rows = [sorted(map(tuple, df.collect())) for df in (few, many)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {"map config", "config w1 config", "config map the"}
    assert {(r[1], r[3]) for r in rows[0] if r[0] == "map config"} == {(i, 2.0 + i % 4) for i in range(60)}
