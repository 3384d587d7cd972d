import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.operators import bm25, explore, facts, index, widen
from passagework.plans import search as searching
from passagework.plans.corpus import Corpus

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def made(spark):
    """A small map with its index, and questions."""
    r = random.Random(3)
    types = ["Article", "SoftwareSourceCode", "Configuration"]
    said = lambda n: " ".join(r.choices(WORDS, weights=range(30, 0, -1), k=n))
    files = [(i, 1 + i % 2, f"docs/f{i}.md", types[i % 3], "markdown", 9, i) for i in range(40)]
    chunks = [(i, i // 3, 1 + i % 3, 1 + i % 3, "text", f"head {said(1)}", None, said(r.randint(3, 20))) for i in range(120)]
    c = Corpus(
        sources=spark.createDataFrame([(1, "a", "dir", True, "/", ""), (2, "b", "dir", True, "/", "")], "id bigint, name string, kind string, public boolean, root string, origin string"),
        files=spark.createDataFrame(files, "id bigint, source_id bigint, path string, type string, lang string, size bigint, mtime_ns bigint"),
        file_texts=None,
        chunks=spark.createDataFrame(chunks, "id bigint, file_id bigint, start_line int, end_line int, kind string, heading_path string, parent_id bigint, text string"),
        idents=spark.createDataFrame([(7, "w3", "defines")], "chunk_id bigint, ident string, role string"),
        refs=None,
        file_meta=None,
        mirror_items=None,
        links=spark.createDataFrame([(1, 5, "about", "x"), (2, 9, "about", "y")], "src bigint, dst bigint, rel string, via string"),
        categories=spark.createDataFrame([(i, ("Rule", "Record")[i % 2], 0.9, True, "m") for i in range(120)], "chunk_id bigint, category string, p double, kept boolean, model string"),
    )
    asked = spark.createDataFrame([(i, f"{said(2)} must {said(1)}_{said(1)}") for i in range(25)], "query_id bigint, text string")
    return c, index.of_corpus(c).stored(), asked


@pytest.fixture()
def unscored(monkeypatch):
    """Rows of every query and chunk must not be made: they grow with the product of both."""

    def refused(*a, **more):
        raise AssertionError("all scores of all queries")

    monkeypatch.setattr(bm25, "scores", refused)
    monkeypatch.setattr(bm25, "phrase_worth", refused)


def told(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows.collect())


@pytest.fixture(scope="module")
def every(made):
    return bm25.scores(made[1], made[2]).cache()


def test_three_arms_make_no_table_of_all_scores(made, every, unscored):
    c, ix, asked = made
    got = searching.three_arms(c, ix, asked, facts.CueJudge(), 7, 3).cache()
    assert told(got.where("arm = 'base'"), "query_id", "chunk_id", "seq") == told(bm25.top(every, 7), "query_id", "chunk_id", "bm25_rank")
    size = got.where("arm = 'facts'").groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    assert size.agg(F.max("size")).head()[0] > 7
    assert told(got.where("arm = 'control'"), "query_id", "chunk_id", "seq") == told(bm25.top(every.join(size, "query_id"), F.col("size")), "query_id", "chunk_id", "bm25_rank")


def test_best_inside_the_parts_of_a_query(spark, made, every, unscored):
    """A query may have several parts and a chunk too; small shares give what large ones give."""
    _, ix, asked = made
    parts = spark.createDataFrame([(i, p) for i in range(25) for p in {i % 4, i % 3}], "query_id bigint, part int")
    members = spark.createDataFrame([(i, p) for i in range(120) for p in {i % 4, i % 5}], "chunk_id bigint, part int")
    inside = parts.join(members, "part").select("query_id", "chunk_id").distinct()
    want = told(bm25.top(every.join(inside, ["query_id", "chunk_id"], "left_semi"), 6), "query_id", "chunk_id", "score", "bm25_rank")
    with pytest.MonkeyPatch.context() as m:
        for rows in (3_000_000, 200):
            m.setattr(bm25, "ROWS_AT_ONCE", rows)
            assert told(bm25.best(ix, bm25.query_phrases(asked), 6, parts, members), "query_id", "chunk_id", "score", "bm25_rank") == want


def _near(made, words, own, most):
    """Neighbours by all scores."""
    c, ix, _ = made
    asked = words.select("query_id", F.col("term").alias("phrase"), F.array("term").alias("terms"))
    found = asked.join(bm25.phrase_worth(ix, asked), "phrase").groupBy("query_id", "chunk_id").agg(F.round(F.sum("worth"), bm25.PLACES).alias("score"))
    other = bm25.top(found, 50).join(c.chunks.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id").join(own, ["query_id", "file_id"], "left_anti")
    return other.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("bm25_rank"))).where(F.col("rank") <= most)


def test_neighbours_make_no_table_of_all_scores(made, request):
    c, ix, _ = made
    some = c.chunks.where("id % 4 = 0").select(F.col("id").alias("query_id"), "text", "file_id")
    want = told(_near(made, widen.distinctive_words(ix, some), some.select("query_id", "file_id"), 10), "query_id", "chunk_id", "rank")
    request.getfixturevalue("unscored")
    assert told(widen.neighbours(c, ix, some.select(F.col("query_id").alias("chunk_id"))), "seed", "chunk_id", "rank") == want


def test_arms_make_no_table_of_all_scores(made, every, unscored):
    c, ix, asked = made
    got = widen.arms(c, ix, asked, 4).cache()
    assert told(got.where("arm = 'base'"), "query_id", "chunk_id", "seq") == told(bm25.top(every, 4), "query_id", "chunk_id", "bm25_rank")
    for arm in ("all", "code+sym"):
        size = got.where(F.col("arm") == arm).groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
        assert told(got.where(F.col("arm") == f"ctl-{arm}"), "query_id", "chunk_id", "seq") == told(bm25.top(every.join(size, "query_id"), F.col("size")), "query_id", "chunk_id", "bm25_rank")
    typed = every.join(c.placed().select("chunk_id", "type"), "chunk_id")
    best = typed.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "chunk_id"))).where("k <= 4")
    assert told(got.where("arm = 'all'").select("query_id", "chunk_id"), "query_id", "chunk_id") == told(best.select("query_id", "chunk_id").union(bm25.top(every, 4).select("query_id", "chunk_id")).distinct(), "query_id", "chunk_id")


def test_candidates_make_no_table_of_all_scores(made, unscored):
    c, ix, _ = made
    got = facts.candidates(c, ix, 8).cache()
    where = {r.id: r.file_id for r in c.chunks.select("id", "file_id").collect()}
    assert got.count() > 100
    for r in got.collect():
        assert where[r.a] != where[r.b] and where[r.a] % 2 == where[r.b] % 2 and (r.a - r.b) % 2 and 1 <= r["rank"] <= 8


def test_shown_similar_makes_no_table_of_all_scores(made, request):
    c, ix, _ = made
    shown = c.chunks.where("id % 5 < 2").select(F.concat(F.lit("t"), F.floor(F.col("id") / 5)).alias("target"), F.col("id").alias("chunk_id"), "start_line", "file_id")
    texts = shown.join(c.chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id").groupBy(F.col("target").alias("query_id")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    own = shown.select(F.col("target").alias("query_id"), "file_id").distinct()
    want = told(_near(made, widen.distinctive_words(ix, texts), own, 3), "query_id", "rank", "chunk_id")
    request.getfixturevalue("unscored")
    assert told(explore.shown_similar(c, ix, shown), "target", "place", "other") == want


def test_search_makes_no_table_of_all_scores(made, request):
    _, ix, asked = made
    want = told(bm25.top(bm25.scores(ix, asked, head_weight=3.0), 12), "query_id", "chunk_id", "score", "bm25_rank")
    request.getfixturevalue("unscored")
    assert told(bm25.search(ix, asked, 12, head_weight=3.0), "query_id", "chunk_id", "score", "bm25_rank") == want


def test_spare_hits_come_from_shares_of_any_size(spark, unscored):
    """Ties, a chunk indexed twice, and fewer hits than are asked for, in one share or in many."""
    docs = [(i % 90, "h", "same words here" if i % 2 else f"same w{i % 7}") for i in range(100)]
    ix = index.build(spark.createDataFrame(docs, "id bigint, head string, body string"), "id", F.col("head"), F.col("body")).stored()
    asked = spark.createDataFrame([(1, "same"), (2, "w3 here"), (3, "w5"), (4, "none")], "query_id bigint, text string")
    runs = []
    with pytest.MonkeyPatch.context() as m:
        for rows in (3_000_000, 100):
            m.setattr(bm25, "ROWS_AT_ONCE", rows)
            runs.append(told(bm25.search(ix, asked, 30), "query_id", "bm25_rank", "chunk_id", "score"))
    assert runs[0] == runs[1] and [sum(r[0] == q for r in runs[0]) for q in (1, 2, 3, 4)] == [30, 30, 7, 0]
    first = [r[2] for r in runs[0] if r[0] == 1]
    assert len(set(first)) == 30


def test_first_places_of_two_weightings_make_no_table_of_all_scores(made, every, request):
    _, ix, asked = made
    want = [told(bm25.top(rows, 1), "query_id", "chunk_id") for rows in (every, bm25.scores(ix, asked, head_weight=3.0))]
    request.getfixturevalue("unscored")
    assert [told(widen.seeds(ix, asked, 1, **more), "query_id", "chunk_id") for more in ({}, {"head_weight": 3.0})] == want
