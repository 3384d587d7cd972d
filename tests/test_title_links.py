from passagework.operators import links
from passagework.plans import queries


def drawn(spark, pages, **more):
    passages = spark.createDataFrame([(i, text) for i, _, text in pages], "page_id bigint, text string")
    titles = spark.createDataFrame([(i, title) for i, title, _ in pages], "page_id bigint, title string")
    return {(r.page_id, r.target, r.title, r.start) for r in links.drawn_titles(passages, titles, **more).collect()}


def test_titles_of_any_length_are_drawn_whole(spark):
    seven = "The Night Run That Copies All Ledgers"
    forty = " ".join(f"Word{i}" for i in range(40))
    pages = [
        (1, "Alpha Beta Gamma", f"see the night run that copies all ledgers, then {forty}."),
        (2, seven, "Alpha beta delta, alpha, and Solo"),
        (3, forty, "the night run that copies all"),
        (4, "Alpha Beta Delta", "ends with alpha beta"),
        (5, "Solo", ""),
    ]
    assert drawn(spark, pages) == {(1, 2, seven, 1), (1, 3, forty, 9), (2, 4, "Alpha Beta Delta", 0), (2, 5, "Solo", 5)}


def test_the_longest_title_and_the_first_mention_hold(spark):
    pages = [(1, "Own Page", "x Red Blue Green, red blue, red blue green"), (2, "Red Blue", "red blue"), (3, "Red Blue Green", "own page")]
    assert drawn(spark, pages) == {(1, 3, "Red Blue Green", 1), (1, 2, "Red Blue", 4), (3, 1, "Own Page", 0)}
    assert drawn(spark, pages, most_pages=0) == set()


def test_a_page_does_not_name_its_own_title(spark):
    pages = [(1, "Same Old Title", "Same old title"), (2, "Same Old Title", "Same old title"), (3, "Old Title", "the same old title")]
    assert drawn(spark, pages) == {(1, 3, "Old Title", 1), (2, 3, "Old Title", 1), (3, 2, "Same Old Title", 1)}


def test_the_query_keeps_whole_titles(spark, tmp_path):
    rows = [(1, "page", "# Full Grammar Meter\n\ntext"), (2, "page", "# Full Grammar Banner\n\nas the full grammar meter says"), (3, "page", "# Other Page Here\n\nfull grammar alone")]
    spark.createDataFrame(rows, "doc_id bigint, doc_type string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.page_id, r.target, r.title, r.start) for r in queries.s42_title_links(spark, str(tmp_path)).collect()} == {(2, 1, "Full Grammar Meter", 5)}
