"""Queries over the test tables, one or more for each operator of the engine.

A map is prepared once a session and directory: its index and links are written
to the shared folder, as a synced map would hold them. Queries that read no links
or categories are given the index alone.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions import fixed, text
from passagework.functions.words import SPACE
from passagework.operators import bm25, chunking, evaluation, explore, facts, index, links, naming, rank, sync, widen
from passagework.operators.scope import Scope, scope_types
from passagework.plans import search as searching
from passagework.plans.corpus import Corpus, from_directory
from passagework.session import materialize
from passagework.sources import files as file_source
from passagework.sources import objects
from passagework.sources.tables import table


def _parent_refs(c: Corpus) -> DataFrame:
    """A link of each section to the heading above it, as a text would write it."""
    parents = c.chunks.select(F.col("id").alias("parent_id"), F.col("anchor").alias("target_anchor"), F.col("file_id").alias("parent_file"))
    paths = c.files.select(F.col("id").alias("parent_file"), F.col("path").alias("target_path"))
    return c.chunks.where("parent_id is not null").select(F.col("id").alias("chunk_id"), "parent_id").join(parents, "parent_id").join(paths, "parent_file").select("chunk_id", "target_path", "target_anchor")


def _item_refs(c: Corpus) -> DataFrame:
    """A link of each mirrored file's first chunk to the next item of its source, by URL."""
    following = c.mirror_items.select("source_id", "path", F.lead("url").over(Window.partitionBy("source_id").orderBy("item_id")).alias("target_path")).where("target_path <> ''")
    first = c.chunks.groupBy("file_id").agg(F.min_by("id", F.struct("start_line", "id")).alias("chunk_id"))
    held = c.files.select(F.col("id").alias("file_id"), "source_id", "path").join(following, ["source_id", "path"]).join(first, "file_id")
    return held.select("chunk_id", "target_path", F.lit("").alias("target_anchor"))


@cache
def _indexed(app: str, d: str) -> tuple[Corpus, index.Index]:
    c = from_directory(SparkSession.active(), d)
    return c, index.of_corpus(c).stored()


def indexed(spark: SparkSession, d: str) -> tuple[Corpus, index.Index]:
    """The tables of the directory and their index, for queries that ask for no links or categories: none are drawn or written."""
    return _indexed(spark.sparkContext.applicationId, d)


@cache
def _prepared(app: str, d: str) -> tuple[Corpus, index.Index]:
    c, ix = _indexed(app, d)
    # The texts of the test tables write no links; the queries are given some, beside those that texts write.
    c = c.with_(refs=c.refs.unionByName(_parent_refs(c)).unionByName(_item_refs(c)))
    c = c.with_(idents=materialize(c.idents, "idents"), refs=materialize(c.refs, "refs"), file_meta=materialize(c.file_meta, "meta"))
    c = c.with_(links=materialize(links.all_links(c), "links"))
    categories, _ = facts.categorize(c, facts.CueJudge())
    return c.with_(categories=materialize(categories, "categories")), ix


def prepared(spark: SparkSession, d: str) -> tuple[Corpus, index.Index]:
    return _prepared(spark.sparkContext.applicationId, d)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bench_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def known_items(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Questions that are a chunk's last heading (every twentieth id), and where that chunk is."""
    some = c.chunks.where("id % 20 = 0 and heading_path <> ''")
    asked = some.select(F.col("id").alias("query_id"), F.element_at(F.split("heading_path", " > "), -1).alias("text"))
    gold = c.placed().join(asked.select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "chunk_id", "source", "path", "start_line", "end_line")
    return materialize(asked, "questions"), materialize(gold, "gold")


def _placed_hits(c: Corpus, hits: DataFrame) -> DataFrame:
    return hits.join(c.placed().select("chunk_id", "source", "path", "start_line", "end_line"), "chunk_id")


def _score6(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


# ---- text functions


def f19_document_types(spark, d):
    files = table(spark, d, "file_scans").select("path").distinct()
    lang = text.effective_language(F.col("path"))
    return files.select("path", text.language(F.col("path")).alias("suffix_lang"), lang.alias("lang"), text.document_type(F.col("path"), lang).alias("type"))


def c07_names(spark, d):
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.explode(text.names_in(F.col("text"))).alias("name"))


def c10_slugs(spark, d):
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), text.slug(F.element_at(F.split("heading_path", " > "), -1)).alias("slug"))


def c09_link_targets(spark, d):
    """The links of every file's text, with some put behind it: the texts of the test tables write none."""
    texts = table(spark, d, "file_texts").join(table(spark, d, "files").select(F.col("id").alias("file_id"), "path"), "file_id")
    n = F.char_length(F.coalesce("text", F.lit("")))
    some = F.concat(F.lit("\n\nSee [a](../up/b.md#S"), n, F.lit(") and [b](./c.md) and [w](https://h.example/x"), F.col("file_id"), F.lit(") ![i](img.png \"t\") [m](mailto:x) [h](#here)"))
    rows = texts.select("file_id", F.explode(text.link_targets(F.concat(F.coalesce("text", F.lit("")), some), F.col("path"))).alias("r"))
    return rows.select("file_id", "r.target_path", "r.target_anchor")


def f21_snippets(spark, d):
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), text.snippet(F.col("text")).alias("snippet"))


def s11_sizes(spark, d):
    return table(spark, d, "files").select(F.col("id").alias("file_id"), text.size_text(F.col("size")).alias("size"))


def s10_defined_names(spark, d):
    """Names that files say they define, in a comment put ahead of each file's text: those its chunks define."""
    c, _ = prepared(spark, d)
    plain = c.idents.where("role = 'defines'").where(~F.col("ident").rlike(r"\s") & ~F.contains("ident", F.lit("-->")))
    names = plain.join(c.chunks.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id").groupBy("file_id").agg(F.array_join(F.collect_set("ident"), " ").alias("names"))
    told = c.file_texts.join(names, "file_id").select("file_id", F.concat(F.lit("# T\n<!-- defines: "), "names", F.lit(" -->\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return told.select("file_id", F.explode(text.defined_names(F.col("text"))).alias("name"))


def b03_terms(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(text.terms(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


# ---- index and BM25


def b04_vocabulary(spark, d):
    return prepared(spark, d)[1].vocabulary()


def b00_index(spark, d):
    c = from_directory(spark, d)
    return index.of_corpus(c).postings.select("chunk_id", "len", "term", "head_tf", "body_tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def b01_query_phrases(spark, d):
    return bm25.query_phrases(questions(spark, d), phrases=True).select("query_id", "phrase")


def b02_bm25(spark, d):
    return _score6(bm25.search(prepared(spark, d)[1], questions(spark, d), fixed.POOL))


def b02_bm25_phrases(spark, d):
    return _score6(bm25.search(prepared(spark, d)[1], questions(spark, d), fixed.POOL, phrases=True, head_weight=2.0))


def b02_bm25_scoped(spark, d):
    c, ix = prepared(spark, d)
    allowed = Scope.parse("type:Article -source:ops-*").chunks(c).select("chunk_id")
    return _score6(bm25.search(ix, questions(spark, d), fixed.POOL, allowed))


def b02_bm25_documents(spark, d):
    """The flagship: every question against every document."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "path")
    ix = index.build(docs, "doc_id", text.head_text(F.col("path"), F.col("source")), F.col("text"))
    return _score6(bm25.search(ix.stored(), questions(spark, d), fixed.POOL)).withColumnRenamed("chunk_id", "doc_id")


# ---- filters and exploring

SCOPES = ("kind:jira,github status:Done", "-status:Done", "path:docs/* lang:markdown", "labels:index -type:Dataset", "status:>=O", "source:ops-wiki,ops-api", "kind:dir -lang:python,sql", "category:Rule -kind:dir")


def f03_scopes(spark, d):
    c, _ = prepared(spark, d)
    out = None
    for s in SCOPES:
        part = Scope.parse(s).chunks(c).select(F.lit(s).alias("scope"), "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


def f08_scope_files(spark, d):
    return Scope.parse("category:Rule,Record").files(prepared(spark, d)[0]).select("file_id")


def f10_scope_counts(spark, d):
    c, _ = prepared(spark, d)
    out = None
    for s in SCOPES:
        part = Scope.parse(s).count(c).select(F.lit(s).alias("scope"), "chunks")
        out = part if out is None else out.unionByName(part)
    return out


def f12_scope_types(spark, d):
    return scope_types(prepared(spark, d)[0], Scope.parse("kind:dir"))


def f13_grep_lines(spark, d):
    return explore.matching_lines(prepared(spark, d)[0], r"map_config\(|[Ss]napshot rarely")


def f13_grep_totals(spark, d):
    return explore.grep(prepared(spark, d)[0], "PAYOUT", ignore_case=True)[1]


def f14_folders(spark, d):
    c, _ = prepared(spark, d)
    out = None
    for source, prefix in (("ops-api", ""), ("ops-api", "lib"), ("billing-docs", "docs/")):
        part = explore.folder_entries(c, source, prefix).select(F.lit(f"{source}:{prefix}").alias("target"), "*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("files", F.coalesce("files", F.lit(0)))


def f15_sources(spark, d):
    return explore.source_rows(prepared(spark, d)[0]).drop("indexed_at")


def _targets(c: Corpus) -> DataFrame:
    """Coordinates around every twentieth chunk: some inside it, some over its end."""
    some = c.placed().where("chunk_id % 20 = 0")
    return some.select(F.concat(F.col("source"), F.lit(":"), F.col("path"), F.lit(":"), F.col("start_line") + 1, F.lit("-"), F.col("end_line") + 2).alias("target"))


def f16_read(spark, d):
    c, _ = prepared(spark, d)
    return explore.read(c, _targets(c))


def f17_read_urls(spark, d):
    c, _ = prepared(spark, d)
    return explore.read_urls(c, c.mirror_items.where("url <> ''").select(F.col("url").alias("target")))


def f18_sections(spark, d):
    c, _ = prepared(spark, d)
    heads = c.chunks.where("id % 20 = 0 and heading_path <> ''").select(F.col("id").alias("key"), "file_id", F.element_at(F.split("heading_path", " > "), -1).alias("fragment"))
    return explore.sections(heads.join(c.file_texts, "file_id").select("key", "text", F.translate("fragment", " ", "-").alias("fragment")))


def f24_type_groups(spark, d):
    c, ix = prepared(spark, d)
    hits = bm25.search(ix, questions(spark, d), fixed.POOL).withColumnRenamed("bm25_rank", "seq").join(c.placed().select("chunk_id", "type"), "chunk_id")
    return naming.by_type_groups(hits).select("query_id", "chunk_id", "seq", "type", "group_place")


def j15_around(spark, d):
    return explore.neighbours_in_file(prepared(spark, d)[0]).fillna(0, ["before", "after"])


def j17_overlaps(spark, d):
    c, _ = prepared(spark, d)
    return explore.shown_chunks(c, _targets(c)).select("target", "chunk_id")


def l07_shown_links(spark, d):
    c, _ = prepared(spark, d)
    return explore.shown_links(c, explore.shown_chunks(c, _targets(c))).select("target", "dir", "rel", "via", "other")


def x03_shown_structure(spark, d):
    c, _ = prepared(spark, d)
    return explore.shown_structure(c, explore.shown_chunks(c, _targets(c)))


def x03_shown_names(spark, d):
    c, _ = prepared(spark, d)
    names = explore.shown_names(c, explore.shown_chunks(c, _targets(c)))
    return names.select("target", "chunk_id", F.array_join("defines", " ").alias("defines"), F.size("mentions").alias("mentions"))


def x03_shown_similar(spark, d):
    c, ix = indexed(spark, d)
    return explore.shown_similar(c, ix, explore.shown_chunks(c, _targets(c)))


# ---- links


def j03_citations(spark, d):
    return links.citations(prepared(spark, d)[0])


def _with_definers(c: Corpus) -> Corpus:
    """No name of the test tables is both defined and mentioned; here the first chunk that mentions a name with a sign in it also defines it."""
    first = c.idents.where("role = 'mentions'").where(F.col("ident").rlike("[_./-]")).groupBy("ident").agg(F.min("chunk_id").alias("chunk_id"))
    return c.with_(idents=c.idents.unionByName(first.select("chunk_id", "ident", F.lit("defines").alias("role"))))


def j04_definitions(spark, d):
    return links.definition_mentions(_with_definers(prepared(spark, d)[0]))


def j05_shared_names(spark, d):
    return links.shared_names(prepared(spark, d)[0])


def j06_prose_mentions(spark, d):
    return links.prose_mentions(_with_definers(prepared(spark, d)[0]))


def j07_url_citations(spark, d):
    return links.url_citations(prepared(spark, d)[0])


def l01_links(spark, d):
    return prepared(spark, d)[0].links


def l03_link_counts(spark, d):
    return links.link_counts(prepared(spark, d)[0].links)


def l04_named_links(spark, d):
    c, _ = prepared(spark, d)
    return naming.named_links(c, c.chunks.where("id % 20 = 0").select(F.col("id").alias("chunk_id"))).drop("place")


def l05_chunk_kinds(spark, d):
    c, _ = prepared(spark, d)
    return naming.chunk_kinds(c, c.chunks.select(F.col("id").alias("chunk_id"))).select("chunk_id", "chunk_kind")


def s42_title_links(spark, d):
    pages = table(spark, d, "documents").where("doc_type = 'page'").select(F.col("doc_id").alias("page_id"), "text")
    titles = pages.select("page_id", F.regexp_extract("text", r"^# ([^\n]+)", 1).alias("title")).where("title <> ''")
    return links.drawn_titles(pages, titles)


# ---- widening and search


def w01_named_files(spark, d):
    c, ix = prepared(spark, d)
    asked = c.files.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("what does "), "path", F.lit(" say of snapshot and payout")).alias("text"))
    none = spark.createDataFrame([], "query_id bigint, chunk_id bigint, seq int, via string, bm25_rank int")
    return widen.by_path(c, ix, asked, none).select("query_id", "chunk_id", "seq", "via")


def w02_named_definitions(spark, d):
    c, _ = prepared(spark, d)
    asked = c.chunks.where("id % 20 = 0").select(F.col("id").alias("query_id"), "text")
    none = spark.createDataFrame([], "query_id bigint, chunk_id bigint, seq int, via string, bm25_rank int")
    return widen.by_definition(c, asked, none).select("query_id", "chunk_id", "seq", "via")


def w03_query_names(spark, d):
    c, _ = prepared(spark, d)
    return widen.query_names(c.chunks.where("id % 20 = 0").select(F.col("id").alias("query_id"), "text"))


def _type_probabilities(spark, d):
    kinds = F.array(*[F.lit(t) for t in (fixed.ARTICLE, fixed.SOURCE_CODE, fixed.CONFIG_TYPE, fixed.DATASET)])
    rows = questions(spark, d).select("query_id", F.posexplode(kinds).alias("i", "type"))
    return rows.select("query_id", "type", F.when((F.col("query_id") + F.col("i")) % 3 == 0, 0.4).otherwise(0.1).alias("p"))


def w04_by_type(spark, d):
    c, ix = prepared(spark, d)
    q = questions(spark, d)
    return widen.by_type(c, ix, q, widen.seeds(ix, q, 5), _type_probabilities(spark, d), 5)


def w05_by_category(spark, d):
    c, ix = prepared(spark, d)
    q = questions(spark, d)
    about = facts.query_categories(facts.CueJudge(), q)
    return widen.by_category(c, ix, q, widen.seeds(ix, q, 5), about, 10).drop("bm25_rank")


def w06_expand(spark, d):
    c, ix = prepared(spark, d)
    return widen.expand(c, widen.seeds(ix, questions(spark, d), fixed.POOL), fixed.SEEDS, fixed.EXPAND_LIMIT).drop("bm25_rank")


def w07_distinctive_words(spark, d):
    c, ix = prepared(spark, d)
    words = widen.distinctive_words(ix, c.chunks.where("id % 20 = 0").select(F.col("id").alias("query_id"), "text"))
    return words.withColumn("weight", F.round("weight", 6))


def w07_neighbours(spark, d):
    c, ix = prepared(spark, d)
    return widen.neighbours(c, ix, c.chunks.where("id % 20 = 0").select(F.col("id").alias("chunk_id")))


def w08_by_neighbours(spark, d):
    c, ix = prepared(spark, d)
    asked, _ = known_items(c)
    return widen.by_neighbours(c, ix, widen.seeds(ix, asked, 3), 3, 10).drop("bm25_rank")


def w11_search(spark, d):
    c, ix = prepared(spark, d)
    return searching.search(c, ix, questions(spark, d)).select("query_id", "seq", "chunk_id", "source", "path", "start_line", "end_line", "via", "bm25_rank")


def w11_search_wide(spark, d):
    c, ix = prepared(spark, d)
    o = searching.Options(links=True, neighbours=True, judge=facts.CueJudge())
    hits = searching.search(c, ix, questions(spark, d), rank.LexicalRanker(), o)
    return hits.select("query_id", "seq", "chunk_id", "via", "score", F.size(F.coalesce("links", F.array())).alias("links"))


def w12_arms(spark, d):
    c, ix = prepared(spark, d)
    asked, _ = known_items(c)
    return widen.arms(c, ix, asked, 5)


# ---- models


def m02_lexical_scores(spark, d):
    c, ix = prepared(spark, d)
    return rank.LexicalRanker().score(_full_pool(spark, d, c, ix, fixed.POOL))


def _full_pool(spark, d, c, ix, k):
    q = questions(spark, d)
    pool = widen.seeds(ix, q, k)
    placed = c.placed("heading_path").select("chunk_id", "source", "public", "path", "heading_path")
    body = c.chunks.select(F.col("id").alias("chunk_id"), "text")
    return pool.withColumn("first", F.lit(k)).join(placed, "chunk_id").join(body, "chunk_id").join(q.select("query_id", F.col("text").alias("question")), "query_id")


def m04_passes(spark, d):
    c, ix = prepared(spark, d)
    scored = rank.PassRanker("overlap", rank.overlap_reader).score(_full_pool(spark, d, c, ix, 30))
    return scored.withColumn("score", F.round("score", 6))


def m05_states(spark, d):
    c, ix = prepared(spark, d)
    states = rank.render(_full_pool(spark, d, c, ix, 5).withColumn("heat", F.lit(0)))
    return states.select("query_id", "state", F.size("chunks").alias("passages"))


def m11_categories(spark, d):
    c, _ = prepared(spark, d)
    return c.categories.select("chunk_id", "category", "p", "kept", "model")


def m12_planned_pairs(spark, d):
    c, ix = prepared(spark, d)
    return facts.planned_pairs(facts.candidates(c, ix))


def m12_fact_links(spark, d):
    c, ix = prepared(spark, d)
    return facts.link_facts(c, ix, facts.CueJudge())[0]


def m13_query_categories(spark, d):
    return facts.query_categories(facts.CueJudge(), questions(spark, d))


def a08_category_counts(spark, d):
    return facts.category_counts(prepared(spark, d)[0].categories)


# ---- evaluation


def _known_run(spark, d, k=30, **more):
    c, ix = indexed(spark, d)
    asked, gold = known_items(c)
    return _placed_hits(c, widen.seeds(ix, asked, k, **more)), gold


def e02_gold_ranks(spark, d):
    return evaluation.gold_ranks(*_known_run(spark, d))


def e03_summary(spark, d):
    return evaluation.rank_summary(e02_gold_ranks(spark, d))


def e03_question_rows(spark, d):
    hits, gold = _known_run(spark, d)
    rows = evaluation.question_rows(hits, gold, evaluation.gold_ranks(hits.where("seq <= 5"), gold))
    return rows.select("query_id", "rank", "via", "in_bm25", F.array_join("top10", ";").alias("top10"))


def e05_graded(spark, d):
    """Files as documents; a file of the same type and source has gain 1, the question's own file gain 2."""
    hits, gold = _known_run(spark, d)
    run = evaluation.collapsed(hits.withColumn("doc", F.concat_ws(":", "source", "path")), "doc")
    own = gold.select("query_id", F.concat_ws(":", "source", "path").alias("doc"), "source")
    c, _ = prepared(spark, d)
    near = own.select("query_id", "source", F.col("doc").alias("own")).join(c.placed_files().select("source", F.concat_ws(":", "source", "path").alias("doc")), "source")
    return evaluation.graded(run, near.select("query_id", "doc", F.when(F.col("doc") == F.col("own"), 2).otherwise(1).alias("gain")))


def e06_binary(spark, d):
    hits, gold = _known_run(spark, d)
    run = evaluation.collapsed(hits.withColumn("doc", F.concat_ws(":", "source", "path")), "doc")
    return evaluation.graded(run, gold.select("query_id", F.concat_ws(":", "source", "path").alias("doc"), F.lit(1).alias("gain")), binary=True)


def _two_arms(spark, d):
    a, b = e02_gold_ranks(spark, d), evaluation.gold_ranks(*_known_run(spark, d, head_weight=3.0))
    score = lambda x: x.select("query_id", F.round(evaluation.ndcg_one(F.col("rank")), 6).alias("v"))
    return score(a), score(b)


def e09_arms(spark, d):
    """The measures of three arms on the same questions."""
    c, ix = prepared(spark, d)
    asked, gold = known_items(c)
    hits = _placed_hits(c, searching.three_arms(c, ix, asked, facts.CueJudge(), 10))
    # A question is one for each arm.
    each = gold.withColumn("arm", F.explode(F.array(*[F.lit(arm) for arm in ("base", "facts", "control")])))
    ranks = evaluation.gold_ranks(*(rows.withColumn("query_id", F.struct("arm", "query_id")) for rows in (hits, each)))
    return evaluation.rank_summary(ranks.withColumn("arm", F.col("query_id.arm")), ["arm"])


def w04_predicted_types(spark, d):
    """Types by a predictor that counts cue words, and the chunks that they bring."""
    c, ix = prepared(spark, d)
    q = questions(spark, d)

    def predict(question, types):
        n = {t: 1 + question.lower().count(t[:3].lower()) for t in types}
        return {t: v / sum(n.values()) for t, v in n.items()}

    types = [fixed.ARTICLE, fixed.CONFIG_TYPE, fixed.DATASET, fixed.SOURCE_CODE]
    return widen.by_type(c, ix, q, widen.seeds(ix, q, 5), rank.TypePredictor(predict).probabilities(q, types), 5).select("query_id", "chunk_id", "seq", "via")


def e10_paired_counts(spark, d):
    return evaluation.paired_counts(*_two_arms(spark, d), "v")


def e10_paired(spark, d):
    return evaluation.paired(*_two_arms(spark, d), "v")


def _judged(spark, d):
    """Kept categories with their probability, and a second reading that agrees where the id allows."""
    rows = prepared(spark, d)[0].categories.where("kept and model <> 'code'")
    gold = F.when(F.col("chunk_id") % 7 == 0, "Other").otherwise(F.col("category"))
    return rows.select("chunk_id", F.col("category").alias("said"), gold.alias("gold"), "p", (F.col("chunk_id") % 7 != 0).alias("ok"), (F.col("chunk_id") % 3).alias("stratum"))


def e11_auc(spark, d):
    return evaluation.auc(_judged(spark, d), "p", "ok", ["stratum"])


def e12_negative_pools(spark, d):
    hits, gold = _known_run(spark, d)
    return evaluation.without_gold(hits.where("seq <= 10").select("query_id", "chunk_id", "seq"), hits.select("query_id", "chunk_id", "seq"), gold, 10)


def _same_file(spark, d):
    """Every chunk of the file that a question comes from answers it: questions with one answer and with many."""
    c, _ = indexed(spark, d)
    hits, gold = _known_run(spark, d)
    files = c.chunks.select(F.col("id").alias("query_id"), "file_id").join(gold.select("query_id"), "query_id")
    return hits, files.join(c.chunks.select(F.col("id").alias("chunk_id"), "file_id"), "file_id").select("query_id", "chunk_id")


def e13_slot_swap(spark, d):
    hits, gold = _same_file(spark, d)
    return evaluation.swapped_slots(hits.where("seq <= 10").select("query_id", "chunk_id", "seq"), hits.select("query_id", "chunk_id", "seq"), gold)


def e14_hash_pick(spark, d):
    return table(spark, d, "documents").select("doc_id", evaluation.hash_pick(F.col("doc_id").cast("string"), 7, "wording").alias("pick"))


def e14_arranged(spark, d):
    """The first ten hits of each question and the same without its answers, in one order for both."""
    hits, gold = _same_file(spark, d)
    pool = hits.where("seq <= 10").select("query_id", "chunk_id", "seq")
    both = pool.withColumn("arm", F.lit("pos")).unionByName(evaluation.swapped_slots(pool, hits.select("query_id", "chunk_id", "seq"), gold).withColumn("arm", F.lit("neg")))
    return evaluation.arranged(both, 0.5)


def e15_spread(spark, d):
    return evaluation.spread(_judged(spark, d), "p", ["stratum"])


def e16_classification(spark, d):
    return evaluation.classification(_judged(spark, d), "gold", "said", "stratum")


def e17_calibration(spark, d):
    return evaluation.calibration(_judged(spark, d), "said", "gold", "p", F.col("stratum") == 0)


def e17_taus(spark, d):
    return evaluation.lowest_threshold(e17_calibration(spark, d), 0.8, 0.2)


def e18_threshold_curve(spark, d):
    return evaluation.threshold_curve(_judged(spark, d), "p", "ok")


def e18_threshold_points(spark, d):
    return evaluation.threshold_points(e18_threshold_curve(spark, d))


def e19_gate(spark, d):
    """The first places of two weightings of the head."""
    first = lambda ranks: ranks.select("query_id", F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0)).alias("top1"))
    return evaluation.gate(first(e02_gold_ranks(spark, d)), first(evaluation.gold_ranks(*_known_run(spark, d, head_weight=3.0)))).drop("low", "high")


def a10_how_found(spark, d):
    return evaluation.how_found(e03_question_rows(spark, d))


def e20_leak_probe(spark, d):
    rows = table(spark, d, "documents").where("text <> '' and doc_type in ('page', 'ticket')").select("doc_id", "text", (F.col("doc_type") == "ticket").cast("int").alias("label"), F.coalesce("source", F.lit("")).alias("source"))
    return evaluation.leak_probe(rows, "text", "label", "source")


def _patches(c: Corpus) -> DataFrame:
    """A patch of every file: an insertion at the head of a hunk, or a change inside one, at a line that depends on the file."""
    k = F.col("id") % 9 + 1
    there = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"))
    put = F.concat(F.lit("@@ -"), k, F.lit(",1 +"), k, F.lit(",2 @@\n+new\n same\n"))
    change = F.concat(F.lit("@@ -"), k, F.lit(",3 +"), k, F.lit(",3 @@\n same\n-old\n+new\n same\n"))
    return c.files.select("id", F.concat(there, F.when(F.col("id") % 2 == 0, put).otherwise(change)).alias("patch"))


def e22_touched_chunks(spark, d):
    c, _ = prepared(spark, d)
    return evaluation.touched_chunks(evaluation.touched(_patches(c), "id", "patch"), c.placed().select("chunk_id", "path", "start_line", "end_line"), "id")


def e22_patch_files(spark, d):
    return evaluation.patch_files(_patches(prepared(spark, d)[0]), "id", "patch")


def e23_even_sample(spark, d):
    return evaluation.even_sample(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", ["doc_id"], 5)


def e24_stratified(spark, d):
    rows = table(spark, d, "documents").where("text <> ''").select("doc_type", "text")
    return evaluation.stratified_sample(rows, "doc_type", "text", 50).select("doc_type", "key", "held_out")


def e25_agreement(spark, d):
    rows = _judged(spark, d)
    return evaluation.agreement(rows.select(F.col("chunk_id").alias("key"), "p"), rows.select(F.col("chunk_id").alias("key"), F.when(F.col("ok"), F.col("p")).otherwise(1 - F.col("p")).alias("p")))


# ---- sync and sources


def _scan(spark, d):
    scan = sync.newest_scan(table(spark, d, "file_scans"), table(spark, d, "sync_runs"))
    return scan.withColumn("type", text.document_type(F.col("path"), F.col("lang")))


def s05_file_changes(spark, d):
    return sync.file_changes(_scan(spark, d), table(spark, d, "files"))


def s05_change_counts(spark, d):
    return sync.change_counts(s05_file_changes(spark, d))


def _listing(spark, d):
    return sync.newest_listing(table(spark, d, "remote_listing"), table(spark, d, "sync_runs"))


def s17_item_changes(spark, d):
    return sync.item_changes(_listing(spark, d), table(spark, d, "mirror_items"))


def s17_mirrored(spark, d):
    rows = sync.mirrored(_listing(spark, d), table(spark, d, "mirror_items"))
    return rows.select("source_id", "item_id", "version", "path", F.col("meta").isNotNull().alias("has_meta"))


def s18_meta(spark, d):
    return from_directory(spark, d).file_meta


def s07_schema_cards(spark, d):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "chunks")
    rows = [(n, i, f.name, f.dataType.simpleString()) for n in names for i, f in enumerate(table(spark, d, n).schema)]
    return file_source.table_cards(spark.createDataFrame(rows, "name string, position int, column string, type string"))


def s32_datasets(spark, d):
    rows = table(spark, d, "file_scans").where("seen_at is not null")
    keys = rows.select(F.concat_ws("/", F.lit("lake"), F.concat(F.lit("src="), "source_id"), "path").alias("key"), F.col("seen_at").alias("modified"))
    found = objects.datasets(keys.unionByName(rows.select(F.concat(F.lit("raw/"), "path").alias("key"), F.col("seen_at").alias("modified"))))
    return found.select("dataset", F.array_join("partition_keys", ",").alias("partition_keys"), "newest", "files")


# ---- chunking


def _texts(spark, d):
    files = table(spark, d, "files").select(F.col("id").alias("file_id"), "lang")
    return table(spark, d, "file_texts").join(files, "file_id").select("file_id", "lang", "text")


def c01_sections(spark, d):
    """Chunks of Markdown files by section: its lines from the first piece to the last."""
    cut = chunking.chunks_of(_texts(spark, d).where("lang = 'markdown'"))
    return cut.groupBy("file_id", "heading_path", "anchor").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def c06_chunks(spark, d):
    cut = chunking.chunks_of(_texts(spark, d))
    return chunking.with_names(cut).select("file_id", "seq", "kind", "heading_path", "start_line", "end_line", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.size("mentions").alias("mentions"), F.size("defines").alias("defines"))


def c02_lines_kept(spark, d):
    """Of each file that is not kept as Markdown, how many of its lines with text are in chunks and how many it has."""
    rows = _texts(spark, d).where(~F.col("lang").isin(*fixed.WRITTEN_AS_MARKDOWN))
    full = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    cut = chunking.chunks_of(rows).groupBy("file_id").agg(F.sum(full(F.col("text"))).alias("kept"))
    return rows.select("file_id", full(F.col("text")).alias("lines")).join(cut, "file_id", "left").select("file_id", "lines", F.coalesce("kept", F.lit(0)).alias("kept"))


_NOT_QUERIES = {"indexed", "prepared", "questions", "known_items"}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in _NOT_QUERIES}
