"""The whole search: BM25 seeds, widening, ranking, the best with their links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import fixed
from passagework.operators import facts as fact
from passagework.operators import naming, widen
from passagework.operators.index import Index
from passagework.operators.rank import Ranker, refuse_private
from passagework.operators.scope import Scope
from passagework.session import materialize


@dataclass(frozen=True)
class Options:
    """How a search widens and cuts; the defaults are those of a plain question."""

    k: int = fixed.TOP
    pool: int = fixed.POOL
    symbols: bool = True
    links: bool = False
    neighbours: bool = False
    types: DataFrame | None = None
    per_type: int | None = None
    judge: fact.Judge | None = None
    facts_limit: int = 10
    seeds: int = fixed.SEEDS
    expand_limit: int = fixed.EXPAND_LIMIT
    scope: Scope = Scope()
    phrases: bool | None = None


def candidates(corpus, index: Index, queries: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(pool, named, first): every candidate in order, those that the question names, and how many BM25 gave each query."""
    o = options
    allowed = o.scope.chunks(corpus).select("chunk_id") if o.scope.terms else None
    base = materialize(widen.seeds(index, queries, o.pool, allowed, phrases=o.phrases), "pool")
    first = base.groupBy("query_id").agg(F.count(F.lit(1)).alias("first"))
    groups: list[DataFrame] = []

    def add(group: DataFrame) -> None:
        groups.append(materialize(group, "widened"))

    held = lambda: widen.appended(base, *groups) if groups else base
    if o.symbols:
        add(widen.by_symbols(corpus, index, queries, base, o.pool, o.scope))
    if o.types is not None:
        add(widen.by_type(corpus, index, queries, held(), o.types, o.per_type or o.pool, o.scope))
    if o.judge is not None:
        add(widen.by_facts(corpus, index, queries, held(), fact.query_categories(o.judge, queries), o.facts_limit, o.seeds, o.scope))
    if o.links:
        add(widen.expand(corpus, held(), o.seeds, o.expand_limit, o.scope))
    if o.neighbours:
        add(widen.by_neighbours(corpus, index, held(), o.seeds, o.expand_limit, o.scope))
    if not groups:
        return base, None, first
    return widen.appended(base, widen.interleaved(groups)), groups[0] if o.symbols else None, first


def ranked(corpus, index: Index, queries: DataFrame, ranker: Ranker | None = None, options: Options = Options()) -> DataFrame:
    """(query_id, chunk_id, seq, via, bm25_rank, score) of every candidate, in the final order."""
    if ranker is not None and options.types is not None:
        # Widening by type may bring any chunk of the scope, so all of it must be public.
        refuse_private(options.scope.files(corpus), ranker.name, ranker.remote)
    pool, named, first = candidates(corpus, index, queries, options)
    if ranker is None:
        ordered = pool if named is None else widen.named_first(pool, named)
        return ordered.withColumn("score", F.lit(None).cast("double"))
    placed = corpus.placed("heading_path").select("chunk_id", "source", "public", "path", "heading_path")
    texts = corpus.chunks.select(F.col("id").alias("chunk_id"), "text")
    asked = queries.select("query_id", F.col("text").alias("question"))
    full = pool.join(first, "query_id", "left").join(placed, "chunk_id").join(texts, "chunk_id").join(asked, "query_id")
    return widen.by_score(pool, ranker.score(full))


def search(corpus, index: Index, queries: DataFrame, ranker: Ranker | None = None, options: Options = Options(), with_links: bool = True) -> DataFrame:
    """The `k` best hits of each query, with text and named links; wide columns are read for these alone."""
    order = ranked(corpus, index, queries, ranker, options)
    best = materialize(order.where(F.col("seq") <= options.k), "best")
    links = naming.named_links(corpus, best) if with_links and corpus.links is not None else None
    return naming.hit_rows(corpus, best, links)


def three_arms(corpus, index: Index, queries: DataFrame, judge: fact.Judge, pool: int = 30, facts_limit: int = 10) -> DataFrame:
    """(arm, query_id, chunk_id, seq): BM25's pool, the pool with what facts add, and BM25's pool grown to that size.

    The third arm tells a gain from facts from a gain by more candidates.
    """
    base = widen.seeds(index, queries, pool)
    about = materialize(fact.query_categories(judge, queries), "about")
    added = widen.by_facts(corpus, index, queries, base, about, facts_limit)
    wide = materialize(widen.appended(base, added), "facts")
    size = wide.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    control = widen.seeds(index, queries, size.withColumnRenamed("size", "k"))
    parts = (("base", base), ("facts", wide), ("control", control))
    out = None
    for arm, rows in parts:
        part = rows.select(F.lit(arm).alias("arm"), "query_id", "chunk_id", "seq")
        out = part if out is None else out.unionByName(part)
    return out


def covered(hits: DataFrame) -> DataFrame:
    """Hits per query, as a check that widening only ever adds."""
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("seq").alias("last"))


def first_per_file(hits: DataFrame) -> DataFrame:
    """(query_id, source, path, rank): files in the order of their best hit."""
    best = hits.groupBy("query_id", "source", "path").agg(F.min("seq").alias("seq"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seq", "source", "path"))).drop("seq")
