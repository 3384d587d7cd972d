"""Widening a pool of candidates, for a whole table of queries at once.

A pool is (query_id, chunk_id, seq, via, bm25_rank): `seq` is the place, from 1.
Every widening returns rows of that shape that the pool does not hold yet;
none takes anything away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import fixed, text
from passagework.functions.words import WORD
from passagework.operators import bm25
from passagework.operators.index import Index
from passagework.operators.links import both_ways, definers
from passagework.operators.scope import Scope
from passagework.session import materialize

POOL = ("query_id", "chunk_id", "seq", "via", "bm25_rank")


def seeds(index: Index, queries: DataFrame, k: int | DataFrame, allowed: DataFrame | None = None, **more) -> DataFrame:
    """The pool that BM25 gives."""
    found = bm25.search(index, queries, k, allowed, **more)
    return found.select("query_id", "chunk_id", F.col("bm25_rank").alias("seq"), F.lit("").alias("via"), "bm25_rank")


def _fresh(found: DataFrame, pool: DataFrame) -> DataFrame:
    return found.join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def _placed(found: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """`found` with its place by `order`, each chunk once, up to `limit` of a query."""
    w = Window.partitionBy("query_id").orderBy(*order)
    out = found.withColumn("seq", F.row_number().over(w))
    out = out if limit is None else out.where(F.col("seq") <= limit)
    return out.select(*POOL)


def query_names(queries: DataFrame) -> DataFrame:
    """(query_id, name): names a query uses, and the parts of dotted ones of three characters or more."""
    trace = F.transform(F.regexp_extract_all("text", F.lit(rf"line \p{{Nd}}+, in ([{fixed.W}]{{3,}})"), F.lit(1)), text.norm_name)
    whole = queries.select("query_id", F.explode(F.array_union(text.names_in(F.col("text")), trace)).alias("name"))
    parts = whole.select("query_id", F.explode(F.filter(F.split("name", "[./:]"), lambda p: F.char_length(p) >= 3)).alias("name"))
    return whole.unionByName(parts).distinct()


def stem(path: Column) -> Column:
    """A path in lower case without its suffix and outer dots and slashes."""
    return F.regexp_replace(F.btrim(F.translate(F.lower(path), "\\", "/"), F.lit("./")), rf"\.[{fixed.W}]+$", "")


def query_paths(queries: DataFrame) -> DataFrame:
    """(query_id, path): paths a query names; a dotted module of three parts or more is one."""
    slashes = rf"[{fixed.W}.\-]+(?:/[{fixed.W}.\-]+)+"
    dots = rf"{fixed.LEFT}[a-z_][{fixed.W}]*(?:\.[a-z_][{fixed.W}]*){{2,}}{fixed.RIGHT}"
    found = queries.select("query_id", F.explode(F.regexp_extract_all("text", F.lit(f"{slashes}|{dots}"), F.lit(0))).alias("p"))
    plain = found.select("query_id", F.btrim("p", F.lit("./")).alias("p"))
    path = F.when(F.instr("p", "/") > 0, F.col("p")).otherwise(F.translate("p", ".", "/"))
    return plain.select("query_id", path.alias("p")).where(F.instr("p", "/") > 0).select("query_id", stem(F.col("p")).alias("path")).distinct()


def path_ends(files: DataFrame) -> DataFrame:
    """(file_id, path): each file's stem and every ending of it at a slash, so that a named path is an equal key."""
    parts = files.select("file_id", F.split(stem(F.col("path")), "/").alias("p"))
    ends = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))
    return parts.select("file_id", F.explode(ends).alias("path"))


def _best_of_named_files(corpus, index: Index, queries: DataFrame, scope: Scope) -> DataFrame:
    files = scope.files(corpus).select("file_id", "path")
    named = query_paths(queries).join(path_ends(files), "path").select("query_id", "file_id").distinct()
    first = Window.partitionBy("query_id").orderBy("file_id")
    named = named.withColumn("k", F.row_number().over(first)).where(F.col("k") <= fixed.MAX_NAMED_FILES)
    depth = named.groupBy("query_id").agg((3 * F.count(F.lit(1))).cast("int").alias("k"))
    asked = queries.join(depth.select("query_id"), "query_id", "left_semi")
    inside = scope.chunks(corpus).select("chunk_id", F.col("file_id").alias("part"))
    return bm25.best(index, bm25.query_phrases(asked), depth, named.select("query_id", F.col("file_id").alias("part")), inside)


def by_path(corpus, index: Index, queries: DataFrame, pool: DataFrame, scope: Scope = Scope(), best: DataFrame | None = None) -> DataFrame:
    """BM25's best chunks of the files that a query names, three a file."""
    best = _best_of_named_files(corpus, index, queries, scope) if best is None else best
    kept = _fresh(best.select("query_id", "chunk_id", "bm25_rank"), pool)
    return _placed(kept.withColumn("via", F.lit("path")), F.col("bm25_rank")).withColumn("bm25_rank", F.lit(None).cast("int"))


def _defining(corpus, queries: DataFrame, scope: Scope) -> DataFrame:
    named = query_names(queries)
    defined = corpus.idents.where("role = 'defines'").join(definers(corpus.idents), "ident", "left_semi")
    found = named.join(defined.select(F.col("ident").alias("name"), "chunk_id"), "name").join(scope.chunks(corpus).select("chunk_id"), "chunk_id", "left_semi")
    return found.groupBy("query_id", "chunk_id").agg(F.max(F.struct(F.char_length("name").alias("n"), "name")).alias("m"))


def by_definition(corpus, queries: DataFrame, pool: DataFrame, scope: Scope = Scope(), found: DataFrame | None = None) -> DataFrame:
    """Chunks that define a name the query uses, longest name first; names with too many definers name nothing."""
    once = _defining(corpus, queries, scope) if found is None else found
    kept = _fresh(once, pool).select("query_id", "chunk_id", F.col("m.n").alias("n"), F.concat(F.lit("defines:"), "m.name").alias("via"), F.lit(None).cast("int").alias("bm25_rank"))
    return _placed(kept, F.desc("n"), F.col("via"), F.col("chunk_id"))


def by_symbols(corpus, index: Index, queries: DataFrame, pool: DataFrame, limit: int, scope: Scope = Scope(), symbols: tuple | None = None) -> DataFrame:
    """Named files, then named definitions, up to `limit` of a query; `symbols` if they are looked up already."""
    best, found = symbols or (None, None)
    paths = by_path(corpus, index, queries, pool, scope, best)
    names = _fresh(by_definition(corpus, queries, pool, scope, found), paths)
    both = paths.withColumn("part", F.lit(0)).unionByName(names.withColumn("part", F.lit(1)))
    return _placed(both.withColumnRenamed("seq", "at"), F.col("part"), F.col("at"), limit=limit)


def chosen_types(probabilities: DataFrame) -> DataFrame:
    """(query_id, type, place): the likely types of each query, most likely first; the likeliest where none is.

    `probabilities` is (query_id, type, p). Ties go by the type's name.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("p"), "type")
    ranked = probabilities.withColumn("place", F.row_number().over(w))
    return ranked.where((F.col("p") >= fixed.TYPE_MIN_P) | (F.col("place") == 1)).select("query_id", "type", "place")


def by_type(corpus, index: Index, queries: DataFrame, pool: DataFrame, probabilities: DataFrame, per_type: int, scope: Scope = Scope()) -> DataFrame:
    """BM25's best chunks of each likely document type; they keep the rank inside their type.

    Nothing is added where the scope holds fewer than two types.
    """
    chosen = chosen_types(probabilities)
    return _typed(best_of_types(corpus, index, queries, chosen, per_type, scope), chosen, pool)


def best_of_types(corpus, index: Index, queries: DataFrame, types: DataFrame, per_type: int, scope: Scope = Scope()) -> DataFrame:
    """(query_id, type, chunk_id, bm25_rank): BM25's best chunks of each query among those of a type, for `types` (query_id, type)."""
    placed = scope.chunks(corpus).where("type is not null").select("chunk_id", F.col("type").alias("part"))
    enough = placed.agg((F.countDistinct("part") >= 2).alias("enough"))  # one row
    each = types.select("query_id", "type").crossJoin(F.broadcast(enough)).where("enough")
    # A query asks once for each type, under a number.
    asked = materialize(each.select("query_id", F.monotonically_increasing_id().alias("asked"), F.col("type").alias("part")), "asked")
    told = bm25.query_phrases(queries).join(asked, "query_id").select(F.col("asked").alias("query_id"), "phrase", "terms")
    best = bm25.best(index, told, per_type, asked.select(F.col("asked").alias("query_id"), "part"), placed)
    return best.withColumnRenamed("query_id", "asked").join(asked, "asked").select("query_id", F.col("part").alias("type"), "chunk_id", "bm25_rank")


def _typed(best: DataFrame, chosen: DataFrame, pool: DataFrame) -> DataFrame:
    kept = _fresh(best.join(chosen, ["query_id", "type"]), pool).withColumn("via", F.concat(F.lit("type:"), "type"))
    return _placed(kept, F.col("place"), F.col("bm25_rank"))


def by_category(corpus, index: Index, queries: DataFrame, pool: DataFrame, categories: DataFrame, limit: int, scope: Scope = Scope()) -> DataFrame:
    """BM25's best chunks that keep a category the query is about; `categories` is (query_id, category)."""
    kept = corpus.categories.where("kept").select("chunk_id", "category")
    if scope.terms:
        kept = kept.join(scope.chunks(corpus).select("chunk_id"), "chunk_id", "left_semi")
    size = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
    named = categories.groupBy("query_id").agg(F.concat(F.lit("category:"), F.array_join(F.array_sort(F.collect_set("category")), ",")).alias("via"))
    depth = named.select("query_id").join(size, "query_id", "left").select("query_id", (F.coalesce("held", F.lit(0)) + limit).cast("int").alias("k"))
    best = bm25.best(index, bm25.query_phrases(queries), depth, categories.withColumnRenamed("category", "part"), kept.withColumnRenamed("category", "part"))
    fresh = _fresh(best, pool).join(named, "query_id")
    return _placed(fresh, F.col("bm25_rank"), limit=limit).withColumn("bm25_rank", F.lit(None).cast("int"))


def expand(corpus, pool: DataFrame, seeds: int, limit: int, scope: Scope = Scope(), rels: tuple[str, ...] | None = None) -> DataFrame:
    """Other ends of the links of the first `seeds` of each pool: those that most seeds lead to first,
    then by relation, then by chunk. `via` is the relation and the sorted names of the links."""
    links = corpus.links if rels is None else corpus.links.where(F.col("rel").isin(*rels))
    start = pool.where(F.col("seq") <= seeds).select("query_id", F.col("chunk_id").alias("me"))
    met = start.join(both_ways(links), "me").groupBy("query_id", F.col("other").alias("chunk_id"))
    told = met.agg(F.countDistinct("me").alias("n"), F.min("rel").alias("rel"), F.array_join(F.array_sort(F.collect_set("via")), ",").alias("names"))
    fresh = _fresh(told, pool)
    if scope.terms:
        fresh = fresh.join(scope.chunks(corpus).select("chunk_id"), "chunk_id", "left_semi")
    shown = fresh.withColumn("via", F.concat_ws(":", "rel", "names")).withColumn("bm25_rank", F.lit(None).cast("int"))
    return _placed(shown, F.desc("n"), F.col("rel"), F.col("chunk_id"), limit=limit)


def distinctive_words(index: Index, texts: DataFrame, most: int = fixed.NEIGHBOUR_TERMS) -> DataFrame:
    """(query_id, term, weight): the `most` words of each text with the highest tf-idf in the map.

    `texts` is (query_id, text). Words of one letter, words that fewer than two
    chunks have, and words that the index parts do not count; ties go by term.
    """
    said = F.transform(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: (F.char_length(w) > 1) & ~w.contains("_")), text.fold)
    # Texts are moved once; their words are counted and ranked where they lie.
    counted = texts.select("query_id", "text").repartition("query_id").select("query_id", F.explode(said).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = index.terms.where("body_df >= 2").select("term", F.col("body_df").alias("df"))
    weighed = counted.join(bm25.sent(df), "term").crossJoin(F.broadcast(index.stats.select("n"))).withColumn("weight", F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), bm25.PLACES))
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("query_id", "term", "weight")


def similar(index: Index, words: DataFrame, chunk_files: DataFrame, own_files: DataFrame, allowed: DataFrame | None = None, depth: int = fixed.NEIGHBOUR_DEPTH, most: int = fixed.NEIGHBOURS_A_SEED) -> DataFrame:
    """(query_id, chunk_id, rank): up to `most` chunks of other files that BM25 finds by the words.

    `chunk_files` is (chunk_id, file_id), `own_files` (query_id, file_id).
    Only the best `depth` are looked at, the own file's among them.
    """
    asked = materialize(words.select("query_id", F.col("term").alias("phrase"), F.array("term").alias("terms")), "words")
    best = bm25.best(index, asked, depth, allowed=allowed).join(chunk_files, "chunk_id")
    other = best.join(own_files, ["query_id", "file_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("bm25_rank")
    return other.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "chunk_id", "rank")


def neighbours(corpus, index: Index, chunk_ids: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """(seed, chunk_id, rank): neighbours of chunks by their most distinctive words."""
    held = corpus.chunks.select(F.col("id").alias("query_id"), "text", "file_id").join(chunk_ids.select(F.col("chunk_id").alias("query_id")).distinct(), "query_id", "left_semi")
    files = corpus.chunks.select(F.col("id").alias("chunk_id"), "file_id")
    allowed = scope.chunks(corpus).select("chunk_id") if scope.terms else None
    found = similar(index, distinctive_words(index, held.select("query_id", "text")), files, held.select("query_id", "file_id"), allowed)
    return found.withColumnRenamed("query_id", "seed")


def by_neighbours(corpus, index: Index, pool: DataFrame, seeds: int, limit: int, scope: Scope = Scope()) -> DataFrame:
    """Neighbours of the first `seeds` that the pool lacks: those of most seeds first, then the first met."""
    start = pool.where(F.col("seq") <= seeds).select("query_id", F.col("chunk_id").alias("seed"), "seq")
    near = neighbours(corpus, index, start.select(F.col("seed").alias("chunk_id")), scope)
    votes = _fresh(start.join(near, "seed").select("query_id", "chunk_id", "seq", "rank"), pool)
    told = votes.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("seq", "rank")).alias("met"))
    shown = told.withColumn("via", F.lit("neighbour")).withColumn("bm25_rank", F.lit(None).cast("int"))
    return _placed(shown, F.desc("votes"), F.col("met"), limit=limit)


def by_facts(corpus, index: Index, queries: DataFrame, pool: DataFrame, categories: DataFrame, limit: int = 10, seeds: int = fixed.SEEDS, scope: Scope = Scope()) -> DataFrame:
    """By category, then along `about` links from the pool as widened so far."""
    near = materialize(by_category(corpus, index, queries, pool, categories, limit, scope), "near")
    linked = expand(corpus, appended(pool, near), seeds, limit, scope, ("about",))
    both = near.withColumn("part", F.lit(0)).unionByName(linked.withColumn("part", F.lit(1))).withColumnRenamed("seq", "at")
    return _placed(both, F.col("part"), F.col("at"))


def appended(pool: DataFrame, *groups: DataFrame) -> DataFrame:
    """The pool, then each group in turn."""
    rows = pool.withColumn("part", F.lit(0))
    for i, g in enumerate(groups, 1):
        rows = rows.unionByName(g.withColumn("part", F.lit(i)))
    return _placed(rows.withColumnRenamed("seq", "at"), F.col("part"), F.col("at"))


def interleaved(groups: list[DataFrame]) -> DataFrame:
    """One row from each group in turn, each chunk where it comes first."""
    rows = None
    for i, g in enumerate(groups):
        part = g.withColumn("part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    first = Window.partitionBy("query_id", "chunk_id").orderBy("seq", "part")
    once = rows.withColumn("k", F.row_number().over(first)).where("k = 1").withColumnRenamed("seq", "at")
    return _placed(once, F.col("at"), F.col("part"))


def named_first(pool: DataFrame, named: DataFrame) -> DataFrame:
    """The pool with what the question names ahead of BM25's guesses."""
    mark = named.select("query_id", "chunk_id", F.col("seq").alias("named"))
    rows = pool.join(mark, ["query_id", "chunk_id"], "left").withColumnRenamed("seq", "at")
    return _placed(rows, F.col("named").isNull(), F.col("named"), F.col("at"))


def by_score(pool: DataFrame, scored: DataFrame) -> DataFrame:
    """The pool by score, chunks without one last, ties as they were; with the score."""
    rows = pool.join(scored.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left").withColumnRenamed("seq", "at")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "at")
    return rows.withColumn("seq", F.row_number().over(w)).drop("at")


def type_shares(corpus, pool: DataFrame) -> DataFrame:
    """(query_id, type, in_pool, in_map): share of each type among a query's candidates and in the whole map."""
    placed = corpus.placed().where("type is not null").select("chunk_id", "type")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    whole = placed.groupBy("type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("type", (F.col("n") / F.col("total")).alias("in_map"))
    size = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    held = pool.join(placed, "chunk_id").groupBy("query_id", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(*[F.lit(t) for t in (fixed.ARTICLE, fixed.CONFIG_TYPE, fixed.DATASET, fixed.SOURCE_CODE, fixed.TEST)])
    grid = size.select("query_id", "size", F.explode(kinds).alias("type")).join(whole, "type")
    return grid.join(held, ["query_id", "type"], "left").select("query_id", "type", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("in_pool"), "in_map")


def arms(corpus, index: Index, queries: DataFrame, depth: int, scope: Scope = Scope()) -> DataFrame:
    """(arm, query_id, chunk_id, seq, via, bm25_rank): pools widened in several ways on the same queries.

    base; all types; code only; types rarer in the pool than in the map; named
    symbols; the same with symbols first; code and symbols; and for each a
    plain BM25 pool of the same size.
    """
    base = materialize(seeds(index, queries, depth, _allowed(corpus, scope)), "base")
    shares = materialize(type_shares(corpus, base), "shares")
    typed = best_of_types(corpus, index, queries, shares, depth, scope)
    likely = {"all": shares, "code": shares.where(F.col("type") == fixed.SOURCE_CODE), "under": shares.where("in_pool < in_map")}
    pools = {"base": base}
    for arm, some in likely.items():
        added = _typed(typed, chosen_types(some.select("query_id", "type", F.lit(1.0).alias("p"))), base)
        pools[arm] = materialize(appended(base, added), "arm")
    named = _best_of_named_files(corpus, index, queries, scope), materialize(_defining(corpus, queries, scope), "defining")
    symbols = materialize(by_symbols(corpus, index, queries, base, depth, scope, named), "symbols")
    pools["sym"] = materialize(appended(base, symbols), "arm")
    pools["symfirst"] = named_first(pools["sym"], symbols)
    pools["code+sym"] = materialize(appended(pools["code"], by_symbols(corpus, index, queries, pools["code"], depth, scope, named)), "arm")
    sizes = {arm: pools[arm].groupBy("query_id").agg(F.count(F.lit(1)).alias("size")) for arm in ("all", "code", "under", "sym", "code+sym")}
    # A smaller pool of the same scores is the head of a larger one.
    most = reduce(DataFrame.unionByName, sizes.values()).groupBy("query_id").agg(F.max("size").alias("k"))
    deepest = bm25.search(index, queries, most, _allowed(corpus, scope))
    for arm, size in sizes.items():
        same = deepest.join(size, "query_id").where(F.col("bm25_rank") <= F.col("size"))
        pools[f"ctl-{arm}"] = same.select("query_id", "chunk_id", F.col("bm25_rank").alias("seq"), F.lit("").alias("via"), "bm25_rank")
    out = None
    for arm, pool in pools.items():
        part = pool.select(F.lit(arm).alias("arm"), *POOL)
        out = part if out is None else out.unionByName(part)
    return out


def _allowed(corpus, scope: Scope) -> DataFrame | None:
    return scope.chunks(corpus).select("chunk_id") if scope.terms else None
