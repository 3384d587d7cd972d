"""Where each hit leads: its links, named by what the map knows for certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import fixed
from passagework.operators.links import both_ways


def chunk_kinds(corpus, chunk_ids: DataFrame) -> DataFrame:
    """(chunk_id, chunk_kind, ticket, title): a noun for what each chunk is.

    By document type, else a ticket's own type, else issue or pull request with
    its state, else a category that is certain enough, else `page`.
    """
    rows = corpus.chunks.select(F.col("id").alias("chunk_id"), "file_id", F.col("heading_path").alias("title")).join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = rows.join(corpus.files.select(F.col("id").alias("file_id"), "type"), "file_id")
    wanted = ["issuetype", "item", "state"]
    meta = corpus.file_meta.where(F.col("key").isin(*wanted)).groupBy("file_id").pivot("key", wanted).agg(F.max("value"))
    rows = rows.join(meta, "file_id", "left")
    noun = F.lit("page")
    if corpus.categories is not None:
        kept = corpus.categories.where("kept").select("chunk_id", "category", "p")
        rows = rows.join(kept, "chunk_id", "left")
        for category, least in fixed.CATEGORY_NOUN_AT.items():
            noun = F.when((F.col("category") == category) & (F.col("p") >= least), fixed.CATEGORY_NOUN[category]).otherwise(noun)
    item = F.when(F.col("item") == "pull", "pull request").otherwise("issue")
    item = F.concat(item, F.when(F.coalesce("state", F.lit("")) != "", F.concat(F.lit(" ("), "state", F.lit(")"))).otherwise(""))
    noun = F.when(F.coalesce("issuetype", F.lit("")) != "", F.lower("issuetype")).when(F.coalesce("item", F.lit("")) != "", item).otherwise(noun)
    for kind, name in fixed.TYPE_NOUN.items():
        noun = F.when(F.col("type") == kind, name).otherwise(noun)
    return rows.select("chunk_id", noun.alias("chunk_kind"), (F.coalesce("issuetype", F.lit("")) != "").alias("ticket"), "title")


def own_verb(text: Column, name: Column) -> Column:
    """The verb of a ticket's own link line `- verb NAME ...`; empty where it has none."""
    line = F.concat(F.lit(r"(?im)^\s*-\s+(.+?)\s+\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.call_function("regexp_extract", text, line, F.lit(1))


def named_links(corpus, hits: DataFrame, per_hit: int | None = fixed.LINKS_A_HIT) -> DataFrame:
    """(chunk_id, place, rel, dir, via, other, source, coord, kind, fact, title) of the links of `hits` (chunk_id).

    Only links that the texts draw; one a target. Another kind of thing comes
    first, then what one side states before what both only name, then one of
    each kind before a second. Up to `per_hit` of a hit.
    """
    mine = hits.select(F.col("chunk_id").alias("me")).distinct()
    met = mine.join(both_ways(corpus.links.where("rel <> 'about'")), "me")
    first = Window.partitionBy("me", "other").orderBy(F.col("dir") == "in", "rel", "via")
    once = met.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    placed = corpus.placed().select(F.col("chunk_id").alias("other"), "source", F.concat(F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line")).alias("coord"))
    rows = once.join(placed, "other")
    kinds = chunk_kinds(corpus, once.select(F.col("me").alias("chunk_id")).union(once.select("other")))
    own = kinds.select(F.col("chunk_id").alias("me"), F.col("chunk_kind").alias("my_kind"), F.col("ticket").alias("my_ticket"))
    their = kinds.select(F.col("chunk_id").alias("other"), F.col("chunk_kind").alias("kind"), F.col("ticket").alias("their_ticket"), "title")
    rows = rows.join(own, "me").join(their, "other")
    texts = corpus.chunks.select("id", "text")
    rows = rows.join(texts.select(F.col("id").alias("me"), F.col("text").alias("my_text")), "me").join(texts.select(F.col("id").alias("other"), F.col("text").alias("their_text")), "other")
    defined = corpus.idents.where("role = 'defines'").select("chunk_id", F.col("ident").alias("via")).distinct()
    rows = rows.join(defined.select(F.col("chunk_id").alias("me"), "via", F.lit(True).alias("i_define")), ["me", "via"], "left")
    rows = rows.join(defined.select(F.col("chunk_id").alias("other"), "via", F.lit(True).alias("they_define")), ["other", "via"], "left")
    tickets = F.col("my_ticket") & F.col("their_ticket")
    out_verb = F.when(tickets, own_verb(F.col("my_text"), F.col("via"))).otherwise("")
    in_verb = F.when(tickets, own_verb(F.col("their_text"), F.col("via"))).otherwise("")
    too = F.concat(F.lit("names "), "via", F.lit(" too"))
    outward = F.when(out_verb != "", out_verb).when(F.col("they_define"), F.concat(F.lit("defines "), "via")).otherwise(too)
    inward = F.when(in_verb != "", F.concat(in_verb, F.lit(" this"))).when(F.col("i_define"), F.concat(F.lit("uses "), "via")).otherwise(too)
    closed = F.regexp_extract("my_text", r"(?i)(?<![\p{L}\p{N}_])(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+(?:[\p{L}\p{N}_.-]+/[\p{L}\p{N}_.-]+)?#(\p{Nd}+)", 1)
    closes = (closed != "") & F.coalesce(F.call_function("regexp_like", F.coalesce("title", F.lit("")), F.concat(F.lit("#"), closed, F.lit(r"(?![\p{L}\p{N}_])"))), F.lit(False))
    cited = F.when(F.col("dir") == "in", "links here").when(closes, "closes").otherwise("links to")
    fact = F.when(F.col("rel") == "citation", cited).when(F.col("dir") == "out", outward).otherwise(inward)
    rows = rows.withColumn("fact", fact)
    order = [F.col("kind") == F.col("my_kind"), F.col("fact").endswith(" too"), F.col("dir") == "in", F.col("rel"), F.col("source"), F.col("coord"), F.col("other")]
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("me").orderBy(*order)))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("me", "kind").orderBy("at")) > 1)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("me").orderBy("again", "at")))
    if per_hit is not None:
        rows = rows.where(F.col("place") <= per_hit)
    return rows.select(F.col("me").alias("chunk_id"), "place", "rel", "dir", "via", "other", "source", "coord", "kind", "fact", "title")


def hit_rows(corpus, pool: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The hits of a pool as they are shown: text is read for these rows only; `links` become an array of structs."""
    placed = corpus.placed("heading_path")
    texts = corpus.chunks.select(F.col("id").alias("chunk_id"), "text")
    rows = pool.join(placed, "chunk_id").join(texts, "chunk_id")
    if links is not None:
        shown = F.struct("place", "rel", "dir", "via", "source", "coord", "kind", "fact", "title")
        rows = rows.join(links.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x.dropFields("place")).alias("links")), "chunk_id", "left")
    score = [F.col("score")] if "score" in pool.columns else [F.lit(None).cast("double").alias("score")]
    keep = ["links"] if links is not None else []
    return rows.select("query_id", "seq", "chunk_id", "source", "path", "root", "start_line", "end_line", "heading_path", "type", *score, "bm25_rank", "via", "text", *keep)


def by_type_groups(hits: DataFrame) -> DataFrame:
    """Hits with `group_place`: document types in order of their best hit."""
    best = F.min("seq").over(Window.partitionBy("query_id", F.coalesce("type", F.lit("(untyped)"))))
    ranked = hits.withColumn("best", best)
    return ranked.withColumn("group_place", F.dense_rank().over(Window.partitionBy("query_id").orderBy("best"))).drop("best")
