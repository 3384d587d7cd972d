"""Links between chunks, drawn from what the texts say.

`citation`: a written link resolves to a file or heading. `mentions`: a chunk
names what another defines, or two share a rare name. Names that are defined in
too many places, or shared too widely, are cut before the join that would
multiply them; what is left has a bounded number of partners.
"""

from __future__ import annotations

import re
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import fixed


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(file_id, first_chunk): a file's first chunk by line, then id."""
    return chunks.groupBy("file_id").agg(F.min_by("id", F.struct("start_line", "id")).alias("first_chunk"))


def anchored_chunks(chunks: DataFrame) -> DataFrame:
    """(file_id, anchor, anchored_chunk): the first chunk of a file with an anchor."""
    return chunks.where("anchor <> ''").groupBy("file_id", "anchor").agg(F.min_by("id", F.struct("start_line", "id")).alias("anchored_chunk"))


def citations(corpus) -> DataFrame:
    """(src, dst, via): written links to files of the same source.

    The target is the first chunk with the named anchor, else the file's first
    chunk. A link that resolves to nothing, or to its own chunk, is none.
    """
    files = corpus.files.select(F.col("id").alias("file_id"), "source_id", "path")
    origin = corpus.chunks.select(F.col("id").alias("chunk_id"), "file_id").join(files.drop("path"), "file_id").select("chunk_id", "source_id")
    named = corpus.refs.join(origin, "chunk_id").withColumn("anchor", F.lower("target_anchor"))
    target = named.join(files.withColumnRenamed("path", "target_path"), ["source_id", "target_path"])
    found = target.join(anchored_chunks(corpus.chunks), ["file_id", "anchor"], "left").join(first_chunks(corpus.chunks), "file_id", "left")
    via = F.concat("target_path", F.when(F.col("target_anchor") != "", F.concat(F.lit("#"), "target_anchor")).otherwise(""))
    links = found.select(F.col("chunk_id").alias("src"), F.coalesce("anchored_chunk", "first_chunk").alias("dst"), via.alias("via"))
    return links.where("dst is not null and src <> dst").distinct()


def item_of_url(url: str | None) -> tuple[str, str, str, str] | None:
    """(host, kind, item, fragment) of a URL that names one item of a known kind of site, however it is spelled."""
    if not url:
        return None
    try:
        u = urllib.parse.urlparse(url)
        host = (u.hostname or "").lower()
    except ValueError:
        return None
    if u.scheme not in ("http", "https") or not host:
        return None
    asked = urllib.parse.parse_qs(u.query)
    if m := re.search(r"/browse/([A-Z][A-Z0-9_]+-\d+)", u.path):
        key: str | None = m[1]
    else:
        key = asked.get("selectedIssue", [None])[0]
    if key:
        comment = asked.get("focusedCommentId", [""])[0]
        return host, "jira", key, f"focusedCommentId={comment}" if comment else ""
    if m := re.fullmatch(r"/[^/]+/[^/]+/(?:issues|pull)/(\d+)/?(?:.*)", u.path):
        return host, "github", m[1], u.fragment
    page = m[1] if (m := re.search(r"/pages/(\d+)", u.path)) else asked.get("pageId", [None])[0]
    if page:
        return host, "confluence", page, urllib.parse.unquote(u.fragment)
    # Any other address is an item by its whole path.
    return host, "path", u.path.rstrip("/"), urllib.parse.unquote(u.fragment)


def located(url: str) -> Column:
    """struct<host, kind, item, fragment> of a column of URLs; null fields where they name no item."""

    @F.pandas_udf("host string, kind string, item string, fragment string")
    def told(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([item_of_url(u) or (None,) * 4 for u in urls], columns=["host", "kind", "item", "fragment"])

    return told(F.col(url))


def url_citations(corpus) -> DataFrame:
    """(src, dst, via): absolute links to items that a source mirrors.

    Both the link and the recorded address are read as (host, kind, item), so
    the spelling of either does not matter. The target is the heading that the
    fragment names, if the file has it, else the item's first chunk.
    """
    wanted = corpus.refs.where(F.col("target_path").rlike("^https?://")).select("chunk_id", F.col("target_path").alias("via")).distinct()
    wanted = wanted.withColumn("at", located("via")).where("at.item is not null").select("chunk_id", "via", "at.*")
    kinds = corpus.sources.where("kind <> 'dir'").select(F.col("id").alias("source_id"), F.col("origin"))
    items = corpus.mirror_items.where("url <> ''").select("source_id", "path", "url").join(kinds, "source_id").withColumn("at", located("url")).where("at.item is not null")
    files = corpus.files.select(F.col("id").alias("file_id"), "source_id", "path")
    held = items.join(files, ["source_id", "path"]).groupBy("at.host", "at.kind", "at.item").agg(F.min("file_id").alias("file_id"))
    found = wanted.join(held, ["host", "kind", "item"])
    anchor = F.lower(F.translate("fragment", "+ ", "--"))
    found = found.withColumn("anchor", anchor).join(anchored_chunks(corpus.chunks), ["file_id", "anchor"], "left").join(first_chunks(corpus.chunks), "file_id", "left")
    return found.select(F.col("chunk_id").alias("src"), F.coalesce("anchored_chunk", "first_chunk").alias("dst"), "via").where("dst is not null and src <> dst").distinct()


def definers(idents: DataFrame, most: int = fixed.MAX_DEFINERS) -> DataFrame:
    """(ident): names that few enough rows define to mean something."""
    return idents.where("role = 'defines'").groupBy("ident").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("ident")


def definition_mentions(corpus) -> DataFrame:
    """(src, dst, via): a chunk that mentions a name, and the chunks that define it."""
    few = definers(corpus.idents)
    defined = corpus.idents.where("role = 'defines'").join(few, "ident", "left_semi").select("ident", F.col("chunk_id").alias("dst")).distinct()
    named = corpus.idents.where("role = 'mentions'").select("ident", F.col("chunk_id").alias("src")).distinct()
    return named.join(defined, "ident").where("src <> dst").select("src", "dst", F.col("ident").alias("via"))


def _shared(mentions: DataFrame) -> DataFrame:
    """Ordered pairs (src, dst, via) of chunks of different files that share a name of `mentions`
    (ident, chunk_id, file_id) which 2 to MAX_SHARED chunks of at least 2 files mention.

    The counts come first, so that the join that follows meets at most
    MAX_SHARED chunks a name.
    """
    rare = mentions.groupBy("ident").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("file_id").alias("files"))
    rare = rare.where(F.col("chunks").between(2, fixed.MAX_SHARED) & (F.col("files") >= 2)).select("ident")
    held = mentions.join(rare, "ident", "left_semi").distinct()
    a = held.select("ident", F.col("chunk_id").alias("src"), F.col("file_id").alias("fa"))
    b = held.select("ident", F.col("chunk_id").alias("dst"), F.col("file_id").alias("fb"))
    return a.join(b, "ident").where("fa <> fb").select("src", "dst", F.col("ident").alias("via"))


def shared_names(corpus) -> DataFrame:
    """(src, dst, via): chunks that share a rare name with a sign in it that nothing defines."""
    named = corpus.idents.where("role = 'mentions'").where(F.col("ident").rlike("[_./-]"))
    free = named.join(corpus.idents.where("role = 'defines'").select("ident"), "ident", "left_anti")
    return _shared(free.select("ident", "chunk_id").join(corpus.chunks.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id"))


def prose_mentions(corpus) -> DataFrame:
    """(src, dst, via): prose chunks that mention the same defined name."""
    prose = corpus.files.where(F.col("lang").isin("markdown", "text")).select(F.col("id").alias("file_id"))
    chunks = corpus.chunks.select(F.col("id").alias("chunk_id"), "file_id").join(prose, "file_id", "left_semi")
    named = corpus.idents.where("role = 'mentions'").select("ident", "chunk_id").join(definers(corpus.idents), "ident", "left_semi")
    return _shared(named.join(chunks, "chunk_id"))


def all_links(corpus, judged: DataFrame | None = None) -> DataFrame:
    """(src, dst, rel, via): one link a pair and relation; `judged` ones are kept beside them.

    Where a pair is linked in several ways the first of these names it: written
    links, addresses, definitions, shared names, prose; then the smallest name.
    """
    drawn = [(citations(corpus), "citation", 0), (url_citations(corpus), "citation", 1), (definition_mentions(corpus), "mentions", 2), (shared_names(corpus), "mentions", 3), (prose_mentions(corpus), "mentions", 4)]
    out = None
    for df, rel, order in drawn:
        part = df.select("src", "dst", F.lit(rel).alias("rel"), F.lit(order).alias("order"), "via")
        out = part if out is None else out.unionByName(part)
    named = out.groupBy("src", "dst", "rel").agg(F.min(F.struct("order", "via")).alias("first"))
    links = named.select("src", "dst", "rel", F.col("first.via").alias("via"))
    return links if judged is None else links.unionByName(judged.select("src", "dst", "rel", "via"))


def link_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("rel").agg(F.count(F.lit(1)).alias("links"))


def both_ways(links: DataFrame) -> DataFrame:
    """(me, other, rel, via, dir): every link from both of its ends."""
    out = links.select(F.col("src").alias("me"), F.col("dst").alias("other"), "rel", "via", F.lit("out").alias("dir"))
    back = links.select(F.col("dst").alias("me"), F.col("src").alias("other"), "rel", "via", F.lit("in").alias("dir"))
    return out.unionByName(back)


def without(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links that touch none of `chunks` (chunk_id), as when files are dropped."""
    gone = chunks.select(F.col("chunk_id").alias("gone")).distinct()
    return links.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")


def drawn_titles(passages: DataFrame, titles: DataFrame, most_pages: int = 50) -> DataFrame:
    """(page_id, title, target, start): where a page first names another page's title.

    `passages` (page_id, text), `titles` (page_id, title) of any length. Where
    the first two words of a title stand in a text (one word for titles of
    one), the runs as long as the titles that begin so are compared with all
    titles; of the titles that begin at a word the longest holds, titles named
    on more than `most_pages` pages are skipped, and only a page's first
    mention of a title counts.
    """
    from passagework.functions.words import words

    def opening(a: Column, b: Column) -> Column:
        # A hash picks the places only; what stands there is compared in full.
        return F.xxhash64(a, b)

    held = passages.select(F.col("page_id"), words(F.col("text")).alias("w"))
    known = titles.select(F.col("page_id").alias("target"), "title", words(F.col("title")).alias("tw")).where(F.size("tw") > 0)
    known = known.select("target", "title", F.size("tw").alias("n"), opening(F.get("tw", F.lit(0)), F.get("tw", F.lit(1))).alias("opening"), F.array_join("tw", " ").alias("key"))
    lengths = known.groupBy("opening").agg(F.collect_set("n").alias("lengths"))
    ones, twos = F.transform("w", lambda a: opening(a, F.lit(None))), F.transform("w", lambda a, i: opening(a, F.get("w", i + 1)))
    openings = held.select("page_id", F.explode(F.array_distinct(F.concat(twos, ones))).alias("opening"))
    begun = openings.join(lengths, "opening").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("opening", "lengths"))).alias("begun"))
    lengths_of = lambda key: F.coalesce(F.try_element_at("begun", key), F.array().cast("array<int>"))
    probed = lambda a, i: F.filter(F.array_union(lengths_of(opening(a, F.get("w", i + 1))), lengths_of(opening(a, F.lit(None)))), lambda n: i + n <= F.size("w"))
    runs = F.flatten(F.transform("w", lambda a, i: F.transform(probed(a, i), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("key")))))
    spans = held.join(begun, "page_id").select("page_id", F.explode(runs).alias("r")).select("page_id", "r.at", "r.n", "r.key")
    # A page's own title is no mention, though another page may have the same.
    other = spans.join(known.select(F.col("target").alias("page_id"), "key"), ["page_id", "key"], "left_anti")
    named = other.join(known.select("target", "title", "key"), "key")
    longest_at = named.groupBy("page_id", "at").agg(F.max(F.struct("n", F.col("target"), "title")).alias("m")).select("page_id", "at", "m.*")
    common = longest_at.groupBy("target").agg(F.countDistinct("page_id").alias("pages")).where(F.col("pages") <= most_pages).select("target")
    first = Window.partitionBy("page_id", "target").orderBy("at")
    return longest_at.join(common, "target", "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").select("page_id", "title", "target", F.col("at").alias("start"))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two spans of lines share a line."""
    return (end >= other_start) & (start <= other_end)
