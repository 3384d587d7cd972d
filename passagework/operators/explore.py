"""Looking at a map: grep, ls, sources, read and show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import fixed, text
from passagework.functions.text import coordinate
from passagework.operators import widen
from passagework.operators.index import Index
from passagework.operators.links import both_ways, overlap
from passagework.operators.scope import Scope

FENCE = r"^\s*(?:```|~~~)"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"


def matching_lines(corpus, pattern: str, ignore_case: bool = False, scope: Scope = Scope(), changed: DataFrame | None = None) -> DataFrame:
    """(source, path, line, text) of every line of the files in scope that matches.

    A text is tested as a whole before it is cut into lines. `changed` is
    (file_id, text): files whose text is newer than the map's. A pattern with
    `^` or `$` is tested line by line only, so it finds lines in the middle of
    a file too.
    """
    rx = ("(?i)" if ignore_case else "") + pattern
    files = scope.files(corpus).select("file_id", "source", "path")
    texts = corpus.file_texts.select("file_id", "text")
    if changed is not None:
        texts = texts.join(changed.select("file_id"), "file_id", "left_anti").unionByName(changed.select("file_id", "text"))
    if not any(c in pattern for c in "^$"):
        texts = texts.where(F.col("text").rlike(rx))
    lines = files.join(texts, "file_id").select("source", "path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(F.col("text").rlike(rx)).select("source", "path", (F.col("line") + 1).alias("line"), F.rtrim("text").alias("text"))


def grep(corpus, pattern: str, ignore_case: bool = False, scope: Scope = Scope(), most: int = fixed.GREP_LINES) -> tuple[DataFrame, DataFrame]:
    """The first `most` matching lines in order, and (total, files) over all of them."""
    found = matching_lines(corpus, pattern, ignore_case, scope)
    totals = found.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("source", "path").alias("files"))
    return found.orderBy("source", "path", "line").limit(most), totals


def folder_entries(corpus, source: str, prefix: str = "") -> DataFrame:
    """(name, files, chunks): what lies right under a folder; `files` is null for a file.

    A source or folder that is not in the map has no entries.
    """
    under = prefix.strip("/") + "/" if prefix.strip("/") else ""
    files = corpus.placed_files().where((F.col("source") == source) & F.col("path").startswith(under)).select("file_id", "path")
    counts = corpus.chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    rest = F.substring(F.col("path"), len(under) + 1, 1 << 30)
    rows = files.join(counts, "file_id", "left").select(rest.alias("rest"), F.coalesce("n", F.lit(0)).alias("n"))
    name = F.when(F.instr("rest", "/") > 0, F.concat(F.substring_index("rest", "/", 1), F.lit("/"))).otherwise(F.col("rest"))
    grouped = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"))
    return grouped.select("name", F.when(F.col("name").endswith("/"), F.col("files")).alias("files"), "chunks")


def file_chunks(corpus, source: str, path: str) -> DataFrame:
    """(coord, kind, heading_path) of a file's chunks in order of line."""
    rows = corpus.placed("kind", "heading_path").where((F.col("source") == source) & (F.col("path") == path))
    return rows.select(coord_of("source", "path", "start_line", "end_line").alias("coord"), "kind", "heading_path", "start_line").orderBy("start_line").drop("start_line")


def coord_of(source: str, path: str, start: str, end: str) -> Column:
    return F.concat(F.col(source), F.lit(":"), F.col(path), F.lit(":"), F.col(start), F.lit("-"), F.col(end))


def source_rows(corpus) -> DataFrame:
    """Every source with its files and chunks, those without any too."""
    per_file = corpus.chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    files = corpus.files.select(F.col("id").alias("file_id"), "source_id").join(per_file, "file_id", "left")
    counts = files.groupBy("source_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    s = corpus.sources.select(F.col("id").alias("source_id"), "name", "kind", "public", "indexed_at")
    return s.join(counts, "source_id", "left").select("name", "kind", "public", "indexed_at", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def read(corpus, targets: DataFrame) -> DataFrame:
    """(target, source, path, start_line, end_line, heading_path, text) of coordinates.

    `targets` has (target). Lines are kept inside the file; a coordinate
    without lines is the whole file; one that names nothing gives no row.
    `heading_path` is that of the last chunk that begins at or before the start.
    """
    asked = targets.select("target", coordinate(F.col("target")).alias("c")).where("c.source is not null").select("target", "c.*")
    held = asked.join(corpus.placed_files().select("file_id", "source", "path"), ["source", "path"]).join(corpus.file_texts.select("file_id", "text"), "file_id")
    lines = F.split("text", "\n")
    n = F.size(lines)
    start = F.greatest(F.coalesce("start", F.lit(1)), F.lit(1))
    end = F.least(n, F.greatest(start, F.coalesce("end", n)))
    cut = held.select("target", "source", "path", "file_id", start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n").alias("text"))
    before = corpus.chunks.select("file_id", F.col("start_line").alias("at"), F.col("id"), "heading_path")
    heads = cut.select("target", "file_id", "start_line").join(before, "file_id").where("at <= start_line").groupBy("target", "file_id").agg(F.max_by("heading_path", F.struct("at", "id")).alias("heading_path"))
    return cut.join(heads, ["target", "file_id"], "left").select("target", "source", "path", "start_line", "end_line", "heading_path", "text")


def sections(texts: DataFrame) -> DataFrame:
    """(key, start_line, end_line) of the section that a fragment names.

    `texts` is (key, text, fragment). The fragment is compared with headings
    outside code fences by letters and digits alone; the section runs to the
    next heading of its level or above. The whole text, if nothing matches.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    lines = texts.select("key", "fragment", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    order = Window.partitionBy("key").orderBy("i")
    fence = F.col("line").rlike(FENCE)
    marked = lines.withColumn("open", F.sum(fence.cast("int")).over(order) % 2)
    level = F.length(F.regexp_extract("line", HEADING, 1))
    heads = marked.where((F.col("open") == 0) & ~fence & F.col("line").rlike(HEADING)).select("key", "fragment", (F.col("i") + 1).alias("n"), level.alias("level"), bare(F.regexp_extract("line", HEADING, 2)).alias("name"))
    first = heads.where((F.coalesce("fragment", F.lit("")) != "") & (F.col("name") == bare(F.col("fragment")))).groupBy("key").agg(F.min(F.struct("n", "level")).alias("s")).select("key", "s.*")
    after = first.alias("s").join(heads.alias("h"), (F.col("s.key") == F.col("h.key")) & (F.col("h.n") > F.col("s.n")) & (F.col("h.level") <= F.col("s.level"))).groupBy("s.key").agg(F.min("h.n").alias("next"))
    size = texts.select("key", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("size"))
    told = size.join(first.select("key", "n"), "key", "left").join(after, "key", "left")
    return told.select("key", F.coalesce("n", F.lit(1)).alias("start_line"), F.coalesce(F.col("next") - 1, F.col("size")).alias("end_line"))


def read_urls(corpus, targets: DataFrame) -> DataFrame:
    """(target, source, path, start_line, end_line, text) of addresses of mirrored items; a fragment narrows to its section."""
    from passagework.operators.links import located

    asked = targets.select("target").withColumn("at", located("target")).where("at.item is not null").select("target", "at.*")
    items = corpus.mirror_items.where("url <> ''").select("source_id", "path", "url").withColumn("at", located("url")).select("source_id", "path", "at.host", "at.kind", "at.item")
    files = corpus.placed_files().select("file_id", "source_id", "source", "path")
    held = asked.join(items, ["host", "kind", "item"]).join(files, ["source_id", "path"]).join(corpus.file_texts.select("file_id", "text"), "file_id")
    spans = sections(held.select(F.col("target").alias("key"), "text", "fragment"))
    rows = held.join(spans.withColumnRenamed("key", "target"), "target")
    return rows.select("target", "source", "path", "start_line", "end_line", F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("text"))


def shown_chunks(corpus, targets: DataFrame) -> DataFrame:
    """(target, chunk_id, ...): the chunks that the lines of a coordinate touch."""
    asked = targets.select("target", coordinate(F.col("target")).alias("c")).where("c.source is not null").select("target", "c.*")
    rows = asked.join(corpus.placed("kind", "heading_path", "parent_id"), ["source", "path"])
    whole = F.col("start").isNull()
    rows = rows.where(whole | overlap(F.col("start_line"), F.col("end_line"), F.col("start"), F.col("end")))
    # The node's own lines: those asked for, else the whole file.
    return rows.select("target", "chunk_id", "file_id", "source", "path", F.coalesce("start", F.lit(1)).alias("from_line"), F.coalesce("end", F.lit((1 << 31) - 1)).alias("to_line"), "start_line", "end_line", "kind", "heading_path", "parent_id", "type", "lang")


def shown_names(corpus, chunks: DataFrame) -> DataFrame:
    """(target, chunk_id, defines, mentions): sorted names of the shown chunks."""
    names = chunks.select("target", "chunk_id").join(corpus.idents.select("chunk_id", "ident", "role"), "chunk_id", "left")

    def of(role: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("ident")))).alias(role)

    return names.groupBy("target", "chunk_id").agg(of("defines"), of("mentions"))


def shown_links(corpus, chunks: DataFrame) -> DataFrame:
    """(target, place, dir, rel, via, other): links out of the shown chunks, one a relation and chunk.

    A pair linked both ways is `both` with the names of either side; `about`
    links have the direction `~`. Citations first, then mentions, then about.
    """
    mine = chunks.select("target", F.col("chunk_id").alias("me"))
    met = mine.join(both_ways(corpus.links), "me")
    inside = mine.select("target", F.col("me").alias("other"))
    away = met.join(inside, ["target", "other"], "left_anti")
    told = away.groupBy("target", "rel", "other").agg(F.array_sort(F.collect_set("dir")).alias("dirs"), F.collect_set(F.struct((F.col("dir") == "in").alias("back"), "via")).alias("named"))
    names = F.array_join(F.array_distinct(F.transform(F.array_sort("named"), lambda x: x["via"])), ", ")
    direction = F.when(F.col("rel") == "about", "~").when(F.size("dirs") > 1, "both").otherwise(F.col("dirs")[0])
    # A relation met in one direction only is named once, as it was first drawn.
    first = F.array_min("named")["via"]
    via = F.when((F.size("dirs") > 1) & (F.col("rel") != "about"), names).otherwise(first)
    order = F.when(F.col("rel") == "citation", 0).when(F.col("rel") == "mentions", 1).when(F.col("rel") == "about", 2).otherwise(3)
    rows = told.select("target", direction.alias("dir"), "rel", via.alias("via"), "other", order.alias("o"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("o", F.col("dir") == "in", "other"))).drop("o")


def shown_structure(corpus, chunks: DataFrame) -> DataFrame:
    """(target, rel, other): the section around the first shown chunk, and the chunks right before and after the lines."""
    first = chunks.groupBy("target").agg(F.min_by(F.struct("parent_id", "file_id", "from_line", "to_line"), F.struct("start_line", "chunk_id")).alias("f")).select("target", "f.*")
    own = chunks.select("target", F.col("chunk_id").alias("other"))
    parent = first.where("parent_id is not null").select("target", F.lit("parent").alias("rel"), F.col("parent_id").alias("other")).join(own, ["target", "other"], "left_anti")
    around = first.join(corpus.chunks.select("file_id", F.col("id").alias("other"), "start_line", "end_line"), "file_id")
    before = around.where("end_line < from_line").groupBy("target").agg(F.max_by("other", F.struct("start_line", "other")).alias("other")).select("target", F.lit("before").alias("rel"), "other")
    after = around.where("start_line > to_line").groupBy("target").agg(F.min_by("other", F.struct("start_line", "other")).alias("other")).select("target", F.lit("after").alias("rel"), "other")
    return parent.select("target", "rel", "other").unionByName(before).unionByName(after)


def shown_similar(corpus, index: Index, chunks: DataFrame, most: int = fixed.SIMILAR_SHOWN) -> DataFrame:
    """(target, place, other): chunks of other files that share the most distinctive words of the shown ones."""
    texts = chunks.select("target", "chunk_id", "start_line").join(corpus.chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    joined = texts.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    files = chunks.select(F.col("target").alias("query_id"), "file_id").distinct()
    words = widen.distinctive_words(index, joined.select(F.col("target").alias("query_id"), "text"))
    near = widen.similar(index, words, corpus.chunks.select(F.col("id").alias("chunk_id"), "file_id"), files, most=most)
    return near.select(F.col("query_id").alias("target"), F.col("rank").alias("place"), F.col("chunk_id").alias("other"))


def neighbours_in_file(corpus) -> DataFrame:
    """(chunk_id, before, after): the chunks next to each in its file, by line, then id."""
    w = Window.partitionBy("file_id").orderBy("start_line", "id")
    return corpus.chunks.select(F.col("id").alias("chunk_id"), F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


def snippets(corpus, chunk_ids: DataFrame) -> DataFrame:
    rows = corpus.chunks.select(F.col("id").alias("chunk_id"), "text").join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi")
    return rows.select("chunk_id", text.snippet(F.col("text")).alias("snippet"))
