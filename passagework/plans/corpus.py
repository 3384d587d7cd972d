"""The tables of a map, and the joins that every path uses."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import fixed, text
from passagework.sources.tables import table


@dataclass(frozen=True)
class Corpus:
    """One map: its sources, files, chunks and what is drawn from them."""

    sources: DataFrame
    files: DataFrame
    file_texts: DataFrame
    chunks: DataFrame
    idents: DataFrame
    refs: DataFrame
    file_meta: DataFrame
    mirror_items: DataFrame
    links: DataFrame | None = None
    categories: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> Corpus:
        return replace(self, **tables)

    def placed(self, *more: str) -> DataFrame:
        """Chunks with file and source: chunk_id, file_id, source, path, type, lang, start_line, end_line and `more`.

        The long text is joined by those who ask for it, after they have cut down the rows.
        """
        c = self.chunks.select(F.col("id").alias("chunk_id"), "file_id", "start_line", "end_line", *[m for m in more if m in self.chunks.columns])
        f = self.files.select(F.col("id").alias("file_id"), "source_id", "path", "type", "lang")
        s = self.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), F.col("kind").alias("source_kind"), "public", "root", "origin")
        keep = ["source", "path", "type", "lang", "source_kind", "public", "root", "origin"]
        return c.join(f, "file_id").join(s, "source_id").select("chunk_id", "file_id", "source_id", "start_line", "end_line", *[m for m in more if m in self.chunks.columns], *keep)

    def placed_files(self) -> DataFrame:
        f = self.files.select(F.col("id").alias("file_id"), "source_id", "path", "type", "lang", "size", "mtime_ns")
        s = self.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), F.col("kind").alias("source_kind"), "public", "root")
        return f.join(s, "source_id")


def exploded_meta(files: DataFrame, mirror_items: DataFrame) -> DataFrame:
    """(file_id, key, value): one row a value of each item's fields; empty and null values dropped.

    An item without a file, or without fields, has none; a value that an item
    lists twice is kept twice.
    """
    items = mirror_items.select("source_id", "path", F.explode("meta").alias("key", "values"))
    rows = items.select("source_id", "path", "key", F.explode("values").alias("value")).where(F.col("value") != "")
    return files.select(F.col("id").alias("file_id"), "source_id", "path").join(rows, ["source_id", "path"]).select("file_id", "key", "value")


def markdown_refs(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, target_path, target_anchor): the links that chunks kept as Markdown write, in any number."""
    written = files.where(F.col("lang").isin(*fixed.WRITTEN_AS_MARKDOWN)).select(F.col("id").alias("file_id"), "path")
    some = chunks.where(F.col("text").contains("](")).select(F.col("id").alias("chunk_id"), "file_id", "text").join(written, "file_id")
    return some.select("chunk_id", F.explode(text.link_targets(F.col("text"), F.col("path"))).alias("r")).select("chunk_id", "r.target_path", "r.target_anchor")


def from_directory(spark: SparkSession, d: str) -> Corpus:
    """The map of a data directory."""
    t = {n: table(spark, d, n) for n in ("sources", "files", "file_texts", "chunks", "idents", "mirror_items")}
    # Names are compared in one form; the table has them as they were written, and some rows twice.
    t["idents"] = t["idents"].select("chunk_id", text.norm_name(F.col("ident")).alias("ident"), "role").where("ident <> ''").distinct()
    return Corpus(refs=markdown_refs(t["chunks"], t["files"]), file_meta=exploded_meta(t["files"], t["mirror_items"]), **t)
