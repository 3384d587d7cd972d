"""The engine: one map in a warehouse folder, brought in line by syncs and asked by DataFrames."""

from __future__ import annotations

import datetime
import os
import uuid
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import fixed, text
from passagework.operators import chunking, explore, facts, index, links, sync
from passagework.operators.rank import make_ranker
from passagework.operators.scope import Scope
from passagework.operators.store import SCHEMAS, Store
from passagework.plans import search as searching
from passagework.plans.corpus import Corpus
from passagework.session import materialize, shared_dir
from passagework.sources import files as file_source
from passagework.sources.remote import Registry, RemoteError, built_in, clean_meta

PER_SOURCE = ("files", "file_texts", "chunks", "idents", "refs", "file_meta", "mirror_items", "chunk_categories", "postings", "chunk_lens")
#: Documents of a remote source that are held before they are written.
DOCUMENTS_AT_A_TIME = 500
#: Tables of the map that a corpus holds.
OF_CORPUS = ("sources", "files", "file_texts", "chunks", "idents", "refs", "file_meta", "mirror_items", "links")


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str, registry: Registry | None = None):
        self.spark, self.store = spark, Store(spark, warehouse)
        self.registry = registry or built_in()

    # ---- writing

    def init(self, root: str, name: str | None = None, public: bool = False, excludes: list[str] = (), full: bool = False) -> DataFrame:
        """Bring a folder's part of the map in line with its files; one row of counts."""
        base = self.store.version()
        name = name or os.path.basename(root.rstrip("/"))
        listing = file_source.list_files(self.spark, root, list(excludes), file_source.tracked_files(root))
        texts = materialize(file_source.read_texts(self.spark, listing), "texts")
        return self._take(name, root, public, list(excludes), "dir", "", texts, None, None, full, base)

    def sync(self, url: str, name: str | None = None, public: bool = False, remote=None) -> DataFrame:
        """Mirror a remote source: list, fetch what is new or changed, and index it; one row of counts."""
        base = self.store.version()
        found = self.registry.for_url(url)
        if found is None:
            raise RemoteError(f"no connector takes {url}")
        kind, origin = found
        module = self.registry.kinds[kind]
        remote = remote or module.Remote(origin)
        name = name or remote.name
        held = self.store.read("sources").where(F.col("name") == name).head()
        if held and (held.kind, held.origin) != (kind, origin):
            raise RemoteError(f"source {name!r} already is {held.origin or held.root}")
        sid = held.id if held else self._source_id(name)
        old = self.store.read("mirror_items", str(sid))
        entries = remote.listing()
        listed = self.spark.createDataFrame([(sid, i, e.version, e.path, e.url) for i, e in entries.items()], "source_id bigint, item_id string, version string, path string, url string")
        if not entries:
            sync.empty_is_no_deletion(listed, old)
        changes = materialize(sync.item_changes(listed, old), "changes")
        counts = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
        stale = [r.item_id for r in changes.where("status = 'fetched'").select("item_id").toLocalIterator()]
        docs = self._fetched(sid, remote, stale)
        kept = old.select("source_id", "item_id", F.col("anchors").alias("a"), F.col("meta").alias("m"))
        items = listed.join(docs.drop("text"), ["source_id", "item_id"], "left").join(kept, ["source_id", "item_id"], "left")
        items = materialize(items.select("source_id", "item_id", "version", "path", "url", F.coalesce("anchors", "a").alias("anchors"), F.coalesce("meta", "m").alias("meta")), "items")
        old_texts = self.store.read("files", str(sid)).select(F.col("id").alias("file_id"), "path").join(self.store.read("file_texts", str(sid)), "file_id")
        before = old.select("item_id", F.col("path").alias("had")).join(old_texts.select(F.col("path").alias("had"), F.col("text").alias("old_text")), "had")
        texts = items.select("item_id", "path").join(docs.select("item_id", "text"), "item_id", "left").join(before.select("item_id", "old_text"), "item_id", "left")
        body = F.coalesce("text", "old_text")
        texts = texts.where(body.isNotNull()).select("path", F.lit("markdown").alias("lang"), F.octet_length(body).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ns"), F.sha1(body.cast("binary")).alias("sha1"), body.alias("text"), body.alias("shown"))
        told = self._take(name, "", public, [], kind, origin, materialize(texts, "texts"), items, getattr(module, "DOC_TYPE", None), False, base, sid)
        return told.withColumns({k: F.lit(counts.get(k, 0)) for k in ("fetched", "moved", "deleted", "same")})

    def _fetched(self, sid: int, remote, items: list[str]) -> DataFrame:
        """Documents of items, written as they come: no more than a batch of them is held at a time."""
        schema = "source_id bigint, item_id string, text string, anchors map<string,string>, meta map<string,array<string>>"
        rows = ((sid, i, doc.text, doc.anchors, clean_meta(doc.meta)) for i, doc in remote.fetch(items))
        path = f"{shared_dir(self.spark).rstrip('/')}/tables/docs-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], schema).write.parquet(path)
        while batch := list(islice(rows, DOCUMENTS_AT_A_TIME)):
            self.spark.createDataFrame(batch, schema).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def sync_all(self, sources: dict[str, str]) -> DataFrame:
        """(source, ok, message): sync each name -> address; one that fails does not stop the others."""
        told = []
        for name, url in sources.items():
            try:
                self.sync(url, name)
                told.append((name, True, ""))
            except Exception as e:  # noqa: BLE001 - reported in its row
                told.append((name, False, f"{type(e).__name__}: {e}"))
        return self.spark.createDataFrame(told, "source string, ok boolean, message string")

    def _source_id(self, name: str) -> int:
        return self.spark.range(1).select(F.xxhash64(F.lit(name)).alias("h")).head().h

    def _take(self, name, root, public, excludes, kind, origin, texts, items, doc_type, full, base, sid=None) -> DataFrame:
        """Bring a source's part in line with its texts; its tables, its index and the links of the map become visible in one version."""
        sid = sid if sid is not None else self._source_id(name)
        part = str(sid)
        empty = lambda t: self.spark.createDataFrame([], SCHEMAS[t])
        held = {t: empty(t) if full else self.store.read(t, part, base) for t in PER_SOURCE}
        grammars = tuple(lang for lang in fixed.CUT_BY_GRAMMAR if chunking.grammar(lang) is not None)
        usable = texts.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("source_id", F.lit(sid)).withColumn("lang", text.effective_language(F.col("path"), grammars))
        typed = F.lit(doc_type) if doc_type else text.document_type(F.col("path"), F.col("lang"))
        listing = usable.withColumn("type", typed).withColumn("id", F.xxhash64("source_id", "path"))
        changes = materialize(sync.file_changes(listing.select("source_id", "path", "lang", "type", "size", "mtime_ns", "sha1"), held["files"]), "changes")
        fresh = changes.where(F.col("status").isin("added", "changed"))
        ids = lambda c: c.select(F.xxhash64("source_id", "path").alias("file_id"))
        stays = materialize(ids(changes.where(F.col("status").isin("unchanged", "restamped"))), "stays")
        cut = listing.join(fresh.select("path"), "path", "left_semi")
        chunks = chunking.chunks_of(cut.select(F.col("id").alias("file_id"), "lang", "text"))
        made = chunking.tables_of(materialize(chunks, "chunks"), listing.select(F.col("id").alias("file_id"), "source_id", "path"))
        new_chunks = materialize(made["chunks"], "new-chunks")
        old_chunks = held["chunks"].join(stays, "file_id", "left_semi")
        kept = materialize(old_chunks.select(F.col("id").alias("chunk_id")), "kept")
        stayed = lambda t: held[t].join(kept, "chunk_id", "left_semi")
        # Only new chunks are indexed; the postings of the others stay as they are.
        out = {
            "files": listing.select("id", "source_id", "path", "lang", "type", "size", "mtime_ns", "sha1"),
            "file_texts": listing.select(F.col("id").alias("file_id"), F.col("shown").alias("text")),
            "chunks": old_chunks.unionByName(new_chunks),
            "idents": stayed("idents").unionByName(made["idents"]),
            "refs": stayed("refs").unionByName(made["refs"]),
            "chunk_categories": stayed("chunk_categories"),
            "postings": stayed("postings").unionByName(index.of_chunks(new_chunks, listing).postings),
            "chunk_lens": stayed("chunk_lens").unionByName(index.lengths(new_chunks, listing)),
        }
        if items is not None:
            from passagework.plans.corpus import exploded_meta

            out["mirror_items"], out["file_meta"] = items, exploded_meta(listing.select("id", "source_id", "path"), items)
        out["sources"] = self.spark.createDataFrame([(sid, name, root, public, excludes, datetime.datetime.now(datetime.UTC), kind, origin)], SCHEMAS["sources"])
        folders = {t: self.store.write(t, rows, base) for t, rows in out.items()}
        folders["terms"] = self.store.write("terms", index.term_counts(self.store.folder("postings", folders["postings"])), base)
        self._publish(part, folders, base)
        counted = sync.change_counts(changes).drop("source_id")
        zero = self.spark.createDataFrame([(0, 0, 0, 0)], "added bigint, changed bigint, removed bigint, unchanged bigint")
        told = counted.unionByName(zero).agg(*[F.sum(c).alias(c) for c in counted.columns])
        return told.select(F.lit(name).alias("source"), "*")

    def _publish(self, part: str, folders: dict[str, str], base: int) -> int:
        """Publish a source's folders (none: the source goes) with the links of the map that results."""
        tables = {}
        for t in OF_CORPUS[:-1]:
            rest = {p: f for p, f in self.store.parts(t, base).items() if p != part} | ({part: folders[t]} if t in folders else {})
            rows = [self.store.folder(t, f) for f in rest.values()]
            tables[t] = rows[0] if rows else self.spark.createDataFrame([], SCHEMAS[t])
            for more in rows[1:]:
                tables[t] = tables[t].unionByName(more)
        c = Corpus(**tables)
        there = c.chunks.select("id")
        old = self.store.read("links", version=base).where("rel = 'about'")
        about = old.join(there.withColumnRenamed("id", "src"), "src", "left_semi").join(there.withColumnRenamed("id", "dst"), "dst", "left_semi")
        links_folder = self.store.write("links", links.all_links(c, about), base)
        return self.store.publish({**{(t, part): f for t, f in folders.items()}, ("links", "all"): links_folder}, base, dropped=[] if folders else [part])

    def drop(self, name: str) -> int:
        """Take a source out of the map, with everything that hangs on it."""
        base = self.store.version()
        row = self.store.read("sources", version=base).where(F.col("name") == name).head()
        if row is None:
            raise KeyError(name)
        return self._publish(str(row.id), {}, base)

    def facts(self, judge: facts.Judge) -> dict[str, DataFrame]:
        """Judge what has no category yet, and link it."""
        base = self.store.version()
        c = self.corpus()
        found = facts.build(c, self.index(), judge, self.store.read("judgments", version=base))
        # The categories of all sources in one part each: a write a source that has chunks.
        owner = materialize(found["categories"].join(c.placed().select("chunk_id", "source_id"), "chunk_id"), "owned")
        changed: dict = {("chunk_categories", str(r.source_id)): owner.where(F.col("source_id") == r.source_id) for r in c.sources.select(F.col("id").alias("source_id")).collect()}
        changed["links", "all"] = self.store.read("links", version=base).unionByName(found["links"]).distinct()
        changed["judgments", "all"] = self.store.read("judgments", version=base).unionByName(found["judgments"])
        self.store.publish(changed, base)
        return found

    # ---- reading

    def corpus(self) -> Corpus:
        return Corpus(**{n: self.store.read(n) for n in OF_CORPUS}, categories=self.store.read("chunk_categories"))

    def index(self) -> index.Index:
        """The stored index; nothing is read until it is asked, and no text is."""
        terms = self.store.read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("body_df").alias("body_df"))
        return index.Index(self.store.read("postings"), index.stats_of(self.store.read("chunk_lens")), terms)

    def scope(self, where: str | None = None, sources: list[str] | None = None) -> Scope:
        found = Scope.parse(where, sources)
        found.check(self.store.read("file_meta"))
        return found

    def query(self, question: str | DataFrame, k: int = 5, pool: int = 15, ranker: str | None = None, where: str | None = None, **options) -> DataFrame:
        """The best hits of a question, or of a table (query_id, text) of them."""
        asked = question if isinstance(question, DataFrame) else self.spark.createDataFrame([(0, question)], "query_id bigint, text string")
        opened = searching.Options(k=k, pool=pool, scope=self.scope(where), **options)
        return searching.search(self.corpus(), self.index(), asked, make_ranker(ranker), opened)

    def _targets(self, *targets: str) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in targets], "target string")

    def read(self, *targets: str) -> DataFrame:
        """Lines behind coordinates or addresses of mirrored items."""
        web = [t for t in targets if t.startswith(("http://", "https://"))]
        near = [t for t in targets if t not in web]
        columns = ["target", "source", "path", "start_line", "end_line", "text"]
        out = explore.read(self.corpus(), self._targets(*near)).select(columns)
        return out.unionByName(explore.read_urls(self.corpus(), self._targets(*web)).select(columns)) if web else out

    def show(self, *targets: str) -> dict[str, DataFrame]:
        """What the map knows of coordinates: chunks, names, links, structure and similar passages."""
        c, asked = self.corpus(), self._targets(*targets)
        chunks = materialize(explore.shown_chunks(c, asked), "shown")
        return {"chunks": chunks, "names": explore.shown_names(c, chunks), "links": explore.shown_links(c, chunks), "structure": explore.shown_structure(c, chunks), "similar": explore.shown_similar(c, self.index(), chunks)}

    def grep(self, pattern: str, ignore_case: bool = False, where: str | None = None, most: int = 50) -> tuple[DataFrame, DataFrame]:
        return explore.grep(self.corpus(), pattern, ignore_case, self.scope(where), most)

    def ls(self, target: str | None = None) -> DataFrame:
        if not target:
            return self.sources()
        source, _, path = target.partition(":")
        found = explore.file_chunks(self.corpus(), source, path)
        return found if path and not found.isEmpty() else explore.folder_entries(self.corpus(), source, path)

    def sources(self) -> DataFrame:
        return explore.source_rows(self.corpus())

    def bench(self, path: str, pool: int = 30, ranker: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """(summary, a row a question) of a JSON-lines file of questions with their answers."""
        from passagework.operators import evaluation, widen

        rows = materialize(evaluation.bench_rows(self.spark, path).withColumn("query_id", F.monotonically_increasing_id()), "bench")
        c, ix = self.corpus(), self.index()
        asked = rows.select("query_id", F.col("question").alias("text"))
        order = searching.ranked(c, ix, asked, make_ranker(ranker), searching.Options(pool=pool, **options))
        hits = order.join(c.placed().select("chunk_id", "source", "path", "start_line", "end_line"), "chunk_id")
        base = widen.seeds(ix, asked, pool).join(c.placed().select("chunk_id", "source", "path", "start_line", "end_line"), "chunk_id")
        told = materialize(evaluation.question_rows(hits, rows, evaluation.gold_ranks(base, rows)), "rows")
        return evaluation.rank_summary(told), told.join(rows, "query_id")
