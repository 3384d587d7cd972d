"""Processing only new or changed records: the target is the state.

Every output row stores the key and the version of the source record it was
made from. Work is found by an anti-join of the source against those stored
columns, and a new version of the target becomes visible by one exclusive
creation of a manifest. A run that fails before that leaves nothing behind
that a reader could see, so the next run finds the same records to do; a run
that succeeded has stored their versions, so none is repeated.

Layout of a target::

    <target>/data/v-<n>-<random>/*.parquet      rows of one published run
    <target>/versions/<n>.json                  the folders that make up version n
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_rows(scans: DataFrame, runs: DataFrame, key: list[str], seen: str) -> DataFrame:
    """Rows of the newest run of each source, one per key.

    `runs` has (run_id, source_id, started_at). The newest run is the one with
    the latest `started_at` (null is oldest; ties go to the larger `run_id`).
    Of several rows of a key the one with the latest `seen` holds; null is
    oldest, and rows that tie are ordered by their other columns, so that the
    result does not depend on row order. The choice is an aggregate with a
    partial step, so a key that holds a third of the rows costs one row per
    task in the shuffle.
    """
    newest = runs.groupBy("source_id").agg(
        F.max(F.struct(F.coalesce("started_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "run_id"))["run_id"].alias("run_id")
    )
    rest = [c for c in scans.columns if c not in {"run_id", *key, seen}]
    # One row per source: a fixed table, kept small by the aggregate above.
    current = scans.join(newest, ["source_id", "run_id"], "left_semi")
    order = F.struct(F.col(seen).isNotNull().alias("known"), F.col(seen).alias("seen"), *[F.col(c) for c in rest if not _unordered(scans, c)])
    picked = current.groupBy(*key).agg(F.max_by(F.struct(*rest, seen), order).alias("row"))
    return picked.select(*key, *[F.col("row")[c].alias(c) for c in [*rest, seen]])


def _unordered(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in {"map", "variant"}


def pending(source: DataFrame, state: DataFrame, key: list[str], unchanged: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """Rows of `source` that `state` lacks or holds in another version.

    `unchanged(new, old)` gets two column getters and says when a stored
    record still stands. Keys are compared null-safe, so a null key is a key.
    Columns of `state` may bear any names; none reaches the result.
    """
    new, old = source.alias("__new"), state.alias("__old")
    get_new, get_old = (lambda c: F.col(f"__new.`{c}`")), (lambda c: F.col(f"__old.`{c}`"))
    match = unchanged(get_new, get_old)
    for k in key:
        match = match & get_new(k).eqNullSafe(get_old(k))
    return new.join(old, match, "left_anti").select("__new.*")


def file_unchanged(new: Callable[[str], Column], old: Callable[[str], Column]) -> Column:
    """A hashed row stands while its hash is equal, another while size and time are."""
    by_stat = new("size").eqNullSafe(old("size")) & new("mtime_ns").eqNullSafe(old("mtime_ns"))
    return F.when(new("sha1").isNull(), by_stat).otherwise(new("sha1").eqNullSafe(old("sha1")))


def item_unchanged(new: Callable[[str], Column], old: Callable[[str], Column]) -> Column:
    """An item stands while its version is the same text; two nulls are the same."""
    return new("version").eqNullSafe(old("version"))


def changed_records(files: DataFrame, file_scans: DataFrame, mirror_items: DataFrame, remote_listing: DataFrame, sync_runs: DataFrame) -> DataFrame:
    """(record_kind, source_id, record_key) of files and items to process now.

    Empty tables give no rows; a source without runs gives none; records that
    the newest run does not list are no cases.
    """
    runs = sync_runs.select("run_id", "source_id", "started_at")
    scan = latest_rows(file_scans.select("run_id", "source_id", "path", "size", "mtime_ns", "sha1", "seen_at"), runs, ["source_id", "path"], "seen_at")
    listing = latest_rows(remote_listing.select("run_id", "source_id", "item_id", "version", "listed_at"), runs, ["source_id", "item_id"], "listed_at")
    new_files = pending(scan, files.select("source_id", "path", "size", "mtime_ns", "sha1"), ["source_id", "path"], file_unchanged)
    new_items = pending(listing, mirror_items.select("source_id", "item_id", "version"), ["source_id", "item_id"], item_unchanged)
    return new_files.select(F.lit("file").alias("record_kind"), "source_id", F.col("path").alias("record_key")).unionByName(
        new_items.select(F.lit("item").alias("record_kind"), "source_id", F.col("item_id").alias("record_key"))
    )


class Target:
    """A versioned Parquet table that only ever shows whole published runs.

    A run adds one folder; a row is superseded by a row with the same key in a
    later folder. Readers resolve that on the key columns alone, and `compact`
    folds the folders of a version into one, so that a run costs what changed
    and not what is stored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Folders (oldest first) and key columns of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "folders": [], "key": []}
        return json.loads(self._text(*self._fs(f"{self.path}/versions/{version}.json")))

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a published version (the newest, if none is named); empty before the first."""
        held = self.manifest(version)
        paths = [f"{self.path}/data/{f}" for f in held["folders"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if len(paths) == 1:
            return self.spark.read.schema(schema).parquet(paths[0])
        parts = [self.spark.read.schema(schema).parquet(p).withColumn("__seq", F.lit(i)) for i, p in enumerate(paths)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        last = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(held["key"])]).agg(F.max("__seq").alias("__last"))
        match = rows["__seq"] == last["__last"]
        for i, k in enumerate(held["key"]):
            match = match & rows[k].eqNullSafe(last[f"__k{i}"])
        return rows.join(last, match, "left_semi").drop("__seq")

    def publish(self, rows: DataFrame, key: list[str], base: int | None = None, replace: bool = False) -> int:
        """Write `rows` to a folder of their own and publish it as the next version; its number.

        Rows of the base version with the same key are superseded; with
        `replace` the rows are the whole of the new version. Publishing is one
        exclusive create, so of two runs that started from the same base one
        gets `RuntimeError` and has to look for its work again.
        """
        base = self.version() if base is None else base
        held = self.manifest(base)["folders"] if base and not replace else []
        name = f"v-{base + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{name}")
        self.commit({"version": base + 1, "folders": [*held, name], "key": key})
        return base + 1

    def compact(self, schema) -> int:
        """Publish the newest version again as one folder; its new number."""
        base = self.version()
        return self.publish(self.read(schema, base), self.manifest(base)["key"], base, replace=True)

    def commit(self, manifest: dict) -> None:
        """Publish a manifest under its number, if no other run has.

        On a local folder a link is made that fails where the name is taken; on
        other file systems the file is created with `overwrite` off, which
        is exclusive on HDFS and a conditional request on object stores whose
        Hadoop client makes one. Who wrote it is read back, so that a
        store which lets two writers through still has one that is told no. A
        manifest that can't be read whole is no version.
        """
        stamped = json.dumps(manifest | {"writer": uuid.uuid4().hex})
        fs, final = self._fs(f"{self.path}/versions/{manifest['version']}.json")
        try:
            if fs.getScheme() == "file":
                self._link(fs, stamped, final)
            else:
                self._write(fs, stamped, final)
        except (FileExistsError, Py4JJavaError) as e:
            if not fs.exists(final):
                raise
            raise self._taken(manifest) from e
        if self._text(fs, final) != stamped:
            raise self._taken(manifest)

    def _taken(self, manifest: dict) -> RuntimeError:
        return RuntimeError(f"version {manifest['version']} of {self.path} was published by another run")

    def _write(self, fs, body: str, at) -> None:
        out = fs.create(at, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()

    def _link(self, fs, body: str, final) -> None:
        # Written under another name first: a reader never meets half a manifest, and a rename would replace.
        _, temp = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        self._write(fs, body, temp)
        try:
            os.link(temp.toUri().getPath(), final.toUri().getPath())
        finally:
            fs.delete(temp, False)

    def _text(self, fs, at) -> str:
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def clean(self, keep: int = 2, named=lambda manifest: manifest["folders"]) -> list[str]:
        """Delete the manifests before the newest `keep` and the data folders that none of those left names; their names.

        Folders of runs that are still writing are told by their version being
        newer than the newest; those of failed runs go once another has been published.
        """
        newest = self.version()
        fs, versions = self._fs(f"{self.path}/versions")
        if not newest:
            return []
        for status in fs.listStatus(versions):
            name = status.getPath().getName()
            if name[:-5].isdigit() and int(name[:-5]) <= newest - keep:
                fs.delete(status.getPath(), False)
        held = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in named(self.manifest(v))}
        _, data = self._fs(f"{self.path}/data")
        gone = []
        for status in fs.listStatus(data):
            name = status.getPath().getName()
            began = int(name.split("-")[1]) if name.split("-")[1].isdigit() else 0
            if name not in held and began <= newest:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)


def run_incremental(target: Target, source: DataFrame, key: list[str], unchanged, process: Callable[[DataFrame], DataFrame], schema) -> int:
    """Process what is pending against the target's newest version and publish it.

    `process` gets the pending source rows and returns the rows to store, with
    the key and version columns among them. Returns the new version, or the
    old one where nothing was pending.
    """
    base = target.version()
    work = pending(source, target.read(schema, base), key, unchanged)
    if work.isEmpty():
        return base
    return target.publish(process(work), key, base)
