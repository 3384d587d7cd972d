"""Datasets in an object store, a card each: keys grouped to folders, the newest file's schema."""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import fixed
from passagework.sources.files import FORMAT_NAME, NAME, describe
from passagework.sources.markdown import card, segment
from passagework.sources.remote import RemoteError
from passagework.sources.schema_kinds import Cards, heading_url, locate, no_query

__all__ = ["KIND", "DOC_TYPE", "Remote", "dataset_of", "datasets", "heading_url", "list_objects", "locate", "origin"]
KIND, DOC_TYPE = "s3", "Dataset"


def origin(url: str, query: str | None = None) -> str | None:
    if not url.startswith("s3://"):
        return None
    no_query(query)
    bucket, _, prefix = url.removeprefix("s3://").partition("/")
    inside = prefix.strip("/")
    return f"s3://{bucket}/{inside + '/' if inside else ''}"


def dataset_of(key: str) -> tuple[str, list[str]] | None:
    """(dataset, partition keys) of an object's key; None if it is no data file. A file without a folder is its own dataset."""
    if key.rsplit(".", 1)[-1].lower() not in fixed.DATA_FORMATS or "." not in key.rsplit("/", 1)[-1]:
        return None
    folders = key.split("/")[:-1]
    plain = [f for f in folders if "=" in f]
    first = folders.index(plain[0]) if plain else len(folders)
    return "/".join(folders[:first]) or key, [f.split("=")[0] for f in folders[first:] if "=" in f]


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, modified) of all objects under a root, by metadata alone."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    name = base.split("://")[-1]
    return raw.select(F.expr(f"substring(path, instr(path, '{name}/') + {len(name) + 1})").alias("key"), F.col("modificationTime").alias("modified"))


def datasets(objects: DataFrame) -> DataFrame:
    """(dataset, partition_keys, newest, files): keys grouped by the folder above their partitions.

    The deepest partition path names the keys; the newest object, the last by
    key among equals, gives the schema. Objects that are no data are left out.
    """
    key: Column = F.col("key")
    folders = F.slice(F.split(key, "/"), 1, F.size(F.split(key, "/")) - 1)
    parts = F.transform(F.filter(folders, lambda f: f.contains("=")), lambda f: F.substring_index(f, "=", 1))
    before = F.regexp_replace(F.regexp_extract(key, r"^((?:[^/=]+/)*)", 1), "/$", "")
    data = objects.where(F.lower(key).rlike(r"\.(?:" + "|".join(fixed.DATA_FORMATS) + ")$"))
    rows = data.select(F.when(before != "", before).otherwise(key).alias("dataset"), parts.alias("parts"), "key", "modified")
    return rows.groupBy("dataset").agg(F.max_by("parts", F.struct(F.size("parts"), "key")).alias("partition_keys"), F.max_by("key", F.struct("modified", "key")).alias("newest"), F.count(F.lit(1)).alias("files"))


#: Lists (key, modified) under (bucket, prefix), and gives a path that a reader opens for a key.
STORES: list[tuple[Callable[[str, str], list[tuple[str, object]]], Callable[[str, str], str]]] = []


class Remote(Cards):
    def __init__(self, origin_url: str, store=None):
        super().__init__()
        self.origin = origin_url
        self.bucket, _, self.prefix = origin_url.removeprefix("s3://").partition("/")
        self.name = f"s3-{self.bucket}"
        self.store = store or (STORES[-1] if STORES else None)

    def listing(self):
        if self.store is None:
            raise RemoteError("no object store client is registered; Spark reads s3a paths by list_objects")
        listed, opened = self.store
        groups: dict[str, dict] = {}
        for key, modified in listed(self.bucket, self.prefix):
            if found := dataset_of(key.removeprefix(self.prefix)):
                g = groups.setdefault(found[0], {"keys": [], "newest": (modified, key)})
                g["keys"] = max(g["keys"], found[1], key=len)
                g["newest"] = max(g["newest"], (modified, key))
        return {name: self._entry(name, g["keys"], g["newest"][1], opened) for name, g in sorted(groups.items())}

    def _entry(self, name: str, keys: list[str], newest: str, opened):
        fmt = fixed.DATA_FORMATS[newest.rsplit(".", 1)[-1].lower()]
        try:
            columns, _ = describe(opened(self.bucket, newest), fmt)
        except Exception as e:  # noqa: BLE001 - a dataset that can't be read is still shown
            columns = [["(unreadable)", str(e).split("\n")[0][:200]]]
        where = f"s3://{self.bucket}/{self.prefix}{name}" + ("" if newest == self.prefix + name else "/")
        about = [f"{FORMAT_NAME[fmt]} dataset in S3 at `{where}`."]
        if keys:
            about.append(f"Partitioned by `{', '.join(keys)}` (Hive-style folders).")
        about.append(f"Schema read from `{newest}`.")
        leaf = posixpath.basename(name).split(".")[0]
        version = hashlib.sha1(json.dumps([fmt, keys, columns]).encode()).hexdigest()
        return self.keep(name, "/".join(map(segment, name.split("/"))) + ".md", card(where, about, ["Column", "Type"], columns, defines=[leaf] if NAME.fullmatch(leaf) else []), version)
