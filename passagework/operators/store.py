"""The tables of a map on disk: parts by source, one manifest a version.

A sync writes new folders for the parts it changed and publishes a manifest that
names, for every table and part, the folder that holds it now. Readers see whole
versions; parts of other sources are carried over as they are. A writer says
from which version it started: of two that started from the same one the later
gets an error and has to look at the newer version first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from passagework.operators.incremental import Target

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS = {
    "sources": _schema(id=L, name=S, root=S, public=B, excludes=T.ArrayType(S), indexed_at=T.TimestampType(), kind=S, origin=S),
    "files": _schema(id=L, source_id=L, path=S, lang=S, type=S, size=L, mtime_ns=L, sha1=S),
    "file_texts": _schema(file_id=L, text=S),
    "chunks": _schema(id=L, file_id=L, parent_id=L, kind=S, heading_path=S, anchor=S, start_line=I, end_line=I, text=S),
    "idents": _schema(chunk_id=L, ident=S, role=S),
    "refs": _schema(chunk_id=L, target_path=S, target_anchor=S),
    "file_meta": _schema(file_id=L, key=S, value=S),
    "mirror_items": _schema(source_id=L, item_id=S, version=S, path=S, url=S, anchors=T.MapType(S, S), meta=T.MapType(S, T.ArrayType(S))),
    "postings": _schema(chunk_id=L, len=I, head_len=I, term=S, head_tf=I, body_tf=I, positions=T.ArrayType(I)),
    "chunk_lens": _schema(chunk_id=L, len=L),
    "terms": _schema(term=S, df=L, body_df=L),
    "links": _schema(src=L, dst=L, rel=S, via=S),
    "chunk_categories": _schema(chunk_id=L, category=S, p=D, kept=B, model=S),
    "judgments": _schema(kind=S, question=S, passage=S, other=S, key=S, p=D, model=S, source=S),
}


class Store:
    """A versioned set of tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.target = spark, Target(spark, path)

    def version(self) -> int:
        return self.target.version()

    def parts(self, table: str, version: int | None = None) -> dict[str, str]:
        """Part -> folder of a table in a version (the newest, if none is named)."""
        return self.target.manifest(version).get("tables", {}).get(table, {})

    def read(self, table: str, part: str | None = None, version: int | None = None) -> DataFrame:
        """A table, or one part of it; empty if there is none. Columns of a fixed schema."""
        found = [f for p, f in sorted(self.parts(table, version).items()) if part in (None, p)]
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.target.path}/data/{f}" for f in found])

    def write(self, table: str, rows: DataFrame, base: int) -> str:
        """Write rows of a table to a folder of their own, which no version names yet; its name."""
        name = f"{table}-{base + 1}-{uuid.uuid4().hex}"
        shaped = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])
        shaped.write.parquet(f"{self.target.path}/data/{name}")
        return name

    def folder(self, table: str, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.target.path}/data/{name}")

    def publish(self, changed: dict[tuple[str, str], DataFrame | str], base: int, dropped: list[str] = ()) -> int:
        """Publish the (table, part) rows, or folders already written, with all other parts of version `base`; parts named in `dropped` go, in every table.

        One version has them all. `RuntimeError` if a version was published since `base`.
        """
        if self.version() != base:
            raise RuntimeError(f"version {base} of {self.target.path} is no longer the newest")
        tables = {t: {p: f for p, f in parts.items() if p not in dropped} for t, parts in self.target.manifest(base).get("tables", {}).items()}
        for (table, part), rows in changed.items():
            tables.setdefault(table, {})[part] = rows if isinstance(rows, str) else self.write(table, rows, base)
        self.target.commit({"version": base + 1, "tables": tables, "folders": [], "key": []})
        return base + 1

    def clean(self, keep: int = 2) -> list[str]:
        """Delete old versions and what no version left names, as after a run that broke off."""
        return self.target.clean(keep, lambda m: [f for parts in m.get("tables", {}).values() for f in parts.values()])
