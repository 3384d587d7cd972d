"""Named queries over a data directory, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagework.operators.incremental import changed_records
from passagework.plans import oracle, queries
from passagework.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_records(*(table(spark, d, n) for n in ("files", "file_scans", "mirror_items", "remote_listing", "sync_runs")))


QUERIES: dict[str, Query] = {"p2_found": p2_found, **queries.QUERIES}

ORACLE: dict[str, str] = {
    **oracle.ORACLE,
    "p2_found": """
WITH newest AS (SELECT source_id, arg_max(run_id, (coalesce(started_at, TIMESTAMP '0001-01-01'), run_id)) AS run_id FROM sync_runs GROUP BY 1),
f AS (SELECT source_id, path, size, mtime_ns, sha1, row_number() OVER (PARTITION BY source_id, path ORDER BY seen_at DESC NULLS LAST, size DESC NULLS LAST, mtime_ns DESC NULLS LAST) AS rn
      FROM file_scans SEMI JOIN newest USING (source_id, run_id)),
i AS (SELECT source_id, item_id, version, row_number() OVER (PARTITION BY source_id, item_id ORDER BY listed_at DESC NULLS LAST, version DESC NULLS LAST) AS rn
      FROM remote_listing SEMI JOIN newest USING (source_id, run_id))
SELECT 'file' AS record_kind, f.source_id, f.path AS record_key FROM f LEFT JOIN files o ON o.source_id = f.source_id AND o.path = f.path
WHERE f.rn = 1 AND (o.id IS NULL OR CASE WHEN f.sha1 IS NULL THEN f.size IS DISTINCT FROM o.size OR f.mtime_ns IS DISTINCT FROM o.mtime_ns ELSE f.sha1 IS DISTINCT FROM o.sha1 END)
UNION ALL
SELECT 'item', i.source_id, i.item_id FROM i LEFT JOIN mirror_items o ON o.source_id = i.source_id AND o.item_id = i.item_id
WHERE i.rn = 1 AND (o.item_id IS NULL OR i.version IS DISTINCT FROM o.version)
""",
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries.b02_bm25_documents(spark, d)
