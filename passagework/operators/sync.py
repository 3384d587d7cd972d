"""Bringing a map in line with what exists now: snapshot differences and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.incremental import latest_rows


def file_changes(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, path, status, retyped) of every file that is listed or held.

    `unchanged` by size, time and language; `restamped` if those differ but the
    hash is equal; else `changed`; `added` and `removed`. Both sides have
    (source_id, path, lang, type, size, mtime_ns, sha1); a listing without a
    hash, or without a type, never matches on it.
    """
    new, old = listing.alias("n"), files.alias("o")
    both = new.join(old, (F.col("n.source_id") == F.col("o.source_id")) & (F.col("n.path") == F.col("o.path")), "full_outer")
    same = lambda c: F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    held = F.col("o.path").isNotNull()
    status = (
        F.when(~held, "added")
        .when(F.col("n.path").isNull(), "removed")
        .when(same("lang") & same("size") & same("mtime_ns"), "unchanged")
        .when(same("lang") & (F.col("n.sha1") == F.col("o.sha1")), "restamped")
        .otherwise("changed")
    )
    retyped = held & F.col("n.path").isNotNull() & ~same("type")
    return both.select(F.coalesce("n.source_id", "o.source_id").alias("source_id"), F.coalesce("n.path", "o.path").alias("path"), status.alias("status"), retyped.alias("retyped"))


def change_counts(changes: DataFrame) -> DataFrame:
    """(source_id, added, changed, removed, unchanged): a re-stamped file counts as unchanged."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.groupBy("source_id").agg(n("added").alias("added"), n("changed").alias("changed"), n("removed").alias("removed"), n("unchanged", "restamped").alias("unchanged"))


def item_changes(listing: DataFrame, mirror_items: DataFrame, rewritten: bool = False) -> DataFrame:
    """(source_id, item_id, status) of every item that is listed or mirrored.

    `deleted` if it is listed no more, `fetched` if it is new or has another
    version (all of them if the form of the mirror was `rewritten`), `moved` if
    only its path differs, else `same`. Two null versions are the same.
    """
    new, old = listing.alias("n"), mirror_items.alias("o")
    both = new.join(old, (F.col("n.source_id") == F.col("o.source_id")) & (F.col("n.item_id") == F.col("o.item_id")), "full_outer")
    stale = F.lit(rewritten) | F.col("o.item_id").isNull() | ~F.col("n.version").eqNullSafe(F.col("o.version"))
    status = F.when(F.col("n.item_id").isNull(), "deleted").when(stale, "fetched").when(~F.col("n.path").eqNullSafe(F.col("o.path")), "moved").otherwise("same")
    return both.select(F.coalesce("n.source_id", "o.source_id").alias("source_id"), F.coalesce("n.item_id", "o.item_id").alias("item_id"), status.alias("status"))


def newest_scan(file_scans: DataFrame, sync_runs: DataFrame) -> DataFrame:
    """What the newest run of each source saw, a row a file."""
    return latest_rows(file_scans, sync_runs.select("run_id", "source_id", "started_at"), ["source_id", "path"], "seen_at")


def newest_listing(remote_listing: DataFrame, sync_runs: DataFrame) -> DataFrame:
    """What the newest run of each source listed, a row an item."""
    rows = remote_listing.select("run_id", "source_id", "item_id", "version", "path", "url", "listed_at")
    return latest_rows(rows, sync_runs.select("run_id", "source_id", "started_at"), ["source_id", "item_id"], "listed_at")


def mirrored(listing: DataFrame, mirror_items: DataFrame) -> DataFrame:
    """The manifest after a sync whose fetches all went well: listed items, with the old fields of those not fetched."""
    old = mirror_items.select("source_id", "item_id", F.col("version").alias("had"), "meta")
    rows = listing.join(old, ["source_id", "item_id"], "left")
    kept = F.when(F.col("version").eqNullSafe(F.col("had")), F.col("meta"))
    return rows.select("source_id", "item_id", "version", "path", "url", kept.alias("meta"))


def empty_is_no_deletion(listed: DataFrame, held: DataFrame) -> None:
    """Refuse a listing that is empty for a source that holds items: an unsigned answer must not empty a mirror."""
    gone = held.select("source_id").distinct().join(listed.select("source_id").distinct(), "source_id", "left_anti").limit(5).collect()
    if gone:
        raise RuntimeError(f"nothing was listed for source(s) {', '.join(str(r.source_id) for r in gone)} that hold items; not taken as deletion")
