"""Continuous sync: a stream of scans keeps a versioned target up to date.

This goes beyond a sync on demand. The stream only says when to look; what has to be
done is found from the target's stored versions, so a batch that is replayed
after a failure finds nothing left to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.operators.incremental import Target, pending


def keep_current(scans: DataFrame, target: Target, key: list[str], seen: str, unchanged, process: Callable[[DataFrame], DataFrame], schema, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that processes new and changed records of a stream of scans.

    Of a key seen several times in a batch the latest row holds; one older than
    what the target stores under `seen` is late and does not replace it.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rest = [c for c in rows.columns if c not in key]
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seen)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])
        base = target.version()
        held = target.read(schema, base)
        work = pending(latest, held, key, unchanged)
        if seen in held.columns:
            newer = held.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(seen).alias("__seen"))
            match = F.col(seen) < F.col("__seen")
            for k in key:
                match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
            work = work.join(newer, match, "left_anti")
        if not work.isEmpty():
            target.publish(process(work), key, base)

    writer = scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their values by window and type; rows later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
