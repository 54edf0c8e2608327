"""Structured Streaming: the change feed of listings, and the latest state per key of an event stream.

State is bounded by watermarks where rows expire, and otherwise has one small row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir, table

STATE = "seen double, size long, mtime double, hash string"
CHANGE = "ws string, rel string, change string"


def detect_changes(listings: DataFrame) -> DataFrame:
    """new / changed / removed for each file as its listings arrive, late and repeated ones ignored.

    The state of a key is the newest listing that was seen; a row that is not newer than that changes nothing.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        first = old
        for pdf in batches:
            for r in pdf.sort_values("seen_at").itertuples(index=False):
                seen = pd.Timestamp(r.seen_at).timestamp()
                if old is not None and seen <= old[0]:
                    continue
                if r.gone:
                    old = (seen, -1, -1.0, "")
                else:
                    old = (seen, int(r.size) if pd.notna(r.size) else 0, float(r.mtime) if pd.notna(r.mtime) else 0.0, (r.hash or "").lower().lstrip("0"))
        if old is None:
            return
        state.update(old)
        was = first is not None and first[1] >= 0
        now = old[1] >= 0
        differs = was and now and (old[3] != first[3] if old[3] and first[3] else old[1:3] != first[1:3])
        change = "new" if now and not was else "removed" if was and not now else "changed" if differs else None
        if change:
            yield pd.DataFrame({"ws": [key[0]], "rel": [key[1]], "change": [change]})

    rows = listings.select("ws", "rel", "size", "mtime", "hash", F.coalesce("gone", F.lit(False)).alias("gone"), "seen_at").where("ws IS NOT NULL AND rel IS NOT NULL AND seen_at IS NOT NULL")
    return rows.groupBy("ws", "rel").applyInPandasWithState(step, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts by type; rows later than the watermark are left out of windows already closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def feed(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Drives ``apply`` once per micro-batch; the batch id makes it idempotent for sinks that remember it."""
    return changes.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(apply).trigger(availableNow=True).start()


# -- queries: a bounded stream is run to its end into the shared folder, and the result read from there


def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user, by a stream whose batches are merged by their greatest time."""
    out = shared_dir(spark, "stream")
    src = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    last = src.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e"))

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/latest")

    last.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/latest").select("user_id", "e.event_id", "e.event_type", "e.value")


def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change feed over all listings: what each file has become by the end, counted by workspace."""
    out = shared_dir(spark, "feed")
    src = spark.readStream.schema(table(spark, sf, "listings").schema).parquet(f"{sf}/listings.parquet*")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/changes/batch={batch}")

    feed(detect_changes(src), f"{out}/checkpoint", write).awaitTermination()
    return spark.read.parquet(f"{out}/changes").groupBy("ws", "change").agg(F.count("*").alias("files"))


QUERIES = {f.__name__: f for f in (stream_latest_state, stream_changes)}
ORACLE = {
    "stream_latest_state": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_changes": """WITH l AS (SELECT ws, rel, coalesce(gone, false) AS gone FROM listings WHERE ws IS NOT NULL AND rel IS NOT NULL AND seen_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ws, rel ORDER BY seen_at DESC) = 1)
 SELECT ws, 'new' AS change, count(*) AS files FROM l WHERE NOT gone GROUP BY ws""",
}
