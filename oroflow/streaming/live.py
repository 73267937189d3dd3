"""Live feeds in Structured Streaming: windows, last known positions with expiry, bounded active sets, polled snapshots.

Times in the feeds may be without zone; they are read as UTC, as watermarks need an instant. Event time wins over
arrival: a late report never replaces a newer one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..plans.scratch import scratch_dir


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """events as a stream, malformed rows (no key or time) left out. Parquet streams watch folders: the glob names one file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).filter("user_id is not null and ts is not null")


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and value sums of tumbling or sliding windows by type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def last_known(events: DataFrame) -> DataFrame:
    """The newest report of each key, updated as reports come in."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


def _millis(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[ms]").astype(np.int64)


def _newest(pdf: pd.DataFrame) -> tuple[int, int]:
    """Id and time of the last report of a batch."""
    ms = _millis(pdf["ts"])
    return int(pdf["event_id"].to_numpy()[ms == ms.max()].max()), int(ms.max())


LIVE_SCHEMA = "user_id long, event_id long, ts timestamp, expired boolean"


def _live(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        event_id, ms = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [event_id], "ts": [pd.Timestamp(ms, unit="ms")], "expired": [True]})
        return
    best = state.get if state.exists else (-1, -1)
    for pdf in batches:
        best = max(best, _newest(pdf), key=lambda x: (x[1], x[0]))
    state.update(best)
    state.setTimeoutTimestamp(max(best[1] + 600_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[0]], "ts": [pd.Timestamp(best[1], unit="ms")], "expired": [False]})


def live_positions(events: DataFrame) -> DataFrame:
    """Keyed state: the newest report, dropped ten minutes of event time after it."""
    return events.withWatermark("ts", "10 minutes").select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(_live, LIVE_SCHEMA, "event_id long, ms long", "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all that is there now and give the sink's table: for append and update, every row it sent; for
    complete, the last result."""
    spark = stream.sparkSession
    at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    stream.writeStream.foreachBatch(batch_writer(at, mode)).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{at}/out")


def batch_writer(at: str, mode: str) -> Callable[[DataFrame, int], None]:
    """A sink that may get a batch twice: each has a folder of its own name that a replay overwrites; in complete mode the
    result is one folder."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch-{batch_id}")

    return keep


ACTIVE_SCHEMA = "shard int, version long, user_id long, event_id long, ts timestamp"


def active_set(events: DataFrame, most: int, shards: int = 16) -> DataFrame:
    """The `most` keys with the newest reports, bounded at every moment: each shard of keys keeps its own `most` newest in
    state and drops older ones, so state never passes shards * most entries, however many keys there are. A shard that
    changes sends its whole set under its next version; `merge_active` takes the last of each and the newest over all.
    A key that is dropped had `most` newer ones in its shard, and those only get newer: no report of the answer is lost."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, users, ids, times = state.get if state.exists else (0, [], [], [])
        parts = [pd.DataFrame({"user_id": users, "event_id": ids, "ms": times}, dtype="int64")]
        for pdf in batches:
            parts.append(pd.DataFrame({"user_id": pdf["user_id"].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "ms": _millis(pdf["ts"])}))
            rows = pd.concat(parts).sort_values(["ms", "event_id", "user_id"], ascending=False).drop_duplicates("user_id").head(most)
            parts = [rows]
        rows = parts[0]
        state.update((version + 1, *(rows[c].tolist() for c in ("user_id", "event_id", "ms"))))
        yield pd.DataFrame({"shard": key[0], "version": version + 1, "user_id": rows["user_id"], "event_id": rows["event_id"], "ts": pd.to_datetime(rows["ms"], unit="ms")})

    dealt = events.select("user_id", "event_id", "ts", F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandasWithState(keep, ACTIVE_SCHEMA, "version long, users array<long>, ids array<long>, times array<long>", "update", GroupStateTimeout.NoTimeout)


def merge_active(sent: DataFrame, most: int) -> DataFrame:
    """What active_set has sent: of each shard the last version, of these the `most` newest (shards * most rows at most)."""
    last = sent.groupBy("shard").agg(F.max("version").alias("version"))
    return sent.join(last, ["shard", "version"]).orderBy(F.desc("ts"), F.desc("event_id"), F.desc("user_id")).limit(most).select("user_id", "event_id", "ts")


class Snapshots:
    """Polled snapshots of keyed rows under one folder, each a version, with a feed of what changed from poll to poll.

    A poll replaces the snapshot as a whole. Writing a version again, as a replayed batch does, overwrites that version
    and its feed with the same rows; the version before it is never touched. `keep` versions stay."""

    def __init__(self, spark: SparkSession, path: str, key: str, values: list[str], keep: int = 3):
        self.spark, self.path, self.key, self.values, self.keep = spark, path, key, values, keep
        self.seen: dict[int, StructType] = {}

    def _read(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.schema(self.seen[version]).parquet(f"{self.path}/{kind}-{version}")

    def poll(self, version: int, rows: DataFrame) -> None:
        """One row a key; a null key is left out, as malformed reports are."""
        now = rows.filter(F.col(self.key).isNotNull()).select(self.key, *self.values)
        now.write.mode("overwrite").parquet(f"{self.path}/snapshot-{version}")
        self.seen[version] = now.schema

    def current(self) -> DataFrame:
        return self._read("snapshot", max(self.seen))

    def changes(self, version: int) -> DataFrame:
        """key, change ('added', 'moved' or 'gone') and the values after it (before it, for 'gone'); rows that stayed as
        they were are not in it."""
        now = self._read("snapshot", version)
        if version - 1 not in self.seen:
            return now.select(self.key, F.lit("added").alias("change"), *self.values)
        old = self._read("snapshot", version - 1).select(F.col(self.key), F.struct(*self.values).alias("_old"))
        both = now.select(F.col(self.key), F.struct(*self.values).alias("_new")).join(old, self.key, "full_outer")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_new")), "moved")
        told = both.withColumn("change", change).filter("change is not null")
        last = F.coalesce("_new", "_old")
        return told.select(self.key, "change", *[last[v].alias(v) for v in self.values])
