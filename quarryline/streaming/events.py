"""Event feeds: keyed upserts, request limits, repeats, changes, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def route_events(events: DataFrame, schema: str, known: list[str]) -> DataFrame:
    """``events`` (event, payload, received_at) with the parsed payload and outcome: upsert,
    ignored (unknown type), dead_letter (no JSON) or warning (no id in it)."""
    parsed = events.withColumn("object", F.from_json("payload", schema))
    valid = F.try_parse_json("payload").isNotNull() if hasattr(F, "try_parse_json") else F.get_json_object("payload", "$").isNotNull()
    outcome = F.when(~F.col("event").isin(known), "ignored").when(~F.coalesce(valid, F.lit(False)), "dead_letter").when(F.col("object.id").isNull(), "warning").otherwise("upsert")
    return parsed.withColumn("outcome", outcome)


def last_of_batch(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of each key in a micro-batch, to be merged once."""
    fields = F.struct(ts, *[c for c in rows.columns if c not in (key, ts)])
    return rows.groupBy(key).agg(F.max(fields).alias("_r")).select(key, "_r.*")


def request_demand(requests: DataFrame, seconds: int = 60, slide: int = 10, delay: str = "5 minutes") -> DataFrame:
    """Requests of each user in sliding windows (refused ones included)."""
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), "user_id").agg(F.count("*").alias("requests"))


class _Limit(StatefulProcessor):
    """Times of each user's accepted requests in the last window."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("accepted", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.times.get()] if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event, ts in zip(batch["event_id"], batch["ts"], strict=True):
            now = ts.timestamp()
            kept = [t for t in kept if now - t < self.seconds]
            accepted = len(kept) < self.most
            if accepted:
                kept.append(now)
            out.append((key[0], event, ts, accepted))
        self.times.put([(t,) for t in kept])
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "accepted"])

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """(user_id, event_id, ts, accepted): a request is refused if ``most`` were accepted in the
    last ``seconds``; refused ones aren't counted.  Needs the RocksDB state store."""
    rows = requests.select("user_id", "event_id", "ts").groupBy("user_id")
    return rows.transformWithStateInPandas(statefulProcessor=_Limit(most, seconds), outputStructType="user_id long, event_id long, ts timestamp, accepted boolean", outputMode="Append", timeMode="None")


class _LastStatus(StatefulProcessor):
    """The last status of each entity."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        status = self.last.get()[0] if known else None
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for ts, new in zip(batch["ts"], batch["status"], strict=True):
            if known and new != status:
                out.append((key[0], ts, status, new))
            known, status = True, new
        self.last.update((status,))
        yield pd.DataFrame(out, columns=["entity", "ts", "previous", "new"])

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame) -> DataFrame:
    """(entity, ts, previous, new) whenever a status (entity, ts, seq, status) differs from
    the entity's last one; the first one is no change.  Needs the RocksDB state store."""
    rows = stream.select("entity", "ts", "seq", "status").groupBy("entity")
    return rows.transformWithStateInPandas(statefulProcessor=_LastStatus(), outputStructType="entity string, ts timestamp, previous string, new string", outputMode="Append", timeMode="None")


def rate_limit_batch(requests: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """The same over a finished table.  Acceptance depends on the requests accepted before,
    so a user's requests stream through one task in order of time; only the times accepted
    last are held."""
    kind = requests.schema["user_id"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["user_id", "accepted", "refused"]
        one = lambda *values: [pa.array([v], t) for v, t in zip(values, (arrow, pa.int64(), pa.int64()), strict=True)]
        started, user, recent, accepted, refused, arrow = False, None, [], 0, 0, None
        for batch in batches:
            arrow = batch.schema.field(0).type
            done = []
            for now_user, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or now_user != user:
                    if started:
                        done.append((user, accepted, refused))
                    started, user, recent, accepted, refused = True, now_user, [], 0, 0
                # a request without a time falls into no window
                recent = [] if now is None else [t for t in recent if now - t < seconds]
                if len(recent) < most:
                    accepted += 1
                    if now is not None:
                        recent.append(now)
                else:
                    refused += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (arrow, pa.int64(), pa.int64()), strict=True)], names=names)
        if started:
            yield pa.RecordBatch.from_arrays(one(user, accepted, refused), names=names)

    times = requests.select("user_id", (F.unix_micros("ts") / 1e6).alias("s"), "event_id")
    ordered = times.repartition("user_id").sortWithinPartitions("user_id", "s", "event_id")
    return ordered.select("user_id", "s").mapInArrow(fold, f"user_id {kind.simpleString()}, accepted long, refused long")


def query_key(query: Column, filters: Column) -> Column:
    """A hash of a question and its filters (a JSON object as text): the order of keys and white
    space don't matter at any depth; null and what isn't JSON are no filters."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(filters)), F.lit("{}"))
    return F.sha2(F.concat(F.coalesce(query, F.lit("")), F.lit("\0"), canonical), 256)


class _Kept(StatefulProcessor):
    """Since when an answer is kept; a timer drops it after its time to live."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.since = handle, handle.getValueState("since", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = self.since.get()[0] if self.since.exists() else None
        batch = pd.concat([r[["ts", "query_id"]] for r in rows]).sort_values(["ts", "query_id"], kind="stable")
        # Python's timestamp() of a time without a zone would be the machine's own
        at = batch["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6
        hit, last = _hits(at, since, self.seconds)
        if last is not None and last != since:
            self.since.update((last,))
            self.handle.registerTimer(int((last + self.seconds) * 1000))
        yield pd.DataFrame({"query_key": key[0], "query_id": batch["query_id"].to_numpy(), "ts": batch["ts"].to_numpy(), "hit": hit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.since.exists() and expiredTimerInfo.getExpiryTimeInMs() >= int((self.since.get()[0] + self.seconds) * 1000):
            self.since.clear()
        return iter(())

    def close(self) -> None:
        pass


def _hits(at: np.ndarray, since: float | None, seconds: float) -> tuple[np.ndarray, float | None]:
    """Which of one key's times, in order, find an answer that is younger than its time to live
    and since when the last one is kept: each miss stores one anew, a hit doesn't renew it."""
    hit = np.ones(len(at), bool)
    i = 0 if since is None else int(np.searchsorted(at, since + seconds, "left"))
    while i < len(at):
        hit[i], since = False, float(at[i])
        i = max(i + 1, int(np.searchsorted(at, since + seconds, "left")))
    return hit, since


def cache_hits(queries: DataFrame, seconds: float = 3600) -> DataFrame:
    """(query_key, query_id, ts, hit): whether the same question with the same filters was
    answered less than ``seconds`` before (``queries``: query_id, query_key, ts); an answer's
    time runs from the miss that stored it.  Of equal times the smallest query_id comes
    first; a null time never hits and stores nothing.

    A key's questions stream through one task in order of time, and only since when its answer
    is kept is held: each depends on the miss before it."""
    key, number = (queries.schema[c].dataType.simpleString() for c in ("query_key", "query_id"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, since = False, None, None
        for batch in batches:
            keys = batch.column(0)
            ends = pc.run_end_encode(keys)
            hit, begin = np.zeros(batch.num_rows, bool), 0
            at = batch.column(2).to_numpy(zero_copy_only=False)
            for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                if not started or value != now:
                    started, now, since = True, value, None
                part = at[begin:end]
                known = ~np.isnan(part)
                hit[begin:end][known], since = _hits(part[known], since, seconds)
                begin = end
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), batch.column(3), pa.array(hit)], names=["query_key", "query_id", "ts", "hit"])

    times = queries.select("query_key", "query_id", (F.unix_micros("ts") / 1e6).alias("s"), "ts")
    ordered = times.repartition("query_key").sortWithinPartitions("query_key", "s", "query_id")
    return ordered.mapInArrow(fold, f"query_key {key}, query_id {number}, ts timestamp, hit boolean").select("query_key", "query_id", "ts", "hit")


def cache_hits_stream(queries: DataFrame, seconds: float = 3600, delay: str = "1 hour") -> DataFrame:
    """The same over a stream; what came later than ``delay`` is dropped, and an answer's state
    goes with a timer once the watermark has passed its time to live.  Needs the RocksDB state
    store."""
    rows = queries.select("query_key", "query_id", "ts").withWatermark("ts", delay).groupBy("query_key")
    return rows.transformWithStateInPandas(statefulProcessor=_Kept(seconds), outputStructType="query_key string, query_id long, ts timestamp, hit boolean", outputMode="Append", timeMode="EventTime")


def dedup_within(queries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of equal queries within a time to live (streams)."""
    return queries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query_hash"])


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of a user's events with less than the gap between them."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def hourly_updates(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling hours."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("hour"), "event_type", "events")


def upsert_stream(stream: DataFrame, merge, checkpoint: str, available_now: bool = True):
    """Start a query that merges every micro-batch: ``merge(batch, batch_id)``."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="6 hours")).start()
