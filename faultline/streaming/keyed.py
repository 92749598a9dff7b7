"""Keyed state with timers: events in the order of their own time, however they arrive.

State lives in the state store on the executors; a batch writes what it changes. Rows behind the
watermark are not dropped: they leave by the same stream, marked as late. The event time
reaches the processors as a plain number, so the store's own filter for late rows does
not see it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state for ids: a key holds the ids of a bucket.
BUCKETS = 1024
HOUR_MS = 3_600_000


def append_keyed(rows: DataFrame, out: str) -> StreamingQuery:
    """Appends to ``out/data``, late rows in a partition of their own; state in RocksDB."""
    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data")
    if "late" in rows.columns:
        writer = writer.partitionBy("late")
    try:
        return writer.option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


class _ByArrival(StatefulProcessor):
    """Per key the last status; the events of a batch follow it in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable", na_position="first")
        status = [None if pd.isna(x) else x for x in own["status"]]
        before = self.last.get()[0] if self.last.exists() else None
        self.last.update((status[-1],))
        yield pd.DataFrame(
            {"key": key[0], "micros": own["micros"].to_numpy(), "from_status": [before, *status[:-1]], "to_status": status}
        )

    def close(self) -> None:
        pass


class _ByTime(StatefulProcessor):
    """Per key the last status, and the events that the watermark has not passed yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")
        self.waiting = handle.getListState("waiting", "micros long, seq long, status string")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            # a filter in the plan would slip below the watermark, which heartbeats are to move
            part = part[part["micros"].notna() & (not pd.isna(key[0]))]
            late = part["micros"] // 1000 <= watermark
            if late.any():
                out = part[late]
                yield pd.DataFrame(
                    {"key": key[0], "micros": out["micros"], "from_status": None, "to_status": out["status"], "late": True}
                )
            new = part[~late]
            if len(new):
                status = [None if pd.isna(x) else x for x in new["status"]]
                seq = [None if pd.isna(x) else int(x) for x in new["seq"]]
                self.waiting.appendList(list(zip(new["micros"].astype(int).tolist(), seq, status)))
                least = int(new["micros"].min()) // 1000
                first = least if first is None else min(first, least)
        if first is not None and (not self.timer.exists() or first < self.timer.get()[0]):
            self.timer.update((first,))
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for row in self.waiting.get():
            (ready if row[0] // 1000 <= watermark else rest).append(tuple(row))
        if rest:
            self.waiting.put(rest)
            first = min(rest, key=lambda r: r[0])[0] // 1000
            self.timer.update((first,))
            self.handle.registerTimer(first)
        else:
            self.waiting.clear()
            self.timer.clear()
        if ready:
            ready.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
            before = self.last.get()[0] if self.last.exists() else None
            statuses = [r[2] for r in ready]
            self.last.update((statuses[-1],))
            yield pd.DataFrame(
                {
                    "key": key[0],
                    "micros": [r[0] for r in ready],
                    "from_status": [before, *statuses[:-1]],
                    "to_status": statuses,
                    "late": False,
                }
            )

    def close(self) -> None:
        pass


def _named(events: DataFrame, key: str, status: str, order: tuple[str, str], moment: str) -> DataFrame:
    return events.select(
        F.col(key).alias("key"),
        F.unix_micros(F.col(moment).cast("timestamp")).alias("micros"),
        F.col(order[1]).cast("long").alias("seq"),
        F.col(status).cast("string").alias("status"),
    )


def _finished(moved: DataFrame, statuses: list[str], *more: str) -> DataFrame:
    valid = F.coalesce(F.col("to_status").isin(list(statuses)), F.lit(False)).alias("valid")
    return moved.select("key", F.timestamp_micros("micros").alias("moment"), "from_status", "to_status", valid, *more)


def transitions_by_arrival(
    events: DataFrame, key: str, status: str, order: tuple[str, str], statuses: list[str]
) -> DataFrame:
    """Stream of ``key, moment, from_status, to_status, valid``, written with the batch of the event.

    Within a batch events follow in the order of time and sequence number; arrival by batch
    comes before time. What a key holds is its last status. A task sorts what one batch has
    of a key, so the trigger bounds it. Rows with a null key are left out.
    """
    kind = dict(events.dtypes)[key]
    named = _named(events, key, status, order, order[0]).where("key is not null")
    moved = named.groupBy("key").transformWithStateInPandas(
        _ByArrival(), f"key {kind}, micros long, from_status string, to_status string", "append", "none"
    )
    return _finished(moved, statuses)


def transitions_by_time(
    events: DataFrame, key: str, status: str, order: tuple[str, str], statuses: list[str], delay: str
) -> DataFrame:
    """Stream of ``key, moment, from_status, to_status, valid, late``.

    Transitions come in the order of time and sequence number once the watermark, ``delay``
    behind the latest event, has passed them; so batches in any order give the same rows. Events
    behind it when they arrive are late: they come out at once, change nothing and have no
    previous status. Rows with a null key or time move the watermark only. What a
    key holds are its last status and its events of the last ``delay``.
    """
    timed = events.withColumn("_moment", F.col(order[0]).cast("timestamp")).withWatermark("_moment", delay)
    kind = dict(events.dtypes)[key]
    moved = _named(timed, key, status, order, "_moment").groupBy("key").transformWithStateInPandas(
        _ByTime(), f"key {kind}, micros long, from_status string, to_status string, late boolean", "append", "eventtime"
    )
    return _finished(moved, statuses, "late")


class _FirstOfId(StatefulProcessor):
    """Per bucket the ids seen, a list for each hour; hours behind the watermark are forgotten.

    A batch reads the lists of a bucket once and writes those of the hours it adds to: the calls to
    the store are by hours, not by events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "hour long", "ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        hours = {k[0]: list(v[0]) for k, v in self.seen.iterator()}
        known, new = {i for ids in hours.values() for i in ids}, {}
        for part in rows:
            late = (part["micros"] // 1000 <= watermark).to_numpy()
            keep = late.copy()
            for k, (id_, micros) in enumerate(zip(part["id"].tolist(), part["micros"].tolist())):
                if not late[k] and id_ not in known:
                    known.add(id_)
                    new.setdefault(int(micros) // 1000 // HOUR_MS, []).append(id_)
                    keep[k] = True
            yield part.assign(late=late)[keep].drop(columns=["bucket", "id", "micros"])
        for hour, ids in new.items():
            self.seen.updateValue((hour,), (hours.get(hour, []) + ids,))
        if new and (not hours or min(new) < min(hours)):  # one timer waits, for the earliest hour
            self.handle.registerTimer((min(new) + 1) * HOUR_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // HOUR_MS
        hours = [k[0] for k in self.seen.keys()]
        for hour in hours:
            if hour < passed:
                self.seen.removeKey((hour,))
        if rest := [hour for hour in hours if hour >= passed]:
            self.handle.registerTimer((min(rest) + 1) * HOUR_MS)
        return iter(())

    def close(self) -> None:
        pass


def first_of_id(events: DataFrame, event_id: str, ts: str, delay: str) -> DataFrame:
    """Stream of the events, once per id, and of all late ones marked in ``late``.

    A copy is found as long as the watermark, ``delay`` behind the latest event, has not left the
    hour of the first one. Events behind the watermark can't be checked any more; they
    all come out as late. Rows with a null id or time are late too. Ids are kept by a hash
    in ``BUCKETS`` keys, which spreads them evenly.
    """
    timed = events.withColumn("_moment", F.col(ts).cast("timestamp")).withWatermark("_moment", delay)
    micros = F.when(F.col(event_id).isNotNull(), F.unix_micros("_moment"))
    # the frames of a processor rename columns that are no plain names: all get their own
    plain = timed.select(
        F.pmod(F.xxhash64(event_id), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.coalesce(F.col(event_id).cast("string"), F.lit("")).alias("id"),
        F.coalesce(micros, F.lit(-1)).alias("micros"),
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(events.columns)],
    )
    fields = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(events.schema)]
    first = plain.groupBy("bucket").transformWithStateInPandas(
        _FirstOfId(), ", ".join([*fields, "late boolean"]), "append", "eventtime"
    )
    return first.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(events.columns)], "late")
