"""Tickets as a table and an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline import schemas
from faultline.functions import text as t
from faultline.session import complete_folders

#: Order of events of one instant and sequence number.
_EVENT_RANK = {"INSERT": 0, "STATUS_UPDATE": 1, "DELETE": 2}


def next_seq(log: DataFrame | None) -> Column:
    """First unused sequence number of an event log; 0 without one."""
    if log is None:
        return F.lit(0).cast("bigint")
    return log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).cast("bigint").alias("n")).scalar()


_PAYLOAD = [
    "key", "summary", "description", "status", "component", "priority", "assignee", "reporter",
    "duplicate_of", "media_paths", "created", "updated",
]


def ticket_search_text(summary: Column, description: Column) -> Column:
    parts = [t.blank_to_null(t.strip(F.coalesce(c, F.lit("")))) for c in (summary, description)]
    return F.concat_ws("\n", *parts)


def highest_number(tickets: DataFrame) -> Column:
    """Largest number of the existing keys; keys without one are ignored."""
    number = F.regexp_extract("key", r"^[^-]*-\s*([+-]?\d+)\s*$", 1).try_cast("bigint")
    return tickets.select(F.greatest(F.coalesce(F.max(number), F.lit(0)), F.lit(0)).alias("n")).scalar()


def next_key(tickets: DataFrame, prefix: str = "TKT-") -> DataFrame:
    number = F.regexp_extract("key", r"^[^-]*-\s*([+-]?\d+)\s*$", 1).try_cast("bigint")
    return tickets.agg(
        F.concat(F.lit(prefix), (F.greatest(F.coalesce(F.max(number), F.lit(0)), F.lit(0)) + 1).cast("string")).alias("next_key")
    )


def number_rows(rows: DataFrame, by: str) -> DataFrame:
    """Dense numbers 1..n without a global sort.

    Rows are ordered by the first three hex digits of the MD5 of ``by``, then
    ``by``. Each of the 4096 even buckets is numbered on its own and shifted by
    the rows of the buckets before it.
    """
    bucket = F.substring(F.md5(F.coalesce(F.col(by).cast("string"), F.lit(""))), 1, 3)
    spread = rows.withColumn("_b", bucket)
    counts = spread.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(by))
    return (
        spread.withColumn("_i", inside)
        .join(F.broadcast(offsets), "_b")
        .withColumn("number", F.col("_before") + F.col("_i"))
        .drop("_b", "_i", "_before")
    )


def insert_tickets(
    drafts: DataFrame,
    tickets: DataFrame,
    now: Column,
    by: str = "report_id",
    prefix: str = "TKT-",
    log: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New ticket rows with minted keys, and their INSERT events.

    Single writer: keys continue after the largest existing one, sequence numbers
    after the last one of ``log``. The events of one call share theirs.
    """
    numbered = number_rows(drafts, by)
    opt = {c: t.blank_to_null(F.col(c)) for c in ("component", "priority", "assignee", "reporter", "duplicate_of")}
    new = numbered.select(
        by,
        F.concat(F.lit(prefix), (highest_number(tickets) + F.col("number")).cast("string")).alias("key"),
        F.left(F.coalesce("summary", F.lit("")), F.lit(500)).alias("summary"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit(lx.DEFAULT_STATUS).alias("status"),
        *[c.alias(n) for n, c in opt.items()],
        F.coalesce("media_paths", F.array().cast("array<string>")).alias("media_paths"),
        now.cast("timestamp_ntz").alias("created"),
        now.cast("timestamp_ntz").alias("updated"),
    )
    return new, insert_events(new, next_seq(log))


def insert_events(tickets: DataFrame, seq: Column | None = None) -> DataFrame:
    payload = F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) if c not in ("media_paths", "created", "updated") else F.col(c) for c in _PAYLOAD]))
    return tickets.select(
        F.col("created").alias("timestamp"),
        (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"),
        F.lit("INSERT").alias("event"), "key", payload.alias("payload"),
    )


def update_status(
    tickets: DataFrame,
    changes: DataFrame,
    now: Column,
    statuses: list[str] = lx.STATUSES,
    log: DataFrame | None = None,
    order: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid changes applied: the new table, STATUS_UPDATE events, rejected rows.

    Of several valid ``changes(key, to)`` of a key the one with the highest ``order``
    column counts, or without one the status that comes last in ``statuses``.
    """
    from faultline.operators.quality import status_domain_check

    rejects = status_domain_check(changes, tickets, statuses).filter(F.col("reject_reason").isNotNull())
    stamp = now.cast("timestamp_ntz")
    # Changes of unknown keys find no ticket, so this one join applies exactly the valid ones.
    place = F.array_position(F.array(*[F.lit(x) for x in statuses]), F.col("to"))
    latest = [F.col(order)] if order else []
    allowed = (
        changes.filter(F.col("to").isin(list(statuses)))
        .groupBy("key")
        .agg(F.max_by("to", F.struct(*latest, place)).alias("to"))
    )
    joined = tickets.join(allowed, "key", "left")
    updated = joined.withColumns(
        {
            "updated": F.when(F.col("to").isNotNull(), stamp).otherwise(F.col("updated")),
            "status": F.coalesce("to", "status"),
        }
    ).select(*tickets.columns)
    events = joined.filter(F.col("to").isNotNull()).select(
        stamp.alias("timestamp"), next_seq(log).alias("seq"), F.lit("STATUS_UPDATE").alias("event"), "key",
        F.to_json(F.struct(F.col("status").alias("from"), F.col("to"))).alias("payload"),
    )
    return updated, events, rejects


def delete_tickets(
    tickets: DataFrame, keys: DataFrame, now: Column, log: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Remaining tickets, and DELETE events so that a replay is complete."""
    gone = keys.select("key").distinct()
    events = tickets.join(gone, "key", "left_semi").select(
        now.cast("timestamp_ntz").alias("timestamp"), next_seq(log).alias("seq"),
        F.lit("DELETE").alias("event"), "key", F.lit("{}").alias("payload"),
    )
    return tickets.join(gone, "key", "left_anti"), events


def event_state(events: DataFrame) -> DataFrame:
    """What a replay needs to know of each key: the last insert, status and event, and when they were.

    Events of one instant and sequence number are taken as INSERT, STATUS_UPDATE, DELETE.
    """
    ranks = F.create_map(*[F.lit(x) for pair in _EVENT_RANK.items() for x in pair])
    order = F.struct("timestamp", "seq", F.element_at(ranks, F.col("event")).alias("rank"))
    inserted = F.col("event") == "INSERT"
    status = F.when(inserted, F.get_json_object("payload", "$.status")).when(
        F.col("event") == "STATUS_UPDATE", F.get_json_object("payload", "$.to")
    )
    return events.groupBy("key").agg(
        F.max_by(F.when(inserted, F.col("payload")), F.when(inserted, order)).alias("payload"),
        F.max(F.when(inserted, order)).alias("payload_at"),
        F.max_by(status, F.when(status.isNotNull(), order)).alias("status"),
        F.max(F.when(status.isNotNull(), order)).alias("status_at"),
        F.max_by("event", order).alias("last"),
        F.max(order).alias("last_at"),
        F.max(F.when(inserted, F.col("timestamp"))).alias("created"),
        F.max("timestamp").alias("updated"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """States of parts of a log to those of the whole, in any order of the parts."""
    parts = [F.max_by(c, f"{c}_at").alias(c) for c in ("payload", "status", "last")]
    marks = [F.max(f"{c}_at").alias(f"{c}_at") for c in ("payload", "status", "last")]
    merged = states.groupBy("key").agg(*parts, *marks, F.max("created").alias("created"), F.max("updated").alias("updated"))
    return merged.select(*states.columns)


def tickets_of(states: DataFrame) -> DataFrame:
    """The tickets that are there, from the states of their keys."""
    alive = states.filter((F.col("last") != "DELETE") & F.col("payload").isNotNull())
    body = alive.withColumn("p", F.from_json("payload", schemas.INSERT_PAYLOAD))
    kept = ["summary", "description", "component", "priority", "assignee", "reporter", "duplicate_of"]
    return body.select(
        "key", *[F.col(f"p.{c}").alias(c) for c in kept[:2]], "status",
        *[t.blank_to_null(F.col(f"p.{c}")).alias(c) for c in kept[2:]],
        F.coalesce("p.media_paths", F.array().cast("array<string>")).alias("media_paths"), "created", "updated",
    )


def replay_state(events: DataFrame) -> DataFrame:
    """Current tickets from the log alone: one grouped pass, combined map-side."""
    return tickets_of(event_state(events))


# --- a log on disk, with snapshots --------------------------------------------------------


def append_log(events: DataFrame, path: str) -> int:
    """Writes the events as the next batch of the log at ``path``; returns its number."""
    number = max([-1, *complete_folders(events.sparkSession, f"{path}/log", "batch=")]) + 1
    events.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
    return number


def _state_of_log(spark: SparkSession, path: str, upto: int | None) -> tuple[DataFrame, int, int]:
    """State up to a batch, the snapshot's mark in it (-1: none) and the last batch."""
    batches = [n for n in complete_folders(spark, f"{path}/log", "batch=") if upto is None or n <= upto]
    if not batches:
        raise ValueError(f"no events below {path}")
    mark = max([-1, *[n for n in complete_folders(spark, f"{path}/state", "upto=") if n <= batches[-1]]])
    tail = [f"{path}/log/batch={n}" for n in batches if n > mark]
    states = event_state(spark.read.parquet(*tail)) if tail else None
    if mark >= 0:
        before = spark.read.parquet(f"{path}/state/upto={mark}")
        states = before if states is None else merge_states(before.unionByName(states))
    return states, mark, batches[-1]


def snapshot_log(spark: SparkSession, path: str) -> int:
    """Writes the state up to the last complete batch; returns that batch, the high-water mark.

    It reads the last snapshot and the batches behind it. Batches count in the order they were
    appended, so an event whose time lies before the mark is not lost: it is in a later
    batch, and states merge by the events' own order. Needless folders stay for their owner.
    """
    states, mark, last = _state_of_log(spark, path, None)
    if last > mark:
        states.write.mode("overwrite").parquet(f"{path}/state/upto={last}")
    return last


def replay_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Tickets after batch ``upto`` (default: the last) from the nearest snapshot and the rest."""
    return tickets_of(_state_of_log(spark, path, upto)[0])


def last_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Latest status per key, from a log that carries the status directly."""
    moment = F.struct(*order)
    return events.groupBy(key).agg(
        F.max_by(status, moment).alias("status"), F.max(order[0]).alias("updated"), F.count("*").alias("n_events")
    )


def event_order_state(
    events: DataFrame, key: str, status: str, ts: str, seq: str, chunk: str = "day"
) -> DataFrame:
    """Previous status and time until the next event, per key in log order.

    The log of one key may be a large part of the table, so it is cut into
    stretches of time. Neighbours are found inside a stretch; its first and
    last event look into the neighbouring stretches through a summary with one
    row per key and stretch.
    """
    cut = events.withColumn("_c", F.date_trunc(chunk, F.col(ts)))
    inside = Window.partitionBy(key, "_c").orderBy(ts, seq)
    local = cut.withColumns(
        {"_prev": F.lag(status).over(inside), "_next": F.lead(ts).over(inside)}
    )
    order = F.struct(F.col(ts), F.col(seq))
    edges = cut.groupBy(key, "_c").agg(F.max_by(status, order).alias("_last"), F.min(ts).alias("_first"))
    across = Window.partitionBy(key).orderBy("_c")
    links = edges.select(
        key, "_c", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after")
    )
    links = links.withColumnsRenamed({key: "_key", "_c": "_stretch"})
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_c").eqNullSafe(F.col("_stretch"))
    return local.join(links, same).select(
        *events.columns,
        F.coalesce("_prev", "_before").alias("previous_status"),
        (F.unix_micros(F.coalesce("_next", "_after").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))).alias("micros_in_status"),
    )


def tickets_newest_first(tickets: DataFrame, created: str = "created", key: str = "key") -> DataFrame:
    return tickets.orderBy(F.desc(created), key)


def backfill_missing(tickets: DataFrame, encode) -> DataFrame:
    """Vectors for the rows that lack one; ``encode`` maps ``(key, text)`` to ``(key, vec)``."""
    pending = tickets.filter(F.col("vec").isNull()).select(
        "key", ticket_search_text(F.col("summary"), F.col("description")).alias("text")
    )
    filled = encode(pending).select("key", F.col("vec").alias("_new"))
    return tickets.join(filled, "key", "left").withColumn("vec", F.coalesce("vec", "_new")).drop("_new")


def add_missing_column(tickets: DataFrame, name: str, kind: str) -> DataFrame:
    """The column added as nulls where a table predates it."""
    return tickets if name in tickets.columns else tickets.withColumn(name, F.lit(None).cast(kind))


# --- corrections ------------------------------------------------------------------------


def corrections_latest(corrections: DataFrame, mode: str = "latest") -> DataFrame:
    """One row per bug hash (the newest), or every row with ``mode='all'``."""
    if mode == "all":
        return corrections
    row = F.struct(*corrections.columns)
    order = F.struct("timestamp", "corrected_component")
    return corrections.groupBy("bug_hash").agg(F.max_by(row, order).alias("r")).select("r.*")


def union_training(issues: DataFrame, corrections: DataFrame) -> DataFrame:
    return issues.unionByName(corrections, allowMissingColumns=True)
