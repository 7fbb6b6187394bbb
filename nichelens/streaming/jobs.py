"""Streaming forms of the batch work: ingest, dedupe, spend, slots, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StringType, StructType

from nichelens.operators.clustering import ClusterRules, cluster_items
from nichelens.operators.ledger import DAILY_LIMIT_USD
from nichelens.operators.research import ITEM_FACTS, ITEM_METADATA, ITEM_TEXT
from nichelens.operators.slots import SlotRules, _holding
from nichelens.vocab import OCCUPYING_STATUSES

CANDIDATE_WINDOW = "7 days"
CANDIDATE_SECONDS = 7 * 86_400


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything that has landed and append finished rows to a table."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that ``transformWithState`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _per_batch(
    stream: DataFrame, table_path: str, checkpoint: str, step: Callable[[DataFrame, DataFrame | None], DataFrame]
) -> StreamingQuery:
    """Write ``step(batch, rows of earlier batches)`` into a folder of the batch's own.

    A replayed batch overwrites its own folder and sees the same earlier ones, so
    a restart repeats nothing; what is written follows the batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        earlier = [batch_path(table_path, n) for n in range(batch_id)]
        previous = batch.sparkSession.read.parquet(*earlier) if earlier else None
        step(batch, previous).write.mode("overwrite").parquet(batch_path(table_path, batch_id))

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_path(table_path: str, batch_id: int) -> str:
    return f"{table_path}/batch-{batch_id:09d}"


def every_batch(spark: SparkSession, table_path: str) -> DataFrame:
    """Rows of all batches of :func:`stream_clusters`."""
    return spark.read.parquet(f"{table_path}/batch-*")


class ItemState(StatefulProcessor):
    """One value per (source, external id): the item as it stands.

    Arrivals of a batch replay in order of ``arrival``. A changed fingerprint is
    a revision; the rules are those of the batch operator ``store_items``.
    """

    def __init__(self, schema: StructType, columns: dict[str, list[str]]):
        self.schema, self.columns = schema, columns

    def init(self, handle) -> None:
        self.item = handle.getValueState("item", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.item.get()
        item = None if held is None else dict(zip(self.schema.fieldNames(), held, strict=True))
        stored, changes, sightings = item is not None, 0, 0
        for row in sorted(rows, key=lambda r: r["arrival"]):
            sightings += 1
            if item is None:
                item = {c: row[c] for c in self.columns["first"] + self.columns["text"]}
                item |= {"discovered_at": row["arrived_at"], "published_at": row["published_at"], "content_changed_at": None, "revision": 1}
            elif row["content_fingerprint"] != item["content_fingerprint"]:
                changes += 1
                late = item["content_changed_at"]
                item |= {c: row[c] for c in self.columns["text"]}
                if row["published_at"] is not None:
                    item["published_at"] = row["published_at"]
                item["content_changed_at"] = row["arrived_at"] if late is None else max(late, row["arrived_at"])
                item["revision"] += 1
        self.item.update(tuple(item[c] for c in self.schema.fieldNames()))
        action = "NEW" if not stored else "UPDATED" if changes else "UNCHANGED"
        told = {"action": action, "revised": stored and changes > 0, "status": None if stored else "NEW", "changes": changes, "sightings": sightings}
        yield Row(source_key=key[0], external_id=key[1], **item, **told)

    def close(self) -> None:
        pass


def stream_items(arrivals: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Landed items (with identity), batch by batch, as a log of item versions.

    The state keeps one item a key; each batch appends one row for each item it
    touched, and nothing else is written. :func:`latest_items` reads the log. An
    item's arrivals of one batch are ordered in memory.
    """
    facts = [c for c in ITEM_FACTS if c in arrivals.columns]
    texts = [*ITEM_TEXT, *[c for c in ITEM_METADATA if c in arrivals.columns]]
    columns = {"first": ["url", "canonical_url", "url_hash", *facts], "text": texts}
    kinds = {f.name: f.dataType for f in arrivals.schema.fields}
    maps = [c for c in texts if c in ITEM_METADATA]  # a value state does not give maps back
    state = StructType()
    for name in columns["first"] + columns["text"]:
        state.add(name, StringType() if name in maps else kinds[name])
    times = ["discovered_at", "published_at", "content_changed_at"]
    for name in times:  # microseconds: Python's times would depend on the worker's zone
        state.add(name, "long")
    state.add("revision", "long")
    out = StructType().add("source_key", "string").add("external_id", "string")
    for field in state.fields:
        out.add(field)
    out.add("action", "string").add("revised", "boolean").add("status", "string").add("changes", "long").add("sightings", "long")
    micros = [F.unix_micros(c).alias(c) for c in ("published_at", "arrived_at")]
    arrivals = arrivals.withColumns({c: F.to_json(c) for c in maps})
    keyed = arrivals.select("source_key", "external_id", *columns["first"], *texts, *micros, "arrival")
    log = keyed.groupBy("source_key", "external_id").transformWithState(ItemState(state, columns), out, "Append", "None")
    log = log.withColumns({c: F.timestamp_micros(c) for c in times})
    log = log.withColumns({c: F.from_json(c, kinds[c].simpleString()) for c in maps})
    with keyed_state(arrivals.sparkSession):
        return append_stream(log, table_path, checkpoint)


def latest_items(spark: SparkSession, table_path: str) -> DataFrame:
    """Each item as it stands, with all its sightings."""
    log = spark.read.parquet(table_path)
    keys = ["source_key", "external_id"]
    counts = ["changes", "sightings"]
    rest = [c for c in log.columns if c not in (*keys, *counts)]
    # Of rows with one revision, the last appended may differ in nothing but its action.
    last = F.max_by(F.struct(*rest), F.struct("revision", F.col("action") == "UNCHANGED")).alias("last")
    return log.groupBy(*keys).agg(last, *[F.sum(c).alias(c) for c in counts]).select(*keys, "last.*", *counts)


def stream_exact_dedupe(items: DataFrame, event_time: str = "arrived_at") -> DataFrame:
    """Drop repeats of (source, external id, content) seen within the candidate window."""
    return items.withWatermark(event_time, CANDIDATE_WINDOW).dropDuplicatesWithinWatermark(
        ["source_key", "external_id", "content_fingerprint"]
    )


class FirstSightings(StatefulProcessor):
    """Times of a key that still wait for the watermark, and the last time that was kept."""

    def __init__(self, window_seconds: int):
        self.window = window_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "kept long, waiting array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept, waiting = self.held.get() or (None, [])
        times = set(waiting)
        for row in rows:
            if kept is None or row["second"] >= kept + self.window:
                times.add(row["second"])
        fresh = sorted(times)
        if fresh and (not waiting or fresh[0] < waiting[0]):
            self.handle.registerTimer(1000 * fresh[0])
        if fresh or kept is not None:
            self.held.update((kept, fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept, waiting = self.held.get() or (None, [])
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        ripe = [t for t in waiting if 1000 * t <= now]
        for t in ripe:
            if kept is None or t >= kept + self.window:
                kept = t
                out.append(t)
        waiting = [t for t in waiting[len(ripe) :] if kept is None or t >= kept + self.window]
        if waiting:
            self.held.update((kept, waiting))
            self.handle.registerTimer(1000 * waiting[0])
        elif kept is not None and 1000 * (kept + self.window) > now:
            self.held.update((kept, []))
            self.handle.registerTimer(1000 * (kept + self.window))
        else:
            self.held.clear()
        for t in out:
            yield Row(**{f"key{i}": v for i, v in enumerate(key)}, second=t)

    def close(self) -> None:
        pass


def stream_first_sightings(
    items: DataFrame,
    table_path: str,
    checkpoint: str,
    keys: tuple[str, ...] = ("source_key", "external_id", "content_fingerprint"),
    event_time: str = "arrived_at",
    window_seconds: int = CANDIDATE_SECONDS,
    lateness: str = "1 hour",
) -> StreamingQuery:
    """Append the sightings of a key that no kept sighting of the window before them covers.

    A kept sighting covers the ``window_seconds`` from it on, whatever is seen in
    between; the next one after that is kept again. Sightings wait until the
    watermark has passed them and are then judged in order of time (whole
    seconds), so that the answer does not depend on how rows fall into batches,
    as long as none is later than ``lateness``. A key is forgotten when its
    window is over. A key's state is at most one number a second of ``lateness``.
    """
    schema = StructType()
    for i, name in enumerate(keys):
        schema.add(f"key{i}", items.schema[name].dataType)
    schema.add("second", "long")
    timed = items.withWatermark(event_time, lateness).select(*keys, event_time, F.unix_seconds(event_time).alias("second"))
    found = timed.groupBy(*keys).transformWithState(FirstSightings(window_seconds), schema, "Append", "EventTime")
    named = found.select(*[F.col(f"key{i}").alias(name) for i, name in enumerate(keys)], F.timestamp_seconds("second").alias(event_time))
    with keyed_state(items.sparkSession):
        return append_stream(named, table_path, checkpoint)


def stream_spend(
    calls: DataFrame, lateness: str = "1 hour", daily_limit: str = DAILY_LIMIT_USD
) -> DataFrame:
    """Spend per model and UTC day, flagged when it reaches the limit on its own."""
    return (
        calls.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("w"), "model")
        .agg(F.sum("estimated_cost_usd").alias("spent_usd"), F.count("*").alias("calls"))
        .select(
            F.to_date("w.start").alias("day"),
            "model",
            "spent_usd",
            "calls",
            (F.col("spent_usd") >= F.lit(daily_limit).cast("decimal(12,2)")).alias("over_limit"),
        )
    )


def stream_slots(
    publications: DataFrame, rules: SlotRules | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Posts per slot, emitted once the slot is over; later rows are ignored.

    Each post is moved to the end of every slot that holds it, and that end is
    the event time: a group closes when the watermark passes its slot.
    """
    rules = rules or SlotRules()
    placed = (
        publications.filter(F.col("status").isin(*OCCUPYING_STATUSES))
        .select(F.explode(_holding(F.col("created_at"), rules)).alias("s"))
        .select("s.starts_at", "s.ends_at", "s.slot_index")
    )
    return (
        placed.withWatermark("ends_at", lateness)
        .groupBy("ends_at", "starts_at", "slot_index")
        .agg(F.count("*").alias("posts"))
    )


def stream_clusters(
    signatures: DataFrame,
    table_path: str,
    checkpoint: str,
    rules: ClusterRules | None = None,
) -> StreamingQuery:
    """Cluster each micro-batch of signatures against what came before.

    Each batch adds its own signatures with their clusters to the table, and
    rewrites none; candidates are the stored items discovered within the window
    before the oldest item of the batch, and only their days' rows are read whole.
    """

    def step(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        if stored is None:
            found = cluster_items(batch, rules=rules)
            return batch.join(found, "item_id")
        oldest = batch.agg(F.unix_micros(F.min("discovered_at")).alias("at")).first()["at"]
        if oldest is None:  # a batch without rows
            return batch.join(stored.select("item_id", "cluster_key", "matched_by", "similarity", "is_seed"), "item_id")
        since = F.timestamp_micros(F.lit(oldest - CANDIDATE_SECONDS * 1_000_000))
        recent = stored.filter(F.col("discovered_at") >= since)
        found = cluster_items(
            batch,
            stored=recent.select(*batch.columns),
            stored_membership=recent.select("item_id", "cluster_key"),
            stored_clusters=stored.select("cluster_key"),
            rules=rules,
        )
        return batch.join(found, "item_id")

    return _per_batch(signatures, table_path, checkpoint, step)
