"""The polling loop as micro-batches: each takes what has landed, rations it and stores it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark import model
from tidemark.functions import urls
from tidemark.lineage import settled
from tidemark.operators import health
from tidemark.operators.dedupe import WINDOW_MS
from tidemark.operators.health import run_summary
from tidemark.operators.normalise import normalise, usable
from tidemark.operators.tagging import Taxonomy
from tidemark.store import Store


#: The setting that state beyond a value a key needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest_batch(store: Store, taxonomy: Taxonomy, raw: DataFrame, now_ms: int, take: int = 5) -> dict:
    """One pass over raw items: known rows leave before the ration, so a backlog drains a few at a time."""
    rows = usable(normalise(raw, store.read("sources"), taxonomy, now_ms))
    return store.insert(rows, now_ms, take).first().asDict()


def run(spark: SparkSession, store: Store, taxonomy: Taxonomy, landing: str, checkpoint: str, clock: Callable[[], int], take: int = 5, every: str | None = "60 seconds"):
    """Starts the query over a folder of raw items; every=None takes what is there and ends."""
    raw = spark.readStream.schema(model.RAW_ITEMS).parquet(landing)

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_batch(store, taxonomy, batch, clock(), take)

    writer = raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest(spark: SparkSession, store: Store, taxonomy: Taxonomy, landing: str, checkpoint: str, clock: Callable[[], int], every: str | None = "60 seconds", compact_every: int = 100):
    """The loop from landed bodies (model.LANDED) on: each micro-batch is a run over the sources that it has bodies of."""
    landed = spark.readStream.schema(model.LANDED).parquet(landing)

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch, taxonomy, clock())
            if number % compact_every == compact_every - 1:
                store.compact(keep=compact_every)  # panels may still read what a batch before found

    writer = landed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def due_run(store: Store, taxonomy: Taxonomy, fetch: Callable[[DataFrame], DataFrame], now_ms: int, force: bool = False) -> tuple[DataFrame | None, int]:
    """One pass: the sources that are due (with force all that are active) go to fetch in the order of their schedule, and what lands is stored.

    fetch gets id, host, lane, place, start_ms, config_json and validators, and gives bodies (model.LANDED); those of
    sources that weren't asked for are left out. Returns the outcomes and what a command would exit with, 1 if any
    source is broken; None and 0 where none was due.
    """
    due = settled(health.schedule(health.to_run(store.read("sources"), now_ms, force), urls.host(F.col("homepage"))))
    if due.isEmpty():
        return None, 0
    asked = due.select("id", "institution", "name", "homepage", "config_json", "etag", "last_modified", "host", "lane", "place", "start_ms")
    landed = fetch(asked).join(due.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return once(store, taxonomy, landed, now_ms)


def poll(spark: SparkSession, store: Store, taxonomy: Taxonomy, fetch: Callable[[DataFrame], DataFrame], checkpoint: str, clock: Callable[[], int], every: str = "60 seconds"):
    """The polling loop: a pass over what is due at every tick."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, __: due_run(store, taxonomy, fetch, clock())).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()


def once(store: Store, taxonomy: Taxonomy, landed: DataFrame, now_ms: int) -> tuple[DataFrame, int]:
    """One run whatever the clock: its outcomes, and what a command would exit with, 1 if any source is broken."""
    outcomes = store.ingest(landed, taxonomy, now_ms)
    return outcomes, int(run_summary(outcomes).first()["broken"] > 0)


def fresh_only(stream: DataFrame, store: Store, step: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """step gets a stream's rows, batch by batch, whose hash is neither stored nor pruned when the batch begins."""

    def fresh(batch: DataFrame, number: int) -> None:
        step(batch.join(store.known(batch), "canonical_hash", "left_anti").select(*batch.columns), number)

    return stream.writeStream.foreachBatch(fresh)


class KeptDates(StatefulProcessor):
    """The fold of one title, row by row, with the dates of its kept rows as state.

    Dates are kept by buckets as wide as the window. Kept dates lie more than the window apart, so a bucket has
    one at most, and a row asks for its own and the two beside it, however many dates there are. With a watermark
    a date goes by a timer when no row that may still come can meet it.
    """

    def __init__(self, window_ms: int, evict: bool):
        self.window_ms, self.evict = window_ms, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dates = handle.getMapState("dates", "bucket long", "at long")

    def _meets(self, at: int) -> bool:
        bucket = at // self.window_ms
        for b in (bucket, bucket - 1, bucket + 1):
            if self.dates.containsKey((b,)) and abs(self.dates.getValue((b,))[0] - at) <= self.window_ms:
                return True
        return False

    def handleInputRows(self, key, rows, timerValues):
        for r in sorted(rows, key=lambda r: r.pos):
            dated = r.title_key != "" and r.published_at is not None and r.institution is not None
            kept = not (dated and self._meets(r.published_at))
            if kept and dated:
                self.dates.updateValue((r.published_at // self.window_ms,), (r.published_at,))
                if self.evict:
                    self.handle.registerTimer(r.published_at + self.window_ms + 1)
            yield Row(institution=r.institution, title_key=r.title_key, pos=r.pos, published_at=r.published_at, kept=kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs() - self.window_ms - 1
        if self.dates.containsKey((at // self.window_ms,)) and self.dates.getValue((at // self.window_ms,))[0] == at:
            self.dates.removeKey((at // self.window_ms,))
        return iter(())

    def close(self) -> None:
        pass


def greedy_stream(stream: DataFrame, window_ms: int = WINDOW_MS, late: str | None = None) -> DataFrame:
    """institution, title_key, pos, published_at, kept of a stream's rows, as the batch fold decides.

    Without late, rows are judged however late they come and all kept dates are state. With it (`30 days`), rows
    more than that behind the newest date are dropped, and dates that no other row can meet leave the state.
    The session needs the RocksDB state store (STATE_STORE), as any map state.
    """
    schema = "institution string, title_key string, pos long, published_at long, kept boolean"
    rows = stream.select("institution", "title_key", "pos", "published_at")
    if late:
        rows = rows.withColumn("at", F.timestamp_millis("published_at")).withWatermark("at", late)
    return rows.groupBy("institution", "title_key").transformWithState(KeptDates(window_ms, bool(late)), StructType.fromDDL(schema), "append", "EventTime" if late else "None")


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; an addition to what the loop needs."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
