"""Rules on a feed of sessions: the streaming form of the daily replay, its stored form, and a keyed upsert."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.asof import latest_by
from tidemark.operators.rules import FILING, settle_sessions, settled_events, settled_state
from tidemark.sources.sinks import delete_path, new_rows, table_exists, upsert_by_key

EVENTS = ("rule_id int, ticker string, trigger_date date, condition string, threshold double, metric_key string, "
          "value double, percentile double")
#: The state of a ticker: its pairs, one entry per rule; `seen` is when (in ms) the pair's last session arrived.
STATE = "pairs array<struct<rule_id int, held boolean, marker date, session date, seen bigint>>"
STATE_DDL = "rule_id int, ticker string, last_session date, last_held boolean, last_marker date"
EVENT_KEY = ["rule_id", "ticker", "trigger_date"]
#: What a session says of its rule: equal for the sessions that are packed together.
RULE = ["rule_id", "ticker", "condition", "threshold", "metric_key"]
PACKED = "rule_id int, ticker string, condition string, threshold double, metric_key string, sessions binary"
#: A session within a packed row. Days count from 1970-01-01; no day of a date is as large as `UNKNOWN`.
SESSION = np.dtype([("day", "i4"), ("marker", "i4"), ("holds", "?"), ("value", "f8"), ("percentile", "f8")])
UNKNOWN = 2**31 - 1
EPOCH = dt.date(1970, 1, 1)
#: A pair without a session for so long is forgotten: its rule or its company is gone.
TTL_DAYS = 400
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State with a lifetime asks for another batch after each batch; a run that ends once its input is read must not wait for it.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """What streams of `edge_events` need while they start and run; the session's own settings return afterwards."""
    before = {key: spark.conf.get(key) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sessions of one pair and rule in an Arrow batch become one row; none is left out, whatever their order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sessions = np.empty(batch.num_rows, SESSION)
        for field, column in (("day", "session"), ("marker", "marker")):
            sessions[field] = batch[column].cast(pa.int32()).fill_null(UNKNOWN).to_numpy()
        sessions["holds"] = batch["holds"].fill_null(False).to_numpy(zero_copy_only=False)
        for field in ("value", "percentile"):
            sessions[field] = batch[field].fill_null(np.nan).to_numpy()
        codes = [batch[c].dictionary_encode().indices.fill_null(-1).to_numpy() for c in RULE]
        order = np.lexsort(codes)
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for code in codes:
            new[1:] |= np.diff(code[order]) != 0
        starts = np.flatnonzero(new)
        texts = batch.select(RULE).take(pa.array(order[starts]))
        packed = [part.tobytes() for part in np.split(sessions[order], starts[1:])]
        yield pa.RecordBatch.from_arrays([*texts.columns, pa.array(packed, pa.binary())], names=[*RULE, "sessions"])


def _day(day: dt.date | None) -> int:
    return UNKNOWN if day is None else (day - EPOCH).days


def _date(day: int) -> dt.date | None:
    return None if day == UNKNOWN else EPOCH + dt.timedelta(days=int(day))


def _crossings(sessions: np.ndarray, filing: np.ndarray, prior: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Places of the sessions that cross, and the state after the last one; `filing` marks those of a filing rule.

    `prior` is (held, marker, session) or None for a pair never evaluated. A session at or
    before the last evaluated one changes nothing, so replays and late rows are harmless.
    """
    order = np.argsort(sessions["day"], kind="stable")
    if prior is not None:
        days = sessions["day"][order]
        order = order[(days > _day(prior[2])) & (days != UNKNOWN)]
    if not len(order):
        return order, None
    marker = sessions["marker"][order]
    before = np.concatenate(([_day(prior[1]) if prior else UNKNOWN], marker[:-1]))
    changed = (marker != UNKNOWN) & (marker != before)
    changed[0] &= prior is not None
    holds = np.where(filing[order], changed, sessions["holds"][order])
    held_before = np.concatenate(([bool(prior and prior[0])], holds[:-1]))
    last = (bool(holds[-1]), _date(marker[-1]), _date(sessions["day"][order[-1]]))
    return order[holds & ~held_before], last


class TickerState(StatefulProcessor):
    """The last evaluations of one ticker under its rules, and the events that follow from new sessions.

    One state value holds all rules of a ticker: the state store is asked once per ticker and batch, not once per pair.
    """

    def __init__(self, ttl_days: int = TTL_DAYS) -> None:
        self._ttl = ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", STATE, ttlDurationMs=self._ttl)

    def _pairs(self, now: int) -> dict:
        """(held, marker, session, seen) by rule. The value expires with its ticker, a pair with its own last session."""
        stored = self._last.get()
        return {rule: tuple(last) for rule, *last in (stored[0] if stored else ()) if last[3] + self._ttl > now}

    def _keep(self, pairs: dict) -> None:
        self._last.update(([(rule, *last) for rule, last in pairs.items()],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        # One entry per session of one pair: a micro-batch holds at most its new sessions.
        now = timerValues.getCurrentProcessingTimeInMs()
        by_rule: dict = {}
        for row in rows:
            by_rule.setdefault(row["rule_id"], []).append(row)
        pairs, events = self._pairs(now), []
        for rule, packed in by_rule.items():
            parts = [np.frombuffer(row["sessions"], SESSION) for row in packed]
            sessions, source = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(part) for part in parts])
            filing = np.array([row["condition"] == FILING for row in packed])[source]
            crossed, last = _crossings(sessions, filing, pairs[rule][:3] if rule in pairs else None)
            if last is not None:
                pairs[rule] = (*last, now)
            for place in crossed:
                row, seen = packed[source[place]], sessions[place]
                value, percentile = (None if np.isnan(seen[c]) else float(seen[c]) for c in ("value", "percentile"))
                events.append(Row(
                    rule_id=row["rule_id"], ticker=row["ticker"], trigger_date=_date(seen["day"]),
                    condition=row["condition"], threshold=row["threshold"], metric_key=row["metric_key"],
                    value=None if filing[place] else value, percentile=percentile))
        self._keep(pairs)
        yield from events

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        now = timerValues.getCurrentProcessingTimeInMs()
        last = (bool(initialState["last_held"]), initialState["last_marker"], initialState["last_session"], now)
        self._keep({**self._pairs(now), initialState["rule_id"]: last})

    def close(self) -> None:
        pass


def edge_events(sessions: DataFrame, stored: DataFrame | None = None, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Events of a stream of (rule_id, ticker, session, condition, threshold, metric_key, holds, marker, value,
    percentile). State per ticker is one typed value with an entry per rule, which expires `ttl_days` after its last session
    arrived. `stored` (STATE_COLUMNS, one row per pair) lets a new stream go on from an evaluated state.

    Sessions are packed before they are shuffled: Python meets few rows per pair and batch, not one per session.
    Start the query under `state_settings`.
    """
    initial = None if stored is None else stored.groupBy("ticker")
    packed = sessions.select(*RULE, "session", "marker", "holds", "value", "percentile").mapInArrow(_pack, PACKED)
    return packed.groupBy("ticker").transformWithState(
        TickerState(ttl_days), EVENTS, "Append", "ProcessingTime", initialState=initial)


def stream_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(STATE_COLUMNS) as a stream's last committed micro-batch left it in its state store."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    value = "value.value" if "value" in held.schema["value"].dataType.names else "value"
    return held.select("key.ticker", F.inline(f"{value}.pairs")).select(
        "rule_id", "ticker", F.col("session").alias("last_session"), F.col("held").alias("last_held"),
        F.col("marker").alias("last_marker"))


def run_events(sessions: DataFrame, path: str, checkpoint: str, stored: DataFrame | None = None) -> None:
    """Append the events of everything that has arrived to a table, then stop."""
    with state_settings(sessions.sparkSession):
        query = (edge_events(sessions, stored).writeStream.format("parquet").option("path", path)
                 .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()


# ---- stored rule state -----------------------------------------------------------------
def state_path(root: str, epoch: int) -> str:
    return f"{root}/state/batch={epoch}"


def settled_path(root: str, epoch: int) -> str:
    return f"{root}/settled/batch={epoch}"


def evaluate_batch(sessions: DataFrame, epoch: int, root: str) -> None:
    """Fold one micro-batch of sessions over the state the batch before it left; store events and state.

    Both are written to folders of the batch's own, from the previous batch's state, and events already recorded by
    earlier batches are not inserted again. So a batch that is run twice, or again after a failure, changes nothing.
    The state is written last. States older than the previous one are dropped.

    Sessions are folded once: what crosses or comes last is stored, and both results are read from it.
    """
    spark = sessions.sparkSession
    folded = settle_sessions(sessions, read_state(spark, root, epoch - 1))
    folded.write.mode("overwrite").parquet(settled_path(root, epoch))
    settled = spark.read.schema(folded.schema).parquet(settled_path(root, epoch))
    events, state = settled_events(settled), settled_state(settled)
    if epoch > 0 and table_exists(spark, f"{root}/events"):
        earlier = spark.read.schema(f"{EVENTS}, batch long").parquet(f"{root}/events").where(F.col("batch") < epoch)
        events = new_rows(earlier, events, EVENT_KEY)
    events.write.mode("overwrite").parquet(f"{root}/events/batch={epoch}")
    state.write.mode("overwrite").parquet(state_path(root, epoch))
    delete_path(spark, settled_path(root, epoch))
    if epoch > 1:
        delete_path(spark, state_path(root, epoch - 2))


def read_state(spark: SparkSession, root: str, epoch: int) -> DataFrame:
    """The state after a batch; empty before the first one."""
    if epoch < 0:
        return spark.createDataFrame([], STATE_DDL)
    return spark.read.schema(STATE_DDL).parquet(state_path(root, epoch))


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{EVENTS}, batch long").parquet(f"{root}/events").drop("batch")


def run_evaluations(sessions: DataFrame, root: str, checkpoint: str) -> int:
    """Evaluate everything that has arrived, batch by batch, then stop; the number of the last batch, -1 for none."""
    query = (sessions.writeStream.foreachBatch(lambda batch, epoch: evaluate_batch(batch, epoch, root))
             .trigger(availableNow=True).option("checkpointLocation", checkpoint).start())
    query.awaitTermination()
    return max((p.batchId for p in query.recentProgress if p.numInputRows), default=-1)


def refresh_table(feed: DataFrame, path: str, staging: str, checkpoint: str,
                  keys: list[str], order: list[str]) -> StreamingQuery:
    """Upsert everything that has arrived into a key-bucketed table, then stop.

    Of several rows for a key in one micro-batch the greatest in `order` counts. A repeated micro-batch rewrites the same rows, so a retry after a failure is harmless.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        newest = latest_by(batch, keys, order).select(*batch.columns)
        upsert_by_key(newest, path, f"{staging}/epoch={epoch}", keys)

    return (feed.writeStream.foreachBatch(write).trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start())
