"""Alerts on clients whose errors no sale followed, by one stateful stream that is started anew for every batch.

An error click joins its client's open obligation or opens one, which stays open through ``due``; a sale cancels it. Events count in
the order of their own times, clicks before sales at the same time, in whatever batch they come; an obligation that nothing cancels is an alert.

Clients are hashed into buckets, and a bucket is one group of the stream. Its state holds the open obligations of its clients in a dictionary and one
heap of all that is to happen: buffered events and deadlines, ordered by time. A cancelled obligation leaves its
deadline in the heap; it is passed over when it comes up, as the dictionary no longer knows it. Every batch brings each bucket one tick row
with the exact watermark W of the batch. Events before it are late; what lies in the heap before it can no longer be
preceded by anything and happens. The last tick has no bound and empties the heap.

The watermarks come from one aggregate by batch, so a start of the query only reads the rows of its own batch. Between the scan
and the shuffle to the buckets each task thins its rows, which are laid out by client and period of at most the time an obligation stays open: of a client's
events of a period only the first and last sale remain, and no click between them, as the last sale cancels each of them and none
can be due before; clicks of the same time become one row with their number, and so do late events. What remains of a hot client grows
with the periods, not with its rows, as long as it buys at all; its clicks in periods without a sale travel one row for each distinct time.

Rows. Events without client or time take no part; equal clicks count once, equal sales each. Without ``arrived_at`` a row
comes in the last batch, with one before the start in the first; a null id has remainder 0. A batch may be empty. Times without a zone
are UTC. Other columns only tell clicks apart. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ._runtime import use_shared_checkpoints

HOUR = 3_600_000_000
BATCHES, SPREAD, HOURS = 8, 80, 3648
START = "2024-01-01"
OPEN, LATENESS = 24 * HOUR, 96 * HOUR
#: Groups of the state. A bucket is held by one task at a time; take more for more clients.
BUCKETS = 256
CLICK, SALE, DEADLINE, TICK = 0, 1, 2, 9
NEVER, EVER = -(1 << 63), (1 << 63) - 1
_EVENT = "batch int, client_id long, at long, kind int, n long"
_FOUND = "batch int, client_id long, opened_us long, due_us long, n_rows long"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone is taken as UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"cast(cast(cast(`{name}` - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) * 1000000 as long)")
    return F.unix_micros(F.col(name).cast("timestamp"))


def batch_of(df: DataFrame, id_: str, batches: int = BATCHES) -> Column:
    """The batch that a row comes in."""
    start = F.lit(int(np.datetime64(START, "us").astype(np.int64)))
    hours = F.floor((micros(df, "arrived_at") - start) / F.lit(HOUR)) + SPREAD * F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 4, F.lit(0))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor(hours * batches / HOURS))), F.lit(batches - 1)).cast("int")


def events_of(clicks: DataFrame, sales: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows (batch, client_id, at, kind, n) of error clicks, equal ones once, and of sales."""
    errors = clicks.where("kind = 'error' and client_id is not null and ts is not null").distinct()
    one = F.lit(1).cast("long").alias("n")
    clicked = errors.select(batch_of(errors, "click_id", batches).alias("batch"), F.col("client_id").cast("long").alias("client_id"), micros(errors, "ts").alias("at"), F.lit(CLICK).alias("kind"), one)
    sold = sales.where("client_id is not null and sold_at is not null")
    return clicked.unionByName(sold.select(batch_of(sold, "sale_id", batches).alias("batch"), F.col("client_id").cast("long").alias("client_id"), micros(sold, "sold_at").alias("at"), F.lit(SALE).alias("kind"), one))


def thinned(watermark: int, period: int):
    """Rows (batch, client_id, at, kind, n), best in the order of client and time, less those that change nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            columns = [whole.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            tick = columns[3] == TICK
            if tick.any():
                yield whole.filter(pa.array(tick))
                columns = [c[~tick] for c in columns]
            batch, client, at, kind, n = (c.astype(np.int64) for c in columns)
            if not len(batch):
                continue
            late = at < watermark
            out = []
            if late.any():
                # one row with the number of a client's late events stands for all
                order = np.flatnonzero(late)[np.lexsort((client[late], batch[late]))]
                b, c = batch[order], client[order]
                begin = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
                out.append((b[begin], c[begin], np.minimum.reduceat(at[order], begin), kind[order][begin], np.add.reduceat(n[order], begin)))
            own = np.flatnonzero(~late)
            if len(own):
                own = own[np.lexsort((kind[own], at[own], client[own], batch[own]))]
                b, c, a, k, m = batch[own], client[own], at[own], kind[own], n[own]
                slot = a // period
                group = np.cumsum(np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (slot[1:] != slot[:-1])])) - 1
                first, last = np.full(group[-1] + 1, EVER), np.full(group[-1] + 1, NEVER)
                sold = k == SALE
                np.minimum.at(first, group[sold], a[sold])
                np.maximum.at(last, group[sold], a[sold])
                lo, hi = first[group], last[group]
                stays = np.where(sold, (a == lo) | (a == hi), (a <= lo) | (a > hi))
                b, c, a, k, m = (x[stays] for x in (b, c, a, k, m))
                begin = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (k[1:] != k[:-1])]))
                out.append((b[begin], c[begin], a[begin], k[begin], np.add.reduceat(m, begin)))
            b, c, a, k, m = (np.concatenate(x) for x in zip(*out))
            yield pa.record_batch([pa.array(b, pa.int32()), pa.array(c), pa.array(a), pa.array(k, pa.int32()), pa.array(m)], ["batch", "client_id", "at", "kind", "n"])

    return run


class Bucket:
    """Open obligations (first, due, n) by client, and the heap of (time, kind, client, n) that is to happen."""

    def __init__(self, held: bytes = b"", period: int = OPEN) -> None:
        self.period = period
        rows = np.frombuffer(held, np.int64).reshape(-1, 4)
        n = int(rows[0, 0]) if len(rows) else 0
        self.open = {c: (first, due, m) for c, first, due, m in rows[1 : n + 1].tolist()}
        # a heap that was written in its own order is a heap
        self.heap = [tuple(r) for r in rows[n + 1 :].tolist()]

    def held(self) -> bytes:
        rows = [(len(self.open), 0, 0, 0), *((c, *x) for c, x in self.open.items()), *self.heap]
        return np.array(rows, np.int64).tobytes()

    def advance(self, watermark: int, client: np.ndarray, at: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
        """Takes in the events of a batch and lets all before ``watermark`` happen: late events by client, and alerts (client, first, due, n)."""
        late: dict[int, int] = {}
        behind = at < watermark
        for c, m in zip(client[behind].tolist(), n[behind].tolist()):
            late[c] = late.get(c, 0) + m
        ahead = ~behind
        self.heap += zip(at[ahead].tolist(), kind[ahead].tolist(), client[ahead].tolist(), n[ahead].tolist())
        heapq.heapify(self.heap)
        alerts = []
        while self.heap and self.heap[0][0] < watermark:
            when, what, c, m = heapq.heappop(self.heap)
            now = self.open.get(c)
            if what == CLICK:
                if now is None:
                    now = (when, when + self.period, 0)
                    heapq.heappush(self.heap, (now[1], DEADLINE, c, 0))
                self.open[c] = (now[0], now[1], now[2] + m)
            elif what == SALE:
                self.open.pop(c, None)
            elif now is not None and now[1] == when:
                alerts.append((c, *self.open.pop(c)))
        return late, alerts


def _stepped(period: int):
    """The rows that a bucket gets in a micro-batch to its alerts and late events."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [[f[c].to_numpy(np.int64) for c in ("batch", "client_id", "at", "kind", "n")] for f in frames]
        batch, client, at, kind, n = (np.concatenate(x) for x in zip(*parts))
        bucket = Bucket(state.get[0] if state.exists else b"", period)
        out = []
        for b in np.unique(batch).tolist():
            mine, tick = (batch == b) & (kind != TICK), (batch == b) & (kind == TICK)
            late, alerts = bucket.advance(int(at[tick].max()), client[mine], at[mine], kind[mine], n[mine])
            out += [(b, c, -1, -1, m) for c, m in late.items()] + [(b, *a) for a in alerts]
        state.update((bucket.held(),))
        yield pd.DataFrame(out, columns=["batch", "client_id", "opened_us", "due_us", "n_rows"]).astype({"batch": "int32"} | dict.fromkeys(["client_id", "opened_us", "due_us", "n_rows"], "int64"))

    return run


def watermarks(staged: DataFrame, batches: int, lateness: int) -> list[int]:
    """W of each batch and of the end: one number a batch comes to the driver."""
    latest = {r["batch"]: r["at"] for r in staged.groupBy("batch").agg(F.max("at").alias("at")).collect()}
    found, most = [], None
    for b in range(batches):
        found.append(NEVER if most is None else most - lateness)
        most = max((x for x in (most, latest.get(b)) if x is not None), default=None)
    return [*found, EVER]


def follow(events: DataFrame, batches: int = BATCHES, period: int = OPEN, lateness: int = LATENESS, buckets: int = BUCKETS, between: Callable[[int], None] | None = None) -> DataFrame:
    """Rows (batch, client_id, opened_us, due_us, n_rows) of alerts, and of late events by batch and client with times of -1.

    ``events`` are (batch, client_id, at, kind, n). Input, state and result lie in a new folder under the shared one. ``between`` is called before each start.
    """
    spark = events.sparkSession
    use_shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/followup-{uuid.uuid4().hex}"
    events.select("batch", "client_id", "at", "kind", "n").write.partitionBy("batch").parquet(f"{folder}/staged")
    staged = spark.read.schema(_EVENT).parquet(f"{folder}/staged")
    slot = F.floor(F.col("at") / period)
    for b, watermark in enumerate(watermarks(staged, batches, lateness)):
        if between is not None:
            between(b)
        rows = staged.where(F.col("batch") == b).select("batch", "client_id", "at", "kind", "n")
        rows = rows.repartition("client_id", slot).sortWithinPartitions("client_id", "at", "kind")
        ticks = spark.range(0, buckets, 1, 1).select(F.lit(b).alias("batch"), F.col("id").alias("client_id"), F.lit(watermark).cast("long").alias("at"), F.lit(TICK).alias("kind"), F.lit(0).cast("long").alias("n"))
        rows.unionByName(ticks).write.mode("append").parquet(f"{folder}/feed")
        fed = spark.readStream.schema(_EVENT).parquet(f"{folder}/feed").mapInArrow(thinned(watermark, period), _EVENT)
        # a tick's client is the number of its bucket
        bucket = F.when(F.col("kind") == TICK, F.col("client_id")).otherwise(F.pmod(F.xxhash64("client_id"), F.lit(buckets)))
        stepped = fed.withColumn("bucket", bucket.cast("int")).groupBy("bucket").applyInPandasWithState(_stepped(period), _FOUND, "held binary", "append", GroupStateTimeout.NoTimeout)
        query = stepped.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(_FOUND).parquet(f"{folder}/found")
