"""Streams: cleaned text, first-wins dedup, and the state of conversations.

Rows of a conversation carry numbers from 0 on. They may come in any order, over any number of micro-batches, and more
than once: a row that is ahead of its turn waits in a map state, one that was taken is passed over. What a processor
makes of a row never depends on how the rows were dealt to batches, so that a run that ends halfway goes on from its
checkpoint to the same result. State needs the RocksDB provider, which ``run`` sets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions import text as T
from tessera.operators import corpus as C
from tessera.streaming.reading import Reading

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def text_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Cleaned documents of a folder of text files, as they arrive."""
    lines = spark.readStream.options(**options).text(path).select(T.clean(F.make_valid_utf8("value")).alias("text"))
    return lines.filter(C.keep(F.col("text")))


def first_seen(df: DataFrame, column: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each text. With an event time, what the watermark has passed is forgotten."""
    name = T.unused(df, "key")
    keyed = df.withColumn(name, F.sha2(column, 256))
    if time is None:
        return keyed.dropDuplicates([name]).drop(name)
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark([name]).drop(name)


#: Waiting rows of a key that are one entry of its state: they are read and written together.
WAITING = 256


class InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of their numbers; what a row brings are texts and numbers.

    Every call of a state is a round trip to the JVM, so that states are read when a key's rows come and written once when
    they are taken, and rows wait in lots: a key's trips follow its micro-batches and lots, not its rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long, waiting long")
        self.waiting = handle.getMapState("waiting", "lot long", "rows string")
        self.begin()

    def begin(self) -> None:
        """Further state."""

    def open(self) -> None:
        """Reads the key's further state, before rows are taken."""

    def take(self, at: int, row: tuple) -> bool:
        """One row in its turn; False if the key takes no more."""
        raise NotImplementedError

    def save(self) -> None:
        """Writes the key's further state, after rows were taken."""

    def result(self, key) -> Row | None:
        raise NotImplementedError

    def lot(self, k: int, stored: bool) -> dict[int, tuple]:
        """The rows that wait in lot ``k`` of the state, by number."""
        got = self.waiting.getValue((k,)) if stored else None
        return {at: tuple(row) for at, row in json.loads(got[0])} if got else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, stored = self.due.get() or (0, 0)
        here = {}
        for r in rows:
            if r["at"] >= due >= 0:
                here.setdefault(r["at"], tuple(r[c] for c in r.__fields__ if c not in ("conv_id", "at")))
        before, waiting, lots = due, stored, {}
        if due in here:  # what waits is of use only behind it
            self.open()
        while due in here or (due > before and waiting):
            k = due // WAITING
            if waiting and k not in lots:
                lots[k] = self.lot(k, stored > 0)
            row = lots.get(k, {}).pop(due, None)
            waiting -= row is not None
            row = here.pop(due, row)
            if row is None:
                break
            due = due + 1 if self.take(due, row) else -1
        if due < 0 <= before:
            self.waiting.clear()
            waiting = 0
        elif due >= 0:
            for at, row in here.items():
                k = at // WAITING
                if k not in lots:
                    lots[k] = self.lot(k, stored > 0)
                waiting += at not in lots[k]
                lots[k][at] = row
            for k, held in lots.items():
                if held:
                    self.waiting.updateValue((k,), (json.dumps([*held.items()]),))
                elif stored:
                    self.waiting.removeKey((k,))
        if (due, waiting) != (before, stored):
            self.due.update((due, waiting))
        if due != before:
            self.save()
            out = self.result(key)
            if out is not None:
                yield out

    def close(self) -> None:
        pass


class Runs(InOrder):
    """State of a run: how many turns and assistant turns it had, and why it stopped."""

    def __init__(self, max_steps: int, threshold: float, execute: bool):
        self.max_steps, self.threshold, self.execute = max_steps, threshold, execute

    def begin(self):
        self.run = self.handle.getValueState("run", "turns long, steps long, reason string")

    def open(self):
        self.now = self.run.get() or (0, 0, "")

    def take(self, at, row):
        turns, steps, reason = self.now
        role, n_calls, confidence = row
        turns += 1
        if role == "assistant":
            steps += 1
            unsure = confidence is not None and confidence < self.threshold
            reason = "escalate" if unsure else "done" if not n_calls else "reported" if not self.execute else "max_steps" if steps >= self.max_steps else ""
        self.now = (turns, steps, reason)
        return not reason

    def save(self):
        self.run.update(self.now)

    def result(self, key):
        turns, _, reason = self.now
        return Row(conv_id=key[0], turns=turns, stop_reason=reason)


def agent_runs(turns: DataFrame, max_steps: int = 8, threshold: float = 0.0, execute: bool = True) -> DataFrame:
    """Turns (conv_id, turn, role, n_calls, confidence) to runs: (conv_id, turns, stop_reason), as they change.

    A run stops at an assistant turn: as ``escalate`` if its confidence lies under ``threshold``, before anything else; as
    ``done`` if it has no calls; as ``reported`` if calls aren't to be executed; as ``max_steps`` after so many with calls.
    Later turns of a stopped run are ignored.
    """
    if max_steps < 1:
        raise ValueError("max_steps must be at least 1")
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), "role", F.col("n_calls").cast("long").alias("n_calls"), F.col("confidence").cast("double").alias("confidence"))
    return t.groupBy("conv_id").transformWithState(Runs(max_steps, threshold, execute), "conv_id long, turns long, stop_reason string", "update", "none")


class Calls(InOrder):
    """State of a turn: the reader's, which holds no text that it has read."""

    def __init__(self, tools: str):
        self.tools = json.loads(tools)

    def begin(self):
        self.saved = self.handle.getValueState("reader", "saved string")

    def open(self):
        self.reader = Reading(self.tools, (self.saved.get() or (None,))[0])

    def take(self, at, row):
        self.reader.feed(row[0] or "")
        return True

    def save(self):
        self.saved.update((self.reader.saved(),))

    def result(self, key):
        r = self.reader.report()
        return Row(conv_id=key[0], state=r["state"], text=r["text"], tool=r["tool"], forbids_close=r["forbids_close"])


def call_states(pieces: DataFrame, tools: str) -> DataFrame:
    """Pieces (conv_id, at, piece) of unfinished turns to the state in which each turn stands; ``tools`` is JSON text."""
    p = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("at").cast("long").alias("at"), "piece")
    return p.groupBy("conv_id").transformWithState(Calls(tools), "conv_id long, state string, text string, tool string, forbids_close boolean", "update", "none")


class Ring(InOrder):
    """State of a memory: the pinned first rows, and the last of the others."""

    def __init__(self, pinned: int, window: int):
        self.pinned, self.last = pinned, window - pinned

    def begin(self):
        self.first = self.handle.getListState("first", "at long, payload string")
        self.ring = self.handle.getListState("ring", "at long, payload string")

    def open(self):
        self.head, self.tail = ([tuple(x) for x in s.get()] if s.exists() else [] for s in (self.first, self.ring))
        self.new = False

    def take(self, at, row):
        if at < self.pinned:
            self.head.append((at, row[0]))
            self.new = True
        else:
            self.tail = [*self.tail, (at, row[0])][-self.last :]  # what falls out is evicted from the state
        return True

    def save(self):
        if self.new:
            self.first.put(self.head)
        if self.tail:
            self.ring.put(self.tail)

    def result(self, key):
        return Row(conv_id=key[0], held=[Row(at=at, payload=payload) for at, payload in (*self.head, *self.tail)])


def memories(turns: DataFrame, pinned: int, window: int) -> DataFrame:
    """Turns (conv_id, turn, text) to what a memory of ``window`` places holds, the first ``pinned`` of them for good."""
    if not 0 <= pinned < window:
        raise ValueError("at least one place must be left for later rows")
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), F.col("text").cast("string").alias("payload"))
    return t.groupBy("conv_id").transformWithState(Ring(pinned, window), "conv_id long, held array<struct<at:long,payload:string>>", "update", "none")


def recent(turns: DataFrame, pinned: int, window: int) -> DataFrame:
    """Per conversation, the pinned first turns and the last of the rest, ``window`` in all (batch form)."""
    from pyspark.sql import Window

    i, n = T.unused(turns, "i", "n")
    w = Window.partitionBy("conv_id")
    t = turns.withColumn(i, F.row_number().over(w.orderBy("turn"))).withColumn(n, F.count("*").over(w))
    return t.filter((F.col(i) <= pinned) | (F.col(i) > F.col(n) - (window - pinned))).drop(i, n)


def run(stream: DataFrame, where: str, mode: str = "append") -> None:
    """Takes what there is, in as many micro-batches as the source gives, into ``where``/out; a later call goes on from there.

    Each batch is a folder of its own, written whole or again, so that a batch that is run twice counts once."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
        q = q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{where}/out/batch={n}")).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def latest(spark: SparkSession, where: str, key: str) -> DataFrame:
    """The last row that ``run`` wrote of each key."""
    out = spark.read.parquet(f"{where}/out")
    rest = [c for c in out.columns if c not in (key, "batch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
