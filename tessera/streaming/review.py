"""State machines by key over append-only logs: decisions on review items, and leases on tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.relations import tasks_of
from tessera.operators.review import DECISION, SAID, examined
from tessera.operators.review import decided as judge
from tessera.streaming import ingest

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Decisions(StatefulProcessor):
    """Keeps an item's first valid decision and holds every later one against it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", ", ".join(f"{c} string" for c in SAID))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq")
        first = self.first.get()
        first = None if first is None else tuple(first)
        out = []
        for r in log.itertuples(index=False):
            said = tuple(None if pd.isna(v) else v for v in (getattr(r, c) for c in SAID))
            if not pd.isna(r.problem):
                out.append(r.problem)
            elif first is None:
                first = said
                self.first.update(said)
                out.append("accepted")
            else:
                out.append("repeated" if said == first else "conflict")
        yield pd.DataFrame({"seq": log["seq"], "queue_item_id": key[0], "outcome": out})

    def close(self) -> None:
        pass


def decided(stream: DataFrame, items: DataFrame) -> DataFrame:
    """``(seq, queue_item_id, outcome)`` of a stream of decisions on frozen ``items``, in the order in which they arrive.

    Within one micro-batch ``seq`` decides.  The outcome is that of ``operators.review.decided`` if the log arrives in
    order; an item's state is its first valid decision alone, however many follow.
    """
    rows = examined(items, stream)
    return rows.groupBy("queue_item_id").transformWithStateInPandas(Decisions(), "seq long, queue_item_id string, outcome string", "append", "None")


def decide_new(spark: SparkSession, source: str, items: DataFrame, sink: str, state: str) -> None:
    """Writes the outcomes of the decisions in ``source`` not seen yet to ``sink``, as ``decided`` does; a second call goes on.

    A micro-batch is judged as a whole, in joins, against the decisions that earlier ones accepted, which are files
    under ``state``.  Each batch has folders of its own, so one that is run again replaces what it wrote.
    """
    schema = ", ".join(["queue_item_id string", *(f"{c} string" for c in SAID), "batch long"])

    def publish(log: DataFrame, batch: int) -> None:
        here = log.sparkSession
        before = here.read.schema(schema).parquet(f"{state}/accepted").where(F.col("batch") < batch) if batch else None
        judge(items, log, before).write.mode("overwrite").parquet(f"{state}/judged/batch={batch}")
        judged = here.read.parquet(f"{state}/judged/batch={batch}")
        judged.where("outcome = 'accepted'").select("queue_item_id", *SAID).write.mode("overwrite").parquet(f"{state}/accepted/batch={batch}")
        judged.select("seq", "queue_item_id", "outcome").write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    ingest.staged(spark, source, DECISION, f"{state}/checkpoint", publish)


#: Seconds that a lease may last (fixed values), and the columns of a task's state.
SHORTEST, LONGEST = 30, 3600
LEASES = "reviewer string, until long, status string"


def lease_step(leases: list[list], kind: str, reviewer: str, at: int, seconds: int | None, required: int) -> tuple[str, list[tuple[str, int]]]:
    """What becomes of one event of a task, and the leases that ran out before it: ``(outcome, [(reviewer, until)])``.

    ``leases``, which it changes, has [reviewer, until, status] of all that the task ever gave: held, expired or judged.
    A claim is granted while judgments and leases together are fewer than ``required``, once to each reviewer; a
    judgment counts while the reviewer's lease runs.  Times are milliseconds.
    """
    gone = [(x[0], x[1]) for x in leases if x[2] == "held" and x[1] <= at]
    for x in leases:
        if x[2] == "held" and x[1] <= at:
            x[2] = "expired"
    judged, held = (sum(x[2] == s for x in leases) for s in ("judged", "held"))
    if kind == "claim":
        if seconds is None or not SHORTEST <= seconds <= LONGEST:
            return "invalid_lease", gone
        if judged >= required:
            return "done", gone
        if any(x[0] == reviewer for x in leases):
            return "seen_before", gone
        if judged + held >= required:
            return "held", gone
        leases.append([reviewer, at + 1000 * seconds, "held"])
        return "granted", gone
    for x in leases:
        if x[0] == reviewer and x[2] == "held":
            x[2] = "judged"
            return "judged", gone
    return "no_lease", gone


OUT = "task string, event_id long, reviewer string, at long, outcome string"


def _played(task: str, log: pd.DataFrame, leases: list[list], required: int) -> tuple[list[tuple], list[int]]:
    """Rows of OUT for the events in order of time and id, and the ends of the leases that they gave."""
    out, ends = [], []
    for r in log.sort_values(["at", "event_id"]).itertuples(index=False):
        outcome, gone = lease_step(leases, r.kind, r.reviewer, int(r.at), None if pd.isna(r.seconds) else int(r.seconds), required)
        out += [(task, None, who, until, "expired") for who, until in gone]
        out.append((task, r.event_id, r.reviewer, int(r.at), outcome))
        if outcome == "granted":
            ends.append(leases[-1][1])
    return out, ends


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"event_id": "Int64"})


class Leases(StatefulProcessor):
    """A task's leases; a timer ends the one that nobody touches any more."""

    def __init__(self, required: int) -> None:
        self.required = required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.leases = handle, handle.getListState("leases", LEASES)

    def _read(self) -> list[list]:
        return [list(x) for x in self.leases.get()] if self.leases.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        leases = self._read()
        out, ends = _played(key[0], pd.concat(list(rows)), leases, self.required)
        if leases:
            self.leases.put([tuple(x) for x in leases])
        for end in ends:
            self.handle.registerTimer(end)
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, leases, out = expiredTimerInfo.getExpiryTimeInMs(), self._read(), []
        for x in leases:
            if x[2] == "held" and x[1] <= now:
                x[2] = "expired"
                out.append((key[0], None, x[0], x[1], "expired"))
        if out:
            self.leases.put([tuple(x) for x in leases])
            yield _frame(out)

    def close(self) -> None:
        pass


def leased(stream: DataFrame, required: int = 1, time: str = "at_time", delay: str = "0 seconds", clock: str = "EventTime") -> DataFrame:
    """Outcomes of a stream of claims and judgments (task, event_id, kind, reviewer, at, seconds), and leases that ended.

    At most ``required`` reviewers hold or have judged a task at one time, also where their claims are in one
    micro-batch; a lease that runs out returns the task, at the latest when its timer fires.  With ``clock="EventTime"``
    timers follow the watermark of ``time``, with ``"ProcessingTime"`` the machine's clock.
    """
    rows = stream.withWatermark(time, delay) if clock == "EventTime" else stream
    return rows.groupBy("task").transformWithStateInPandas(Leases(required), OUT, "append", clock)


def replayed(events: DataFrame, required: int = 1) -> DataFrame:
    """The same outcomes from a log at rest; of the leases that ran out, those that a later event of the task met.

    A task's events follow one another by nature, so they are in one partition, one after the other; its state is as
    small as in the stream, and no task's log is held whole.
    """

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, leases = None, []
        for log in frames:
            out = []
            columns = (log[c].to_numpy(object, na_value=None) for c in ("task", "event_id", "kind", "reviewer", "at", "seconds"))
            for name, event, kind, reviewer, at, seconds in zip(*columns, strict=True):
                if name != task:
                    task, leases = name, []
                outcome, gone = lease_step(leases, kind, reviewer, int(at), None if seconds is None else int(seconds), required)
                out += [(name, None, who, until, "expired") for who, until in gone]
                out.append((name, event, reviewer, int(at), outcome))
            yield _frame(out)

    rows = events.select("task", "event_id", "kind", "reviewer", "at", "seconds").repartition(tasks_of(events), "task")
    return rows.sortWithinPartitions("task", "at", "event_id").mapInPandas(play, OUT)


def with_store(spark: SparkSession, run: Callable[[], None]) -> None:
    """Runs a query whose state needs the RocksDB store, and leaves the session's setting as it was."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        run()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
