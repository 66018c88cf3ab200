"""What was already recommended, kept as the state of a stream.

Each paper has a state of its own (the row of the history), which outlives batches and
restarts and can begin with a stored history. A paper that wasn't announced for a given
time by the watermark is forgotten by a timer, so the state doesn't grow for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenlit.session import ship

#: Times are microseconds since 1970 here, which no time zone changes on the way to Python and back.
STATE = "first_at long, last_at long, times int, best_score double, report long, summary string, analyzed boolean, told_at long, told_by long"
SAID = "arxiv_id string, at long, seen_before boolean, expired boolean, first_at long, last_at long, times int, best_score double, report long, summary string, analyzed boolean"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
_BLANK = dict.fromkeys(_FIELDS)
#: The store that keeps states of this kind.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _later(a: tuple, b: tuple) -> bool:
    """Whether a time and report come after others; without any is first."""
    order = lambda x: [(v is not None, v) for v in x]
    return order(a) >= order(b)


def updated(held: dict[str, Any] | None, row: dict[str, Any]) -> dict[str, Any]:
    """A paper's row of the history after one more announcement, in whatever order they come."""
    old = held or _BLANK
    some = lambda f, *values: f([v for v in values if v is not None], default=None)
    new = old | {"first_at": some(min, old["first_at"], row["micros"]), "times": (old["times"] or 0) + 1, "best_score": some(max, old["best_score"], row["score"])}
    if not held or _later((row["micros"], row["report"]), (old["last_at"], old["report"])):
        new["report"] = row["report"]
    new["last_at"] = some(max, old["last_at"], row["micros"])
    new["analyzed"] = bool(old["analyzed"] or row["analyzed"]) if row["analyzed"] is not None or old["analyzed"] is not None else None
    if row["analyzed"] and row["summary"] is not None and (old["told_at"] is None or _later((row["micros"], row["report"]), (old["told_at"], old["told_by"]))):
        new |= {"summary": row["summary"], "told_at": row["micros"], "told_by": row["report"]}
    return new


class Recommended(StatefulProcessor):
    """Holds a paper's row of the history and forgets it ``keep`` after its last announcement."""

    def __init__(self, keep: timedelta) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("history", STATE)

    def _load(self) -> dict[str, Any] | None:
        return dict(zip(_FIELDS, self.held.get(), strict=True)) if self.held.exists() else None

    def _store(self, state: dict[str, Any]) -> None:
        self.held.update(tuple(state[f] for f in _FIELDS))

    def _wait(self, state: dict[str, Any]) -> None:
        """The paper's only timer: it looks again when it goes off, as the paper may have come again meanwhile."""
        if state["last_at"] is not None:
            self.handle.registerTimer(self._due(state))

    def _due(self, state: dict[str, Any]) -> int:
        return (state["last_at"] + self.keep // timedelta(microseconds=1)) // 1000

    def _said(self, key: str, at: Any, seen: bool, expired: bool, state: dict[str, Any]) -> Row:
        return Row(arxiv_id=key, at=at, seen_before=seen, expired=expired, **{f: state[f] for f in _FIELDS[:7]})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self._load()
        waits = state is not None and state["last_at"] is not None
        if waits and self._due(state) <= timerValues.getCurrentWatermarkInMs():  # its timer goes off after these rows
            yield self._said(key[0], state["last_at"], True, True, state)
            state = None
        for row in sorted((r.asDict() for r in rows), key=lambda r: [(r[c] is not None, r[c]) for c in ("micros", "report")]):
            seen, state = state is not None, updated(state, row)
            yield self._said(key[0], row["micros"], seen, False, state)
        if state is not None:
            self._store(state)
            if not waits:
                self._wait(state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self._load()
        if state is None:
            return
        if self._due(state) > timerValues.getCurrentWatermarkInMs():
            self._wait(state)
            return
        self.held.clear()
        yield self._said(key[0], state["last_at"], True, True, state)

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        told = initialState.asDict()
        told |= {"told_at": told["last_at"] if told["summary"] is not None else None, "told_by": told["report"] if told["summary"] is not None else None}
        self._store(told)
        self._wait(told)

    def close(self) -> None:
        pass


def recommended(rows: DataFrame, late: str = "2 days", keep: timedelta = timedelta(days=365), known: DataFrame | None = None) -> DataFrame:
    """A row for each announcement: whether its paper was recommended before, and the paper's history with it.

    ``rows`` has the columns of ``announcements.SCHEMA``; those without an identifier go. ``known`` is a history that was kept (the columns
    of ``state.replay``). A forgotten paper is told once more, ``expired``, and is new when it comes again.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.where("coalesce(trim(arxiv_id), '') <> ''").withWatermark("at", late).withColumn("micros", F.unix_micros("at")).groupBy("arxiv_id")
    initial = known.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")}).groupBy("arxiv_id") if known is not None else None
    said = timed.transformWithState(Recommended(keep), SAID, "Update", "EventTime", initial)
    return said.withColumns({c: F.timestamp_micros(c) for c in ("at", "first_at", "last_at")})


def latest(said: DataFrame) -> DataFrame:
    """The history that the rows of ``recommended`` end with: the columns of ``state.replay``, forgotten papers aside."""
    fields = _FIELDS[:7]
    last = said.groupBy("arxiv_id").agg(F.max_by(F.struct("expired", *fields), F.struct("times", "expired")).alias("_row"))
    return last.where("not _row.expired").select("arxiv_id", *(F.col(f"_row.{f}").alias(f) for f in fields))
