"""The interaction state machine: per stream key, an event for each completed hand-and-shelf transfer.

A wrist comes near a region (approach), stays (contact), its hand changes between empty and carrying while the shelf
changes to match (transfer), and leaves (withdrawal). Means of the evidence before and after the transfer decide the type and
the confidence. The state is a record of fixed size - phase, times, running sums - so that batch and stream share it.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

KEY = ["clip_id", "actor_id", "hand_side", "region_id"]
OUT = "clip_id string, actor_id string, hand_side string, region_id string, cycle long, type string, t_start double, transfer_s double, t_end double, confidence double"
#: What the machine reads of an observation besides its key.
_FIELDS = ["timestamp_s", "inside_region", "distance_px", "trajectory_confidence", "hand_empty", "hand_carrying", "hand_uncertain", "shelf_removed", "shelf_placed", "shelf_uncertain"]
EPS = 1e-9
#: The two transfers: hand before, hand after, shelf change.
TRANSFERS = {"pickup": ("empty", "carrying", "removed"), "putdown": ("carrying", "empty", "placed")}


@dataclass(frozen=True)
class Config:
    near_px: float = 40.0
    approach_s: float = 0.10
    contact_s: float = 0.15
    transfer_s: float = 0.20
    withdrawal_s: float = 0.10
    gap_s: float = 0.50
    timeout_s: float = 3.00
    separation_s: float = 0.30
    hand: float = 0.55
    shelf: float = 0.50
    uncertainty: float = 0.50
    confidence: float = 0.50
    weights: tuple[float, float, float] = (0.40, 0.40, 0.20)


@dataclass
class Mean:
    """Sums of named values and how often they were added; the mean of nothing is 0."""

    n: int = 0
    sums: dict = field(default_factory=dict)

    def add(self, **values: float) -> None:
        self.n += 1
        for k, v in values.items():
            self.sums[k] = self.sums.get(k, 0.0) + v

    def __getitem__(self, k: str) -> float:
        return self.sums.get(k, 0.0) / self.n if self.n else 0.0


@dataclass
class State:
    """All that is kept between two rows of a key."""

    phase: str = "outside"
    since: float | None = None
    start: float | None = None
    emitted: bool = False
    cycle: int = 0
    last_seen: float | None = None
    last_event: float | None = None
    before: Mean = field(default_factory=Mean)
    after: Mean = field(default_factory=Mean)

    def go(self, phase: str, t: float) -> None:
        self.phase, self.since = phase, t

    def restart(self) -> None:
        """A new cycle; the times of the last row and the last event survive."""
        self.phase, self.since, self.start, self.emitted = "outside", None, None, False
        self.before, self.after = Mean(), Mean()
        self.cycle += 1


def hand(r) -> dict:
    return {"empty": r.hand_empty, "carrying": r.hand_carrying, "hand_unsure": r.hand_uncertain}


def all_evidence(r) -> dict:
    return hand(r) | {"removed": r.shelf_removed, "placed": r.shelf_placed, "shelf_unsure": r.shelf_uncertain, "track": r.trajectory_confidence}


def transfer_type(before: Mean, now, unsure: float, c: Config) -> str | None:
    if unsure > c.uncertainty:
        return None
    return next((k for k, (a, b, s) in TRANSFERS.items() if before[a] >= c.hand and now[b] >= c.hand and now[s] >= c.shelf), None)


def decided(s: State, c: Config) -> str | None:
    """The type that the means before and after the transfer agree on."""
    if not s.before.n or not s.after.n:
        return None
    return transfer_type(s.before, s.after, (s.before["hand_unsure"] + s.after["hand_unsure"] + s.after["shelf_unsure"]) / 3, c)


def emit(s: State, t: float, c: Config) -> dict | None:
    """The event of this cycle, unless one was emitted, it is too close to the last, or too uncertain."""
    kind = None if s.emitted else decided(s, c)
    if kind is None or (s.last_event is not None and t - s.last_event < c.separation_s - EPS):
        return None
    a, b, shelf = TRANSFERS[kind]
    unsure = round((s.before["hand_unsure"] + s.after["hand_unsure"] + s.after["shelf_unsure"]) / 3, 4)
    parts = min(round(s.before[a], 4), round(s.after[b], 4)), round(s.after[shelf], 4), round(s.after["track"], 4)
    sure = round(sum(w * x for w, x in zip(c.weights, parts, strict=True)) * (1 - 0.5 * unsure), 4)
    sure = max(0.0, min(1.0, sure))
    if sure < c.confidence:
        return None
    s.emitted, s.last_event = True, t
    return {"cycle": s.cycle, "type": kind, "t_start": s.start or t, "transfer_s": s.since or t, "t_end": t, "confidence": sure}


def feed(s: State, r, c: Config) -> dict | None:
    """One observation, in time order; changes s and returns the event that it completes, if any."""
    t, d = r.timestamp_s, r.distance_px
    d = None if d is None or d != d else d
    if s.last_seen is not None and t - s.last_seen > c.gap_s:
        s.restart()
    if s.since is not None and t - s.since > c.timeout_s and s.phase != "outside":
        s.restart()
    s.last_seen = t
    near = bool(r.inside_region) or (d is not None and d <= c.near_px)
    left = not r.inside_region and d is not None and d > c.near_px
    held = t - s.since if s.since is not None else 0.0
    if s.phase == "outside":
        if near:
            s.go("approach", t)
            s.start = t
    elif s.phase == "approach":
        if left and d > 2 * c.near_px:
            s.restart()
        elif held >= c.approach_s - EPS:
            s.go("contact", t)
            s.before = Mean()
            s.before.add(**hand(r))
    elif s.phase == "contact":
        if left:
            if held < c.contact_s - EPS:
                s.restart()
            else:
                s.go("withdrawal", t)
        elif transfer_type(s.before, now := all_evidence(r), (now["hand_unsure"] + now["shelf_unsure"]) / 2, c):
            s.go("transfer", t)
            s.after = Mean()
            s.after.add(**now)
        else:
            s.before.add(**hand(r))
    elif s.phase == "transfer":
        if left:
            event = emit(s, t, c) if held >= c.transfer_s - EPS else None
            s.go("withdrawal", t)
            return event
        s.after.add(**all_evidence(r))
        if held >= c.transfer_s - EPS:
            if decided(s, c) is None:
                s.go("withdrawal", t)
            else:
                return emit(s, t, c)
    elif near:  # back from withdrawal: evidence and the emitted mark stay
        s.go("contact", t)
    elif held >= c.withdrawal_s - EPS:
        event = emit(s, t, c)
        s.restart()
        return event
    return None


def interaction_events(obs: DataFrame, config: Config | None = None) -> DataFrame:
    """Events of every stream key in a bounded table. Rows are dealt by key and sorted by time inside partitions; a task walks them once and holds one
    record and one batch of rows, however many rows a key has."""
    c = config or Config()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        for df in batches:
            found = []
            for r in df.itertuples(index=False):
                if r[:4] != key:
                    key, state = r[:4], State()
                if e := feed(state, r, c):
                    found.append((*key, *e.values()))
            if found:
                yield pd.DataFrame(found, columns=[*KEY, "cycle", "type", "t_start", "transfer_s", "t_end", "confidence"])

    rows = obs.select(*KEY, *_FIELDS)
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "timestamp_s").mapInPandas(run, OUT)


#: Events, and rows of type late with how many observations came too late for their stream.
STREAM_OUT = OUT + ", n_late long"
_WAITING = "at_ms long, timestamp_s double, inside_region boolean, " + ", ".join(f"{c} double" for c in _FIELDS[2:])


class Machines(StatefulProcessor):
    """Per stream key: the machine's record, and in a list the rows that wait for the watermark, whose passing feeds them in time order.

    Rows behind the watermark come too late and are counted. A key that had nothing to do for idle_ms of event time loses its state.
    """

    def __init__(self, config: Config, idle_ms: int):
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "body binary, last_ms long")
        self.waiting = handle.getListState("waiting", _WAITING)

    def _wake(self, at_ms: int) -> None:
        """The one timer of a key."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        late, first = 0, None
        for df in rows:
            ok = df["at_ms"] >= mark
            late += int((~ok).sum())
            fresh = df.loc[ok, ["at_ms", *_FIELDS]]
            if len(fresh):
                self.waiting.appendList(list(fresh.astype(object).where(fresh.notna(), None).itertuples(index=False, name=None)))
                first = min(int(fresh["at_ms"].min()), first if first is not None else 1 << 62)
        if first is not None:
            self._wake(min([first, *(t for t in self.handle.listTimers() if not self._idle())]))
        if late:
            yield _named(key, [{"type": "late"}], late)

    def _idle(self) -> bool:
        """Whether the timer only waits for the state to expire."""
        return self.record.exists() and self.record.get()[1] is not None

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] < mark), key=lambda r: r[1])
        rest = [r for r in rows if r[0] >= mark]
        if not rows:
            self.record.clear()
            return
        body = self.record.get()[0] if self.record.exists() else None
        state = pickle.loads(body) if body else State()
        found = [e for r in ready if (e := feed(state, _Row(*r[1:]), self.config))]
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[0] for r in rest))
        else:
            self.waiting.clear()
            self._wake(max(r[0] for r in ready) + self.idle_ms)
        self.record.update((pickle.dumps(state), None if rest else max(r[0] for r in ready)))
        if found:
            yield _named(key, found, 0)

    def close(self) -> None:
        pass


_Row = namedtuple("_Row", _FIELDS)


def _named(key: tuple, rows: list[dict], late: int) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["cycle", "type", "t_start", "transfer_s", "t_end", "confidence"])
    out["cycle"] = out["cycle"].astype("Int64")
    for i, k in enumerate(KEY):
        out.insert(i, k, key[i])
    out["n_late"] = late
    return out


def stream_interactions(obs: DataFrame, config: Config | None = None, time: str = "event_time", late: str = "10 seconds", idle_s: float = 60.0) -> DataFrame:
    """The same machine over a stream of observations with an event time: events, and rows of type late that count what came behind the watermark.

    Rows of a key may come in any order within `late`: they wait until the watermark passes them, so that micro-batches, however cut or shuffled, give the batch result.
    The end of a stream stays open until the watermark moves on. Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    # late rows are counted by the processor, so that they reach it without the time column that Spark would drop them by
    marked = obs.withWatermark(time, late).withColumn("at_ms", F.unix_millis(F.col(time))).select(*KEY, "at_ms", *[F.col(c).cast("boolean" if c == "inside_region" else "double").alias(c) for c in _FIELDS])
    return marked.groupBy(*KEY).transformWithStateInPandas(Machines(config or Config(), int(idle_s * 1000)), STREAM_OUT, "Append", "EventTime")
