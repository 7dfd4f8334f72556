"""Turn taking: what a party of a conversation does at each event, decided by a policy as events arrive.

Events are own speech, the other's speech, own backchannels and results from the environment. The policy
knows who speaks over whom: a run of speech lasts as long as its events come within ``overlap``. It

- keeps talking, or stops once the other has talked on over it for long enough: ``interrupted`` events
  where the other barged in, ``interrupting`` where this party did or tells a result;
- answers a result of the environment at once;
- listens, and every ``interval`` events may interrupt a run that is long enough, or drop a
  backchannel if it hasn't for long enough;
- speaks up when both parties have been silent for longer than their waits.

Silence is no event, so it is a timer in event time. Rows wait in the state until the watermark has passed
them and are then taken in order, so the result doesn't depend on how they are dealt over triggers.
A key that is silent for ``idle`` begins anew, and the watermark then drops its state.

Times are milliseconds; of equal times the lesser id comes first; rows without a time or of another kind
are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that state variables and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("self", "other", "backchannel", "tool")
#: A row that waits in the state; ``code`` is the place of its kind, and beyond those that of a row without an id.
_ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("code", "u1")])
#: Most rows of one element of the list that waits.
_HELD = 10_000


@dataclass(frozen=True)
class Policy:
    """Thresholds: of times in milliseconds, of runs in events; None never stops, interrupts or backchannels."""

    wait_other: int = 60_000
    wait_self: int = 120_000
    interrupted: int | None = 2
    interrupting: int | None = 4
    interrupt_after: int | None = None
    backchannel_after: int | None = 3
    backchannel_every: int = 5
    interval: int = 1
    overlap: int = 30_000
    idle: int = 86_400_000

    def __post_init__(self) -> None:
        if self.idle <= max(self.wait_other, self.wait_self, self.overlap) or self.interval < 1:
            raise ValueError("a key has to stay longer than any wait, and the interval is at least 1")


@dataclass(slots=True)
class Standing:
    """What the policy remembers of a conversation; times are NULL before the first such event."""

    last: int | None = None
    last_self: int | None = None
    last_other: int | None = None
    began_self: int | None = None
    began_other: int | None = None
    run_other: int = 0
    events: int = 0
    since_backchannel: int = 0
    result_due: bool = False
    telling_result: bool = False
    spoke_up: bool = True


def speaks_up_at(s: Standing, p: Policy) -> int | None:
    """When both waits are over; None without speech or if it has spoken up already."""
    if s.spoke_up:
        return None
    ends = [t + wait for t, wait in ((s.last_other, p.wait_other), (s.last_self, p.wait_self)) if t is not None]
    return max(ends) + 1


def step(s: Standing, p: Policy, at: int, kind: str) -> str:
    """The action at an event; the standing is changed in place."""
    if s.last is not None and at - s.last > p.idle:
        s.__init__()
    other_on = s.last_other is not None and at - s.last_other <= p.overlap
    s.last, s.events, s.since_backchannel = at, s.events + 1, s.since_backchannel + 1
    if kind == "tool":
        s.result_due = True
        return "generate_message"
    if kind == "other":
        s.last_other, s.spoke_up = at, False
        if other_on:
            s.run_other += 1
        else:
            s.began_other, s.run_other = at, 1
        checked = s.events % p.interval == 0
        if checked and p.interrupt_after is not None and s.run_other >= p.interrupt_after:
            return "generate_message"
        if checked and p.backchannel_after is not None and s.run_other >= p.backchannel_after and s.since_backchannel >= p.backchannel_every:
            s.since_backchannel = 0
            return "backchannel"
        return "wait"
    if s.last_self is None or at - s.last_self > p.overlap:  # own speech begins
        s.began_self, s.telling_result, s.result_due = at, s.result_due, False
    s.last_self, s.spoke_up = at, False
    if not other_on:
        s.run_other = 0
    if kind == "backchannel":
        s.since_backchannel = 0
        return "keep_talking"
    barged_in = other_on and s.began_self > s.began_other
    most = p.interrupting if s.telling_result or barged_in else p.interrupted
    stops = other_on and p.interrupted is not None and most is not None and s.run_other >= most
    return "stop_talking" if stops else "keep_talking"


def replay(s: Standing, p: Policy, events: Iterable[tuple[int, int, str]], until: int | None = None) -> tuple[Standing, list[tuple[int, int | None, str]]]:
    """``at, id, action`` of events ``(at, id, kind)`` in order and of silences between them, of the last only before ``until``."""
    out: list[tuple[int, int | None, str]] = []
    s = replace(s)
    for at, number, kind in events:
        silence = speaks_up_at(s, p)
        if silence is not None and silence < at:
            out.append((silence, None, "generate_message"))
            s.spoke_up = True
        out.append((at, number, step(s, p, at, kind)))
    silence = speaks_up_at(s, p)
    if silence is not None and until is not None and silence < until:
        out.append((silence, None, "generate_message"))
        s.spoke_up = True
    return s, out


def _stretches(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[k : k + _HELD].tobytes(),) for k in range(0, len(rows), _HELD)]


class TurnTaking(StatefulProcessor):
    """The policy over a stream: rows wait in a list until the watermark has passed them; one value is the standing.

    The list's elements are stretches of rows as bytes, as each element costs a message to the JVM and a conversion.
    """

    def __init__(self, policy: Policy, key: str):
        self.policy, self.key = policy, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"bool": "boolean"}
        schema = ", ".join(f"{f.name} {kinds.get(str(f.type), 'bigint')}" for f in fields(Standing))
        self.handle = handle
        self.standing = handle.getValueState("standing", schema)
        self.waiting = handle.getListState("waiting", "stretch binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            new = np.empty(len(part), _ROW)
            for name in _ROW.names:
                new[name] = part[name].to_numpy()
            if len(new):
                for stretch in _stretches(new):
                    self.waiting.appendValue(stretch)
                earliest = int(new["at"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            # The earliest thing to do of this key, its only timer; one that has passed comes at once.
            timers = list(self.handle.listTimers())
            if not timers or first < min(timers):
                for old in timers:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        held = np.concatenate([np.empty(0, _ROW), *(np.frombuffer(bytes(x), _ROW) for (x,) in self.waiting.get())])
        held = held[np.lexsort((held["id"], held["code"] >= len(KINDS), held["at"]))]
        over = int(np.searchsorted(held["at"], until))
        rest, codes = held[over:], held["code"][:over].tolist()
        due = ((at, i if c < len(KINDS) else None, KINDS[c % len(KINDS)]) for at, i, c in zip(held["at"][:over].tolist(), held["id"][:over].tolist(), codes, strict=True))
        known = self.standing.get()
        before = Standing(*known) if known is not None else Standing()
        after, out = replay(before, self.policy, due, until)
        if over and len(rest):
            self.waiting.put(_stretches(rest))
        elif over:
            self.waiting.clear()
        # No timer is set for a time that has passed: the one that fired, a key's only one, is deleted when this returns.
        ends = None if after.last is None else after.last + self.policy.idle
        if ends is not None and ends < until:
            self.standing.clear()
            coming = []
        else:
            self.standing.update(tuple(getattr(after, f.name) for f in fields(after)))
            silence = speaks_up_at(after, self.policy)
            coming = [t for t in (silence if silence is not None else ends,) if t is not None]
        coming += rest["at"][:1].tolist()
        if coming:
            self.handle.registerTimer(min(coming))
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "at": [x[0] for x in out], "id": pd.array([x[1] for x in out], dtype="Int64"), "action": [x[2] for x in out]})


def stream_turn_taking(events: DataFrame, policy: Policy, key: str, ts: str, number: str, kind: str, late: str) -> DataFrame:
    """``key, at, id, action`` of a stream of events, once the watermark (``late`` behind the latest time) has passed them.

    ``id`` is NULL where a silence was broken. Rows later than the watermark are left out, as of any stream.
    """
    code = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col(kind)) - 1 + F.when(F.col(number).cast("long").isNull(), len(KINDS)).otherwise(0)
    rows = events.where(F.col(ts).isNotNull() & F.col(kind).isin(*KINDS)).select(key, F.col(ts).cast("timestamp").alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col(number).cast("long"), F.lit(0)).alias("id"), F.coalesce(code, F.lit(0)).alias("code"))
    schema = f"{key} {dict(events.dtypes)[key]}, at bigint, id bigint, action string"
    return rows.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(TurnTaking(policy, key), outputStructType=schema, outputMode="Append", timeMode="EventTime")
