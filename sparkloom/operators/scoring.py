"""Rewards from traces: gold actions, communication, state replay, products of components."""

from __future__ import annotations

import copy
import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import product_of, says
from sparkloom.operators.grouped import scan_groups
from sparkloom.sources.workspace import workspace

#: Reasons to end a run that void its reward (fixed values).
PREMATURE = ("max_steps", "too_many_errors", "agent_error", "user_error", "infrastructure_error", "timeout")


def call_matches(gold: Column, call: Column) -> Column:
    """Whether a call is the gold action (F16).

    Both are ``struct<name, args map<string,string>>``, gold also with ``compare_args``. Only the named
    arguments are compared, or without names those of the call; so a call without arguments fits any.
    """
    keys = F.coalesce(gold["compare_args"], F.map_keys(call["args"]))
    same = F.forall(keys, lambda k: F.try_element_at(gold["args"], k).eqNullSafe(F.try_element_at(call["args"], k)))
    return (gold["name"] == call["name"]) & F.coalesce(same, F.lit(True))


def action_reward(golds: str | Column, calls: str | Column) -> Column:
    """1 if each gold action has a matching call (one may serve several), 1 of none."""
    golds = F.col(golds) if isinstance(golds, str) else golds
    calls = F.col(calls) if isinstance(calls, str) else calls
    met = F.forall(golds, lambda g: F.exists(calls, lambda c: call_matches(g, c)))
    return F.coalesce(met, F.lit(True)).cast("double")


def communication_reward(needles: str | Column, messages: str | Column) -> Column:
    """1 if every needle is said in some message."""
    needles = F.col(needles) if isinstance(needles, str) else needles
    messages = F.col(messages) if isinstance(messages, str) else messages
    return F.coalesce(F.forall(needles, lambda n: F.exists(messages, lambda m: says(m, n))), F.lit(True)).cast("double")


def combined_reward(basis: str | Column, components: str | Column, termination: str | Column, premature: tuple[str, ...] = PREMATURE) -> Column:
    """Product of the components in the basis; 0 for a run that ended early; a missing component raises."""
    basis = F.col(basis) if isinstance(basis, str) else basis
    components = F.col(components) if isinstance(components, str) else components
    termination = F.col(termination) if isinstance(termination, str) else termination
    lacking = F.exists(basis, lambda b: ~F.coalesce(F.map_contains_key(components, b), F.lit(False)))
    product = product_of(F.transform(basis, lambda b: F.try_element_at(components, b)))
    return F.when(F.coalesce(termination.isin(*premature), F.lit(False)), 0.0).when(lacking, F.raise_error(F.lit("a component of the basis was not evaluated")).cast("double")).otherwise(product)


def rebased_reward(components: str | Column, basis: str | Column, termination: str | Column) -> Column:
    """A reward for another basis from stored components, absent ones counting as 1."""
    basis = F.col(basis) if isinstance(basis, str) else basis
    components = F.col(components) if isinstance(components, str) else components
    termination = F.col(termination) if isinstance(termination, str) else termination
    product = product_of(F.transform(basis, lambda b: F.try_element_at(components, b)))
    return F.when(F.coalesce(termination.isin(*PREMATURE), F.lit(False)), 0.0).otherwise(product)


def flat_calls(messages: str | Column, roles: tuple[str, ...] = ("assistant", "user")) -> Column:
    """Tool calls of the given roles' messages in order."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    return F.flatten(F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: F.coalesce(m["tool_calls"], F.array())))


def state_hash(state: dict) -> str:
    return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()


#: The generic mutations: set, add to a number, delete, append to a list.
MUTATIONS = ("set", "add", "delete", "append")


class _Absent:
    """No value under a key."""


ABSENT = _Absent()


def _number(value: object) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (ValueError, TypeError):
        return None


@dataclass(slots=True)
class KeyChange:
    """What a stretch of calls does to the value of one key, whatever it was before.

    Up to the stretch's first ``set`` or ``delete`` the outcome depends on the value that it meets, so only
    what matters is kept: the sum of what would be added, the list of what would be appended. From there
    on the value is known.
    """

    adds: int = 0
    total: float = 0.0
    appended: list = field(default_factory=list)
    bad: int = 0
    first: str | None = None
    known: bool = False
    value: object = ABSENT
    failed: int = 0

    def call(self, op: str, value: str | None) -> None:
        """One call more. A call fails if it is none of the mutations, or doesn't fit the value; it then changes nothing."""
        if op in ("set", "delete"):
            self.known, self.value = True, value if op == "set" else ABSENT
            return
        number = _number(value) if op == "add" else None
        if self.known:
            held = self.value
            fits = isinstance(held, list) or held is ABSENT if op == "append" else number is not None and not isinstance(held, list)
            base = (0.0 if held is ABSENT else _number(held)) if fits and op == "add" else None
            if not fits or (op == "add" and base is None):
                self.failed += 1
            elif op == "add":
                self.value = base + number
            elif held is ABSENT:
                self.value = [value]
            else:
                held.append(value)
        elif op == "append":
            self.appended.append(value)
            self.first = self.first or op
        elif number is not None:
            self.adds, self.total = self.adds + 1, self.total + number
            self.first = self.first or op
        else:
            self.bad += 1

    def then(self, more: KeyChange) -> KeyChange:
        """This stretch and the next as one."""
        if self.known:
            self.value, failed = more.after(self.value)
            self.failed += failed
            return self
        self.adds, self.total, self.bad = self.adds + more.adds, self.total + more.total, self.bad + more.bad
        self.appended += more.appended
        self.first = self.first or more.first
        self.known, self.value, self.failed = more.known, more.value, more.failed
        return self

    def after(self, value: object) -> tuple[object, int]:
        """The value that this stretch leaves of ``value``, and how many of its calls failed."""
        if isinstance(value, list) or (value is ABSENT and self.first == "append"):
            if self.appended:
                value = [] if value is ABSENT else value
                value += self.appended
            failed = self.adds + self.bad
        else:
            number = 0.0 if value is ABSENT else _number(value)
            failed = len(self.appended) + self.bad + (self.adds if number is None else 0)
            if self.adds and number is not None:
                value = number + self.total
        return (self.value, failed + self.failed) if self.known else (value, failed)

    def packed(self) -> str:
        return json.dumps([self.adds, self.total, self.appended, self.bad, self.first, self.known, [] if self.value is ABSENT else [self.value], self.failed])

    @classmethod
    def unpacked(cls, text: str) -> KeyChange:
        *rest, value, failed = json.loads(text)
        return cls(*rest, value[0] if value else ABSENT, failed)


#: What a task finds: the state of a simulation that lies in it whole, or a key's change of one that may go on in other tasks.
_FOUND = "sim {kind}, state string, failed int, key string, part long, change string"


#: ``json.dumps`` with sorted keys, without an encoder made for each state.
_ENCODED = json.JSONEncoder(sort_keys=True).encode


def _outcome(changes: dict[str | None, KeyChange]) -> tuple[str, int]:
    """The state as JSON, and how many calls failed."""
    state, fails = {}, 0
    for key, change in changes.items():
        value, failed = change.after(ABSENT)
        fails += failed
        if value is not ABSENT:
            state[key] = value
    return _ENCODED(state), fails


def _simulations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:data:`_FOUND` of a task's calls, which come in order: its first and last simulation may cross into other tasks, those between lie in it whole."""
    part = TaskContext.get().partitionId()
    kinds = [None, pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]
    names = ["sim", "state", "failed", "key", "part", "change"]
    sim: object = ABSENT
    first, found = True, {}

    def crossing() -> list[tuple]:
        return [(sim, None, None, key, part, change.packed()) for key, change in found.items()]

    for batch in batches:
        kinds[0] = batch.column(0).type
        out: list[tuple] = []
        for own, op, key, value in zip(batch.column(0).to_pylist(), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]), strict=True):
            if own != sim and not (own != own and sim != sim):  # NaN is one simulation
                if sim is not ABSENT:
                    out += crossing() if first else [(sim, *_outcome(found), None, None, None)]
                    first = False
                sim, found = own, {}
            fits = key is not None and op in MUTATIONS
            at = key if fits else None
            change = found.get(at)
            if change is None:
                change = found[at] = KeyChange()
            change.call(op if fits else "none", value)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if sim is not ABSENT:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*crossing(), strict=True), kinds, strict=True)], names)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sim, key, value, failed`` from each key's changes in order; ``value`` is JSON, NULL where there is none."""
    for batch in batches:
        values, fails = [], []
        for changes in batch.column(2).to_pylist():
            whole = functools.reduce(KeyChange.then, (KeyChange.unpacked(c["change"]) for c in changes))
            value, failed = whole.after(ABSENT)
            values.append(None if value is ABSENT else json.dumps(value))
            fails.append(failed)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.string()), pa.array(fails, pa.int32())], ["sim", "key", "value", "failed"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{e["key"]: json.loads(e["value"]) for e in entries if e["value"] is not None} for entries in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_ENCODED(s) for s in rows], pa.string()), batch.column(2).cast(pa.int32())], ["sim", "state", "failed"])


def replay_states(calls: DataFrame, sim: str, order: str, op: str, key: str, value: str, step: Callable[[dict, str, str, str | None], None] | None = None) -> DataFrame:
    """``sim, state, state_hash, failed_calls`` after each simulation's mutating calls in order.

    The generic mutations are composed: calls are dealt out by ranges of simulation and order, and each task
    sums up what its calls do to each key. A simulation that lies in one task is done there. Of the first and the last of
    a task, which may go on in others, the changes of each key are put together in order, so a simulation
    of any length is spread over tasks; only its state is ever held whole. What tasks find is written to the workspace.
    Equal ``order`` is told apart by op, key and value. What is added to a number is summed by stretches, so of numbers that aren't exact in
    binary the last digit may differ from that of adding one by one.

    A mutation that doesn't fit the value (adding to text, appending to a number, an unknown one) fails and
    leaves the state as it was. A ``step`` of one's own takes the place of the mutations; as it may do
    anything to the state, a simulation is then replayed in one Python call.
    """
    if step is not None:
        return _replayed(calls, sim, order, op, key, value, step)
    kind = calls.schema[sim].dataType.simpleString()
    rows = calls.select(F.col(sim).alias("sim"), F.col(order).alias("at"), F.col(op).alias("op"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    dealt = rows.repartitionByRange("sim", "at").sortWithinPartitions("sim", "at", "op", "key", "value").select("sim", "op", "key", "value")
    path = workspace(calls.sparkSession, "replayed")
    dealt.mapInArrow(_simulations, _FOUND.format(kind=kind)).write.parquet(path)
    found = calls.sparkSession.read.schema(_FOUND.format(kind=kind)).parquet(path)
    by_key = found.where("part IS NOT NULL").groupBy("sim", "key").agg(F.array_sort(F.collect_list(F.struct("part", "change"))).alias("changes"))
    values = by_key.mapInArrow(_folded, f"sim {kind}, key string, value string, failed int")
    entries = values.groupBy("sim").agg(F.collect_list(F.struct("key", "value")).alias("entries"), F.sum("failed").alias("failed"))
    crossed = entries.mapInArrow(_states, f"sim {kind}, state string, failed int")
    states = found.where("part IS NULL").select("sim", "state", "failed").unionByName(crossed)
    return states.select(F.col("sim").alias(sim), "state", F.sha2("state", 256).alias("state_hash"), F.col("failed").alias("failed_calls"))


def _replayed(calls: DataFrame, sim: str, order: str, op: str, key: str, value: str, step: Callable[[dict, str, str, str | None], None]) -> DataFrame:
    """Replay by steps that may do anything: a step that raises leaves the state as it was, as a failed tool call does."""

    def scan(rows: list[dict]) -> list[tuple]:
        state: dict = {}
        failed = 0
        for row in rows:
            before = copy.deepcopy(state)
            try:
                step(state, row[op], row[key], row[value])
            except Exception:  # whatever a step raises, the call has failed
                state, failed = before, failed + 1
        return [(json.dumps(state, sort_keys=True), state_hash(state), failed)]

    return scan_groups(calls, sim, order, [op, key, value], scan, "state string, state_hash string, failed_calls int")


def state_reward(gold: DataFrame, actual: DataFrame, sim: str) -> DataFrame:
    """1 where gold and actual states agree (E05); a simulation without one of them gets 0."""
    g, a = gold.select(sim, F.col("state_hash").alias("g")), actual.select(sim, F.col("state_hash").alias("a"))
    return g.join(a, sim, "full_outer").select(sim, F.coalesce((F.col("g") == F.col("a")).cast("double"), F.lit(0.0)).alias("db_reward"))


def judged(df: DataFrame, judge: Callable[[Column], Column], text: str, name: str = "judgement") -> DataFrame:
    """Attach a pluggable judge's verdict, a Column function such as a pandas UDF."""
    return df.withColumn(name, judge(F.col(text)))


def merged_utterances(chunks: DataFrame, key: str, position: str, ids: str, text: str) -> DataFrame:
    """Consecutive chunks whose utterance ids overlap those gathered so far become one message.

    The gathered set grows with the open message, so a conversation is one sequential scan.
    """

    def scan(rows: list[dict]) -> list[list]:
        out: list[list] = []
        seen: set = set()
        for row in rows:
            own = set(row[ids] or ())
            if out and own & seen:
                out[-1][1] = row[position]
                out[-1][2] += row[text] or ""
                seen |= own
            else:
                out.append([row[position], row[position], row[text] or ""])
                seen = own
        return out

    kind = dict(chunks.dtypes)[position]
    return scan_groups(chunks, key, position, [ids, text], scan, f"first {kind}, last {kind}, content string")


def with_language_score(sims: DataFrame, scores: DataFrame, sim: str, name: str = "language_score") -> DataFrame:
    """Simulations with a score from elsewhere, what is stored coming first."""
    given = scores.select(sim, F.col("score").alias("__score"))
    stored = F.col(name) if name in sims.columns else F.lit(None).cast("double")
    return sims.join(given, sim, "left").withColumn(name, F.coalesce(stored, "__score")).drop("__score")


def rescored(sims: DataFrame, basis: Column, components: str, termination: str, name: str = "reward") -> DataFrame:
    """All simulations of a run with rewards by another basis."""
    return sims.withColumn(name, rebased_reward(components, basis, termination))


def assertion_met(actual: str | Column, expected: str | Column) -> Column:
    """Whether a check returned what was asserted (E12); NULL never does."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (actual, expected))
    return F.coalesce(a == b, F.lit(False))


def replay_view(messages: str | Column) -> Column:
    """Messages without agents' calls and without messages that then say nothing."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    spoken = F.filter(messages, lambda m: (m["role"] == "user") | F.coalesce(F.trim(m["content"]) != "", F.lit(False)))
    return F.transform(spoken, lambda m: F.when(m["role"] == "assistant", m.withField("tool_calls", F.filter(m["tool_calls"], lambda c: F.lit(False)))).otherwise(m))


def tick_calls(ticks: DataFrame, sim: str, tick: str, sides: list[str]) -> DataFrame:
    """``sim, n, name, arguments`` of the calls in ticks' messages, by tick, side and place (V32): input for :func:`replay_states`.

    ``n`` orders the calls of a simulation: a struct, which sorts by its fields.
    """
    found = F.array(*(F.struct(F.lit(k).alias("side"), F.coalesce(F.col(c)["tool_calls"], F.array().cast(ticks.schema[c].dataType["tool_calls"].dataType)).alias("calls")) for k, c in enumerate(sides)))
    rows = ticks.select(sim, tick, F.explode(found).alias("f")).select(sim, tick, "f.side", F.posexplode("f.calls").alias("at", "c"))
    return rows.select(sim, F.struct(F.col(tick).alias("tick"), "side", "at").alias("n"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
