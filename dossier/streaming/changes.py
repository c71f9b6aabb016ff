"""Keyed streams with state and timers: settling files, moves of an archive's files, observed values (SRC2, SRC3, STR2, STR4, STR5).

Each is one operator with its state in Spark's state store, so that a key's rows of earlier batches are never gathered
and a lost executor's state is read again from the checkpoint. What has to happen without a further row of the key is a timer. By
event time (the default) a timer is due when the watermark, which any key's rows move, reaches it: results are the same
however rows are cut into batches, as long as none is later than the watermark's delay. By processing time it is the
clock's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Polls alike, and seconds: of an empty file, of one that can't be opened, of one that goes on changing, and of a change that its other half, or the one that made it, is waited for.
POLLS, ZERO_BYTES_S, UNOPENABLE_S, LONGEST_S, PAIR_S = 2, 30, 60, 900, 30
FORGOTTEN_S = 86_400
#: Keys with timers share this many buckets by hash; a checkpoint keeps its number. A batch reads and writes the states of the buckets it has rows of.
BUCKETS = 1024


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def _frame(rows: list[tuple], columns: list[str], times: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out[times] = pd.to_datetime(out[times], unit="ms") if len(out) else pd.Series([], dtype="datetime64[ns]")
    return out


class Timed(StatefulProcessor):
    """A processor of a bucket of keys that walks each key's rows by time and takes its timers in between.

    A call of the state store from Python costs more than the work on a key, so that keys share calls: the states of a
    bucket's keys are one list, (key, state) each, and the bucket's one timer is the earliest of theirs. Keys in a bucket
    don't touch each other.

    Subclasses give STATE, COLUMNS and ``row``, ``due`` and ``timers``; a state is a tuple, or None.
    """

    STATE: str
    COLUMNS: list[str]

    def __init__(self, clock: str = "EventTime"):
        self.clock = clock

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"key string, {self.STATE}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states, out = self._states(), []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            # A timer that lies before this row would have been due first.
            state = self.row(r.key, self._until(r.key, states.get(r.key), _ms(r.at), out), r, out)
            if state is None:
                states.pop(r.key, None)
            else:
                states[r.key] = state
        self._keep(states)
        yield _frame(out, self.COLUMNS, "at")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        states, out = self._states(), []
        # All that is due by now, of all keys.
        now = timerValues.getCurrentWatermarkInMs() if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
        states = {k: state for k, before in states.items() if (state := self._until(k, before, now, out)) is not None}
        self._keep(states)
        yield _frame(out, self.COLUMNS, "at")

    def _until(self, key, state: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        """The state after its timers until now."""
        while state is not None and (before := min(self.timers(state))) <= now:
            state = self.due(key, state, before, out)
        return state

    def _states(self) -> dict[str | None, tuple]:
        return {x[0]: tuple(x[1:]) for x in self.held.get()} if self.held.exists() else {}

    def _keep(self, states: dict[str | None, tuple]) -> None:
        wanted = {min(min(self.timers(x)) for x in states.values())} if states else set()
        known = set(self.handle.listTimers())
        for t in known - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - known:
            self.handle.registerTimer(t)
        if states:
            self.held.put([(k, *x) for k, x in states.items()])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


class Settling(Timed):
    """SRC2, STR2: (path, event, size, at) of polls (path, at, size, mtime, readable, gone).

    settled: alike and readable at POLLS polls after the first sight, or empty for ZERO_BYTES_S; unopenable: alike but not
    readable for UNOPENABLE_S; stillChanging: neither for LONGEST_S since it was first seen, said once and waited for
    still. A path that is gone is forgotten, and one that no poll names for FORGOTTEN_S.
    """

    STATE = "size long, mtime double, alike int, first long, unread long, told int, last long"
    COLUMNS = ["path", "event", "size", "at"]

    def row(self, path, state, r, out):
        at = _ms(r.at)
        if r.gone:
            return None
        seen = (int(r.size), float(r.mtime))
        if state is None or seen != tuple(state[:2]):
            first, told = (at, 0) if state is None else (state[3], state[5])
            return (*seen, 0, first, -1 if r.readable else at, told, at)
        _, _, alike, first, unread, told, _ = state
        alike, unread = (alike + 1, -1) if r.readable else (0, at if unread < 0 else unread)
        if alike >= POLLS and r.size > 0:
            out.append((path, "settled", seen[0], at))
            return None
        return (*seen, alike, first, unread, told, at)

    def timers(self, state):
        size, _, _, first, unread, told, last = state
        out = [last + FORGOTTEN_S * 1000]
        if size == 0:
            out.append(first + ZERO_BYTES_S * 1000)
        elif unread >= 0:
            out.append(unread + UNOPENABLE_S * 1000)
        return out if told else [*out, first + LONGEST_S * 1000]

    def due(self, path, state, now, out):
        size, mtime, alike, first, unread, _, last = state
        if now >= last + FORGOTTEN_S * 1000:
            return None
        if size == 0 and now >= first + ZERO_BYTES_S * 1000:
            out.append((path, "settled", size, now))
            return None
        if size and unread >= 0 and now >= unread + UNOPENABLE_S * 1000:
            out.append((path, "unopenable", size, now))
            return None
        out.append((path, "stillChanging", size, now))
        return size, mtime, alike, first, unread, 1, last


class OwnChanges(Timed):
    """SRC3: the changes (path, at, kind, inode) but those that a row of kind ``expected`` announced for their path.

    The first change within PAIR_S of an expectation is the one expected and uses it up.
    """

    STATE = "until long"
    COLUMNS = ["path", "kind", "inode", "at"]

    def row(self, path, state, r, out):
        if r.kind == "expected":
            return (_ms(r.at) + PAIR_S * 1000,)
        if state is None:
            out.append((path, r.kind, r.inode, _ms(r.at)))
        return None

    def timers(self, state):
        return [state[0]]

    def due(self, path, state, now, out):
        return None


class Moves(Timed):
    """SRC3: (inode, event, was, now, at) of changes (inode, at, kind gone or found, path).

    A gone and a found of one inode within PAIR_S, in either order, are a file renamed (in its folder), moved or, where the
    path is the same, changed; what stays alone is deleted or created when the time is over.
    """

    STATE = "kind string, path string, since long"
    COLUMNS = ["inode", "event", "was", "now", "at"]

    def row(self, inode, state, r, out):
        at = _ms(r.at)
        if state is not None and state[0] != r.kind:
            was, now = (state[1], r.path) if r.kind == "found" else (r.path, state[1])
            folder = lambda p: p.rpartition("/")[0]
            out.append((inode, "changed" if was == now else "renamed" if folder(was) == folder(now) else "moved", was, now, at))
            return None
        if state is not None:
            self.due(inode, state, at, out)
        return r.kind, r.path, at

    def timers(self, state):
        return [state[2] + PAIR_S * 1000]

    def due(self, inode, state, now, out):
        kind, path, _ = state
        out.append((inode, "deleted", path, None, now) if kind == "gone" else (inode, "created", None, path, now))
        return None


def _run(rows: DataFrame, key: str, processor: Timed, schema: str, clock: str, late: str, chained: bool = False, buckets: int = BUCKETS) -> DataFrame:
    if clock == "EventTime" and not chained:
        rows = rows.withWatermark("at", late)
    more = {"eventTimeColumnName": "at"} if clock == "EventTime" else {}
    # Keys and numbers of files travel as strings: pandas would make doubles of longs beside a null.
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), *[F.col(c).cast("string") if c == "inode" else c for c in rows.columns if c != key])
    found = rows.groupBy("bucket").transformWithStateInPandas(processor, schema.replace("inode long", "inode string"), "Append", clock, **more)
    return found.select(*[F.col(c).cast("long") if c == "inode" else c for c in found.columns])


def settling(polls: DataFrame, clock: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """The stream (path, event, size, at) of a stream of polls (path, at, size, mtime, readable, gone)."""
    return _run(polls.select("path", "at", "size", "mtime", "readable", "gone"), "path", Settling(clock), "path string, event string, size long, at timestamp", clock, late)


def without_own(changes: DataFrame, clock: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """The stream of changes (path, kind, inode, at) without those that were announced."""
    return _run(changes.select("path", "at", "kind", "inode"), "path", OwnChanges(clock), "path string, kind string, inode long, at timestamp", clock, late)


def moves(changes: DataFrame, clock: str = "EventTime", late: str = "0 seconds", chained: bool = False) -> DataFrame:
    """The stream (inode, event, was, now, at); chained: changes come from without_own, with its watermark."""
    return _run(changes.select("inode", "at", "kind", "path"), "inode", Moves(clock), "inode long, event string, was string, now string, at timestamp", clock, late, chained)


class Observed(StatefulProcessor):
    """STR5: a value per key, told only when it changes."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "n long, total double, least double, most double, told double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total, least, most, told = self.held.get() if self.held.exists() else (0, 0.0, float("inf"), float("-inf"), float("nan"))
        for frame in rows:
            some = frame["value"].dropna()
            n += len(some)
            if len(some):
                total, least, most = total + float(some.sum()), min(least, float(some.min())), max(most, float(some.max()))
        value = {"count": float(n), "sum": total, "min": least, "max": most}[self.kind]
        changed = (n > 0 or self.kind == "count") and value != told
        self.held.update((n, total, least, most, value if changed else told))
        yield pd.DataFrame({"key": [key[0]], "value": [value]} if changed else {"key": pd.Series([], dtype="object"), "value": pd.Series([], dtype="float64")})

    def close(self) -> None:
        pass


def observed(rows: DataFrame, key: Column, value: Column, kind: str) -> DataFrame:
    """STR5: (key string, value double): count, sum, min or max of each key after every batch in which it changes.

    Null values count for nothing; a null key is a key of its own. A batch that leaves a value as it was tells nothing.
    """
    return rows.select(key.cast("string").alias("key"), value.cast("double").alias("value")).groupBy("key").transformWithStateInPandas(Observed(kind), "key string, value double", "Update", "None")
