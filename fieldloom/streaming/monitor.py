"""Stateful streams with timers: monitors whose references can be rebuilt, and sessions that end by silence.

Both run on transformWithStateInPandas, which needs the RocksDB state store (set by `stateful`). Rows may come in any number of triggers;
what a key gets in one trigger is sorted by time, what comes later is newer or ignored, so the result doesn't depend on the triggers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldloom.streaming.confirm import ROUNDING

# Least reference of forest, and the drop that counts.
FOREST, DROP = 0.5, 0.2

ALERT = ["cell", "version", "since", "confirmed", "value"]
ALERTS = "cell long, version int, since long, confirmed long, value double"
SESSIONS = "user long, began timestamp, ended timestamp, n long, why string"


def stateful(spark: SparkSession) -> None:
    """Sets the state store that timers and expiring state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def one_trigger(spark: SparkSession) -> Iterator[None]:
    """For runs of one trigger, which use none of their state stores twice: stores are closed with their task, and don't stay open with some 4 MB of disk each until Spark's maintenance finds their run gone."""
    name = "spark.sql.streaming.stateStore.unloadOnCommit"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def _sorted(parts: Iterator[pd.DataFrame], *order: str) -> list[Any]:
    x = pd.concat(list(parts))
    return list(x.sort_values(list(order), kind="stable").itertuples(index=False))


#: What a tile's state holds of each cell, in order of the cells; times are microseconds, touched is the milliseconds of the trigger that last saw the cell.
HELD = np.dtype([("cell", "i8"), ("version", "i4"), ("reference", "f8"), ("pending", "i8"), ("last", "i8"), ("done", "?"), ("touched", "i8")])
#: No time yet: before every time.
NEVER = np.iinfo("i8").min
#: The tile of the cell without a name (null).
NAMELESS = -1


def _first(groups: np.ndarray, n: int, none: int) -> np.ndarray:
    """Where each of n groups is first told in a sorted column of groups; none for those that aren't."""
    out = np.full(n, none)
    found, at = np.unique(groups, return_index=True)
    out[found] = at
    return out


def advance_tile(held: np.ndarray, rows: pd.DataFrame, forest: float = FOREST, drop: float = DROP, now: int = -1) -> tuple[np.ndarray, pd.DataFrame]:
    """The state of a tile's cells (HELD) after rows of cell, at (microseconds), value, reference and version, and what was confirmed; all cells together."""
    cell, at, version = rows["cell"].to_numpy("i8"), rows["at"].to_numpy("i8"), rows["version"].to_numpy("f8")
    order = np.lexsort((version, at, cell))
    cell, at, version = cell[order], at[order], version[order]
    value, reference = rows["value"].to_numpy("f8")[order], rows["reference"].to_numpy("f8")[order]

    state = np.zeros(len(cells := np.union1d(held["cell"], cell)), HELD)
    state["cell"], state["reference"], state["pending"], state["last"] = cells, np.nan, NEVER, NEVER
    state[np.searchsorted(cells, held["cell"])] = held
    of = np.searchsorted(cells, cell)
    state["touched"][of] = now

    # Scenes that aren't newer than the newest are ignored.
    newer = (at > state["last"][of]) & np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1]))
    of, at, version, value, reference = of[newer], at[newer], version[newer], value[newer], reference[newer]
    if not len(of):
        return state, pd.DataFrame(columns=ALERT)
    state["last"][of] = at  # in order: the last one stays

    # A part is what a cell has under one version; the first of a cell may go on with what is held. Scenes of older versions than their part's are ignored.
    newest = pd.Series(np.fmax(version, state["version"][of])).groupby(of).cummax().to_numpy()
    current = np.isnan(version) | (version == newest)
    starts = np.append(True, (of[1:] != of[:-1]) | (newest[1:] != newest[:-1]))
    part, own = np.cumsum(starts) - 1, of[starts]
    n, goes_on = len(own), newest[starts] == state["version"][own]
    known = np.where(goes_on, state["reference"][own], np.nan)
    pending = np.where(goes_on, state["pending"][own], NEVER)
    done = goes_on & state["done"][own]

    # The first reference that a part tells is its reference from there on.
    told = np.flatnonzero(current & ~np.isnan(reference))
    since = np.append(told, len(of))[_first(part[told], n, len(told))]
    fresh = np.isnan(known) & (since < len(of))
    known[fresh] = reference[since[fresh]]
    since[~fresh] = 0

    # Of the clear scenes, the first that is low after a low one confirms its part.
    clear = np.flatnonzero(current & ~np.isnan(value) & (known >= forest)[part] & ~done[part] & (np.arange(len(of)) >= since[part]))
    at_part = part[clear]
    low = ~(value[clear] - known[at_part] > ROUNDING - drop)
    follows = np.append(False, at_part[1:] == at_part[:-1])[: len(clear)]
    before = np.where(follows, np.where(np.roll(low, 1), at[np.roll(clear, 1)], NEVER), pending[at_part])
    twice = np.flatnonzero(low & (before != NEVER))
    hit = twice[np.unique(at_part[twice], return_index=True)[1]]
    there = at_part[hit]
    found = pd.DataFrame({"cell": cells[own[there]], "version": newest[starts][there].astype("i4"), "since": before[hit], "confirmed": at[clear[hit]], "value": value[clear[hit]]}, columns=ALERT)

    pending[at_part] = np.where(low, at[clear], NEVER)
    done[there] = True
    state["version"][own], state["reference"][own], state["pending"][own], state["done"][own] = newest[starts], known, pending, done
    return state, found


class Monitor(StatefulProcessor):
    """Of each cell of a tile: its reference with its version, the drop that waits for a second observation, the newest scene, and whether it was confirmed.

    A newer version of the reference starts the cell anew, all but the newest scene's time: scenes from before it stay ignored. State of cells that no
    scene has touched for the time to live is dropped. A call and its round trips to the state store are for a tile, not for a cell.
    """

    def __init__(self, forest: float, drop: float, keep_ms: int | None) -> None:
        self.forest, self.drop, self.keep_ms = forest, drop, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("monitor", "cells binary", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = np.frombuffer(bytes(self.held.get()[0]) if self.held.exists() else b"", HELD)
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else -1
        if self.keep_ms:
            held = held[held["touched"] + self.keep_ms > now]
        state, found = advance_tile(held, pd.concat(list(rows)), self.forest, self.drop, now)
        self.held.update((state.tobytes(),))
        if len(found):
            yield found.assign(cell=None) if key[0] == NAMELESS else found


def monitored(stream: DataFrame, forest: float = FOREST, drop: float = DROP, keep_ms: int | None = None, tiles: int = 1024) -> DataFrame:
    """Confirmed drops of a stream of cell, at, value (null: not clear), reference and version (of the reference); once for each version.

    State is kept by tiles, over which the cells are spread by their hash; a running stream keeps its number of tiles. A worker holds what one tile gets in a trigger.
    """
    tile = F.when(F.col("cell").isNull(), NAMELESS).otherwise(F.pmod(F.hash("cell"), F.lit(tiles)))
    x = stream.where(F.col("at").isNotNull()).select(tile.alias("tile"), F.coalesce("cell", F.lit(0)).cast("long").alias("cell"), F.unix_micros("at").alias("at"), F.col("value").cast("double").alias("value"), F.col("reference").cast("double").alias("reference"), F.col("version").cast("int").alias("version"))
    found = x.groupBy("tile").transformWithStateInPandas(Monitor(forest, drop, keep_ms), ALERTS, "append", "ProcessingTime" if keep_ms else "None")
    return found.select("cell", "version", F.timestamp_micros("since").alias("since"), F.timestamp_micros("confirmed").alias("confirmed"), "value")


class Sessions(StatefulProcessor):
    """A key's open session. A row after the silence, or a timer at its end when the watermark has passed it, ends it."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("session", "began timestamp, ended timestamp, n long")

    def _due(self, ended: pd.Timestamp) -> int:
        return int(pd.Timestamp(ended).tz_localize("UTC").timestamp() * 1000) + self.silence_ms if pd.Timestamp(ended).tzinfo is None else int(pd.Timestamp(ended).timestamp() * 1000) + self.silence_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        session = tuple(self.open.get()) if self.open.exists() else None
        found = []
        for r in _sorted(rows, "at"):
            if session is not None and (r.at - pd.Timestamp(session[1])).total_seconds() * 1000 > self.silence_ms:
                found.append((key[0], *session, "row"))
                session = None
            session = (r.at, r.at, 1) if session is None else (session[0], max(pd.Timestamp(session[1]), r.at), session[2] + 1)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.open.update(session)
        self.handle.registerTimer(self._due(session[1]))
        yield pd.DataFrame(found, columns=["user", "began", "ended", "n", "why"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found = []
        if self.open.exists():
            found = [(key[0], *self.open.get(), "timer")]
            self.open.clear()
        yield pd.DataFrame(found, columns=["user", "began", "ended", "n", "why"])


def silent_sessions(stream: DataFrame, silence: str = "6 hours", late: str = "0 seconds") -> DataFrame:
    """Sessions of a stream of user and at that ended by silence: user, began, ended, n and why (a later row, or a timer). Those still open aren't told."""
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    return stream.withWatermark("at", late).groupBy("user").transformWithStateInPandas(Sessions(ms), SESSIONS, "append", "EventTime")


def ended_sessions(stream: DataFrame, silence: str = "6 hours", late: str = "0 seconds") -> DataFrame:
    """The sessions of silent_sessions without the reason: user, began, ended and n, by Spark's own session windows, whose state never leaves the JVM. For streams of many users."""
    x = stream.withWatermark("at", late).groupBy("user", F.session_window("at", silence))
    return x.agg(F.min("at").alias("began"), F.max("at").alias("ended"), F.count("*").alias("n")).select("user", "began", "ended", "n")


def retained(df: DataFrame, at: str, kept: dict[str, int], kind: str, now) -> DataFrame:  # noqa: ANN001
    """Rows that are no older than the days kept for their kind; kinds without a number of days are kept."""
    days = F.coalesce(*[F.when(F.col(kind) == k, F.lit(d)) for k, d in kept.items()]) if kept else F.lit(None).cast("int")
    return df.where(days.isNull() | (F.col(at) > F.lit(now) - F.make_dt_interval(days)))
