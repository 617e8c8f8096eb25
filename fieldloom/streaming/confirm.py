"""A stream of scenes: drops below a reference are confirmed by a second observation, and each is reported once.

State is kept by cell. Scenes that aren't newer than a cell's last one are ignored (high-water mark), so late data never changes
what was confirmed. The same rules run on a batch through `confirm_batch`, which the tests compare with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Least reference of forest, and the drop that counts.
FOREST, DROP = 0.5, 0.2
#: Differences of decimal values carry errors of rounding: 0.4 - 0.6 is a little more than -0.2. What falls short of a drop by less than this is one.
ROUNDING = 1e-9

OUT = "cell long, since timestamp, confirmed timestamp, value double"
STATE = "reference double, pending timestamp, last timestamp, done boolean"


def advance(state: tuple, rows: pd.DataFrame, forest: float = FOREST, drop: float = DROP) -> tuple[tuple, list[tuple]]:
    """The state after the cell's rows (at, value, reference; value null: not clear) in time order, and what was confirmed."""
    reference, pending, last, done = state
    found = []
    for at, value, own in rows.sort_values("at")[["at", "value", "reference"]].itertuples(index=False):
        reference = own if reference is None or pd.isna(reference) else reference
        if last is not None and at <= last:
            continue
        last = at
        if pd.isna(value) or reference < forest or done:
            continue
        if value - reference <= ROUNDING - drop:
            if pending is not None:
                found.append((pending, at, value))
                done = True
            pending = pending or at
        else:
            pending = None
    return (reference, pending, last, done), found


def confirm(stream: DataFrame, forest: float = FOREST, drop: float = DROP) -> DataFrame:
    """Confirmed drops of a stream of cell, at, value and reference; a cell is confirmed once."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, None, False)
        held = tuple(None if x is None or x is pd.NaT else x for x in held)
        new, found = advance(held, pd.concat(list(parts)), forest, drop)
        state.update(new)
        if found:
            yield pd.DataFrame([(key[0], *f) for f in found], columns=["cell", "since", "confirmed", "value"])

    return stream.groupBy("cell").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def confirm_batch(df: DataFrame, forest: float = FOREST, drop: float = DROP) -> DataFrame:
    """The same over a finished table, one cell's history at a time."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        found = advance((None, None, None, False), x, forest, drop)[1]
        return pd.DataFrame([(x["cell"].iloc[0], *f) for f in found], columns=["cell", "since", "confirmed", "value"])

    return df.groupBy("cell").applyInPandas(run, OUT)


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Requests of each kind in tumbling windows, with a watermark for late data; works on batches and streams."""
    x = events.withColumn("at", F.col("ts").cast("timestamp"))
    return x.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("began"), "n")
