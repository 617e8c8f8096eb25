"""Stateful streams: the result is the same in any number of triggers, and equals a plain pass over each key."""

import datetime
import random
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from fieldloom.plans import streams
from fieldloom.session import shared_folder
from fieldloom.streaming import monitor

START = datetime.datetime(2024, 1, 1)


def replayed(spark, rows, ddl, transform, triggers):
    """Rows in order of their time, dealt to as many files, one a trigger."""
    monitor.stateful(spark)
    at = f"{shared_folder(spark).rstrip('/')}/triggers-{uuid.uuid4().hex}"
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // triggers)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], ddl).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = transform(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
    job = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start()
    job.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{at}/out").collect())


def scenes():
    rng, rows = random.Random(3), []
    for cell in range(12):
        for k in range(30):
            version = 1 + (k >= 15 and cell % 3 == 0)
            rows.append((cell, START + datetime.timedelta(days=k, minutes=cell), None if rng.random() < 0.1 else 0.8 - 0.4 * (rng.random() < 0.35), [0.3, 0.8][cell % 4 > 0], version))
    return rows


def plain_alerts(rows):
    out = []
    for cell in {r[0] for r in rows}:
        for version in {r[4] for r in rows if r[0] == cell}:
            pending = None
            for _, at, value, reference, _ in sorted(r for r in rows if r[0] == cell and r[4] == version):
                if value is None or reference < 0.5:
                    continue
                if value - reference > -0.2:
                    pending = None
                elif pending is None:
                    pending = at
                else:
                    out.append((cell, version, pending, at, value))
                    break
    return sorted(out)


@pytest.mark.parametrize("triggers", [1, 3, 20])
def test_alerts_do_not_depend_on_triggers(spark, triggers):
    rows = scenes()
    got = replayed(spark, rows, "cell long, at timestamp, value double, reference double, version int", monitor.monitored, triggers)
    assert got == plain_alerts(rows) and {v for _, v, *_ in got} == {1, 2}


def test_late_scenes_and_old_references_are_ignored(spark):
    day = lambda k: START + datetime.timedelta(days=k)
    rows = [(1, day(5), 0.4, 0.8, 2), (1, day(6), 0.4, 0.8, 1), (1, day(7), 0.4, 0.8, 2)]
    ddl = "cell long, at timestamp, value double, reference double, version int"
    assert replayed(spark, rows, ddl, monitor.monitored, 3) == [(1, 2, day(5), day(7), 0.4)]


def test_a_drop_that_rounding_hides_counts(spark):
    rows = [(1, START, 40.0 / 100, 0.6, 1), (1, START + datetime.timedelta(days=1), 0.082, 0.6, 1)]
    assert replayed(spark, rows, "cell long, at timestamp, value double, reference double, version int", monitor.monitored, 1) == [(1, 1, START, START + datetime.timedelta(days=1), 0.082)]


def test_state_is_held_by_tiles(spark):
    """Calls to Python and round trips to the state store are as many as tiles, however many cells there are."""
    monitor.stateful(spark)
    at, days, cells = f"{shared_folder(spark).rstrip('/')}/tiles-{uuid.uuid4().hex}", 3, 3000
    ddl = "cell long, at timestamp, value double, reference double, version int"
    x = spark.range(days * cells).selectExpr(f"id % {cells} AS cell", f"timestamp'2024-01-01' + make_dt_interval(CAST(id / {cells} AS INT)) AS at", f"IF(id % {cells} % 2 = 0, 0.4D, 0.8D) AS value", "0.8D AS reference", "1 AS version")
    x.coalesce(1).write.parquet(f"{at}/in")
    job = monitor.monitored(spark.readStream.schema(ddl).parquet(f"{at}/in")).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.read.parquet(f"{at}/out").count() == cells / 2
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress) <= 1024


def test_runs_of_one_trigger_leave_no_stores_open(spark, tmp_path):
    """A store that stays open keeps its folder under Spark's local one; the session's setting is as before."""
    rows = [(u, START + datetime.timedelta(days=k), "view", 30.0) for u in range(20) for k in range(3)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    stores = lambda: set(local.parent.rglob("StateStoreId*"))
    name = "spark.sql.streaming.stateStore.unloadOnCommit"
    before, held = stores(), spark.conf.get(name, None)
    found = streams.monitored_drops(spark, f"file://{tmp_path}")
    assert found.count() == 20 and stores() <= before and spark.conf.get(name, None) == held


def test_a_cell_without_a_name_is_a_cell(spark):
    rows = [(c, START + datetime.timedelta(days=k), 0.4 + 0.5 * (c == 0), 0.8, 1) for k in range(3) for c in (None, 0, 2**53 + 1)]
    ddl = "cell long, at timestamp, value double, reference double, version int"
    for named in (2**53 + 1, None):
        assert replayed(spark, [r for r in rows if r[0] in (0, named)], ddl, monitor.monitored, 3) == [(named, 1, START, START + datetime.timedelta(days=1), 0.4)]


def plain_step(held, rows, found):
    """One cell's state after its rows, one row at a time."""
    version, reference, pending, last, done = held
    for cell, at, value, own, v in sorted(rows, key=lambda r: (r[1], np.inf if np.isnan(r[4]) else r[4])):
        if last is not None and at <= last:
            continue
        last = at
        if v > version:
            version, reference, pending, done = int(v), None, None, False
        if v < version:
            continue
        reference = own if reference is None and not np.isnan(own) else reference
        if np.isnan(value) or reference is None or reference < 0.5 or done:
            continue
        if value - reference > 1e-9 - 0.2:
            pending = None
        elif pending is None:
            pending = at
        else:
            found.append((cell, version, pending, at, value))
            done = True
    return version, reference, pending, last, done


def test_cells_of_a_tile_advance_as_each_alone():
    """Late and equal times, gaps in values, references and versions, older versions, over several triggers."""
    rng, total = random.Random(11), 0
    for _ in range(300):
        state, alone = np.zeros(0, monitor.HELD), {}
        for trigger in range(rng.randint(1, 4)):
            rows = [(rng.randrange(4), 8 * trigger + rng.randrange(14), rng.choice([0.1, 0.4, 0.9, np.nan]), rng.choice([0.6, 0.6, 0.3, np.nan]), rng.choice([1, 1, 1, 0, 2, np.nan])) for _ in range(rng.randint(1, 30))]
            state, found = monitor.advance_tile(state, pd.DataFrame(rows, columns=["cell", "at", "value", "reference", "version"]))
            want = []
            for cell in {r[0] for r in rows}:
                alone[cell] = plain_step(alone.get(cell, (0, None, None, None, False)), [r for r in rows if r[0] == cell], want)
            assert sorted(found.itertuples(index=False, name=None)) == sorted(want)
            total += len(want)
    assert total > 100


def test_cells_expire_one_by_one():
    """A tile's state lives on with any of its cells; a cell's state doesn't."""

    class Held:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, held):
            self.held = held

    class Clock:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    m = monitor.Monitor(0.5, 0.2, keep_ms=100)
    m.held = Held()
    scene = lambda cell, at: pd.DataFrame([(cell, at, 0.4, 0.8, 1)], columns=["cell", "at", "value", "reference", "version"])
    told = lambda now, *scenes: [tuple(r) for x in m.handleInputRows((0,), iter(scenes), Clock(now)) for r in x.itertuples(index=False)]
    assert told(1000, scene(1, 10), scene(2, 10)) == []
    assert told(1050, scene(2, 20)) == [(2, 1, 10, 20, 0.4)]
    assert told(1100, scene(1, 30)) == []  # 100 ms after its last scene cell 1 starts anew
    assert told(1149, scene(1, 40), scene(2, 30)) == [(1, 1, 30, 40, 0.4)]  # cell 2 is known and told


@pytest.mark.parametrize("triggers", [1, 4, 20])
def test_sessions_end_by_silence(spark, triggers):
    rng = random.Random(5)
    rows = [(u, START + datetime.timedelta(minutes=m)) for u in range(8) for m in sorted(rng.sample(range(4000), 12))]
    rows.append((99, START + datetime.timedelta(days=30)))
    got = replayed(spark, rows, "user long, at timestamp", lambda s: monitor.silent_sessions(s, "6 hours"), triggers)
    want = []
    for u in range(8):
        own = [at for k, at in rows if k == u]
        begin = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i] - own[i - 1] > datetime.timedelta(hours=6):
                want.append((u, own[begin], own[i - 1], i - begin))
                begin = i
    assert [g[:4] for g in got] == sorted(want) and "timer" in {g[4] for g in got}


@pytest.mark.parametrize("triggers", [1, 4])
def test_session_windows_tell_the_same_sessions(spark, triggers):
    """Six hours to the microsecond are still one session; no Python state is needed for many users."""
    rng = random.Random(7)
    rows = [(u, START + datetime.timedelta(minutes=m)) for u in range(8) for m in sorted(rng.sample(range(4000), 12))]
    rows += [(50, START), (50, START + datetime.timedelta(hours=6)), (50, START + datetime.timedelta(hours=12, microseconds=1)), (99, START + datetime.timedelta(days=30))]
    ddl = "user long, at timestamp"
    assert replayed(spark, rows, ddl, monitor.ended_sessions, triggers) == [g[:4] for g in replayed(spark, rows, ddl, monitor.silent_sessions, triggers)]
    plan = monitor.ended_sessions(spark.readStream.format("rate").load().selectExpr("value AS user", "timestamp AS at"))._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "TransformWithState" not in plan


def test_retention_by_kind(spark):
    now = datetime.datetime(2024, 6, 1)
    x = spark.createDataFrame([(k, now - datetime.timedelta(days=d)) for k in ("counter", "audit", "other") for d in (0, 2, 400)], "kind string, at timestamp")
    got = monitor.retained(x, "at", {"counter": 1, "audit": 365}, "kind", now).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"counter": 1, "audit": 2, "other": 3}
