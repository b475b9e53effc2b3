"""Streams of several batches, held against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkwright.streaming import events as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY = dt.datetime(2024, 1, 1)


def _written(spark, folder, batches):
    """One file for each batch, in the order in which a stream takes them; returns their pattern."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{k}")
        (name,) = (x for x in os.listdir(f"{folder}/part{k}") if x.endswith(".parquet"))
        os.rename(f"{folder}/part{k}/{name}", f"{folder}/batch{k}.parquet")
        os.utime(f"{folder}/batch{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    return f"{folder}/batch*.parquet"


def test_cusum_of_batches_equals_a_fold(spark, tmp_path):
    """Later batches go on from the state; a key of more than 10,000 rows is folded in order; nulls change nothing."""
    rnd = random.Random(3)
    days = []
    for day in range(3):
        rows = [(day * 100_000 + i, DAY + dt.timedelta(days=day, seconds=rnd.randrange(80_000)), rnd.choice([1, 2, None]), "view", rnd.choice([None, 40.0, 59.5, 60.0, 75.25])) for i in range(300)]
        rows += [(day * 100_000 + 50_000 + i, DAY + dt.timedelta(days=day, seconds=rnd.randrange(80_000)), 7, "view", rnd.randrange(480) / 4) for i in range(12_000 if day == 0 else 50)]
        days.append([*rows, (day * 100_000 + 99_999, DAY, 20 + day, "view", None)])
    days[1].append((900_000, DAY + dt.timedelta(days=1), 20, "view", 61.0))
    got = {(r.user_id, r.event_id): r.cusum for r in S.drain_cusum(S.event_stream(spark, _written(spark, tmp_path, days)), 55.0, 5.0).collect()}
    want, state = {}, {}
    for rows in days:
        for event, _, user, _, value in sorted(rows, key=lambda r: (r[1], r[0])):
            if value is not None:
                state[user] = max(0.0, state.get(user, 0.0) + value - 60)
            want[user, event] = state.get(user)
    assert len(got) == sum(map(len, days))
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})


def test_distinct_over_batches_far_apart(spark, tmp_path):
    """Ids that come again after weeks, or long after the latest time, count once; nulls do not count."""
    batches = [[(i % 40 if i % 7 else None, DAY + dt.timedelta(days=d), 1, "view", 1.0) for i in range(60)] for d in (30, 0, 60)]
    batches[1] += [(100 + i, DAY, 1, "view", 1.0) for i in range(5)]
    got = [r.event_id for r in S.drain_distinct(S.event_stream(spark, _written(spark, tmp_path, batches)), "event_id").collect()]
    assert sorted(got) == sorted({r[0] for b in batches for r in b} - {None})


def test_drained_batches_are_files(spark, tmp_path):
    """Append keeps the rows of all batches, complete those of the last; neither is a table in the driver's memory."""
    path = _written(spark, tmp_path, [[(b * 10 + i, DAY, 1, "view", 1.0) for i in range(10)] for b in range(3)])
    rows = S.drain(S.event_stream(spark, path), "append")
    assert sorted(r.event_id for r in rows.collect()) == list(range(30)) and all("/rows/" in f for f in rows.inputFiles())
    counts = S.drain(S.event_stream(spark, path).groupBy("event_type").agg(F.count("*").alias("n")), "complete")
    assert [tuple(r) for r in counts.collect()] == [("view", 30)] and all("/rows/" in f for f in counts.inputFiles())
