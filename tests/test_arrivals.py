"""Streams out of order: sessions as in batch, late rows kept apart, and batches that are repeated."""

import collections
import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from terravow.streaming import arrivals, queries
from terravow.sources import adapter

START = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Events every 40 minutes; every ninth arrives four days late; a null time arrives as well."""
    held = [(k, START + datetime.timedelta(minutes=40 * k), START + datetime.timedelta(minutes=40 * k) + datetime.timedelta(days=4 if k % 9 == 0 else 0)) for k in range(400)]
    return spark.createDataFrame([*held, (400, None, START + datetime.timedelta(days=3))], "k int, ts timestamp, arrived timestamp")


def expected(rows, days=1):
    slices = collections.defaultdict(list)
    for r in rows.collect():
        slices[int(r["arrived"].timestamp()) // 86_400].append((r["k"], r["ts"]))
    newest, late = None, set()
    for _, own in sorted(slices.items()):
        late |= {k for k, t in own if newest is not None and t is not None and t < newest - datetime.timedelta(days=days)}
        newest = max([t for _, t in own if t is not None] + ([newest] if newest else []), default=None)
    return late


def test_late_rows_are_kept_apart(rows):
    kept, late = arrivals.split_late(arrivals.replayed(rows, F.col("arrived"), 86_400), "ts", "1 DAY")
    kept, late = [r["k"] for r in kept.collect()], [r["k"] for r in late.collect()]
    assert sorted(kept + late) == list(range(401))
    assert set(late) == expected(rows) and 20 < len(late) < 60


def test_a_repeated_batch_changes_nothing(spark, rows, monkeypatch):
    """Every batch fails once after it has written, and is run again."""
    seen, plain = [], DataStreamWriter.foreachBatch

    def failing(self, write):
        def twice(batch, number):
            write(batch, number)
            seen.append(number)
            write(batch, number)

        return plain(self, twice)

    monkeypatch.setattr(DataStreamWriter, "foreachBatch", failing)
    kept, late = arrivals.split_late(arrivals.replayed(rows, F.col("arrived"), 86_400), "ts", "1 DAY")
    assert len(seen) > 5 and sorted(r["k"] for r in kept.unionByName(late).collect()) == list(range(401))
    assert {r["k"] for r in late.collect()} == expected(rows)


def test_sessions_of_a_stream_out_of_order(spark, small):
    events = sorted(((r["user_id"], r["ts"]) for r in adapter.read(spark, small, "events").collect()), key=lambda x: x)
    sessions, before = [], None
    for user, at in events:
        if before is None or before[0] != user or at - before[1] >= datetime.timedelta(minutes=30):
            sessions.append([user, at, 0])
        sessions[-1][2] += 1
        before = (user, at)
    found = queries.sessions(spark, small)
    assert sorted((r["user_id"], r["started"], r["n"]) for r in found.collect()) == sorted(map(tuple, sessions))
