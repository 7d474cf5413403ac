"""Transactions: all tables or none, each row once however often a batch is repeated."""

import pytest

from terravow.functions.commits import Store, Transaction
from terravow.streaming.queries import as_stream, run_again


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def ids(store, table):
    return sorted(r["id"] for r in store.read(table, "id long").collect())


def test_both_tables_or_none(spark, store):
    with store.transaction(1) as scope:
        scope.write("a", spark.range(3))
        assert ids(store, "a") == []  # not seen before the commit
        scope.write("b", spark.range(5, 7))
    with pytest.raises(ValueError), store.transaction(2) as scope:
        scope.write("a", spark.range(10, 12))
        raise ValueError
    assert ids(store, "a") == [0, 1, 2] and ids(store, "b") == [5, 6] and not store.committed(2)
    assert store.vacuum() == 0  # rolled back, so nothing is left


def test_a_number_is_committed_once(spark, store):
    for _ in range(3):
        with store.transaction(7) as scope:
            scope.write("a", spark.range(4))
    assert ids(store, "a") == [0, 1, 2, 3]
    first, second = (store.transaction(8) for _ in range(2))  # two attempts at once: one of them counts
    with first as one, second as two:
        one.write("a", spark.range(20, 22))
        two.write("a", spark.range(20, 22))
    assert ids(store, "a") == [0, 1, 2, 3, 20, 21]


def test_a_killed_driver_leaves_nothing_seen(spark, store):
    Transaction(store, 1).write("a", spark.range(4))  # neither committed nor rolled back
    assert ids(store, "a") == []
    with store.transaction(1) as scope:
        scope.write("a", spark.range(4))
    assert ids(store, "a") == [0, 1, 2, 3] and store.vacuum() == 1 and ids(store, "a") == [0, 1, 2, 3]


def test_a_stream_whose_batches_fail(spark, store):
    """Failures before the first table, between the two, and after the commit."""
    left = {0: ["first", "between"], 1: ["after"], 2: ["between", "after"]}

    def fail(number, place):
        if (left.get(number) or [None])[0] == place:
            left[number].pop(0)
            raise RuntimeError(place)

    def write(batch, number):
        with store.transaction(number) as scope:
            fail(number, "first")
            scope.write("a", batch)
            fail(number, "between")
            scope.write("b", batch.where("id % 2 = 0"))
        fail(number, "after")

    run_again(as_stream(spark.range(100), 3), write)
    assert not any(left.values())
    assert ids(store, "a") == list(range(100)) and ids(store, "b") == list(range(0, 100, 2))


def test_empty_store(store):
    assert ids(store, "a") == [] and store.vacuum() == 0
