"""Keyed state and access analytics: cases worked out by hand, and laws."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slackframe.operators import access, log, update_fns
from slackframe.plans import loop

UPDATES = "clock int, client int, thread int, tab long, rid long, cid int, value double"


def cell_updates(spark, rows):
    """(clock, client, value) of one cell."""
    return spark.createDataFrame([(c, k, 0, 0, 0, 0, float(v)) for c, k, v in rows], UPDATES)


def value(df):
    return df.first()["value"]


def test_global_and_fast_clock(spark):
    p = spark.createDataFrame([(0, 3), (0, 1), (1, 5), (2, 4)], "worker int, clock int")
    assert tuple(log.vector_clock(p).first()) == (3, 5)


@pytest.mark.parametrize("slack, seen", [(0, 3.0), (1, 2.0), (2, 1.0), (3, 1.0), (20_000_000, 0.0)])
def test_slack(spark, slack, seen):
    u = cell_updates(spark, [(c, 0, 1) for c in range(4)])
    r = spark.createDataFrame([(0, 3, slack, 0, 0)], "client int, clock int, slack int, tab long, rid long")
    assert value(log.read(u, r)) == seen


def test_reading_own_writes(spark):
    u = cell_updates(spark, [(0, 0, 1), (1, 0, 10), (1, 1, 100), (2, 0, 1000)])
    r = spark.createDataFrame([(0, 2, 1, 0, 0)], "client int, clock int, slack int, tab long, rid long")
    assert value(log.read(u, r)) == 1
    assert value(log.read_my_writes(u, r)) == 1 + 10 + 1000


def test_coalescing(spark):
    u = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 1.0), (0, 0, 1, 0, 0, 0, 2.0), (0, 1, 0, 0, 0, 0, 4.0)], UPDATES)
    assert sorted(r.value for r in log.coalesce_in_two_levels(u).collect()) == [3, 4]
    assert value(log.coalesce_updates(u)) == 7


def test_stepsize_adagrad_adarevision(spark):
    assert value(update_fns.apply(cell_updates(spark, [(0, 0, 1), (1, 0, 2), (2, 0, -1)]), "stepsize", 0.5)) == 1.5
    assert abs(value(update_fns.apply(cell_updates(spark, [(0, 0, 0), (1, 0, 2), (2, 0, 1)]), "adagrad", 1.0)) - 1.302675) < 1e-6
    both = cell_updates(spark, [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1)])
    assert abs(value(update_fns.apply(both, "adarevision", 1.0)) - 0.894427) < 1e-6


def sequential(rows, function, rate):
    first, w, acc, old, z, top, clock = {}, 0.0, 0.0, 0.0, 0.0, 0.0, None
    for c, k, v in sorted(rows):
        if c != clock:
            old, clock = acc, c
        if c == first.setdefault(k, c):
            w += v
        elif function == "adagrad":
            z += v * v
            w += rate * v / math.sqrt(z + 1)
        else:
            back = acc - old
            eta_old = rate / math.sqrt(top + 1)
            z += v * v + 2 * v * back
            top = max(top, z)
            eta = rate / math.sqrt(top + 1)
            w += eta * v + (eta - eta_old) * back
            acc += v
    return w


@pytest.mark.parametrize("function", ["adagrad", "adarevision"])
def test_windows_equal_a_sequential_loop(spark, function):
    rng = random.Random(9)
    rows = [(c, k, rng.uniform(-2, 2)) for c in range(7) for k in range(3) if rng.random() < 0.7]
    assert abs(value(update_fns.apply(cell_updates(spark, rows), function, 0.3)) - sequential(rows, function, 0.3)) < 1e-9


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 1), st.integers(0, 2), st.integers(-50, 50)), max_size=25))
def test_two_levels_equal_one(spark, rows):
    u = spark.createDataFrame([(c, k, t, 0, r, 0, float(v)) for c, k, t, r, v in rows], UPDATES)
    one = log.coalesce_updates(u, "clock", "client").select("clock", "client", "rid", "value").collect()
    two = log.coalesce_in_two_levels(u.orderBy(F.rand(1))).select("clock", "client", "rid", "value").collect()
    assert sorted(one) == sorted(two)


def test_more_slack_never_sees_later_clocks(spark):
    u = cell_updates(spark, [(c, 0, 1) for c in range(6)])
    r = spark.createDataFrame([(0, 5, s, 0, 0) for s in range(8)], "client int, clock int, slack int, tab long, rid long")
    seen = [x.value for x in sorted(log.read(u, r).collect(), key=lambda x: x.slack)]
    assert seen == sorted(seen, reverse=True)


def test_absent_keys_read_zero(spark):
    u = cell_updates(spark, [(0, 0, 5)])
    keys = spark.createDataFrame([(0, 0, 0), (0, 9, 0)], "tab long, rid long, cid int")
    assert {r.rid: r.value for r in log.get_or_create(log.coalesce_updates(u), keys).collect()} == {0: 5.0, 9: 0.0}


def test_a_registered_function(spark):
    update_fns.register("doubled", lambda sums, rate: sums.groupBy(*log.CELL).agg((2 * F.sum("value")).alias("value")))
    assert value(update_fns.apply(cell_updates(spark, [(0, 0, 3)]), "doubled")) == 6


OPS = "client int, thread int, seq long, op string, tab long, rid long, slack int, vclock int"


def test_hash_placement(spark):
    keys = spark.createDataFrame([(0, r) for r in range(5)], "tab long, rid long")
    got = sorted((r.rid, r.machine, r.channel) for r in access.hash_placement(keys, 2, 2).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 0, 0)]


def test_locality_placement():
    import pyarrow as pa

    ask = lambda *x: [{"client": c, "freq": f} for c, f in x]
    rows = [(0, ask((0, 2), (1, 1))), (1, ask((0, 1), (1, 1))), (2, ask((1, 2), (0, 2)))]
    batch = pa.RecordBatch.from_pylist([{"server": 0, "channel": 0, "tab": 0, "rid": r, "asked": a} for r, a in rows])
    assert [r["machine"] for b in access.place([batch]) for r in b.to_pylist()] == [0, 1, 1]


def test_thread_cache(spark):
    ops = [(0, 0, s, "READ", 0, 1 if s < 8 else 2, 0, 0) for s in range(10)] + [(0, 1, 99, "READ", 0, 1, 0, 0)]
    got = access.thread_cached(spark.createDataFrame(ops, OPS), 0.5).collect()
    assert {(r.thread, r.rid): round(r.score, 6) for r in got} == {(0, 1): 1.6, (1, 1): 2.0}


def test_counts_are_of_clocks(spark):
    ops = [(0, 0, 1, "READ", 0, 1, 0, 0), (0, 0, 2, "READ", 0, 1, 0, 0), (0, 1, 3, "WRITE", 0, 1, 0, 1), (0, 0, 4, "CLOCK", 0, 1, 0, 5)]
    assert tuple(access.counts(spark.createDataFrame(ops, OPS)).first()) == (0, 0, 1, 1, 1)


def test_balanced_split(spark):
    start, size = access.balanced_split(F.lit(10), 4, F.col("id"))
    assert [(r.a, r.b) for r in spark.range(4).select(start.alias("a"), size.alias("b")).collect()] == [(0, 3), (3, 3), (6, 2), (8, 2)]


def test_supersteps(spark):
    out = loop.iterate(spark.range(3), lambda s, c: s.withColumn("id", F.col("id") + c), 4)
    assert sorted(r.id for r in out.collect()) == [6, 7, 8]
    u = cell_updates(spark, [(0, 0, 1), (1, 0, 2), (2, 0, 4)])
    assert {r.clock: r.value for r in loop.history(u, 3).collect()} == {0: 1, 1: 3, 2: 7}


def test_written_tables_are_released(spark):
    import os

    from slackframe import storage

    t = storage.written(spark.range(5), "kept")
    assert t.count() == 5
    path = storage.local_path(storage._made[-1])
    assert os.path.isdir(path)
    storage.release(spark)
    assert not os.path.exists(path)
