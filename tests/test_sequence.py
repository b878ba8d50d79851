import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rippleframe.operators import sequence as S


def rows(n=200, hot=0.5, seed=1):
    rng = random.Random(seed)
    out = [("hot" if rng.random() < hot else f"k{rng.randrange(9)}", rng.randrange(40), i, rng.uniform(-5, 5)) for i in range(n)]
    rng.shuffle(out)
    return out


def by_key(data):
    groups = {}
    for k, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(k, []).append((i, v))
    return groups


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def seq(frame, data):
    df = frame(data, "k string, t int, i int, v double").repartition(7)
    return S.sequence(df, ["k"], ["t", "i"])


def forget(seq):
    """The same sequence without the recorded key length, so that every carry path runs."""
    return seq.withColumn("pos", F.col("pos") + 0)


def test_positions_are_ranks(seq, data):
    want = {i: p for g in by_key(data).values() for p, (i, _) in enumerate(g)}
    got = {r.i: r.pos for r in seq.collect()}
    assert got == want
    assert seq.schema["pos"].metadata[S.LONGEST] == max(len(g) for g in by_key(data).values())


def test_hot_key_spans_several_partitions(frame):
    df = frame([("hot", i % 50, i, 1.0) for i in range(3000)], "k string, t int, i int, v double").repartition(6)
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = S.sequence(df, ["k"], ["t", "i"])
        assert [r.pos for r in s.orderBy("t", "i").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_null_key_fails_loudly(frame):
    with pytest.raises(Exception, match="null in sequence key"):
        S.sequence(frame([(None, 1, 1, 1.0)], "k string, t int, i int, v double"), ["k"], ["t", "i"])


@pytest.mark.parametrize("size", [2, 3, 7, 1000])
def test_frames_cross_chunk_edges(seq, data, size):
    out = S.framed(
        forget(seq),
        ["k"],
        {
            "prev": lambda w: F.lag("v", 2).over(w),
            "near": lambda w: F.sum("v").over(w.rowsBetween(-2, 1)),
        },
        before=2,
        after=1,
        size=size,
    )
    got = {r.i: (r.prev, r.near) for r in out.collect()}
    assert len(got) == len(data)
    for g in by_key(data).values():
        v = [x for _, x in g]
        for p, (i, _) in enumerate(g):
            assert got[i][0] == (v[p - 2] if p >= 2 else None)
            assert got[i][1] == pytest.approx(sum(v[max(0, p - 2) : p + 2]))


@pytest.mark.parametrize("size", [1, 3, 8])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_carries_over_chunks(seq, data, size, exclusive):
    cols = {
        "s": ("sum", F.col("v")),
        "m": ("max", F.col("v")),
        "n": ("min", F.col("v")),
        "l": ("last", F.when(F.col("v") > 2, F.col("v"))),
    }
    got = {r.i: r for r in S.running(forget(seq), ["k"], cols, size=size, exclusive=exclusive).collect()}
    for g in by_key(data).values():
        for p, (i, _) in enumerate(g):
            seen = [v for _, v in g[: p + (0 if exclusive else 1)]]
            big = [v for v in seen if v > 2]
            assert got[i].s == pytest.approx(sum(seen))
            assert got[i].m == (max(seen) if seen else None)
            assert got[i].n == (min(seen) if seen else None)
            assert got[i].l == (big[-1] if big else None)


def test_running_keeps_held_chunks(seq):
    held = S.chunked(forget(seq), size=4)
    out = S.running(held, ["k"], {"s": ("sum", F.lit(1))}, size=4)
    assert S.CHUNK in out.columns
    assert out.filter("s <> pos + 1").count() == 0


@pytest.mark.parametrize("block", [2, 3, 50])
def test_recurrence_matches_a_loop(seq, data, block):
    gain = F.when(F.col("v") > 4, 0.0).otherwise(0.9)
    got = {r.i: r.y for r in S.recurrence(forget(seq), ["k"], "y", gain, F.col("v"), block=block).collect()}
    for g in by_key(data).values():
        y = 0.0
        for i, v in g:
            y = (0.0 if v > 4 else 0.9) * y + v
            assert got[i] == pytest.approx(y)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5)), min_size=1, max_size=25), st.integers(1, 5))
def test_running_sum_ends_at_the_total(frame, items, size):
    df = frame([(k, v, n) for n, (k, v) in enumerate(items)], "k string, v int, n int")
    out = S.running(forget(S.sequence(df, ["k"], ["n"])), ["k"], {"s": ("sum", F.col("v"))}, size=size)
    last = {r.k: r.s for r in out.groupBy("k").agg(F.max_by("s", "pos").alias("s")).collect()}
    want = {}
    for k, v in items:
        want[k] = want.get(k, 0) + v
    assert last == want


def test_attach_joins_null_keys(frame):
    left, right = frame([(None, 1), ("a", 2)], "k string, x int"), frame([(None, 5), ("a", 6)], "k string, y int")
    assert {(r.k, r.x, r.y) for r in S.attach(left, right, ["k"]).collect()} == {(None, 1, 5), ("a", 2, 6)}
