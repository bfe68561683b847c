"""Held events, small: what opens, what expires, what is lost, what is left in state."""

import pytest

from runwarden.streaming import hold

S = 1_000_000_000
SOURCE = "cid string, seq long, t_ns long, what string"


@pytest.fixture
def stream(spark, tmp_path):
    """Each part is one file and so one batch."""
    parts = [
        [("a", 1, 1, "event"), ("b", 2, 2, "event"), ("c", 3, 3, "event"), ("a", 4, 4, "event")],
        [("a", -1, 40, "open"), ("a", 5, 35, "event"), ("b", 6, 40, "event")],
        [("b", 7, 50, "event"), ("c", 8, 51, "event"), ("c", 9, 52, "event")],
        [("d", 10, 90, "event"), ("d", 11, 91, "event"), ("d", 12, 92, "event"), ("b", -1, 92, "open"), ("a", 13, 92, "event")],
    ]

    def run(make, name):
        src, got = f"{tmp_path}/{name}", None
        for part in parts:
            spark.createDataFrame([(c, s, t * S, w) for c, s, t, w in part], SOURCE).coalesce(1).write.mode("append").parquet(src)
            got = hold.run(make(spark.readStream.schema(SOURCE).parquet(src)), f"{src}-out", f"{src}-state")
        return sorted(((r.cid, r.seq, r.outcome, r.n) for r in got.collect()), key=str), sorted((r.cid, r.seq) for r in hold.still_held(spark, f"{src}-state").collect())

    return run


def test_bindings(stream):
    got, left = stream(lambda s: hold.until_bound(s, 30 * S), "bound")
    released = [("a", 1, "released", 1), ("a", 13, "released", 1), ("a", 4, "released", 1), ("a", 5, "released", 1)]
    # The clock is 40 s after the second part: what began to wait until 10 s fails then. b's later event waits anew, and goes when its binding comes.
    assert got == sorted([*released, ("b", 2, "unknown_container", 2), ("c", 3, "unknown_container", 1), ("b", 7, "released", 1), ("c", 8, "unbound_events", 2)], key=str)
    assert left == [("d", 10), ("d", 11), ("d", 12)]


def test_specifications_and_cap(stream):
    got, left = stream(lambda s: hold.until_envelope(s, 30 * S, 2), "spec")
    released = [("a", 1, "released", 1), ("a", 13, "released", 1), ("a", 4, "released", 1), ("a", 5, "released", 1), ("b", 6, "released", 1), ("b", 7, "released", 1)]
    # Told once, and held on; the oldest beyond two are lost and counted.
    assert got == sorted([*released, ("b", 2, "no_envelope", 2), ("c", 3, "no_envelope", 1), ("b", None, "lost", 1), ("c", None, "lost", 1), ("d", None, "lost", 1)], key=str)
    assert left == [("c", 8), ("c", 9), ("d", 11), ("d", 12)]
