"""Behaviour windows: per process, opened by its first counted event, closed 30 s later or at 200 events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graph import written
from .ranks import running

WINDOW_NS, WINDOW_EVENTS, MIN_AGE_NS = 30_000_000_000, 200, 10_000_000_000
COUNTS = ("exec", "write", "load", "cap", "connect", "new_files", "dirs_written", "distinct_exes", "distinct_daddrs", "distinct_dports")


def process_rows(events: DataFrame) -> DataFrame:
    """Events re-keyed by the process that owns them: an exec is a birth of (cid, pid) and a child of (cid, ppid).

    events: cid, pid, ppid, seq, t_ns, kind, path, exe, daddr, dport, new_file, counted (it conformed and used something).
    """
    own = events.select("cid", "pid", "seq", "t_ns", F.when(F.col("kind") == "exec", "birth").otherwise(F.col("kind")).alias("what"), "path", "exe", "daddr", "dport", "new_file", "counted")
    child = events.where("kind = 'exec' and counted").select("cid", F.col("ppid").alias("pid"), "seq", "t_ns", F.lit("child").alias("what"), "path", "exe", "daddr", "dport", "new_file", "counted")
    return own.unionByName(child)


def successors(counted: DataFrame, window_ns: int, most: int) -> DataFrame:
    """counted (epoch, j, t) plus by_time and next: the first row of the epoch that is `window_ns` or more later, and where a window that begins here is followed by the next.

    Times do not fall with j, so the first later row's number is one more than the rows before that time, which are counted in one order of rows and of asked times.
    """
    rows = counted.select("epoch", F.col("t").alias("at"), F.lit(1).alias("kind"), "j", F.lit(1).alias("one"))
    asked = counted.select("epoch", (F.col("t") + window_ns).alias("at"), F.lit(0).alias("kind"), "j", F.lit(0).alias("one"))
    told = running(rows.unionByName(asked), ["epoch"], ["at", "kind", "j"], {"before": F.col("one")}).where("kind = 0")
    return counted.join(told.select("epoch", "j", (F.col("before") + 1).alias("by_time")), ["epoch", "j"]).withColumn("next", F.least(F.col("j") + most, F.col("by_time")))


def starts(jumps: DataFrame) -> DataFrame:
    """(epoch, j): where windows begin, from row 1 on along jumps (epoch, j, next), found by doubling: what is reached in 2^k steps is joined with jumps of 2^k, whose own jumps then are twice as long."""
    last = jumps.groupBy("epoch").agg(F.max("j").alias("last"))
    step = written(jumps.join(last, "epoch").where("next <= last").select("epoch", "j", "next"), "jumps")
    found = written(jumps.where("j = 1").select("epoch", "j"), "starts")
    while not step.isEmpty():
        more = found.join(step, ["epoch", "j"]).select("epoch", F.col("next").alias("j"))
        found = written(found.unionByName(more), "starts")
        far = step.select("epoch", F.col("j").alias("next"), F.col("next").alias("far"))
        step = written(step.join(far, ["epoch", "next"]).select("epoch", "j", F.col("far").alias("next")), "jumps")
    return found


def behaviour_windows(events: DataFrame, window_ns: int = WINDOW_NS, most: int = WINDOW_EVENTS, min_age_ns: int = MIN_AGE_NS) -> DataFrame:
    """One row per closed window: built-in aggregates only, and no task has to hold a process.

    A process's rows, in order of arrival, fall into epochs, each from an exec or exit to the next. A window begins at the first counted row that the one before has not, and has those less than
    `window_ns` later, `most` at most. It closes with its `most`-th row, or once the stream has passed its end; where an exec, an exit or the end of the stream comes first it is dropped, as are
    windows of processes younger than `min_age_ns`. A process that is not seen to begin is as old as its first own row. A time that runs back within a process counts as the greatest before it.
    """
    last_ns = events.agg(F.max("t_ns").alias("last_ns"))
    rows = process_rows(events).where("pid is not null").withColumn("process", F.to_json(F.struct("cid", "pid"))).withColumn("rank", (F.col("what") == "child").cast("int"))
    edge, own = F.col("what").isin("birth", "exit"), ~F.col("what").isin("birth", "exit", "child")
    rows = running(rows, ["process"], ["seq", "rank"], {"nth_epoch": edge.cast("int")}, {"t": F.col("t_ns")})
    rows = written(rows.withColumn("epoch", F.concat_ws("#", "process", "nth_epoch")), "epochs")
    place = F.struct("seq", "rank")
    born = F.min(F.when(F.col("what") == "birth", F.struct(place.alias("place"), "t")))
    seen = F.min(F.when(own, F.struct(place.alias("place"), "t")))
    epochs = rows.groupBy("process", "nth_epoch", "epoch").agg(F.coalesce(born, seen).alias("first"), F.min("t").alias("begins"))
    after = epochs.select("process", (F.col("nth_epoch") - 1).alias("nth_epoch"), F.col("begins").alias("ended"))
    epochs = epochs.join(after, ["process", "nth_epoch"], "left").crossJoin(F.broadcast(last_ns))
    epochs = written(epochs.select("epoch", "first", F.coalesce("ended", "last_ns").alias("ends")).where("first is not null"), "epoch-ends")
    counted = rows.where(~edge & F.col("counted")).join(epochs.select("epoch", F.col("first.place").alias("from_")), "epoch").where(place >= F.col("from_"))
    counted = written(running(counted.drop("from_"), ["epoch"], ["seq", "rank"], {"j": F.lit(1)}), "counted")
    jumps = written(successors(counted.select("epoch", "j", "t"), window_ns, most), "successors")
    begun = starts(jumps.select("epoch", "j", "next")).join(jumps.select("epoch", "j", "by_time"), ["epoch", "j"]).select("epoch", "j", "by_time", F.col("j").alias("start"))
    marked = counted.join(begun, ["epoch", "j"], "left")
    marked = running(marked, ["epoch"], ["j"], maxes={"own_start": F.col("start")})

    is_ = lambda w: F.col("what") == w
    kinds = ("exec", "child"), ("write", "write"), ("load", "load"), ("cap", "cap"), ("connect", "connect")
    different = lambda condition, value: F.size(F.collect_set(F.when(condition, value)))  # noqa: E731 - a window has `most` rows
    folder = F.coalesce(F.nullif(F.regexp_replace("path", "/[^/]*$", ""), F.lit("")), F.lit("/"))
    w = marked.groupBy("epoch", "own_start", "cid", "pid").agg(
        F.min("t").alias("start_ns"), F.max("t").alias("last_t"), F.count("*").alias("events"), F.max("by_time").alias("by_time"),
        *(F.count_if(is_(k)).alias(n) for n, k in kinds),
        different(is_("write") & F.col("new_file"), F.col("path")).alias("new_files"), different(is_("write"), folder).alias("dirs_written"), different(is_("child"), F.col("path")).alias("distinct_exes"),
        different(is_("connect"), F.col("daddr")).alias("distinct_daddrs"), different(is_("connect"), F.col("dport")).alias("distinct_dports"),
    )
    w = w.join(epochs.select("epoch", F.col("first.t").alias("first_t"), "ends"), "epoch")
    by_count = F.col("events") >= most
    w = w.withColumn("closed_by", F.when(by_count, "count").when(F.col("ends") >= F.col("start_ns") + window_ns, "time")).where("closed_by is not null")
    w = w.withColumn("end_ns", F.when(by_count, F.col("last_t")).otherwise(F.col("start_ns") + window_ns)).withColumn("age_ns", F.col("end_ns") - F.col("first_t")).where(F.col("age_ns") >= min_age_ns)
    span = F.when(by_count, F.greatest((F.col("last_t") - F.col("start_ns")) / 1e9, F.lit(1.0))).otherwise(F.lit(window_ns / 1e9))
    features = [x for c in COUNTS for x in (F.col(c).cast("double").alias(c), F.round(F.col(c) / span, 6).alias(f"{c}_per_s"))]
    return w.select("cid", "pid", "start_ns", "end_ns", "events", "closed_by", "age_ns", *features)
