"""Operators over ordered events: greedy starts, behaviour windows, chains, hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def in_order(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows dealt by keys, and sorted by keys and order within a partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def greedy_starts(rows: DataFrame, keys: list[str], time: str, order: str, gap: int) -> DataFrame:
    """Rows kept when a row follows the last kept one of its key by `gap` or more (the first is always kept).

    Sorted rows stream by; the state is the key's last kept time, and within a batch a search jumps to the next kept row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key, t = b.column(0).to_pylist(), b.column(1).to_numpy()
            cut = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            kept = []
            for s, e in zip(cut, cut[1:], strict=False):
                i = s + (int(np.searchsorted(t[s:e], last + gap)) if key[s] == now else 0)
                while i < e:
                    kept.append(i)
                    now, last = key[i], int(t[i])
                    i += int(np.searchsorted(t[i:e], last + gap))
                now = key[s]
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(kept, pa.int64()))], names=["kept"])

    # Keys are compared as one text, in which nulls differ from empty strings.
    own = F.to_json(F.struct(*keys)).alias("own_key")
    narrow = rows.select(own, F.col(time).cast("long").alias("at"), F.col(order).cast("long").alias("kept"))
    kept = in_order(narrow, ["own_key"], "at", "kept").mapInArrow(run, "kept long")
    return rows.join(kept, rows[order] == kept["kept"], "left_semi")


CHAINED = "log long, place long, k long, prev string, hash string"


def chained(digests: DataFrame, k: int = 0, head: str = "0" * 64) -> DataFrame:
    """(log, place, k, prev, hash) of digests (log, place, c) per log by place: k counts on from `k`, hash = sha256(previous hash, c), the first after `head`.

    A chain is one task's, as each hash needs the one before; its state is that hash. c is hexadecimal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, h = None, k, bytes.fromhex(head)
        for b in batches:
            ks, hs = [], [h.hex()]
            prev = []
            for log, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if log != now:
                    now, n, h = log, k, bytes.fromhex(head)
                prev.append(h.hex())
                n, h = n + 1, hashlib.sha256(h + bytes.fromhex(c)).digest()
                ks.append(n)
                hs.append(h.hex())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ks, pa.int64()), pa.array(prev, pa.string()), pa.array(hs[1:], pa.string())], names=["log", "place", "k", "prev", "hash"])

    return in_order(digests.select("log", "place", "c"), ["log"], "place").mapInArrow(run, CHAINED)


def chains(rows: DataFrame, window_s: float = 60.0) -> DataFrame:
    """(id, chain): incident chains. A row (container_id, id, t_s, pid, ppid) joins, in order of arrival (id), the first open chain of its container
    that holds its pid or ppid and was last seen at most window_s ago or ahead; else it opens one. Null pids never match.

    State is one container's chains, found by the pids that they hold; a row looks only at those that hold its own. Times may come in any
    disorder, so chains of a container are kept to its end. Containers are dealt to tasks, and rows are streamed in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, holding = None, {}, {}
        for pdf in batches:
            out = []
            for c, i, t, pid, ppid in zip(pdf["container_id"], pdf["id"], pdf["t_s"], pdf["pid"], pdf["ppid"], strict=True):
                if c != now:
                    now, last, holding = c, {}, {}
                pid, ppid = (None if pd.isna(x) else int(x) for x in (pid, ppid))
                chain = min((x for p in {pid, ppid} - {None} for x in holding.get(p, ()) if abs(t - last[x]) <= window_s), default=i)
                last[chain] = max(last.get(chain, t), t)
                if pid is not None and chain not in holding.setdefault(pid, []):
                    holding[pid].append(chain)
                out.append((i, chain))
            yield pd.DataFrame(out, columns=["id", "chain"])

    return in_order(rows.select("container_id", "id", "t_s", "pid", "ppid"), ["container_id"], "id").mapInPandas(run, "id long, chain long")
