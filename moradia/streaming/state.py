"""The stateful operators as streams. Batch results are the truth; a stream gives the same rows as data arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def breaker_stream(events: DataFrame, most: int = 8, pause: int = 300) -> DataFrame:
    """Circuit breaker over a stream of ``dominio, ts, seq, ok, falha``: ``dominio, seq, seguidas, aberto_ate`` for every event.

    Events of a domain must arrive in order of ``ts, seq`` from one micro-batch to the next; within one they are sorted.
    The state of a domain is one count.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for r in rows.itertuples():
            n = 0 if r.ok else n + bool(r.falha)
            until = r.ts + pd.Timedelta(seconds=pause) if r.falha and not r.ok and n >= most else None
            out.append((key[0], r.seq, n, until))
        state.update((n,))
        yield pd.DataFrame(out, columns=["dominio", "seq", "seguidas", "aberto_ate"])

    return events.groupBy("dominio").applyInPandasWithState(step, "dominio string, seq long, seguidas long, aberto_ate timestamp", "n long", "append", GroupStateTimeout.NoTimeout)


def event_rate(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; rows later than ``late`` are left out once the watermark has passed."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def upsert_batches(events: DataFrame, apply, checkpoint: str):  # noqa: ANN001, ANN201
    """Write a stream by ``apply(batch, number)``; the checkpoint makes a lost micro-batch run again under the same number."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
